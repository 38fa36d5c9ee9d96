"""Byte-level BPE encoding and decoding; the vocabulary is a parameter and nothing is trained.

A text is cut by a pattern, and each match is merged by itself: a segment tree over the match's byte positions holds
the rank of the pair that starts at each live position, with the position as tie-break, so its root is the leftmost
pair of least rank. Merging it unlinks the right part and updates the three positions whose pairs changed, each along
one path to the root. Matches up to 64 bytes are merged many at a time, one array per tree; longer ones one by one.
A match that is itself a token becomes that token at once. Merged matches are remembered up to a bounded number.

Nulls: a null text is empty and has no ids. Empty and very long texts are encoded like any other. Repeated rows and
ids are each returned; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ship

#: Remembered matches for each Python worker.
REMEMBER = 200_000
#: Bytes of text whose matches are merged together.
TOGETHER = 1 << 19
WIDEST = 64
_NONE = np.int64(1) << 60


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token, blank, rank), by rank."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must run from 0 without gaps")
    return [found[k] for k in range(len(found))]


class Codec:
    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.rank = tokens, {t: k for k, t in enumerate(tokens)}
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("a byte-level vocabulary needs all 256 bytes")
        self.find = regex.compile(pattern).findall
        self.longest = max(map(len, tokens))
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for k, t in enumerate(tokens):
            for cut in range(1, len(t)):
                left, right = self.rank.get(t[:cut]), self.rank.get(t[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = k
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.known: dict[str, bytes] = {}

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, or _NONE."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], _NONE)

    def merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids, packed, of pieces of at most `width` bytes each; width is a power of two."""
        k, shift = len(pieces), width.bit_length() - 1
        sizes = np.fromiter(map(len, pieces), np.int64, k)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(k, width)
        col = np.arange(width)
        tok = self.of_byte[raw]
        live = col < sizes[:, None]
        after = np.where(col + 1 < sizes[:, None], col + 1, width)  # width: none
        before = np.tile(col - 1, (k, 1))  # -1: none
        tree = np.full((k, 2 * width), _NONE)
        first = self.pair(tok[:, :-1], tok[:, 1:])
        tree[:, width:-1] = np.where((first < _NONE) & live[:, 1:], first << shift | col[:-1], _NONE)
        level = width // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        act = np.flatnonzero(tree[:, 1] < _NONE)
        while len(act):
            root = tree[act, 1]
            pos, new = root & (width - 1), root >> shift
            gone = after[act, pos]
            nxt = after[act, gone]
            prev = before[act, pos]
            tok[act, pos], after[act, pos], live[act, gone] = new, nxt, False
            tree[act, width + gone] = _NONE
            has = nxt < width
            before[act[has], nxt[has]] = pos[has]
            right = np.where(has, self.pair(new, tok[act, np.minimum(nxt, width - 1)]), _NONE)
            tree[act, width + pos] = np.where(right < _NONE, right << shift | pos, _NONE)
            has = prev >= 0
            left = self.pair(tok[act[has], prev[has]], new[has])
            tree[act[has], width + prev[has]] = np.where(left < _NONE, left << shift | prev[has], _NONE)
            touched = [(act, width + gone), (act, width + pos), (act[has], width + prev[has])]
            for _ in range(shift):
                touched = [(a, x >> 1) for a, x in touched]
                for a, x in touched:
                    tree[a, x] = np.minimum(tree[a, 2 * x], tree[a, 2 * x + 1])
            act = act[tree[act, 1] < _NONE]
        ids = tok[live].astype("<u4").tobytes()
        ends = (4 * np.cumsum(live.sum(1))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merge_one(self, piece: bytes) -> bytes:
        """Ids, packed, of a piece of any length."""
        n, get, longest, none = len(piece), self.rank.get, self.longest, int(_NONE)
        width = 1 << (n - 1).bit_length()
        shift = width.bit_length() - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def leaf(at: int) -> int:
            if at < 0 or after[at] >= n:
                return none
            end = after[after[at]]
            rank = get(piece[at:end]) if end - at <= longest else None
            return none if rank is None else rank << shift | at

        tree = [none] * width + [leaf(at) for at in range(n)] + [none] * (width - n)
        for x in range(width - 1, 0, -1):
            tree[x] = min(tree[2 * x], tree[2 * x + 1])

        def put(at: int, value: int) -> None:
            x = at + width
            tree[x] = value
            while x > 1:
                x >>= 1
                least = min(tree[2 * x], tree[2 * x + 1])
                if tree[x] == least:
                    return
                tree[x] = least

        while tree[1] < none:
            pos = tree[1] & (width - 1)
            gone = after[pos]
            after[pos] = after[gone]
            if after[pos] < n:
                before[after[pos]] = pos
            put(gone, none)
            put(pos, leaf(pos))
            if before[pos] >= 0:
                put(before[pos], leaf(before[pos]))
        out, at = [], 0
        while at < n:
            out.append(self.rank[piece[at : after[at]]])
            at = after[at]
        return np.array(out, "<u4").tobytes()

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Packed ids of pieces that are not remembered; remembers them while there is room."""
        out: dict[str, bytes] = {}
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            whole = self.rank.get(raw)
            if whole is not None:
                out[p] = whole.to_bytes(4, "little")
            elif len(raw) > WIDEST:
                out[p] = self.merge_one(raw)
            else:
                by_width.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((p, raw))
        for width, own in by_width.items():
            for at in range(0, len(own), 20_000):
                some = own[at : at + 20_000]
                out.update(zip((p for p, _ in some), self.merge_many([raw for _, raw in some], width), strict=True))
        room = REMEMBER - len(self.known)
        if room > 0:
            self.known.update(x for x in list(out.items())[:room] if len(x[0]) <= WIDEST)
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Packed little-endian 32-bit ids of each text."""
        out, at = [], 0
        while at < len(texts):
            cut, size = [], 0
            while at < len(texts) and (not cut or size < TOGETHER):
                size += len(texts[at] or "")
                cut.append(self.find(texts[at] or ""))
                at += 1
            new = set().union(*cut).difference(self.known)
            if not new:
                got = self.known.__getitem__
            else:
                fresh, known = self.learn(new), self.known
                got = lambda p: known.get(p) or fresh[p]  # noqa: E731, B023
            out += [b"".join(map(got, pieces)) for pieces in cut]
        return out

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


_codecs: dict[tuple, tuple] = {}


def _codec(held, pattern: str) -> Codec:
    """This worker's codec for a broadcast vocabulary, kept from task to task."""
    key = id(held), pattern
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = held, Codec(held.value, pattern)
    return _codecs[key][1]


def encode(docs: DataFrame, tokens: list[bytes], pattern: str) -> DataFrame:
    """(doc_id, ids) of every row; ids are packed little-endian unsigned 32-bit integers. The vocabulary is broadcast: its size is fixed."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(tokens)

    def run(batches):
        codec = _codec(held, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codec.encode_all(part.column(1).to_pylist()), pa.binary())], ["doc_id", "ids"])

    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, src.select("doc_id", F.lit(b"").alias("ids")).schema)


def decode(encoded: DataFrame, tokens: list[bytes]) -> DataFrame:
    """(doc_id, ids) -> (doc_id, ids, bytes): what the ids stand for."""
    spark = encoded.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(tokens)

    def run(batches):
        tok = held.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                raw = [b"".join(map(tok.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(raw, pa.binary())], ["doc_id", "ids", "bytes"])

    src = encoded.select("doc_id", "ids")
    return src.mapInArrow(run, src.select("doc_id", "ids", F.lit(b"").alias("bytes")).schema)


def round_trip(docs: DataFrame, tokens: list[bytes], pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): encode() and decode() in one pass, so that each task has one
    Python worker and the decoded bytes never leave it."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(tokens)
    names = ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]

    def run(batches):
        codec = _codec(held, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                ids = codec.encode_all(part.column(1).to_pylist())
                own = pa.array([hashlib.sha256(x).hexdigest() for x in ids])
                back = pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), own, back], names)

    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kinds = src.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit(b"").alias("ids"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256"))
    return src.mapInArrow(run, kinds.schema)


def digests(docs: DataFrame, tokens: list[bytes], pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the round trip of every text, as digests."""
    return round_trip(docs, tokens, pattern).drop("ids")
