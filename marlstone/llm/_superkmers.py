"""Finding windows that repeat anywhere in a corpus, without sending each window.

A document is a sequence of units (bytes or words); a window is `width` consecutive units. The minimiser of a window is
the least hash of its runs of `k` units. Consecutive windows that share one travel as one packed string, a super-k-mer
(Li et al., "MSPKmerCounter", 2015). Equal windows have equal minimisers, so they meet in one bucket.

Five steps over batches of documents, in one plan whose shuffle of the texts is shared:
1. a batch sends each of its minimisers once to the minimiser's bucket;
2. a bucket tells the batches which of them occur elsewhere too;
3. a batch sends its super-k-mers with such minimisers, equal ones once, as of equal windows all but the first can be
   told at once;
4. a bucket compares what it got by content, and tells the batches which windows came earlier;
5. a batch joins the spans of its documents.

A minimiser with very many different super-k-mers would fill one bucket. Step 2 sees that; such windows are dealt by the
hash of the whole window instead, the widest minimiser, of which equal ones are again sent once per batch.

Rows equal in id and text are one document. A null text is empty. A null id comes before all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import parts, row_hash, ship

U = np.uint64
NO_ID = -(1 << 63)
#: Different super-k-mers of one minimiser, beyond one for each batch, from which windows are dealt one by one.
HOT = 2000
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240501).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xA0761D6478BD642F)
    return x ^ (x >> U(32))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = U(pow(base, len(out), 1 << 64))
        out = np.concatenate([out, out * step])
    return out[:n]


_INVERSE = pow(_BASE, -1, 1 << 64)
_pow: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _pow or len(_pow[base]) < n:
        _pow[base] = _powers(max(n, 2 * CHUNK), base)
    return _pow[base][:n]


class Spans:
    """Hashes of any span of a byte array, from running sums of a polynomial modulo 2 ** 64."""

    def __init__(self, raw: np.ndarray):
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_TABLE[raw] * _power(_BASE, len(raw)), out=self.sums[1:])
        self.inverse = _power(_INVERSE, len(raw) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def run_hashes(x: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k units, from unit hashes, by doubling."""
    out, at, done, size = None, 0, x, 1
    left, base = k, _BASE
    while left:
        if left & 1:
            out = done[: len(x) - k + 1] if out is None else out[: len(x) - k + 1] * U(pow(base, size, 1 << 64)) + done[at : at + len(x) - k + 1]
            at += size
        left >>= 1
        if left:
            done = done[: len(done) - size] * U(pow(base, size, 1 << 64)) + done[size:]
            size *= 2
    return mix(out)


def slide(x: np.ndarray, w: int, pick: Callable) -> np.ndarray:
    """pick (minimum or maximum) over each w consecutive values."""
    size, done = 1, x
    while size * 2 <= w:
        done = pick(done[: len(done) - size], done[size:])
        size *= 2
    rest = w - size
    return pick(done[: len(done) - rest], done[rest:]) if rest else done


@dataclass
class Runs:
    """Super-k-mers of concatenated documents, in units: first window, number of windows, minimiser, document, and
    whether the minimiser occurs twice in it."""

    start: np.ndarray
    count: np.ndarray
    least: np.ndarray
    doc: np.ndarray
    twice: np.ndarray


def super_kmers(units: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int, k: int) -> Runs:
    """units: hashes of all documents' units; begin, end: each document's part of them."""
    long = np.flatnonzero(end - begin >= width)
    empty = np.zeros(0, np.int64)
    if not len(long):
        return Runs(empty, empty, np.zeros(0, np.uint64), empty, np.zeros(0, bool))
    w = width - k + 1
    h = run_hashes(units, k)
    m = slide(h, w, np.minimum)
    edge = np.zeros(len(m) + 1, np.int32)
    np.add.at(edge, begin[long], 1)
    np.add.at(edge, end[long] - width + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    new = np.empty(len(m), bool)
    new[0] = True
    np.not_equal(m[1:], m[:-1], out=new[1:])
    new[begin[long]] = True
    start = np.flatnonzero(new & valid)
    doc = long[np.searchsorted(begin[long], start, "right") - 1]
    count = np.minimum(np.append(start[1:], len(m)), end[doc] - width + 1) - start
    least = m[start]
    # a run hash is chosen where some valid window has it as least; chosen twice in a row nearby: a repeat inside
    floor = np.where(valid, m, U(0))
    high = slide(np.concatenate([np.zeros(w - 1, np.uint64), floor, np.zeros(w - 1, np.uint64)]), w, np.maximum)
    chosen = np.flatnonzero(high[: len(h)] == h)
    near = (h[chosen[1:]] == h[chosen[:-1]]) & (np.diff(chosen) <= width)
    twice = np.isin(least, np.unique(h[chosen[1:][near]])) if near.any() else np.zeros(len(start), bool)
    return Runs(start, count, least, doc, twice)


@dataclass
class Piece:
    """Documents of one chunk: their rows in the batch, and what the kind of unit needs."""

    rows: np.ndarray
    units: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray  # byte at which each unit starts
    last: np.ndarray  # byte after each unit
    raw: bytes
    spans: Spans


def chunks(texts: pa.Array, cut_units: Callable) -> Iterator[Piece]:
    """Concatenate documents up to CHUNK bytes; a longer one stands alone."""
    at, n = 0, len(texts)
    while at < n:
        own, size, lo = [], 0, at
        while at < n and (not own or size < CHUNK):
            own.append(texts[at].as_py() or b"")
            size += len(own[-1])
            at += 1
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        raw = b"".join(own)
        if not raw:
            continue
        x = np.frombuffer(raw, np.uint8)
        ends = np.cumsum(sizes)
        spans = Spans(x)
        units, first, last, begin, end = cut_units(x, spans, ends - sizes, ends)
        yield Piece(np.arange(lo, at), units, begin, end, first, last, raw, spans)


def by_byte(x, spans, lo, hi):
    return _TABLE[x], np.arange(len(x)), np.arange(1, len(x) + 1), lo, hi


_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(x: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; a document's start (lo) also starts a word."""
    blank = _BLANK[x]
    before = np.ones(len(x), bool)
    before[1:] = blank[:-1]
    before[lo[lo < len(x)]] = True
    after = np.ones(len(x), bool)
    after[:-1] = before[1:] | blank[1:]
    return np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1


def by_word(x, spans, lo, hi):
    first, last = word_bounds(x, lo)
    return spans(first, last), first, last, np.searchsorted(first, lo), np.searchsorted(first, hi)


def _pack(a: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


def _join(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h * U(0x9FB21C651E98DF25) >> U(33)) % U(n)).astype(np.int32)


SENT = "bucket int, batch int, hashes binary, counts binary"
TOLD = "batch int, hashes binary, hot binary"
PACKED = "bucket int, batch int, told boolean, key binary, id binary, rid binary, pos binary, windows binary, twice binary, size binary, data binary"
FOUND = "batch int, id binary, rid binary, first binary, last binary"


@dataclass
class Job:
    """width and k in units; join: content of units first..last as bytes; same_doc: whether a window's earlier copy in
    its own document counts; resolve: (contents, windows, order) -> which windows came earlier, per content."""

    width: int
    k: int
    cut_units: Callable
    content: Callable
    same_doc: bool
    resolve: Callable
    finish: Callable
    out: str


def _send(job: Job, batch: int, table: pa.Table, n: int) -> pa.Table:
    keys, contents, twice = [], [], []
    for p in chunks(table["data"].combine_chunks(), job.cut_units):
        r = super_kmers(p.units, p.begin, p.end, job.width, job.k)
        keys.append(r.least)
        contents.append(p.spans(p.first[r.start], p.last[r.start + r.count + job.width - 2]))
        twice.append(r.twice)
    h = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    if not len(h):
        return pa.Table.from_pylist([], _schema(SENT))
    c = np.concatenate(contents)
    own, at, many = np.unique(h, return_inverse=True, return_counts=True)
    many = many > 1
    many[at[np.concatenate(twice)]] = True
    _, one = np.unique(mix(h * U(3) + c), return_index=True)
    different = np.bincount(at[one], minlength=len(own))
    counts = np.minimum(different, 0x7FFF).astype(np.uint16) | (many.astype(np.uint16) << 15)
    b = _bucket(own, n)
    order = np.argsort(b, kind="stable")
    cuts = np.flatnonzero(np.diff(b[order])) + 1
    rows = np.split(order, cuts)
    return pa.table([[int(b[x[0]]) for x in rows], [batch] * len(rows), [_pack(own[x], "<u8") for x in rows], [_pack(counts[x], "<u2") for x in rows]], schema=_schema(SENT))


def _tell(table: pa.Table, hot: int) -> pa.Table:
    batch = table["batch"].to_numpy()
    blobs = table["hashes"].to_pylist()
    h = np.frombuffer(b"".join(blobs), "<u8")
    who = np.repeat(batch, [len(x) // 8 for x in blobs])
    counts = _join(table["counts"], "<u2")
    own, at, n = np.unique(h, return_inverse=True, return_counts=True)
    again = n > 1
    again[at[counts >> 15 == 1]] = True
    crowd = np.bincount(at, (counts & 0x7FFF).astype(float) - 1, len(own)) > hot
    sel = np.flatnonzero(again[at])
    sel = sel[np.argsort(who[sel], kind="stable")]
    rows = np.split(sel, np.flatnonzero(np.diff(who[sel])) + 1) if len(sel) else []
    return pa.table([[int(who[x[0]]) for x in rows], [_pack(h[x], "<u8") for x in rows], [_pack(crowd[at[x]], "u1") for x in rows]], schema=_schema(TOLD))


def _superstrings(job: Job, batch: int, table: pa.Table, told: pa.Table, n: int) -> pa.Table:
    known = _join(told["hashes"], "<u8")
    if not len(known):
        return pa.Table.from_pylist([], _schema(PACKED))
    hot = _join(told["hot"], "u1").astype(bool)
    order = np.argsort(known)
    known, hot = known[order], hot[order]
    ids = pa.compute.fill_null(table["id"], NO_ID).to_numpy()
    rids = table["rid"].to_numpy()
    cols: dict[str, list] = {c: [] for c in ("key", "row", "pos", "windows", "twice")}
    data: list[bytes] = []
    for p in chunks(table["data"].combine_chunks(), job.cut_units):
        r = super_kmers(p.units, p.begin, p.end, job.width, job.k)
        at = np.minimum(np.searchsorted(known, r.least), len(known) - 1)
        got = known[at] == r.least
        cold = np.flatnonzero(got & ~hot[at])
        warm = np.flatnonzero(got & hot[at])
        each = np.repeat(warm, r.count[warm])  # one row for each window of a hot minimiser
        step = np.arange(len(each)) - np.repeat(np.cumsum(r.count[warm]) - r.count[warm], r.count[warm])
        start = np.concatenate([r.start[cold], r.start[each] + step])
        count = np.concatenate([r.count[cold], np.ones(len(each), np.int64)])
        doc = np.concatenate([r.doc[cold], r.doc[each]])
        a, b = p.first[start], p.last[start + count + job.width - 2]
        key = np.concatenate([r.least[cold], p.spans(a[len(cold) :], b[len(cold) :]) if len(each) else np.zeros(0, np.uint64)])
        if len(each) and job.content is not None:  # blanks between words must not show in the key
            key[len(cold) :] = run_hashes(p.units, job.width)[start[len(cold) :]]
        cols["key"].append(key)
        cols["row"].append(p.rows[doc])
        cols["pos"].append(start - p.begin[doc])
        cols["windows"].append(count)
        cols["twice"].append(np.concatenate([r.twice[cold], np.zeros(len(each), bool)]))
        if job.content is None:
            data += [p.raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        else:
            data += [b" ".join(p.raw[i:j].split()) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    c = {k: np.concatenate(v) for k, v in cols.items()}
    row = c["row"]
    direct, held = first_of(data, ids[row], rids[row], c["pos"], job.same_doc)
    out = [_rows(c, ids[row], rids[row], data, x, int(b), batch, False) for b, x in _split(held, _bucket(c["key"], n))]
    if len(direct):
        out.append(_rows(c, ids[row], rids[row], None, direct, batch % n, batch, True))
    return pa.table([list(x) for x in zip(*out, strict=True)], schema=_schema(PACKED)) if out else pa.Table.from_pylist([], _schema(PACKED))


def _split(sel: np.ndarray, by: np.ndarray):
    if not len(sel):
        return
    sel = sel[np.argsort(by[sel], kind="stable")]
    for x in np.split(sel, np.flatnonzero(np.diff(by[sel])) + 1):
        yield by[x[0]], x


def _rows(c, ids, rids, data, x, bucket, batch, told):
    own = [] if data is None else [data[i] for i in x.tolist()]
    return (
        bucket, batch, told, _pack(c["key"][x], "<u8"), _pack(ids[x], "<i8"), _pack(rids[x], "<i8"), _pack(c["pos"][x], "<i8"), _pack(c["windows"][x], "<i4"),
        _pack(c["twice"][x], "u1"), _pack(np.fromiter(map(len, own), np.int64, len(own)), "<i4"), b"".join(own),
    )


def first_of(data: list[bytes], ids: np.ndarray, rids: np.ndarray, pos: np.ndarray, same_doc: bool) -> tuple[np.ndarray, np.ndarray]:
    """(later, first): of rows with equal content, those that another one comes before, and the others.

    Without same_doc only a smaller id comes before, and all rows of the smallest id are first.
    """
    code: dict[bytes, int] = {}
    group = np.fromiter((code.setdefault(d, len(code)) for d in data), np.int64, len(data))
    order = np.lexsort((pos, rids, ids, group))
    g, i, r, p = group[order], ids[order], rids[order], pos[order]
    lead = np.maximum.accumulate(np.where(np.append(True, g[1:] != g[:-1])[: len(g)], np.arange(len(g)), 0)) if len(g) else order
    first = i == i[lead]
    if same_doc:  # rows equal in id, text and place are one
        first &= (r == r[lead]) & (p == p[lead])
    return order[~first], order[first]


@dataclass
class Held:
    """Super-k-mers of one bucket: content, minimiser, and where they stand."""

    data: list[bytes]
    key: np.ndarray
    id: np.ndarray
    rid: np.ndarray
    pos: np.ndarray
    windows: np.ndarray
    twice: np.ndarray
    batch: np.ndarray

    def take(self, x: np.ndarray) -> Held:
        return Held([self.data[i] for i in x.tolist()], self.key[x], self.id[x], self.rid[x], self.pos[x], self.windows[x], self.twice[x], self.batch[x])


def _settle(job: Job, table: pa.Table) -> pa.Table:
    told = table.filter(table["told"])
    rest = table.filter(pa.compute.invert(table["told"]))
    found = []
    sizes = np.array([len(x) // 8 for x in told["id"].to_pylist()], np.int64)
    pos = _join(told["pos"], "<i8")
    found.append((np.repeat(told["batch"].to_numpy(), sizes), _join(told["id"], "<i8"), _join(told["rid"], "<i8"), pos, pos + _join(told["windows"], "<i4") - 1))
    if len(rest):
        size, raw = _join(rest["size"], "<i4"), b"".join(rest["data"].to_pylist())
        end = np.cumsum(size, dtype=np.int64)
        data = [raw[a:b] for a, b in zip((end - size).tolist(), end.tolist(), strict=True)]
        batch = np.repeat(rest["batch"].to_numpy(), [len(x) // 8 for x in rest["id"].to_pylist()])
        all_ = Held(data, _join(rest["key"], "<u8"), _join(rest["id"], "<i8"), _join(rest["rid"], "<i8"), _join(rest["pos"], "<i8"), _join(rest["windows"], "<i4").astype(np.int64), _join(rest["twice"], "u1").astype(bool), batch)
        later, first = first_of(data, all_.id, all_.rid, all_.pos, job.same_doc)
        found.append((batch[later], all_.id[later], all_.rid[later], all_.pos[later], all_.pos[later] + all_.windows[later] - 1))
        held = all_.take(first)
        row, step = job.resolve(held, job.width)
        order = np.lexsort((step, row))
        row, step = row[order], step[order]
        if len(row):
            new = np.append(True, (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1))
            a, b = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(row)) - 1
            r = row[a]
            found.append((held.batch[r], held.id[r], held.rid[r], held.pos[r] + step[a], held.pos[r] + step[b]))
    batch, *cols = (np.concatenate(x) for x in zip(*found, strict=True))
    out = [(int(b), *(_pack(c[x], "<i8") for c in cols)) for b, x in _split(np.arange(len(batch)), batch)]
    return pa.table([list(x) for x in zip(*out, strict=True)], schema=_schema(FOUND)) if out else pa.Table.from_pylist([], _schema(FOUND))


def spans_by_row(found: pa.Table) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """(id, rid) -> first and last window of each run that came earlier."""
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, r, a, b in zip(*(_join(found[c], "<i8").tolist() for c in ("id", "rid", "first", "last")), strict=True):
        out.setdefault((i, r), []).append((a, b))
    return out


def covered(n: int, runs: list[tuple[int, int]], width: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    a, b = np.array(runs, np.int64).T
    np.add.at(edge, a, 1)
    np.add.at(edge, b + width, -1)
    return np.cumsum(edge[:-1]) > 0


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in text.split(", "))])


def run(docs: DataFrame, job: Job, hot: int = HOT) -> DataFrame:
    """One row per document, as job.finish makes it."""
    spark = docs.sparkSession
    ship(spark)
    n_batches, n = parts(spark, 2), parts(spark)
    rid = row_hash(F.col("text"))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    src = docs.select(F.col("doc_id").cast("long").alias("id"), rid.alias("rid"), text.alias("data"), F.pmod(F.xxhash64("doc_id", rid), F.lit(n_batches)).cast("int").alias("batch"))
    by_batch = src.groupBy("batch")

    def send(key, table):
        return _send(job, key[0].as_py(), table, n)

    def tell(key, table):
        return _tell(table, hot)

    def superstrings(key, table, told):
        return _superstrings(job, key[0].as_py(), table, told, n)

    def settle(key, table):
        return _settle(job, table)

    def finish(key, table, found):
        return job.finish(table, spans_by_row(found), _schema(job.out))

    told = by_batch.applyInArrow(send, SENT).groupBy("bucket").applyInArrow(tell, TOLD)
    packed = by_batch.cogroup(told.groupBy("batch")).applyInArrow(superstrings, PACKED)
    found = packed.groupBy("bucket").applyInArrow(settle, FOUND)
    return by_batch.cogroup(found.groupBy("batch")).applyInArrow(finish, job.out)
