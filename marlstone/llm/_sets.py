"""Texts as sets of word shingles: their Jaccard similarity, and the pairs that a fingerprint search does not reach.

Where one order of all shingles is fixed, two sets with J >= least share a shingle among the first n - ceil(least * n) + 1
of each (Bayardo et al., "Scaling Up All Pairs Similarity Search", 2007). The order here puts shingles that are common in a
sample last, so that few sets meet at them; the sample moves work only, not results.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import row_hash, ship
from ._words import hashes, lower_ascii, shingles
from .exact import _filter, _places

#: The sample that tells common shingles: texts it has at least, and the share of larger corpora (one in EVERY, so that a shingle
#: is told as soon as some EVERY * OFTEN texts have it, however many there are); how often they occur there, and how many are told apart.
SAMPLE, EVERY, OFTEN, COMMON = 5_000, 8, 4, 500_000


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(hashes(shingles(lower_ascii(text), shingle)))


def name_of(own: np.ndarray) -> int:
    """A hash of a set, as a signed 64-bit integer."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 7)).view(np.int64))


#: Columns of a set's odd sketch, 64 bits each.
ODD = ("q0", "q1", "q2", "q3")


def odd_sketch(own: np.ndarray) -> np.ndarray:
    """Bit b is 1 if an odd number of shingles fall on b (Mitzenmacher, Pagh, Pham, "Efficient Estimation for High Similarities
    Using Odd Sketches", 2014). Each shingle that only one of two sets has flips one bit of their difference, so no more bits differ
    than shingles do: as a filter it loses nothing."""
    bits = np.bincount((own & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def may_be_similar(least: float, n, n2, odd, odd2):
    """False only where J < least: of sets of n and n2 shingles no more than (1 - J) / (1 + J) (n + n2) differ."""
    differ = sum((F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(odd, odd2, strict=True)), F.lit(0))
    return (F.least(n, n2) >= least * F.greatest(n, n2) - 1e-9) & (differ <= (1 - least) / (1 + least) * (F.col(n) + F.col(n2)) + 1e-6)


def common_values(src: DataFrame, shingle: int) -> np.ndarray:
    """Shingles that many texts of a sample share, sorted."""

    def run(batches):
        for b in batches:
            own = [shingle_set(t, shingle) for t in b.column(0).to_pylist()]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], ["value"])

    every = max(1, min(EVERY, src.count() // SAMPLE))
    some = src.select("text").where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0) if every > 1 else src.select("text")
    counts = some.mapInArrow(run, "value long").groupBy("value").count().where(F.col("count") >= OFTEN)
    got = counts.orderBy(F.desc("count"), "value").limit(COMMON).select("value").toArrow()
    return np.sort(got["value"].to_numpy().astype(np.int64).view(np.uint64))


def summaries(src: DataFrame, shingle: int, least: float, common: np.ndarray, fingerprint) -> DataFrame:
    """(doc_id, rid, sid, n, fp, prefix, ODD) of every row: name, size and fingerprint of its set, the shingles of which
    any set as similar as `least` has one among its own, and its odd sketch."""
    held = src.sparkSession.sparkContext.broadcast(common)  # COMMON numbers at most

    def run(batches):
        values = held.value
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                sid, n, fp, first, odd = [], [], [], [], [np.zeros((0, len(ODD)), np.int64)]
                for t in part.column(2).to_pylist():
                    own = shingle_set(t, shingle)
                    sid.append(name_of(own))
                    n.append(len(own))
                    fp.append(fingerprint(own))
                    odd.append(odd_sketch(own)[None])
                    late = values[np.minimum(np.searchsorted(values, own), len(values) - 1)] == own if len(values) else np.zeros(len(own), bool)
                    first.append(np.concatenate([own[~late], own[late]])[: len(own) - ceil(least * len(own) - 1e-9) + 1].view(np.int64))
                cols = [part.column(0), part.column(1), pa.array(sid, pa.int64()), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.array(first, pa.list_(pa.int64())), *map(pa.array, np.concatenate(odd).T.copy())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "rid", "sid", "n", "fp", "prefix", *ODD])

    rows = src.select("doc_id", row_hash(F.col("text")).alias("rid"), "text")
    zero = F.lit(0).cast("long")
    kinds = rows.select("doc_id", "rid", zero.alias("sid"), F.lit(0).alias("n"), zero.alias("fp"), F.array(zero).alias("prefix"), *(zero.alias(q) for q in ODD))
    return rows.mapInArrow(run, kinds.schema)


def sets_of(src: DataFrame, shingle: int, wanted: DataFrame) -> DataFrame:
    """(sid, own) of the wanted (doc_id, rid): a filter of fixed size tells each scan which texts to cut into shingles."""
    held = src.sparkSession.sparkContext.broadcast(_filter(wanted))

    def run(batches):
        for b in batches:
            x, y = _places(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            hit = (held.value[x >> 6] >> (x & 63).astype(np.uint64)) & (held.value[y >> 6] >> (y & 63).astype(np.uint64)) & np.uint64(1)
            own = [shingle_set(b.column(1)[k].as_py(), shingle) for k in np.flatnonzero(hit).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([name_of(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], ["sid", "own"])

    rid = row_hash(F.col("text"))
    return src.select(F.xxhash64("doc_id", rid).alias("key"), "text").mapInArrow(run, "sid long, own binary")


def similar(pairs: DataFrame, src: DataFrame, where: DataFrame, shingle: int, least: float) -> DataFrame:
    """Of pairs (u, v) of sids those with J >= least, by their whole sets. where (sid, doc_id, rid): one row with each set."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    ship(src.sparkSession)
    sids = pairs.select(F.col("u").alias("sid")).unionByName(pairs.select(F.col("v").alias("sid"))).distinct()
    wanted = where.join(sids, "sid", "left_semi")
    found = sets_of(src, shingle, wanted.select("doc_id", "rid")).join(sids, "sid", "left_semi")
    sets = found.groupBy("sid").agg(F.first("own").alias("own"))
    one = pairs.join(sets.select(F.col("sid").alias("u"), F.col("own").alias("x")), "u")
    two = one.join(sets.select(F.col("sid").alias("v"), F.col("own").alias("y")), "v")
    return two.select("u", "v", "x", "y").mapInArrow(run, "u long, v long")
