"""Exact duplicates by distributed radix partitioning, most significant bytes first.

Texts are equal if they are once ASCII white space is deleted. A round splits every open group by its texts' next
bytes. Only rows of open groups send any, as a filter of fixed size tells each scan which they are. Rows are counted by
(group, bytes, whether more bytes follow), with a map-side combine. A part of one row is settled as unique, a part
whose texts have ended is settled as equal, and the others are the groups of the next round, whose slice is 16 times
as long. So each byte is moved once at most, unique texts leave after a few dozen bytes, and
equality is decided by the bytes themselves. No group is gathered: a part is known by its least row, and the rows find
their part's count by a join that adaptive execution splits where it is skewed.

Of equal texts the one with the most code points stays, then the smallest doc_id (a null id before all others); where
rows repeat that id with as many code points but other blanks, one of these texts. An empty table gives an empty result,
and a very long text is moved in slices like any other.
A null text is empty. Rows equal in id and text are one document: each counts in group_size, and they stay or go
together; a hash of the text only tells rows that repeat an id apart. Other columns are ignored or kept whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BLANKS, cut, drop, row_hash, ship

FIRST, TIMES = 64, 16
#: Bits of the filter of open rows, which is broadcast: 4 MB. A full one lets all rows pass, and the join decides.
FILTER = 1 << 25
_BLANKS = BLANKS.encode()
_INNER = bytes(range(128, 192))  # bytes inside a code point


def _on(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Join on (doc_id, rid), null ids being equal; b's two columns go."""
    b = b.withColumnsRenamed({"doc_id": "_id", "rid": "_rid"})
    return a.join(b, a["doc_id"].eqNullSafe(b["_id"]) & (a["rid"] == b["_rid"]), how).drop("_id", "_rid")


def _places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = key.view(np.uint64)
    return (u % np.uint64(FILTER)).astype(np.int64), ((u >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(FILTER)).astype(np.int64)


def _filter(open_rows: DataFrame) -> np.ndarray:
    """A bit map in which both places of each open row's hash are set; made of FILTER / 64 words at most."""

    def run(batches):
        for b in batches:
            at = np.concatenate(_places(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    words = open_rows.select(F.xxhash64("doc_id", "rid")).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def _parts(docs: DataFrame, at: int, wide: int, open_rows: DataFrame | None) -> DataFrame:
    """(doc_id, rid, chars, part, more) of the rows that may be open, and sha256 where open_rows is not given."""
    spark = docs.sparkSession
    ship(spark)
    held = None if open_rows is None else spark.sparkContext.broadcast(_filter(open_rows))

    def run(batches):
        for b in batches:
            if held is not None:
                x, y = _places(b.column(2).to_numpy(zero_copy_only=False).astype(np.int64))
                bits, one = held.value, np.uint64(1)
                hit = (bits[x >> 6] >> (x & 63).astype(np.uint64)) & (bits[y >> 6] >> (y & 63).astype(np.uint64)) & one
                b = b.filter(pa.array(hit == one))
            chars, part, more, digest = [], [], [], []
            for t in b.column(3):
                raw = t.as_py()
                norm = raw.translate(None, _BLANKS)
                chars.append(len(raw.translate(None, _INNER)))
                part.append(norm[at : at + wide])
                more.append(len(norm) > at + wide)
                if held is None:
                    digest.append(hashlib.sha256(norm).hexdigest())
            cols = [b.column(0), b.column(1), pa.array(chars, pa.int64()), pa.array(part, pa.binary()), pa.array(more, pa.bool_()), pa.array(digest if held is None else [""] * len(part), pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "rid", "chars", "part", "more", "text_sha256"])

    rid = row_hash(F.col("text"))
    src = docs.select("doc_id", rid.alias("rid"), F.xxhash64("doc_id", rid).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    kinds = src.select("doc_id", "rid", F.lit(0).cast("long").alias("chars"), F.col("data").alias("part"), F.lit(True).alias("more"), F.lit("").alias("text_sha256"))
    return src.mapInArrow(run, kinds.schema)


def settle(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rid, text_sha256) of every row, and (doc_id, rid, keep_id, keep_rid, group_size) of those that have an equal
    row; in the second, one row for repeated rows."""
    id_type = docs.schema["doc_id"].dataType
    at, wide, groups, done, base = 0, FIRST, None, None, None
    while True:
        rows = _parts(docs, at, wide, groups)
        if groups is None:
            base = cut(rows)
            rows = base.drop("text_sha256").select("*", F.lit(None).cast(id_type).alias("g_id"), F.lit(0).cast("long").alias("g_rid"))
        else:
            rows = cut(_on(rows.drop("text_sha256"), groups, "inner"))
        least = rows.groupBy("g_id", "g_rid", "part", "more").agg(
            F.count("*").alias("group_size"), F.min(F.struct("doc_id", "rid")).alias("g"), F.min(F.struct((-F.col("chars")).alias("n"), "doc_id", "rid")).alias("best")
        )
        least = least.where("group_size > 1").select(F.col("g_id").alias("o_id"), F.col("g_rid").alias("o_rid"), F.col("part").alias("o_part"), F.col("more").alias("o_more"), "g", "best", "group_size")
        met = rows.join(least, rows["g_id"].eqNullSafe(F.col("o_id")) & (F.col("g_rid") == F.col("o_rid")) & (F.col("part") == F.col("o_part")) & (F.col("more") == F.col("o_more")))
        now = cut(met.select("doc_id", "rid", "more", F.col("g.doc_id").alias("g_id"), F.col("g.rid").alias("g_rid"), F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), "group_size").distinct())
        ended = now.where("not more").select("doc_id", "rid", "keep_id", "keep_rid", "group_size")
        done = ended if done is None else done.unionByName(ended)
        if groups is not None:
            drop(rows)
        groups = now.where("more").select("doc_id", "rid", "g_id", "g_rid")
        if groups.isEmpty():
            return base.select("doc_id", "rid", "text_sha256"), done
        at, wide = at + wide, wide * TIMES


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row; the digest is of the normalised text."""
    rows, equal = settle(docs)
    found = _on(rows, equal, "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (alone | _stays()).alias("kept"), "text_sha256")


def _stays():
    """Whether a row of a group is the one that stays: by id, and where rows repeat an id with other blanks, by text."""
    return F.col("keep_id").eqNullSafe(F.col("doc_id")) & (F.col("keep_rid") == F.col("rid"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", row_hash(F.col("text")).alias("rid"))
    gone = settle(docs)[1].where(~_stays()).select("doc_id", "rid")
    return _on(rows, gone, "left_anti").select("row.*")


#: DuckDB: the query op8, over the view documents.
SQL = """
with base as (select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as norm from documents),
held as (select *, first_value(doc_id) over (partition by norm order by length(text) desc, doc_id) as keep_id, count(*) over (partition by norm) as group_size from base)
select doc_id, keep_id, group_size, keep_id = doc_id as kept, sha256(norm) as text_sha256 from held
"""
