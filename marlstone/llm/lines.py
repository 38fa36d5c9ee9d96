"""Repeated lines, by overlapping windows of three.

Windows are three consecutive lines that have a word (lines without one neither count nor go). Equal windows are found
over the whole corpus by a 128-bit hash; of equal ones all but the first, by doc_id and place, are later occurrences,
and the lines that any of them covers are removed. Counting has a map-side combine, and rows find their window's
first occurrence by a join that adaptive execution splits where it is skewed, so a passage in a third of all documents
is no hot spot. A document with fewer than three such lines is left as it is.

Very long texts are cut into lines whole; an empty text has no line. An empty table gives an empty result. Extra columns
are kept whole, whatever their names.

Nulls: a null text stays null; a null doc_id comes before all others. Rows equal in id and text are one document.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BLANKS, cut, row_hash, ship

WINDOW = 3


def windows(text: str | None) -> list[tuple[int, int, int, list[int]]]:
    """(place, two halves of the hash, numbers of the lines covered) of each window."""
    lines = [(k, x) for k, x in enumerate((text or "").split("\n")) if x.strip(BLANKS)]
    out = []
    for i in range(len(lines) - WINDOW + 1):
        own = lines[i : i + WINDOW]
        h = xxhash.xxh3_128_digest("\n".join(x for _, x in own).encode("utf-8", "surrogatepass"))
        out.append((i, int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True), [k for k, _ in own]))
    return out


def later_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, gone): numbers of the lines to remove, of the documents that have any."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            took, got = [], []
            for k, t in enumerate(b.column(2).to_pylist()):
                own = windows(t)
                got += own
                took += [k] * len(own)
            i, h, g, covers = zip(*got, strict=True) if got else ((), (), (), ())
            took = pa.array(took, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(took), b.column(1).take(took), pa.array(i, pa.int32()), pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array(covers, pa.list_(pa.int32()))],
                ["doc_id", "rid", "place", "h", "g", "covers"],
            )

    src = docs.select("doc_id", row_hash(F.col("text")).alias("rid"), F.col("text").cast("string").alias("text"))
    empty = src.select("doc_id", "rid", F.lit(0).alias("place"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("g"), F.array(F.lit(0)).alias("covers"))
    own = cut(src.mapInArrow(run, empty.schema))
    place = F.struct("doc_id", "rid", "place")
    first = own.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").drop("last")
    later = own.join(first, ["h", "g"]).where(place > F.col("first"))
    return later.select("doc_id", "rid", F.explode("covers").alias("line")).groupBy("doc_id", "rid").agg(F.collect_set("line").alias("gone"))


def _marked(docs: DataFrame) -> DataFrame:
    """(row, doc_id, gone) of every row; the text is shuffled once, inside its row."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", row_hash(F.col("text")).alias("rid"))
    gone = later_lines(docs).withColumnsRenamed({"doc_id": "_id", "rid": "_rid"})
    return rows.join(gone, rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["rid"] == F.col("_rid")), "left").select("row", "doc_id", "gone")


_TEXT = "row.text"


def _with_kept(marked: DataFrame) -> DataFrame:
    """`marked` with `kept`, the text without the lines in `gone`. Lines and marks are sorted by number together, a mark
    before its line, so a line looks at what stands before it: no line is looked up in the list of marks."""
    text = F.col(_TEXT).cast("string")
    none = F.lit(None).cast("string")
    lines = F.transform(F.split(text, "\n", -1), lambda x, k: F.struct(k.alias("k"), F.lit(1).alias("line"), x.alias("x")))
    marks = F.transform("gone", lambda k: F.struct(k.alias("k"), F.lit(0).alias("line"), none.alias("x")))
    marked = marked.withColumn("_sorted", F.when(F.col("gone").isNotNull(), F.sort_array(F.concat(lines, marks))))
    stays = lambda x, k: (x["line"] == 1) & ((k == 0) | (F.get(F.col("_sorted"), k - 1)["line"] == 1))
    rest = F.array_join(F.transform(F.filter("_sorted", stays), lambda x: x["x"]), "\n")
    return marked.withColumn("kept", F.when(F.col("gone").isNull(), text).otherwise(rest))


def remove_later(docs: DataFrame) -> DataFrame:
    """All rows and columns of `docs`; text without later occurrences, and n_chars, if there is one, to match."""
    new = _with_kept(_marked(docs))
    fresh = {"text": F.col("kept").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.char_length("kept")).cast(docs.schema["n_chars"].dataType)
    return new.select(*(fresh[c].alias(c) if c in fresh else F.col("row").getField(c).alias(c) for c in docs.columns))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256): lines with a word, those removed, and a digest of the rest; null counts as empty."""
    has_word = F.size(F.filter(F.split(F.coalesce(F.col(_TEXT).cast("string"), F.lit("")), "\n", -1), lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0))
    return _with_kept(_marked(docs)).select("doc_id", has_word.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: DuckDB: the query op7, over the view documents.
SQL = """
with raw as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as n from documents),
own as (select *, row_number() over (partition by doc_id order by n) as i from raw where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
win as (
  select doc_id, i, line || chr(10) || lead(line, 1) over w || chr(10) || lead(line, 2) over w as s
  from own window w as (partition by doc_id order by i)),
late as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as k from win where s is not null) where k > 1),
gone as (select distinct doc_id, i + k as i from late, range(0, 3) t(k)),
numbered as (select raw.doc_id, raw.n, raw.line, own.i from raw left join own on raw.doc_id = own.doc_id and raw.n = own.n),
rest as (
  select doc_id, string_agg(line, chr(10) order by n) as s
  from (select numbered.* from numbered left join gone on numbered.doc_id = gone.doc_id and numbered.i = gone.i where gone.i is null) group by doc_id)
select d.doc_id, coalesce(a.n, 0)::bigint as n_lines, coalesce(g.n, 0)::bigint as n_removed, sha256(coalesce(rest.s, '')) as kept_sha256
from documents d left join (select doc_id, count(*) as n from own group by doc_id) a on d.doc_id = a.doc_id
left join (select doc_id, count(*) as n from gone group by doc_id) g on d.doc_id = g.doc_id left join rest on d.doc_id = rest.doc_id
"""
