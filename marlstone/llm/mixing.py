"""Mixing sources to target weights by Pareto order sampling.

Targets: the sources share all words by weight; a target stops at `most` times its source's words, and the excess is
shared out again by weight until none is above (one closed form over the table of sources).

Copies: a document is due copies in proportion to its own weight, `most` at most, such that its source's words due add up
to the target (a closed form over the table of sources and weights; weights are rounded to two digits, so it has some
hundreds of rows a source at most). The whole part is certain. The rest is its inclusion probability p in a fixed-size
sample (Rosen, "On sampling with probability proportional to size", 1997): with a random u, documents are ranked by the
odds u / (1 - u) divided by p / (1 - p), and the first are taken until the words still due are met as nearly as whole
documents can. u comes from a digest of the doc_id, so reruns agree.

No source is ever gathered or sorted: two rounds of histograms over the rank find, for each source, the cell where its
words run out, and only that cell (some 1 / 16,777,216 of the source) is sorted.

Nulls: a null text has size 0, a null source is a source of its own (last), null ids share one u. Rows equal in id,
source and size are taken together. An empty table gives an empty result. Other columns are ignored or kept whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import cut

WORD = r"[^\x20\x09-\x0D]+"
CELLS = 4096
#: Sources up to which their table, a few numbers each, is broadcast; beyond it is joined by shuffles, which adaptive
#: execution splits where a source is large.
FEW = 10_000


def unit(doc_id: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 from a digest of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """sizes (source, size) -> (source, source_size, target). Weights go round the sources by code point, null last."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, everything = W.orderBy(F.asc_nulls_last("source")), W.partitionBy()
    cycle = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    per = per.withColumn("w", cycle).withColumn("total", F.sum("source_size").over(everything).cast("double"))
    # in the order in which targets reach their limit: the level if all before are at their limit and none after is
    order = W.orderBy(F.col("source_size") / F.col("w"), F.asc_nulls_last("source"))
    before = F.coalesce(F.sum("source_size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("double")
    level = (F.col("total") - most * before) / F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    per = per.withColumn("level", level).withColumn("level", F.when(most * F.col("source_size") > F.col("w") * F.col("level"), F.col("level")))
    fair = F.coalesce(F.max("level").over(everything) * F.col("w"), most * F.col("source_size").cast("double"))
    return per.select("source", "source_size", F.least(most * F.col("source_size").cast("double"), fair).alias("target"))


def _same(a: DataFrame, b: DataFrame, how: str = "left") -> DataFrame:
    """Join on source, where null equals null."""
    b = b.withColumnRenamed("source", "_source")
    return a.join(b, a["source"].eqNullSafe(b["_source"]), how).drop("_source")


def two_digits(weight: Column) -> Column:
    """A weight above zero, rounded to two digits; null, NaN and all others count as none."""
    ok = F.when((weight > 0) & (weight < float("inf")), weight.cast("double"))
    place = F.floor(F.log10(ok)) - 1
    return F.when(place >= 0, F.round(ok / F.pow(F.lit(10.0), place)) * F.pow(F.lit(10.0), place)).otherwise(F.round(ok * F.pow(F.lit(10.0), -place)) / F.pow(F.lit(10.0), -place))


def rates(sizes: DataFrame, aims: DataFrame, most: int) -> DataFrame:
    """sizes (source, weight, size) -> (source, weight, due): copies for each weight, that add up to the source's target.

    Heavier documents reach the limit first; the level is that at which all heavier ones are at the limit and none other is.
    """
    per = _same(sizes.where("weight is not null").groupBy("source", "weight").agg(F.sum("size").cast("double").alias("s")), aims.select("source", "target"))
    w = W.partitionBy("source").orderBy(F.desc("weight"))
    before = F.coalesce(F.sum("s").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(F.col("weight") * F.col("s")).over(w.rowsBetween(0, W.unboundedFollowing))
    per = per.withColumn("level", F.try_divide(F.col("target") - most * before, rest))
    per = per.withColumn("level", F.when(F.col("level") * F.col("weight") < most, F.col("level")))
    level = F.max("level").over(W.partitionBy("source"))
    due = F.when(F.col("target") > 0, F.least(F.lit(float(most)), F.coalesce(level * F.col("weight"), F.lit(float(most))))).otherwise(0.0)
    return per.select("source", "weight", F.greatest(due, F.lit(0.0)).alias("due"))


def copies(docs: DataFrame, seed: int = 7, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, weight: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every row of `docs` (doc_id, source, text).

    weight: a document's own, over doc_id, source and size, its words; documents without one are left out. None: all alike.
    """
    sized = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        unit(F.col("doc_id"), seed).alias("u"),
    )
    sized = cut(sized.withColumn("weight", F.lit(1.0) if weight is None else two_digits(weight)))
    aims = cut(targets(sized, weights, most))
    few = aims.count() <= FEW
    due = cut(rates(sized, aims, most))
    many = due.count() > FEW
    ranked = _same(sized, F.broadcast(aims) if few else aims)
    due = due.select(F.col("source").alias("_source"), F.col("weight").alias("_weight"), "due")
    ranked = ranked.join(due if many else F.broadcast(due), ranked["source"].eqNullSafe(F.col("_source")) & (F.col("weight") == F.col("_weight")), "left").drop("_source", "_weight")
    ranked = ranked.withColumn("due", F.coalesce("due", F.lit(0.0))).withColumn("whole", F.floor("due").cast("long")).withColumn("p", F.col("due") - F.col("whole"))
    odds = (F.col("u") / (1 - F.col("u"))) * F.try_divide(1 - F.col("p"), F.col("p"))
    ranked = ranked.withColumn("q", odds).withColumn("at", F.col("q") / (1 + F.col("q")))
    ranked = ranked.withColumn("cell", F.least(F.floor(F.col("at") * CELLS * CELLS), F.lit(CELLS * CELLS - 1)).cast("long"))
    last = cut(_last(ranked, few))
    taken = F.col("whole") + F.when(F.struct("q", F.coalesce("doc_id", F.lit(-(1 << 62))), "size") <= F.col("last"), 1).otherwise(0)
    return _same(ranked, F.broadcast(last) if few else last).select("doc_id", "source", "size", "source_size", "target", F.coalesce(taken, F.col("whole")).alias("copies"))


#: The weight that the queries use: binary digits of a document's words, so that longer documents come more often.
def by_length() -> Column:
    return F.length(F.bin("size")).cast("double")


def _last(ranked: DataFrame, few: bool) -> DataFrame:
    """(source, last): the highest rank that is still taken; sources that take none are left out. few: tables of sources
    are small enough to broadcast."""
    sent = F.broadcast if few else (lambda x: x)
    open_ = ranked.where("q is not null")
    spare = ranked.groupBy("source").agg((F.max("target") - F.sum(F.col("whole") * F.col("size"))).alias("spare"))

    def boundary(cells: DataFrame, before: Column) -> DataFrame:
        """cells (source, c, words) and the words before them all -> the cell in which spare runs out, or the last cell."""
        w = W.partitionBy("source").orderBy("c")
        run = cells.withColumn("before", before + F.coalesce(F.sum("words").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        return run.where("before < spare").groupBy("source").agg(F.max_by(F.struct("c", "before", "spare"), "c").alias("x")).select("source", "x.*")

    first = _same(open_.groupBy("source", F.floor(F.col("cell") / CELLS).alias("c")).agg(F.sum("size").alias("words")), spare)
    first = boundary(first, F.lit(0)).select("source", F.col("c").alias("high"), F.col("before").alias("base"), "spare")
    inner = _same(open_, sent(first), "inner").where(F.floor(F.col("cell") / CELLS) == F.col("high"))
    second = inner.groupBy("source", F.col("cell").alias("c"), "base", "spare").agg(F.sum("size").alias("words"))
    second = boundary(second, F.col("base")).select("source", F.col("c").alias("at_cell"), F.col("before").alias("base"), "spare")
    rows = _same(open_, sent(second), "inner").where("cell = at_cell").withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 62))))
    w = W.partitionBy("source").orderBy("q", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(w), F.lit(0)))
    hit = rows.where(F.col("before") + F.col("size") / 2 < F.col("spare"))
    found = hit.groupBy("source").agg(F.max(F.struct("q", "id", "size")).alias("hit"))
    # if not even the first row of the cell fits, all cells before it are taken: a rank below each of this cell
    floor_q = F.try_divide(F.col("at_cell") / float(CELLS * CELLS), 1 - F.col("at_cell") / float(CELLS * CELLS))
    low = second.select("source", F.struct(floor_q.alias("q"), F.lit(-(1 << 63)).cast("long").alias("id"), F.lit(-1).cast("long").alias("size")).alias("low"))
    return _same(low, found).select("source", F.coalesce("hit", "low").alias("last"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, with all their columns."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", size.alias("size"))
    own = copies(docs, **options).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "copies").distinct()
    met = rows.join(own.where("copies > 0"), rows["doc_id"].eqNullSafe(F.col("_id")) & rows["source"].cast("string").eqNullSafe(F.col("_source")) & (rows["size"] == F.col("_size")))
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


#: DuckDB: the query op2, over the view documents.
SQL = """
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         (('0x' || substr(md5('7|' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint + 0.5::double) / 4503599627370496::double as u
  from documents),
per as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (select *, ((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::double as w, (sum(source_size) over ())::double as total from per),
leveled as (
  select *, (total - 3 * coalesce(sum(source_size) over (order by source_size / w, source asc nulls last rows between unbounded preceding and 1 preceding), 0)::double)
            / sum(w) over (order by source_size / w, source asc nulls last rows between current row and unbounded following) as level
  from weighed),
aims as (
  select source, source_size, least(3 * source_size::double, coalesce(w * max(case when 3 * source_size > w * level then level end) over (), 3 * source_size::double)) as target
  from leveled),
classes as (select source, length(bin(size))::double as w, sum(size)::double as s from sized group by all),
rated as (
  select c.*, a.target, (a.target - 3 * coalesce(sum(s) over (partition by c.source order by w desc rows between unbounded preceding and 1 preceding), 0))
            / nullif(sum(w * s) over (partition by c.source order by w desc rows between current row and unbounded following), 0) as level
  from classes c join aims a on c.source is not distinct from a.source),
rates as (select source, w, greatest(case when target > 0 then least(3.0::double, coalesce(max(case when level * w < 3 then level end) over (partition by source) * w, 3.0::double)) else 0 end, 0.0::double) as due from rated),
due as (
  select s.*, a.source_size, a.target, r.due
  from sized s join aims a on s.source is not distinct from a.source join rates r on s.source is not distinct from r.source and length(bin(s.size)) = r.w),
ranked as (
  select *, floor(due)::bigint as whole, due - floor(due) as p,
         case when due > floor(due) then (u / (1 - u)) * ((1 - (due - floor(due))) / (due - floor(due))) end as q
  from due),
running as (
  select *, target - (sum(whole * size) over (partition by source))::double as spare,
         case when q is not null then coalesce(sum(size) over (partition by source, q is null order by q, doc_id, size rows between unbounded preceding and 1 preceding), 0)::double end as before
  from ranked)
select doc_id, size, source_size, target, (size * (whole + case when q is not null and before + size / 2.0::double < spare then 1 else 0 end))::bigint as taken
from running
"""
