"""SimHash near-duplicates by a generalised pigeonhole search.

A fingerprint has 64 bits; bit b is 1 when more than half of the text's shingle hashes have it. Texts link when their
fingerprints differ in `max_bits` bits or fewer, and links are closed into groups.

Search (Qin et al., "GPH: Similarity Search in Hamming Space", 2018): correlated bits are grouped into m partitions.
By the general pigeonhole principle, thresholds t_i >= -1 with sum(t_i) = max_bits - m + 1 suffice: two fingerprints
within max_bits agree to within t_i on some partition (-1: not probed). For each fingerprint a dynamic programme picks
the thresholds with the least estimated number of candidates and probes; each probe looks one partition value up,
and candidates are verified on all 64 bits.

Only distinct fingerprints are searched, so copies cost nothing. A partition value that very many distinct
fingerprints share would emit their pairs; such fingerprints, and those probing them, are linked another way that is
also exact: two fingerprints are within r + s bits just if a ball of radius r around one meets a ball of radius s around the
other, and a point is shared by at most as many fingerprints as a ball has points.

similar_groups() asks for more than a few bits can tell: a Jaccard similarity of `least`, 0.8 by default, of five-word
shingles. Sets of that similarity differ in about ten bits of 64, which no pigeonhole search reaches without probing
most of the corpus. So the search proposes the pairs within `max_bits`, and what it cannot reach is found by prefixes of
the sets (_sets); a pair that prefixes propose is dropped if odd sketches of the two sets show that too many shingles
differ, which is exact, or if the fingerprints are `FAR` bits apart or more, and every pair left is verified by the Jaccard
similarity of the whole sets. Comparisons go in rounds, after each of which what links is closed into groups: first a set is
held against one that the search proposes, then, `ROUNDS` times, against one of the hubs of its shared shingles, chosen anew
each time, and only then all pairs across groups are compared. So a large group of near copies costs a comparison a member
and round.

Nulls: a null text has no word, so fingerprint zero; a null doc_id is kept, and counts as no id when a group's
smallest is taken. Rows that repeat are each returned. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, drop, ship
from ._components import components
from ._sets import ODD, common_values, may_be_similar, similar, summaries
from ._words import hashes, lower_ascii, shingles

BITS = 64
#: Distinct fingerprints of one partition value up to which its candidates are paired.
CROWD = 512
#: Rounds in which a set is held against one hub of its values, before all pairs across groups are compared.
ROUNDS = 3
#: Cost of one probe in candidates, for the dynamic programme.
PROBE_COST = 4.0
#: Sets of LARGE shingles and more with J >= 0.8 differ in FAR bits or more with a chance of some 1e-6: a bit differs with
#: chance acos(0.889) / pi = 0.15.
FAR, LARGE = 25, 64
#: What goes with a set to its shared shingles.
CARRIED = ("sid", "n", "fp", *ODD)


def fingerprint_of(got: np.ndarray) -> int:
    """Of shingle hashes, as a signed 64-bit integer."""
    if not len(got):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(got), 65536):  # a very long text is unpacked piece by piece
        ones += np.unpackbits(got[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(got), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, shingle: int) -> int:
    return fingerprint_of(hashes(shingles(lower_ascii(text), shingle)))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(x, shingle) for x in b.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, src.select("doc_id", F.lit(0).cast("long").alias("fp")).schema)


def _unpack(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def co_set(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many have bits i and j both set; summed on the executors."""

    def run(batches):
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for b in batches:
            bits = _unpack(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)).astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1).astype(np.int32)), pa.array(np.append(j, -1).astype(np.int32)), pa.array(np.append(total[i, j], n))], ["i", "j", "n"])

    got = distinct.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros((BITS, BITS)), 0
    for r in got:  # one row for each pair of bits
        if r.i < 0:
            n = r.n
        else:
            out[r.i, r.j] = out[r.j, r.i] = r.n
    return n, out


def partition_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of about equal width; each grows from the most correlated bit left by its most correlated bits."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    dev = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(dev, dev))
    left, out = list(range(BITS)), []
    for k in range(m):
        width = len(left) // (m - k)
        own = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        while len(own) < width:
            own.append(max((b for b in left if b not in own), key=lambda b: (corr[b, own].sum(), -b)))
        left = [b for b in left if b not in own]
        out.append(sorted(own))
    return out


def parts_for(n: int, max_bits: int) -> int:
    """Number of partitions: more give fewer probes and shorter keys. Least (probes + candidates) if bits were even."""

    def cost(m: int) -> float:
        spare, width = max_bits - m + 1, BITS / m
        if spare < -m:
            return float("inf")
        t = [spare // m + (k < spare % m) for k in range(m)]
        balls = [sum(np.prod([(width - x) / (x + 1) for x in range(e)]) for e in range(k + 1)) for k in t]
        return sum(b * (PROBE_COST + n / 2**width) for b in balls)

    return min(range(1, max_bits + 2), key=cost)


def _values(bits: np.ndarray, part: list[int]) -> np.ndarray:
    return bits[:, part].astype(np.int64) @ (1 << np.arange(len(part), dtype=np.int64))


def allot(bits: np.ndarray, groups: list[list[int]], ones: np.ndarray, n: int, max_bits: int) -> np.ndarray:
    """Thresholds (rows x partitions) by dynamic programming on estimated candidates plus the cost of probes.

    Candidates within e of a value are estimated from the shares of ones of each bit: the chance of agreeing on all
    bits of the partition, times elementary symmetric sums of the odds of differing on one.
    """
    m, top = len(groups), max_bits
    p = np.clip(ones / max(n, 1), 1e-3, 1 - 1e-3)
    cost = np.zeros((m, len(bits), top + 2))  # [partition, row, threshold + 1]
    for k, g in enumerate(groups):
        agree = np.where(bits[:, g] == 1, p[g], 1 - p[g])
        odds = (1 - agree) / agree
        sums = np.zeros((len(bits), top + 1))
        sums[:, 0] = 1
        for c in range(len(g)):
            for e in range(top, 0, -1):
                sums[:, e] += sums[:, e - 1] * odds[:, c]
        ball = np.cumsum([float(np.prod([(len(g) - x) / (x + 1) for x in range(e)])) for e in range(top + 1)])
        cost[k, :, 1:] = n * np.cumsum(sums, 1) * agree.prod(1)[:, None] + PROBE_COST * ball
    need = max_bits - m + 1 + m  # in steps from all partitions at -1
    best = np.full((len(bits), need + 1), np.inf)
    best[:, 0] = 0
    pick = np.zeros((m, len(bits), need + 1), np.int64)
    for k in range(m):
        new = np.full_like(best, np.inf)
        for step in range(min(top + 1, need) + 1):
            c = best[:, : need + 1 - step] + cost[k, :, step : step + 1]
            better = c < new[:, step:]
            new[:, step:] = np.where(better, c, new[:, step:])
            pick[k][:, step:] = np.where(better, step, pick[k][:, step:])
        best = new
    at, out = np.full(len(bits), need), np.zeros((len(bits), m), np.int64)
    for k in range(m - 1, -1, -1):
        got = pick[k][np.arange(len(bits)), at]
        out[:, k], at = got - 1, at - got
    return out


def _flips(width: int, e: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), e)], np.uint64).view(np.int64)


def _keys(distinct: DataFrame, groups, ones, n, max_bits) -> DataFrame:
    """(part, value, fp, probe): under its own values (probe false) and under every value it has to look up (true)."""

    def rows(part, value, fp, probe):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), part, np.int32)), pa.array(value), pa.array(fp), pa.array(np.full(len(fp), probe))], ["part", "value", "fp", "probe"])

    def run(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = _unpack(fps)
            t = allot(bits, groups, ones, n, max_bits)
            for k, g in enumerate(groups):
                v = _values(bits, g)
                yield rows(k, v, fps, False)
                for e in range(max_bits + 1):
                    sel = t[:, k] >= e
                    if sel.any():
                        f = _flips(len(g), e)
                        step = max(1, (1 << 18) // max(1, len(f)))
                        vs, fs = v[sel], fps[sel]
                        for at in range(0, len(vs), step):
                            yield rows(k, (vs[at : at + step, None] ^ f).ravel(), np.repeat(fs[at : at + step], len(f)), True)

    return distinct.select("fp").mapInArrow(run, "part int, value long, fp long, probe boolean")


def _by_balls(crowd: DataFrame, max_bits: int) -> DataFrame:
    """Links inside `crowd` (fp), by points. Two fingerprints are within r + s bits just if some point is within r of one and
    s of the other, where r and s are max_bits halved, down and up. At each point all within s are linked to the least one
    within r, if there is one: it is within max_bits of them."""
    r, s = max_bits // 2, max_bits - max_bits // 2
    flips = np.concatenate([_flips(BITS, e) for e in range(s + 1)]) if max_bits else np.zeros(1, np.int64)
    inner = np.concatenate([np.full(len(_flips(BITS, e)), e <= r) for e in range(s + 1)]) if max_bits else np.ones(1, bool)

    def run(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(fps), 1000):
                x = fps[at : at + 1000]
                yield pa.RecordBatch.from_arrays([pa.array((x[:, None] ^ flips).ravel()), pa.array(np.repeat(x, len(flips))), pa.array(np.tile(inner, len(x)))], ["point", "fp", "inner"])

    points = crowd.mapInArrow(run, "point long, fp long, inner boolean")
    least = F.min(F.when(F.col("inner"), F.col("fp"))).alias("v")
    held = points.groupBy("point").agg(F.collect_list("fp").alias("own"), least).where("size(own) > 1 and v is not null")  # a ball's points at most
    return held.select(F.explode("own").alias("u"), "v").where("u <> v").distinct()


def _rank(fp="fp"):
    """One order of fingerprints, by a hash, in which the first of any crowd is its hub."""
    return F.xxhash64(fp, F.lit(1))


def _by_stars(keys: DataFrame, hot: DataFrame) -> DataFrame:
    """Each fingerprint in a crowded value, or probing one, with the first of all the hubs of its values."""
    own = keys.join(hot, ["part", "value"])
    hub = F.min(F.struct(_rank().alias("h"), F.col("fp").alias("v"))).alias("o")
    hubs = own.where("not probe").groupBy("part", "value").agg(hub)
    met = own.select("part", "value", F.col("fp").alias("u")).join(hubs, ["part", "value"])
    return met.groupBy("u").agg(F.min("o").alias("o")).select("u", F.col("o.v").alias("v")).where("u <> v")


def links(distinct: DataFrame, max_bits: int = 2, crowd: int = CROWD, whole: bool = True) -> DataFrame:
    """(u, v) between distinct fingerprints (column fp): every pair within max_bits, but inside crowds only as many as connect the same sets.

    whole=False is for callers that search on by other means: crowded values only propose one pair for each fingerprint.
    """
    spark = distinct.sparkSession
    ship(spark)
    n, both = co_set(distinct)
    groups = partition_bits(n, both, parts_for(n, max_bits))
    keys = cut(_keys(distinct, groups, np.diag(both).copy(), n, max_bits))
    hot = cut(keys.where("not probe").groupBy("part", "value").count().where(F.col("count") > crowd).select("part", "value"))
    if hot.isEmpty():
        cold, more = keys, None
    else:
        cold = keys.join(hot, ["part", "value"], "left_anti")
        more = _by_balls(cut(keys.join(hot, ["part", "value"], "left_semi").select("fp").distinct()), max_bits) if whole else _by_stars(keys, hot)
    a = cold.where("probe").select("part", "value", F.col("fp").alias("u"))
    b = cold.where("not probe").select("part", "value", F.col("fp").alias("v"))
    found = a.join(b, ["part", "value"]).where((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)).select("u", "v")
    return found if more is None else found.unionByName(more)


def near_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id of the row's group."""
    prints = cut(fingerprints(docs, shingle))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(distinct, max_bits, crowd)).select(F.col("node").alias("fp"), "root")
    placed = distinct.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def _met_again(met: DataFrame, comps: DataFrame, least: float):
    """met (value, CARRIED) with groups, the other set's columns, and whether a set and another may be alike."""
    two = [f"{q}2" for q in ODD]
    like = (F.col("comp") != F.col("comp2")) & may_be_similar(least, "n", "n2", ODD, two)
    like &= (F.least("n", "n2") < LARGE) | (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) < FAR)
    return cut(met.join(comps, "sid")), [F.col(c).alias(f"{c}2") for c in (*CARRIED, "comp")], like


def _to_hubs(met: DataFrame, comps: DataFrame, seed: int, least: float) -> DataFrame:
    """(u, v): each set with one other, the first of the hubs of its values that is in another group of comps (sid, comp). A value's
    hub is the first of its sets in an order that hangs on the value and the seed, so that a set meets many."""
    now, as_other, like = _met_again(met, comps, least)
    hub = F.min(F.struct(F.xxhash64("sid", "value", F.lit(seed)).alias("h"), *CARRIED, "comp")).alias("o")
    hubs = now.groupBy("value").agg(hub, F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b")
    other = hubs.select("value", "o.*").select("value", "h", *as_other)
    first = now.join(other, "value").where(like).groupBy("sid").agg(F.min(F.struct("h", "sid2")).alias("o"))
    out = cut(first.select(F.least("sid", "o.sid2").alias("u"), F.greatest("sid", "o.sid2").alias("v")).distinct())
    drop(now)
    return out


def _across(met: DataFrame, comps: DataFrame, least: float) -> DataFrame:
    """(u, v): all sets that share a value of met and are not in one group of comps yet; pairs inside the group that has the value
    most often are not even formed."""
    now, as_other, like = _met_again(met, comps, least)
    large = now.groupBy("value", "comp").count().groupBy("value").agg(F.max(F.struct("count", "comp")).alias("o"), F.count("*").alias("c")).where("c > 1")
    other = now.join(large, "value").where("comp <> o.comp").select("value", *as_other)
    out = cut(now.join(other, "value").where(like).select(F.least("sid", "sid2").alias("u"), F.greatest("sid", "sid2").alias("v")).distinct())
    drop(now)
    return out


def _joined(comps: DataFrame, linked: DataFrame) -> DataFrame:
    """comps (sid, comp) once the groups of linked sets (u, v) are one; groups count as one node each."""
    ends = linked
    for end in ("u", "v"):
        ends = ends.join(comps.select(F.col("sid").alias(end), F.col("comp").alias(f"_{end}")), end).drop(end)
    roots = components(ends.select(F.col("_u").alias("u"), F.col("_v").alias("v"))).select(F.col("node").alias("comp"), "root")
    return cut(comps.join(roots, "comp", "left").select("sid", F.coalesce("root", "comp").alias("comp")))


def similar_groups(docs: DataFrame, shingle: int = 5, least: float = 0.8, max_bits: int = 4, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp, component_id) of every row: groups of texts whose sets of shingles have a Jaccard similarity of `least`,
    0.8 or more; fp is the fingerprint of the set."""
    if least < 0.8:
        raise ValueError("least must be 0.8 or more")
    ship(docs.sparkSession)
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = cut(summaries(src, shingle, least, common_values(src, shingle), fingerprint_of))
    one = F.min(F.struct(F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("_k"), "doc_id", "rid")).alias("w")
    sets = cut(rows.groupBy("sid").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("fp").alias("fp"), one, F.first("prefix").alias("prefix"), *(F.first(q).alias(q) for q in ODD)))
    where = sets.select("sid", "w.doc_id", "w.rid")

    hubs = cut(sets.groupBy("fp").agg(F.min("sid").alias("hub")))
    same = sets.select("sid", "fp").join(hubs, "fp").where("sid <> hub").select(F.col("hub").alias("u"), F.col("sid").alias("v"))
    found = links(hubs.select("fp"), max_bits, crowd, whole=False)
    found = found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v"))).where(_rank("v") < _rank("u"))
    found = found.groupBy("u").agg(F.min(F.struct(_rank("v").alias("h"), "v")).alias("o")).select("u", F.col("o.v").alias("v"))
    for end in ("u", "v"):
        found = found.join(hubs.select(F.col("fp").alias(end), F.col("hub").alias(f"{end}_")), end).drop(end).withColumnRenamed(f"{end}_", end)
    pairs = found.select("u", "v").unionByName(same).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()

    met = sets.select(F.explode("prefix").alias("value"), *CARRIED)
    shared = met.groupBy("value").agg(F.min("sid").alias("a"), F.max("sid").alias("b")).where("a <> b").select("value")
    met = cut(met.join(shared, "value"))
    comps = sets.select("sid", F.col("sid").alias("comp"))
    for step in range(ROUNDS + 2):
        new = cut(pairs) if not step else _to_hubs(met, comps, step, least) if step <= ROUNDS else _across(met, comps, least)
        if not new.isEmpty():
            comps = _joined(comps, cut(similar(new, src, where, shingle, least)))
    drop(met)
    joined = sets.select("sid", "first_id").join(comps, "sid")
    named = joined.join(joined.groupBy("comp").agg(F.min("first_id").alias("component_id")), "comp").select("sid", "component_id")
    return rows.select("doc_id", "fp", "sid").join(named, "sid").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, least: float | None = None, **options) -> DataFrame:
    """The rows of `docs` that carry their group's smallest doc_id: one document of each group stays. Groups are those of
    near_groups(), or of similar_groups() if `least`, a Jaccard similarity, is given.

    Rows repeating that doc_id stay too, as they are one document; a group with null ids only keeps all its rows.
    """
    if "doc_id" not in docs.columns:
        raise ValueError("doc_id is missing")
    groups = near_groups(docs, **options) if least is None else similar_groups(docs, least=least, **options)
    lose = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(lose, "doc_id", "left_anti").select(*docs.columns)
