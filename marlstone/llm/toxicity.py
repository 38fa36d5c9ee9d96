"""Toxicity by a counterfactual-regularised classifier.

A logistic model over word features (each word, and its first letters as a stem, which inflected languages need) is
fitted with a second penalty beside the usual one: in labelled sentences that name a group, the name is swapped for
other names of its kind, and the squared change of the score's log-odds is penalised (Garg et al., "Counterfactual
Fairness in Text Classification through Robustness", 2019). So a group's name cannot carry weight of its own, and
neutral mentions are not taken for toxic ones.

The fit sees a bounded sample of labelled rows: at most `max_rows`, those with the least hash of their id, so that
the sample is the same on every run and small enough to broadcast. All swaps of the sample count: equal differences of
features are counted on the executors, and the penalty weighs each by its count. Features are chosen from it by how many
standard errors lie between their shares of toxic and of other rows, `least_z` at least. Everything else sees every row and its whole text; labels, languages, sources and ids are not inputs.

Nulls: a null text is empty and scores as the intercept; rows without label or id are not used for fitting; of
repeated labels of one id the highest counts. Without labels of both classes the score is the share of toxic ones
(0 without any). Repeated rows are each returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, ship

#: Names that may stand for each other, by kind; a parameter.
IDENTITIES: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"), ("black", "white", "asian", "latino"),
    ("immigrants", "natives", "refugees"), ("africans", "europeans", "americans", "asians"), ("old", "young"), ("disabled", "deaf", "blind"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("frauen", "männer"), ("muslime", "christen", "juden"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
_WORD = regex.compile(r"\p{L}+")
_SENTENCE = regex.compile(r"[^.!?\n]+")
#: Words whose features a worker remembers.
REMEMBER = 300_000


#: Letters of the stems that, when more letters follow, are features beside the word itself.
STEMS = (4, 5, 6, 7, 8)


def features(word: str) -> list[str]:
    return [f"={word}", *(f"{word[:n]}+" for n in STEMS if len(word) > n)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0)) == 1


class Model:
    """Weights by feature, and an intercept."""

    def __init__(self, weights: dict[str, float], intercept: float):
        self.weights, self.intercept = weights, intercept
        self._known: dict[str, tuple[str, ...]] = {}

    def present(self, text: str | None) -> set[str]:
        """Features of the vocabulary that a text has."""
        out: set[str] = set()
        known, weights = self._known, self.weights
        for w in set(_WORD.findall((text or "").lower())):
            own = known.get(w)
            if own is None:
                own = tuple(f for f in features(w) if f in weights)
                if len(known) < REMEMBER:
                    known[w] = own
            if own:
                out.update(own)
        return out

    def score(self, text: str | None) -> float:
        odds = self.intercept + sum(self.weights[f] for f in sorted(self.present(text)))
        return float(1 / (1 + np.exp(-np.clip(odds, -700, 700))))

    def __getstate__(self):
        return self.weights, self.intercept

    def __setstate__(self, state):
        self.__init__(*state)


def swaps(text: str, identities: Sequence[Sequence[str]]) -> list[tuple[str, str]]:
    """(sentence, the same with one name swapped) for sentences that have one, once for each other name of its kind."""
    kind = {t: g for g in identities for t in g}
    out = []
    for s in _SENTENCE.findall(text.lower()):
        for w in set(_WORD.findall(s)) & kind.keys():
            others = [t for t in kind[w] if t != w]
            out += [(s, regex.sub(rf"\b{regex.escape(w)}\b", t, s)) for t in others]
    return out


class Rows:
    """A sparse matrix of +1 and -1: for each row the columns with either."""

    def __init__(self, plus: Sequence[Sequence[int]], minus: Sequence[Sequence[int]], width: int):
        both = [np.array([*p, *m], np.int64) for p, m in zip(plus, minus, strict=True)]
        self.shape = len(both), width
        self.col = np.concatenate([np.zeros(0, np.int64), *both])
        self.row = np.repeat(np.arange(len(both)), [len(x) for x in both])
        self.sign = np.concatenate([np.zeros(0), *(np.repeat([1.0, -1.0], [len(p), len(m)]) for p, m in zip(plus, minus, strict=True))])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.sign * w[self.col], self.shape[0])

    def turned_times(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.sign * r[self.row], self.shape[1])


def fit_logistic(x: Rows, y: np.ndarray, pairs: Rows, times: np.ndarray, l2: float, counterfactual: float, rounds: int = 1000) -> np.ndarray:
    """Weights, the intercept last: accelerated gradient descent on the mean log-loss, plus l2 / 2 * |w|^2 and
    counterfactual / 2 * mean (pairs . w)^2, where a row of `pairs` is the difference of two feature vectors, met as many `times`."""
    n, k = x.shape
    m = times.sum()

    def pull(w: np.ndarray) -> np.ndarray:
        return counterfactual * pairs.turned_times(times * pairs.times(w)) / m if m else np.zeros(k)

    w = np.zeros(k + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    # a bound on the curvature: a quarter of the mean squared row, by power iteration
    v, top = np.ones(k + 1) / np.sqrt(k + 1), 1.0
    for _ in range(20):
        z = x.times(v[:-1]) + v[-1]
        g = np.append(x.turned_times(z), z.sum()) / (4 * n)
        g[:-1] += pull(v[:-1])
        top = max(float(np.linalg.norm(g)), 1e-9)
        v = g / top
    step = 1 / (1.1 * top + l2)
    ahead, was, t = w.copy(), w.copy(), 1.0
    for _ in range(rounds):
        r = (1 / (1 + np.exp(-np.clip(x.times(ahead[:-1]) + ahead[-1], -50, 50))) - y) / n
        g = np.append(x.turned_times(r) + l2 * ahead[:-1] + pull(ahead[:-1]), r.sum())
        w = ahead - step * g
        t, t0 = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, was = w + (t0 - 1) / t * (w - was), w
    return w


def train(
    docs: DataFrame, labels: DataFrame, max_rows: int = 20_000,
    least_z: float = 5.0, l2: float = 1e-5, counterfactual: float = 10.0, identities: Sequence[Sequence[str]] = IDENTITIES,
) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic): all label rows given may be used, so leave held-out ones away."""
    spark = docs.sparkSession
    ship(spark)
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # 16 bytes a row: its size is bounded
    text = docs.where("doc_id is not null").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = cut(text.join(F.broadcast(own), "doc_id").select("toxic", "text"))

    def tokens(batches):
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = list({f for w in set(_WORD.findall(t.lower())) for f in features(w)})
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(got), pa.array([y] * len(got), pa.int32())], ["feature", "toxic"])

    total, bad = (x or 0 for x in sample.agg(F.count("*"), F.sum("toxic")).first())
    if not 0 < bad < total:
        rate = min(max(bad / total if total else 0.0, 1e-12), 1 - 1e-12)
        return Model({}, float(np.log(rate / (1 - rate))))
    # how far apart the shares of toxic and of other rows with the feature are, in standard errors
    share, a, c = F.col("n") / total, F.col("a") / bad, (F.col("n") - F.col("a")) / (total - bad)
    z = F.abs(a - c) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / bad + 1 / (total - bad)))
    counts = sample.mapInArrow(tokens, "feature string, toxic int").groupBy("feature").agg(F.count("*").alias("n"), F.sum("toxic").alias("a")).where("n >= 4")
    chosen = [r[0] for r in counts.select("feature", z.alias("z")).where(F.col("z") >= least_z).orderBy(F.desc("z"), "feature").collect()]
    index = {f: k for k, f in enumerate(chosen)}
    reader = Model(dict.fromkeys(chosen, 0.0), 0.0)

    def vectors(batches):
        for b in batches:
            out = []
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out.append((y, sorted(index[f] for f in reader.present(t)), []))
                for s, other in swaps(t, identities):
                    one, two = reader.present(s), reader.present(other)
                    if one != two:
                        out.append((-1, sorted(index[f] for f in one - two), sorted(index[f] for f in two - one)))
            y, plus, minus = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(plus, pa.list_(pa.int32())), pa.array(minus, pa.list_(pa.int32()))], ["y", "plus", "minus"])

    rows = sample.mapInArrow(vectors, "y int, plus array<int>, minus array<int>")
    got = sorted(rows.where("y >= 0").collect())  # max_rows at most
    differ = sorted(rows.where("y < 0").groupBy("plus", "minus").agg(F.count("*").alias("times")).collect())  # as many as names and their stems differ

    def sparse(which) -> Rows:
        return Rows([r.plus for r in which], [r.minus for r in which], len(chosen))

    w = fit_logistic(sparse(got), np.array([r.y for r in got], float), sparse(differ), np.array([r.times for r in differ], float), l2, counterfactual)
    return Model(dict(zip(chosen, w[:-1].tolist(), strict=True)), float(w[-1]))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            s = [model.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], ["doc_id", "score", "predicted"])

    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, src.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema)
