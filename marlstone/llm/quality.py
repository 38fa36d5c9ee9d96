"""Quality rules as weak supervision.

Each rule votes good (1) or bad (0) on a document, or abstains. An expectation-maximisation fit of a two-class model
with independent rules estimates how each rule votes on good and on bad documents, and a document's posterior
probability of being good replaces the demand that it pass every rule. The fit sees all documents: they are counted by
their pattern of votes on the executors, and the number of patterns depends on the number of rules only.

Words are maximal runs without ASCII white space. A null or empty text has no word. Repeated rows count each.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import cut, ship
from ._words import words

SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_distinct")
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_MARKS = bytes(b for b in range(33, 127) if not bytes([b]).isalnum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts named in STATS: lines are those with a word, a duplicate equals an earlier one, n_repeat_words lie in
    3-word windows found twice or more, letters and marks are ASCII, n_distinct counts different words."""
    ws = words(text)
    if not ws:
        return (0,) * len(STATS)
    raw = b"".join(ws)
    symbols = sum(raw.count(c) for c in SYMBOLS)
    seen: set[str] = set()
    lines = dup_lines = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            lines += 1
            dup_lines += line in seen
            seen.add(line)
    repeat = 0
    n = len(ws)
    code: dict[bytes, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in ws), np.int64, n)
    if n >= 4:
        if len(code) < 1 << 21:
            win = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
        else:  # three ids no longer fit one integer: number the pairs first
            _, pairs = np.unique(ids[:-1] * len(code) + ids[1:], return_inverse=True)
            win = pairs[:-1] * len(code) + ids[2:]
        order = np.argsort(win, kind="stable")
        same = win[order[1:]] == win[order[:-1]]
        twice = np.zeros(len(win), bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        cover = np.zeros(n, bool)
        for k in range(3):
            cover[k : k + len(win)] |= twice
        repeat = int(cover.sum())
    bare = len(raw.translate(None, b"".join(bytes([b]) for b in range(128, 192))))  # bytes that start a code point
    upper, letters, marks = (len(raw) - len(raw.translate(None, x)) for x in (_UPPER, _LETTERS, _MARKS))
    return n, bare, symbols, dup_lines, repeat, lines, upper, letters, marks, len(code)


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType(), False) for c in STATS]))
def _counts(texts: pa.Array) -> pa.Array:
    got = [text_stats(x) for x in texts.to_pylist()]
    cols = list(zip(*got, strict=True)) if got else [()] * len(STATS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], list(STATS))


def with_stats(docs: DataFrame) -> DataFrame:
    """Each row of `docs` as the struct `row`, and its counts. Python gets the text and gives integers; the row itself
    stays where it is."""
    ship(docs.sparkSession)
    return docs.select(F.struct(*docs.columns).alias("row"), _counts(F.col("text").cast("string")).alias("_s")).select("row", "_s.*")


@dataclass(frozen=True)
class Rule:
    """bad and good are conditions over the counts; neither met: it abstains; both met: bad."""

    name: str
    bad: Column
    good: Column


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules() -> list[Rule]:
    c, n, letters = F.col, F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_letters"), F.lit(1))
    symbols, length = c("n_symbols") / n, c("word_chars") / n
    return [
        Rule("symbols", symbols > 0.25, symbols < 0.05),
        Rule("marks", c("n_marks") / n > 0.45, c("n_marks") / n < 0.3),
        Rule("mark_share", c("n_marks") / F.greatest(c("word_chars"), F.lit(1)) > 0.08, c("n_marks") / F.greatest(c("word_chars"), F.lit(1)) < 0.05),
        Rule("capitals", c("n_upper") / letters > 0.3, c("n_upper") / letters < 0.15),
        Rule("word_length", (length > 15) | (length < 2), F.lit(False)),
        Rule("repeats", c("n_repeat_words") / n > 0.25, F.lit(False)),
        Rule("lines", c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)) > 0.4, F.lit(False)),
        Rule("variety", c("n_distinct") / n < 0.1, F.lit(False)),
    ]


def _vote(rule: Rule) -> Column:
    return F.when(rule.bad, 0).when(rule.good, 1).otherwise(2)


@dataclass(frozen=True)
class Fit:
    """prior: share of good documents. vote[rule, class, vote]: chances of bad, good and no vote; class 1 is good."""

    prior: float
    vote: np.ndarray

    def log_odds(self) -> np.ndarray:
        return np.log(self.vote[:, 1]) - np.log(self.vote[:, 0])


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, smooth: float = 1.0) -> Fit:
    """EM over patterns (patterns x rules of 0, 1, 2) that occur `counts` times.

    It starts from the belief that a bad vote weighs more than a good one, which also settles which class is the good
    one. `smooth` is added to each count, so no vote is impossible in a class.
    """
    bad, good = (patterns == 0).sum(1), (patterns == 1).sum(1)
    q = 1 / (1 + np.exp(-np.clip(1.0 + 0.5 * good - 4.0 * bad, -30, 30)))
    hot = np.stack([patterns == v for v in range(3)], 2).astype(float)
    was = None
    for _ in range(rounds):
        w = np.stack([counts * (1 - q), counts * q])
        vote = np.einsum("cp,pjv->jcv", w, hot) + smooth
        vote /= vote.sum(2, keepdims=True)
        prior = (w[1].sum() + smooth) / (counts.sum() + 2 * smooth)
        logs = np.einsum("pjv,jcv->pc", hot, np.log(vote)) + np.log([1 - prior, prior])
        q = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))
        if was is not None and np.abs(q - was).max(initial=0) < 1e-9:
            break
        was = q
    return Fit(float(prior), vote)


def fit_rules(stats: DataFrame, rules: Sequence[Rule]) -> Fit:
    """Fit over all rows of `stats`; what reaches the driver is one count per pattern, 3 ** len(rules) at most."""
    got = stats.groupBy(*(_vote(r).alias(f"v{k}") for k, r in enumerate(rules))).count().collect()
    table = np.array([tuple(r) for r in got], np.int64).reshape(-1, len(rules) + 1)
    table = table[np.lexsort(table.T)]  # the order of the rows must not show in the last digits
    return fit(table[:, :-1], table[:, -1].astype(float))


def probability(found: Fit, rules: Sequence[Rule]) -> Column:
    """Posterior chance that a row with the counts of STATS is good, from built-in functions."""
    odds = F.lit(float(np.log(found.prior / (1 - found.prior))))
    for r, w in zip(rules, found.log_odds().tolist(), strict=True):
        odds = odds + F.when(r.bad, w[0]).when(r.good, w[1]).otherwise(w[2])
    return 1 / (1 + F.exp(-odds))


def _verdict(found: Fit, rules: Sequence[Rule], least: float) -> Column:
    return ~base_failed() & (probability(found, rules) >= least)


def judge(docs: DataFrame, rules: Callable[[], list[Rule]] = default_rules, least: float = 0.5) -> DataFrame:
    """(doc_id, the counts of STATS, base_failed, probability, kept) of every row."""
    own = rules()
    stats = cut(with_stats(docs.select("doc_id", "text")).select("row.doc_id", *STATS))
    found = fit_rules(stats, own)
    return stats.select("doc_id", *STATS, base_failed().alias("base_failed"), probability(found, own).alias("probability"), _verdict(found, own, least).alias("kept"))


def keep_good(docs: DataFrame, rules: Callable[[], list[Rule]] = default_rules, least: float = 0.5) -> DataFrame:
    """The rows of `docs` that pass, with all their columns. The counts are made twice, so that no text is stored,
    shuffled or sent back from Python."""
    own = rules()
    found = fit_rules(with_stats(docs.select("text")).select(*STATS), own)
    return with_stats(docs).where(_verdict(found, own, least)).select("row.*")
