"""Repeated runs of words: removal of every word covered by a window that also starts in an earlier document.

Super-k-mers of words bring equal windows together (see _superkmers): each travels as one packed string to its
minimiser's bucket, where sorting its windows counts them exactly. A window counts as repeated in a document when a
document with a smaller doc_id has it too; windows are judged on the input. Words are maximal runs without ASCII white
space, taken as they are. Nulls: a null text has no word. Rows equal in id are one document. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._superkmers import NO_ID, Held, Job, by_word, covered, run


def resolve(held: Held, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of windows that a row with a smaller id has too."""
    order = np.argsort(held.key, kind="stable")
    key, ids = held.key[order], held.id[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)
    rows = order[np.repeat(mixed, np.diff(np.append(starts, len(key))))]
    wins, row, step = [], [], []
    for i in rows.tolist():
        data, n = held.data[i], int(held.windows[i])
        x = np.frombuffer(data, np.uint8)
        gaps = np.flatnonzero(x == 32)
        begin, end = np.append(0, gaps + 1)[:n].tolist(), np.append(gaps, len(x))[width - 1 :].tolist()
        wins += [data[a:b] for a, b in zip(begin, end, strict=True)]
        row += [i] * n
        step += range(n)
    sort = sorted(range(len(wins)), key=wins.__getitem__)
    out = []
    at = 0
    while at < len(sort):
        end, w = at + 1, wins[sort[at]]
        while end < len(sort) and wins[sort[end]] == w:
            end += 1
        if end > at + 1:
            least = min(held.id[row[j]] for j in sort[at:end])
            out += [j for j in sort[at:end] if held.id[row[j]] != least]
        at = end
    out = np.array(out, np.int64)
    return np.array(row, np.int64)[out], np.array(step, np.int64)[out]


def _finish(width: int, digest: bool):
    def finish(table: pa.Table, runs: dict, schema: pa.Schema) -> pa.Table:
        n_words, n_removed, kept = [], [], []
        for i, r, data in zip(table["id"].to_pylist(), table["rid"].to_pylist(), table["data"], strict=True):
            ws, own = data.as_py().split(), runs.get((NO_ID if i is None else i, r))
            n_words.append(len(ws))
            if own:
                gone = covered(len(ws), own, width).tolist()
                ws = [w for w, g in zip(ws, gone, strict=True) if not g]
            n_removed.append(n_words[-1] - len(ws))
            text = b" ".join(ws)
            kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace"))
        return pa.table([table["id"].combine_chunks(), n_words, n_removed, kept], schema=schema)

    return finish


def remove_repeats(docs: DataFrame, width: int = 13, k: int = 4, digest: bool = False, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words joined by one space, or with `digest` their SHA-256 as kept_sha256."""
    last = "kept_sha256" if digest else "kept"
    job = Job(width, min(k, width), by_word, "words", False, resolve, _finish(width, digest), f"doc_id long, n_words long, n_removed long, {last} string")
    return run(docs, job, **options)


#: DuckDB: the query op9, over the view documents.
SQL = """
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
hit as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as f from win) where f < doc_id),
gone as (select distinct doc_id, i + k as p from hit, range(0, 13) t(k)),
words as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d),
kept as (select words.doc_id, string_agg(x, ' ' order by words.p) as s, count(*) as n from words anti join gone on words.doc_id = gone.doc_id and words.p = gone.p group by words.doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(s, '')) as kept_sha256
from d left join kept on d.doc_id = kept.doc_id
"""
