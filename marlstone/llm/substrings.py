"""Repeated byte strings: removal of every byte covered by a string of `width` bytes that also starts earlier.

Super-k-mers of bytes bring equal strings together (see _superkmers). A bucket's super-k-mers are then indexed by a
Burrows-Wheeler transform, and breadth-first backward extension (Beller, Gog, Ohlebusch and Schnattinger, "Computing
the longest common prefix array based on the Burrows-Wheeler transform", 2013) derives common prefixes by increasing
value: from the interval of each string w it reaches the intervals of all c w, and the first interval to end before a
suffix sets that suffix's common prefix with its predecessor to the length of w. The expansion stops at the minimum
length: suffixes not reached by then share at least that many bytes with their predecessors. Rotations are sorted to
128 bytes only, by doubling, as intervals of strings up to the minimum length do not depend on more.

Super-k-mers of one minimiser that are too many to be indexed together are cut again, inside their bucket, by the
minimisers of longer runs, until what shares one is small enough; runs as long as a window leave equal windows only.

Order is by doc_id, then start. Strings are judged on the input; matches never cross documents. Nulls: a null text is
empty. Texts shorter than `width` keep all bytes. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._superkmers import _TABLE, NO_ID, Held, Job, by_byte, covered, first_of, run, super_kmers

#: Bytes indexed together.
INDEX = 1 << 20
#: Different super-k-mers of one minimiser, beyond one for each batch, from which windows are dealt one by one. A window sent alone
#: costs 141 bytes, 35 times a super-k-mer's share, so this follows what a task can hold (some 18 MB), not what is indexed together.
HOT = 100_000


def sorted_rotations(x: np.ndarray, depth: int) -> np.ndarray:
    """Order of the rotations of x by their first bytes, at least `depth` of them."""
    n = len(x)
    wide = np.concatenate([x, np.resize(x, 8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | wide[j : j + n]
    size = 8
    while True:
        order = np.argsort(key)
        k = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.append(0, k[1:] != k[:-1])).astype(np.uint64)
        if size >= depth or rank[order[-1]] == n - 1:
            return order
        key = (rank << np.uint64(32)) | np.roll(rank, -(size % n))
        size *= 2


def shares_prefix(bwt: np.ndarray, least: int) -> np.ndarray:
    """For each suffix in order, whether it has `least` or more bytes in common with the one before."""
    n = len(bwt)
    back = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int64)
    lf[back] = np.arange(n)
    same = bwt[back[1:]] == bwt[back[:-1]]
    before, after = np.full(n, -1), np.full(n, n)
    before[back[1:][same]] = back[:-1][same]
    after[back[:-1][same]] = back[1:][same]
    known = np.zeros(n + 1, bool)
    known[0] = True
    low, high = np.zeros(1, np.int64), np.full(1, n - 1)
    for _ in range(least):
        if not len(low):
            break
        size = high - low + 1
        ends = np.cumsum(size)
        at = np.repeat(low - (ends - size), size) + np.arange(ends[-1])
        first = before[at] < np.repeat(low, size)
        last = after[at] > np.repeat(high, size)
        # intervals of one level are disjoint, so their sorted first and last rows pair up
        low, high = np.sort(lf[at[first]]), np.sort(lf[at[last]])
        new = ~known[high + 1]
        low, high = low[new], high[new]
        known[high + 1] = True
    return ~known[:n]


def equal_windows(contents: list[bytes], windows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, content, offset) of every window of `width` bytes that equals another; windows: how many a content has."""
    size = np.fromiter(map(len, contents), np.int64, len(contents)) + 1
    x = np.frombuffer(b"\0".join([*contents, b""]), np.uint8)
    order = sorted_rotations(x, width + 1)
    bwt = x[order - 1]
    group = np.cumsum(~shares_prefix(bwt, width))
    owner = np.repeat(np.arange(len(contents)), size)
    offset = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)
    starts = offset < windows[owner]
    sel = starts[order]
    group, at = group[sel], order[sel]
    many = np.bincount(group)[group] > 1
    group, at = group[many], at[many]
    return group, owner[at], offset[at]


def finer(held: Held, width: int, k: int) -> tuple[np.ndarray, np.ndarray, Held]:
    """(row, offset, super-k-mers) of held contents cut by the minimisers of runs of k bytes."""
    parts = []
    ends = np.cumsum(np.fromiter(map(len, held.data), np.int64, len(held.data)))
    at = 0
    while at < len(ends):  # INDEX bytes at once
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + INDEX, "right")))
        raw = b"".join(held.data[at:to])
        end = ends[at:to] - (ends[at - 1] if at else 0)
        begin = np.append(0, end[:-1])
        r = super_kmers(_TABLE[np.frombuffer(raw, np.uint8)], begin, end, width, k)
        data = [raw[a:b] for a, b in zip(r.start.tolist(), (r.start + r.count + width - 1).tolist(), strict=True)]
        parts.append((at + r.doc, r.start - begin[r.doc], r.least, r.count, r.twice, data))
        at = to
    row, step, least, count, twice = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:-1])
    return row, step, Held([d for x in parts for d in x[-1]], least, held.id[row], held.rid[row], held.pos[row] + step, count, twice, held.batch[row])


def resolve_crowd(held: Held, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """resolve() for contents that share the minimiser of runs of fewer than k bytes."""
    row, step, cut = finer(held, width, k)
    later, first = first_of(cut.data, cut.id, cut.rid, cut.pos, True)
    n = cut.windows[later]
    each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    again, offset = resolve(cut.take(first), width, k)
    again = first[again]
    return np.concatenate([np.repeat(row[later], n), row[again]]), np.concatenate([np.repeat(step[later], n) + each, step[again] + offset])


def resolve(held: Held, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of windows that also start earlier, by (id, rid, place); minimisers are those of runs of k bytes."""
    code: dict[bytes, int] = {}
    content = np.fromiter((code.setdefault(d, len(code)) for d in held.data), np.int64, len(held.data))
    order = np.lexsort((content, held.key))
    key, content = held.key[order], content[order]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    differs = np.append(False, (key[1:] == key[:-1]) & (content[1:] != content[:-1]))[: len(key)] | held.twice[order]
    starts = np.flatnonzero(new)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    use = np.repeat(np.logical_or.reduceat(differs, starts), np.diff(np.append(starts, len(key))))
    rows = order[use]
    length = np.cumsum(np.fromiter((len(held.data[i]) + 1 for i in rows.tolist()), np.int64, len(rows)))
    heads = np.flatnonzero(np.append(True, np.diff(held.key[rows]) != 0)[: len(rows)])
    out_row, out_step = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(rows):  # whole minimisers, up to INDEX bytes
        limit = (length[at - 1] if at else 0) + INDEX
        ends = heads[(heads > at) & (length[np.maximum(heads - 1, 0)] <= limit)]
        end = int(ends[-1]) if len(ends) else int(heads[heads > at][0]) if (heads > at).any() else len(rows)
        if length[-1] <= limit:
            end = len(rows)
        own = rows[at:end]
        if k < width and length[end - 1] > limit:  # one minimiser with more than that
            who, step = resolve_crowd(held.take(own), width, (k + width + 1) // 2)
            out_row.append(own[who])
            out_step.append(step)
            at = end
            continue
        group, who, step = equal_windows([held.data[i] for i in own.tolist()], held.windows[own], width)
        who = own[who]
        i, r, p = held.id[who], held.rid[who], held.pos[who] + step
        o = np.lexsort((p, r, i, group))
        group, who, step, i, r, p = group[o], who[o], step[o], i[o], r[o], p[o]
        lead = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1])[: len(group)], np.arange(len(group)), 0)) if len(group) else o
        later = (i != i[lead]) | (r != r[lead]) | (p != p[lead])
        out_row.append(who[later])
        out_step.append(step[later])
        at = end
    return np.concatenate(out_row), np.concatenate(out_step)


def _finish(width: int):
    def finish(table: pa.Table, runs: dict, schema: pa.Schema) -> pa.Table:
        n_bytes, n_removed, n_spans, digest = [], [], [], []
        for i, r, data in zip(table["id"].to_pylist(), table["rid"].to_pylist(), table["data"], strict=True):
            data, own = data.as_py(), runs.get((NO_ID if i is None else i, r))
            gone = spans = 0
            kept = data
            if own:
                out = covered(len(data), own, width)
                gone, spans = int(out.sum()), int(out[0]) + int((out[1:] & ~out[:-1]).sum())
                kept = np.frombuffer(data, np.uint8)[~out].tobytes()
            n_bytes.append(len(data))
            n_removed.append(gone)
            n_spans.append(spans)
            digest.append(kept)
        return pa.table([table["id"].combine_chunks(), n_bytes, n_removed, n_spans, digest], schema=schema)

    return finish


def remove_repeats(docs: DataFrame, width: int = 100, k: int = 32, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept is the remaining bytes, which may cut a code point."""
    k = min(k, width)
    job = Job(width, k, by_byte, None, True, functools.partial(resolve, k=k), _finish(width), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return run(docs, job, **{"hot": HOT} | options)


def digests(docs: DataFrame, width: int = 100, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    plain = _finish(width)

    def finish(table, runs, schema):
        out = plain(table, runs, pa.schema([*list(schema)[:-1], ("kept", pa.binary())]))
        return pa.table([*out.columns[:-1], [hashlib.sha256(x.as_py()).hexdigest() for x in out["kept"]]], schema=schema)

    k = min(32, width)
    job = Job(width, k, by_byte, None, True, functools.partial(resolve, k=k), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return run(docs, job, **{"hot": HOT} | options)
