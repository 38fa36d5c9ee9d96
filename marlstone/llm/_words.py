"""Words, shingles and their 64-bit hashes, per text."""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Maximal runs without ASCII white space; bytes.split() cuts at just x20 and x09 to x0D."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_ascii(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def shingles(ws: list[bytes], k: int) -> list[bytes]:
    """All runs of k words joined by one space, repeats included; a shorter text gives its whole sequence, no word none."""
    if not ws:
        return []
    joined = b" ".join(ws)
    if len(ws) <= k:
        return [joined]
    sizes = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(sizes + 1) - 1
    return [joined[a:b] for a, b in zip((ends - sizes).tolist(), ends[k - 1 :].tolist(), strict=False)]


def hashes(items: list[bytes], seed: int = 42) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, seed) for x in items), np.uint64, len(items))
