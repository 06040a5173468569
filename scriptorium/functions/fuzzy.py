"""Fuzzy containment: how well the shorter text matches its best window in the longer one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

GRAM = 3
#: Below this length all windows are looked at.
SHORT = 32
#: Places where windows are tried: those with the most runs of GRAM characters in common.
PLACES = 32


def common_length(masks: dict[str, int], size: int, window: str) -> int:
    """Length of the longest common subsequence with a text of ``size`` characters, whose places by character are the bits of ``masks``. A step for each character of the window, on integers of ``size`` bits."""
    full = (1 << size) - 1
    v = full
    for c in window:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def _grams(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    out = np.zeros(max(0, len(x) - GRAM + 1), dtype=np.uint64)
    for k in range(GRAM):
        out = (out << np.uint64(21)) | x[k : len(out) + k]  # exact: a character has 21 bits
    return out


def _places(short: str, long: str) -> np.ndarray:
    """Starts of windows where the texts' runs line up, by how many do so within a few characters."""
    a, b = _grams(short), _grams(long)
    order = np.argsort(a, kind="stable")
    lo, hi = np.searchsorted(a[order], b), np.searchsorted(a[order], b, side="right")
    n = hi - lo
    at = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    shift, votes = np.unique(np.repeat(np.arange(len(b)), n) - order[at], return_counts=True)
    if not len(shift):
        return np.zeros(1, dtype=np.int64)
    # dropped and added characters move the runs that follow
    near = max(4, len(short) // 16)
    upto = np.r_[0, np.cumsum(votes)]
    around = upto[np.searchsorted(shift, shift + near, side="right")] - upto[np.searchsorted(shift, shift - near)]
    best = np.lexsort((shift, -votes, -around))[:PLACES]
    return np.unique(np.clip(shift[best], 0, len(long) - len(short)))


def partial_ratio_of(a: str | None, b: str | None) -> float:
    """0 to 100: greatest share of the shorter text that it has in common, in order, with a window of its length in the longer one. Windows are tried where runs of three characters line up; of short texts, everywhere."""
    if not a or not b:
        return 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return 100.0
    size = len(short)
    masks: dict[str, int] = {}
    for i, c in enumerate(short):
        masks[c] = masks.get(c, 0) | 1 << i
    places = range(len(long) - size + 1) if size < SHORT else _places(short, long).tolist()
    return 100 * max(common_length(masks, size, long[p : p + size]) for p in places) / size


def partial_ratio(a: str, b: str) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([partial_ratio_of(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)
