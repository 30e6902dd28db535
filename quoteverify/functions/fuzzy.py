"""Similarity of strings: Indel ratios from bit-parallel longest common subsequences, as Arrow functions.

Spark's own ``levenshtein`` covers edit distance; these two have no counterpart in the JVM. They are meant for few rows a
query, after an index has chosen candidates.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


@lru_cache(maxsize=4096)
def _places(text: str) -> dict[str, int]:
    """For each character the set of its places, as bits."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: one machine word operation set for each character of b."""
    if not a or not b:
        return 0
    places, full = _places(a), (1 << len(a)) - 1
    open_ = full
    for c in b:
        hit = open_ & places.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


def _prefix_lengths(a: str, b: str) -> list[int]:
    """``common_length(a, b[:k])`` for k = 1, 2, …, all in one pass."""
    places, full, out = _places(a), (1 << len(a)) - 1, []
    open_ = full
    for c in b:
        if hit := open_ & places.get(c, 0):
            open_ = ((open_ + hit) | (open_ - hit)) & full
        out.append(len(a) - open_.bit_count())
    return out


def ratio(a: str, b: str) -> float:
    """100 * twice the common subsequence over both lengths; 100 for two empty strings."""
    total = len(a) + len(b)
    return 200.0 * common_length(a, b) / total if total else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with any window of the longer one of at most its length; windows at both
    ends may be shorter.

    A window has no more in common than a longer text that holds it, so windows that end before such a text beats the best
    so far are jumped over; a first coarse pass makes that best high. All windows count, none is left to chance."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0 if b else 100.0
    if a in b:
        return 100.0
    best = _best_window(a, b)
    return max(best, _best_window(b, a)) if len(a) == len(b) else best


def _best_window(a: str, b: str) -> float:
    n, last = len(a), len(b) - len(a)
    places, full = _places(a), (1 << n) - 1
    longest = max(common_length(a, b[s : s + n]) for s in (*range(0, last + 1, max(1, n // 4)), last))
    start = 0
    while start <= last:
        open_ = full
        for c in b[start : start + n]:
            if hit := open_ & places.get(c, 0):
                open_ = ((open_ + hit) | (open_ - hit)) & full
        longest = max(longest, n - open_.bit_count())
        end = start + n
        for c in b[end:]:
            if hit := open_ & places.get(c, 0):
                open_ = ((open_ + hit) | (open_ - hit)) & full
                if n - open_.bit_count() > longest:
                    break
            end += 1
        start = end - n + 1
    best = 100.0 * longest / n
    for k, common in enumerate(_prefix_lengths(a, b[: n - 1]), 1):
        best = max(best, 200.0 * common / (n + k))
    for k, common in enumerate(_prefix_lengths(a[::-1], b[: -n : -1]), 1):
        best = max(best, 200.0 * common / (n + k))
    return best


#: Windows that are met at once.
WINDOWS = 1 << 15


def partial_ratios(pairs: list[tuple[str, str] | None]) -> list[float | None]:
    """``partial_ratio`` of each pair. Pairs whose shorter strings have the same length, of a machine word at most, are met
    together: one operation goes over the windows of all of them."""
    out: list[float | None] = [None] * len(pairs)
    by_size: dict[int, list[tuple[int, str, str]]] = {}
    for row, pair in enumerate(pairs):
        if pair is None:
            continue
        a, b = sorted(pair, key=len)
        if not a or len(a) > 64 or a in b:
            out[row] = partial_ratio(a, b)
            continue
        of_size = by_size.setdefault(len(a), [])
        of_size.append((row, a, b))
        if len(a) == len(b):
            of_size.append((row, b, a))
    for n, of_size in by_size.items():
        at = 0
        while at < len(of_size):
            to, many = at, 0
            while to < len(of_size) and many < WINDOWS:
                many += len(of_size[to][2]) + n - 1
                to += 1
            for (row, _, _), best in zip(of_size[at:to], _best_windows(n, of_size[at:to])):
                out[row] = max(out[row] or 0.0, best)
            at = to
    return out


def _best_windows(n: int, rows: list[tuple[int, str, str]]) -> list[float]:
    """The best ratio of each a, all of length n, with a window of its b. The places of b's characters in a lie in one line,
    with so many empty ones around each b that every window of n meets one b alone, or its first or last characters."""
    gap, places, covered, begin = [0] * (n - 1), [], [], [0]
    for _, a, b in rows:
        of_a = _places(a)
        places += gap
        places += [of_a.get(c, 0) for c in b]
        start = np.arange(1 - n, len(b))
        covered.append(np.minimum(start + n, len(b)) - np.maximum(start, 0))
        begin.append(begin[-1] + len(start))
    line = np.array(places + gap, np.uint64)
    open_ = np.full(begin[-1], (1 << n) - 1, np.uint64)
    hit, more = np.empty_like(open_), np.empty_like(open_)
    for t in range(n):
        np.bitwise_and(open_, line[t : t + len(open_)], out=hit)
        np.add(open_, hit, out=more)
        np.subtract(open_, hit, out=open_)
        np.bitwise_or(open_, more, out=open_)
    common = n - np.bitwise_count(open_ & np.uint64((1 << n) - 1)).astype(np.int64)
    return np.maximum.reduceat(200.0 * common / (n + np.concatenate(covered)), begin[:-1]).tolist()


def _each(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


def fuzz_ratio(a: Column, b: Column) -> Column:
    return pandas_udf(_each(ratio), "double")(a, b)


def fuzz_partial_ratio(a: Column, b: Column) -> Column:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(partial_ratios([None if x is None or y is None else (x, y) for x, y in zip(a, b)]), dtype="float64")

    return pandas_udf(run, "double")(a, b)


def close_words(a: Column, b: Column) -> Column:
    """Edit distance of at most 1 for words of up to 5 letters, else 2."""
    return F.levenshtein(a, b) <= F.when(F.length(b) <= 5, 1).otherwise(2)


def edits_allowed(word: Column) -> Column:
    """0 below 3 letters, 1 up to 5, else 2."""
    return F.when(F.length(word) < 3, 0).when(F.length(word) <= 5, 1).otherwise(2)
