"""Edit distances and name similarity that Spark lacks, as vectorised functions."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro_winkler(a: str, b: str, always: bool = False) -> float:
    """Jaro similarity with a bonus for up to four equal first letters.

    The bonus is given over a Jaro similarity of 0.7 only, or ``always``; half transpositions count down when not
    ``always``.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [b[j] for j in range(len(b)) if used[j]]
    t = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    t = t if always else int(t)
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    same = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + same * 0.1 * (1 - jaro) if always or jaro > 0.7 else jaro


def typo_distance(a: str, b: str) -> int:
    """Least number of insertions, deletions, substitutions and swaps of neighbours, no part edited twice."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row, older = row, [i], before
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        before = last
    return row[-1]


@F.pandas_udf(T.DoubleType())
def jaro_winkler_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.IntegerType())
def typo_distance_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else typo_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def name_score(a: str, b: str) -> float:
    """0.55 of the mean best likeness of the words of ``a`` and 0.45 of that of the whole, ``a`` as it is or turned round."""
    words = [max(jaro_winkler(x, y) for y in b.split(" ")) for x in a.split(" ")]
    turned = " ".join(reversed(a.split(" ")))
    return 0.55 * sum(words) / len(words) + 0.45 * max(jaro_winkler(a, b), jaro_winkler(turned, b))


def sequence_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


@F.pandas_udf(T.DoubleType())
def name_score_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else name_score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def sequence_ratio_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else sequence_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
