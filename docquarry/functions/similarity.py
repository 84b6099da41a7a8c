"""Pairwise similarity of texts and of images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from docquarry.functions.pixels import resize
from docquarry.functions.text import space_tokens


def places(text: str) -> dict[str, int]:
    """Where each character stands, as the bits of an integer."""
    at: dict[str, int] = {}
    for i, c in enumerate(text):
        at[c] = at.get(c, 0) | 1 << i
    return at


def lcs_length(a: str, b: str, at: dict[str, int] | None = None) -> int:
    """Longest common subsequence, bit-parallel over one big integer for each character of b; at: places(a)."""
    at = places(a) if at is None else at
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        hit = free & at.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def indel(a: str, b: str, at: dict[str, int] | None = None) -> float:
    total = len(a) + len(b)
    return 2 * lcs_length(a, b, at) / total if total else 1.0


def winkler(a: str, b: str, at: dict[str, int] | None = None) -> float:
    """Jaro-Winkler; a character's partner is the lowest free bit in its reach; at: places(b)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    at = places(b) if at is None else at
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    window, free = (1 << 2 * reach + 1) - 1, (1 << len(b)) - 1
    left, taken = [], []
    for i, c in enumerate(a):
        hit = at.get(c, 0) & free & (window << i >> reach)
        if hit:
            low = hit & -hit
            free ^= low
            left.append(c)
            taken.append(low)
    if not left:
        return 0.0
    taken.sort()
    swaps = sum(x != b[low.bit_length() - 1] for x, low in zip(left, taken)) // 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


@pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * longest common subsequence / both lengths."""
    return pd.Series([None if x is None or y is None else indel(x, y) for x, y in zip(a, b)], dtype=float)


@pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler with weight 0.1 on up to four prefix characters, from a Jaro of 0.7 on."""
    return pd.Series([None if x is None or y is None else winkler(x, y) for x, y in zip(a, b)], dtype=float)


def char_dice(a: Column, b: Column) -> Column:
    """2 * common characters, with multiplicity, / both lengths."""
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    common = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(times(a, c), times(b, c))))
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2 * common / total)


def token_jaccard(a: Column, b: Column) -> Column:
    """Of distinct space-separated tokens; 1 for two empty texts, 0 for one."""
    x, y = space_tokens(a), space_tokens(b)
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / both)


def hash_bits(values: Column) -> Column:
    """64-bit perceptual hash of 64 numbers: bit i says that number i is above the median."""
    ordered = F.array_sort(values.cast("array<double>"))
    median = (F.element_at(ordered, 32) + F.element_at(ordered, 33)) / 2
    bits = F.transform(values.cast("array<double>"), lambda x, i: F.when(x > median, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda h, b: h.bitwiseOR(b))


def hash_similarity(a: Column, b: Column) -> Column:
    """1 - differing bits / 64; 0 if a hash is missing."""
    return F.coalesce(1 - F.bit_count(a.bitwiseXOR(b)) / 64, F.lit(0.0))


def ssim(a: np.ndarray, b: np.ndarray, window: int = 7) -> float:
    """Mean structural similarity of two grey images (0 to 255), or of one and the other's negative if that is more.

    Images of different sizes are brought to the lesser height and width by area."""
    h, w = min(a.shape[0], b.shape[0]), min(a.shape[1], b.shape[1])
    if min(h, w) < window:
        return 0.0
    a, b = (resize(x, w, h, "area").astype(float) for x in (a, b))

    def mean(x):
        s = np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return (s[window:, window:] - s[:-window, window:] - s[window:, :-window] + s[:-window, :-window]) / window**2

    def score(x, y):
        n = window**2 / (window**2 - 1)
        mx, my = mean(x), mean(y)
        vx, vy, vxy = n * (mean(x * x) - mx * mx), n * (mean(y * y) - my * my), n * (mean(x * y) - mx * my)
        c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
        return float((((2 * mx * my + c1) * (2 * vxy + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean())

    best = max(score(a, b), score(a, 255 - b))
    return 0.0 if np.isnan(best) else min(1.0, max(0.0, best))


@pandas_udf(T.DoubleType())
def grid_ssim(a: pd.Series, b: pd.Series) -> pd.Series:
    """:func:`ssim` of two square grids given as flat arrays."""
    out = []
    for x, y in zip(a, b):
        side = int(len(x) ** 0.5)
        out.append(ssim(np.asarray(x).reshape(side, side), np.asarray(y).reshape(side, side)))
    return pd.Series(out, dtype=float)


def feature_thresholds(shortest: Column) -> tuple[Column, Column]:
    """(least key points, least matches) by the shortest image side; a pair takes the lesser of its two."""
    step = lambda a, b, c: F.when(shortest < 120, a).when(shortest < 180, b).otherwise(c)
    return step(8, 12, 20), step(4, 6, 10)
