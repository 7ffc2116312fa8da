"""Array, map and number functions: pure Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0).cast("double"), lambda s, x: s + x)


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(a), lambda x: x * x)))


def unit(a: Column) -> Column:
    """The vector of length 1; a zero vector stays as it is (ARR01)."""
    n = norm(a)
    return F.when(n > 0, F.transform(doubles(a), lambda x: x / n)).otherwise(doubles(a))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one has no length (ARR02)."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def fade(a: Column, rate: Column, ms: int) -> Column:
    """Linear fade in and out, over at most a third of the samples each (ARR03)."""
    n = F.size(a)
    k = F.least(F.floor(rate * ms / 1000.0).cast("int"), F.floor(n / 3).cast("int"))
    up = lambda i: F.when(k == 1, F.lit(0.0)).otherwise(i / (k - 1))
    down = lambda i: F.when(k == 1, F.lit(1.0)).otherwise(1 - i / (k - 1))

    def ramp(x: Column, i: Column) -> Column:
        return F.when(i < k, x * up(i)).when(i >= n - k, x * down(i - (n - k))).otherwise(x)

    return F.when(k <= 0, doubles(a)).otherwise(F.transform(doubles(a), ramp))


def silence(rate: Column, ms: Column) -> Column:
    """Zeros for so many milliseconds (ARR04)."""
    return F.array_repeat(F.lit(0.0), F.floor(rate * ms / 1000.0).cast("int"))


def quantise(a: Column) -> Column:
    """Clipped to [-1, 1] and truncated to 16 bits (ARR06)."""
    return F.transform(a, lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * 32767).cast("int"))


def pad(a: Column, size: Column, by: Column) -> Column:
    """Padded on the right (ARR07)."""
    return F.concat(a, F.array_repeat(by, F.greatest(size - F.size(a), F.lit(0))))


def trim_back(a: Column, tokens: Column, longest: Column) -> Column:
    """What ``tokens`` of ``longest`` tokens gave of a padded output: round(size / longest * tokens) samples, half to even (ARR07)."""
    return F.slice(a, F.lit(1), F.bround(F.size(a) / longest.cast("double") * tokens).cast("int"))


def channel_mean(*channels: Column) -> Column:
    """The mean of channels of equal length, sample by sample (SRC19)."""
    total = doubles(channels[0])
    for c in channels[1:]:
        total = F.zip_with(total, doubles(c), lambda x, y: x + y)
    return F.transform(total, lambda x: x / len(channels))


def loudness_scale(a: Column, target: float, most: float = 0.99) -> Column:
    """What to multiply with for a root mean square of ``target``, unless a peak would pass ``most`` (AGG25); 1 for silence."""
    return F.when(rms(a) > 0, F.least(F.lit(target) / rms(a), F.lit(most) / peak(a))).otherwise(1.0)


def positions(mask: Column) -> Column:
    """Places among the set entries of a 0/1 mask, 0 where unset (ARR08)."""
    sums = F.transform(mask, lambda m, i: F.aggregate(F.slice(mask, F.lit(1), i + 1), F.lit(0), lambda s, x: s + x))
    return F.zip_with(mask, sums, lambda m, s: F.when(m == 1, s - 1).otherwise(0))


def rms(a: Column) -> Column:
    """Root mean square; null for no samples."""
    return F.sqrt(F.try_divide(_sum(F.transform(doubles(a), lambda x: x * x)), F.size(a)))


def peak(a: Column) -> Column:
    return F.array_max(F.transform(doubles(a), F.abs))


def upper_median(a: Column) -> Column:
    """The middle, or the upper of the two middles, of an array (AGG03)."""
    return F.get(F.array_sort(a), F.floor(F.size(a) / 2).cast("int"))


def systematic(n: Column, k: Column) -> Column:
    """k indices spread over n, rounded half to even, each once (ORD05)."""
    at = F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda i: F.least(F.greatest(n - 1, F.lit(0)), F.bround(i * n / k).cast("int")))
    return F.when((n > 0) & (k > 0), F.array_sort(F.array_distinct(at)))


def spread_pages(first: Column, last: Column, want: int) -> Column:
    """Up to ``want`` pages, counted from 0, of the pages first..last counted from 1 (ORD06)."""
    total = last - first + 1
    some = F.transform(F.sequence(F.lit(0), F.lit(want - 1)), lambda i: first - 1 + F.floor(i * total / F.lit(float(want))).cast("int"))
    return F.when(total < 1, F.array().cast("array<int>")).when(total <= want, F.sequence(first - 1, last - 1)).otherwise(some)
