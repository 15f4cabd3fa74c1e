"""Spectra and scores as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All bands, and the ranges that water absorbs (ends excluded).
BANDS = 425
WATER = ((192, 210), (283, 315), (419, 425))
FALSE_COLOUR = (16, 54, 112)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def drop_water(bands) -> Column:
    """Without the water bands."""
    wet = lambda i: ((i >= WATER[0][0]) & (i < WATER[0][1])) | ((i >= WATER[1][0]) & (i < WATER[1][1])) | ((i >= WATER[2][0]) & (i < WATER[2][1]))
    return F.filter(F.slice(_c(bands), 1, BANDS), lambda v, i: ~wet(i))


def pick_bands(bands, positions=FALSE_COLOUR) -> Column:
    """Bands at places counted from 0."""
    return F.array(*[F.get(_c(bands), F.lit(p)) for p in positions])


def pick_band(bands, number: int) -> Column:
    """One band by a number counted from 1, as a small integer."""
    return F.try_element_at(_c(bands), F.lit(number)).cast("smallint")


def trim(bands, cut: int = 10) -> Column:
    """Without ``cut`` bands at each end, if there are more than 3."""
    b = _c(bands)
    return F.when(F.size(b) > 3, F.slice(b, cut + 1, F.greatest(F.size(b) - 2 * cut, F.lit(0)))).otherwise(b)


def min_max(bands) -> Column:
    """Scaled to 0..1 within the row; flat rows are 0."""
    b = _c(bands)
    low, high = F.array_min(b), F.array_max(b)
    return F.transform(b, lambda v: F.when(high > low, (v - low) / (high - low)).otherwise(F.lit(0.0)))


def resize(rows, size: int) -> Column:
    """Nearest neighbour of an array of rows: source index floor(k * n / size)."""
    pick = lambda a: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.get(a, F.floor(k * F.size(a) / size).cast("int")))
    return F.transform(pick(_c(rows)), pick)


def flip(rows) -> Column:
    """Both directions reversed."""
    return F.transform(F.reverse(_c(rows)), lambda r: F.reverse(r))


def normalise(bands, means, deviations) -> Column:
    """Each channel less its mean over its deviation."""
    pairs = F.arrays_zip(F.lit(list(map(float, means))).alias("m"), F.lit(list(map(float, deviations))).alias("s"))
    return F.zip_with(_c(bands), pairs, lambda v, p: (v - p["m"]) / p["s"])


def fill_missing(bands, size: int) -> Column:
    """Zeros where a year has no spectrum."""
    return F.coalesce(_c(bands), F.array_repeat(F.lit(0.0), size))


def softmax(scores) -> Column:
    """Shifted by the largest score."""
    s = F.transform(_c(scores), lambda v: F.exp(v.cast("double") - F.array_max(_c(scores)).cast("double")))
    return F.transform(s, lambda v: v / F.aggregate(s, F.lit(0.0), lambda a, b: a + b))


def argmax(scores) -> Column:
    """Place of the largest score from 0; the first on ties."""
    return (F.array_position(_c(scores), F.array_max(_c(scores))) - 1).cast("int")


def ranked(scores) -> Column:
    """(score, index) from the best down; ties by the smaller index."""
    pairs = F.transform(_c(scores), lambda v, i: F.struct((-v).alias("k"), i.alias("index"), v.alias("score")))
    return F.transform(F.array_sort(pairs), lambda p: F.struct(p["score"].alias("score"), p["index"].alias("index")))


def normalise_row(values) -> Column:
    """Each value over the row's sum; null for a sum of zero."""
    total = F.aggregate(_c(values), F.lit(0.0), lambda a, b: a + b)
    return F.transform(_c(values), lambda v: F.when(total != 0, v / total))


def all_finite(values) -> Column:
    """no NaN and no infinity."""
    return F.forall(_c(values), lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))


def one_hot(label, classes: int) -> Column:
    """Truth as zeros and a one."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == _c(label)).cast("int"))


def cumulative(values) -> Column:
    """Running sums of an array."""
    return F.aggregate(_c(values), F.array().cast("array<double>"), lambda acc, v: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + v)))
