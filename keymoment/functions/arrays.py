"""Array and mathematical column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def deviation(a: Column) -> Column:
    """Population standard deviation."""
    return F.element_at(F.transform(F.array(mean(a)), lambda m: F.sqrt(total(F.transform(a, lambda x: (x - m) * (x - m))) / F.size(a))), 1)


def sigmoid(x: Column, most: float = 50.0) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-most)), F.lit(most))))


def softmax(a: Column, temperature: float = 1.0) -> Column:
    e = F.element_at(F.transform(F.array(F.array_max(a)), lambda m: F.transform(a, lambda x: F.exp((x - m) / temperature))), 1)
    return F.element_at(F.transform(F.array(e), lambda y: F.element_at(F.transform(F.array(total(y)), lambda t: F.transform(y, lambda x: x / t)), 1)), 1)


def quantise(x: Column, step: float = 1e-9) -> Column:
    return F.floor(x / step + 0.5) * step


def entropy_of(p: Column) -> Column:
    """Entropy of probabilities, as a share of the largest possible."""
    h = total(F.transform(p, lambda x: F.when(x > 0, -x * F.log(x)).otherwise(0.0)))
    return F.when(F.size(p) > 1, h / F.log(F.size(p))).otherwise(0.0)


def harmonic(a: Column, b: Column) -> Column:
    return F.when(a + b <= 1e-12, 0.0).otherwise(2 * a * b / (a + b))


def argmax(a: Column) -> Column:
    """Place of the first largest element, from 0."""
    return F.array_position(a, F.array_max(a)) - 1


def distinct_in_order(a: Column) -> Column:
    return F.array_distinct(a)


def gaussian(x: Column, centre: Column, sigma: float) -> Column:
    return F.exp(-0.5 * ((x - centre) / sigma) * ((x - centre) / sigma))


def round_binary(x: Column, places: int) -> Column:
    """x at a number of decimal places, to the nearest by x's exact binary value, exact halves to the even digit; for |x| * 10 ** places under 2 ** 50.

    The distance from the half is computed without error: x's upper 24 bits and its rest times a power of ten up to 10 ** 6 are exact doubles.
    """
    if not 0 <= places <= 6:
        raise ValueError("places must be from 0 to 6")
    by = float(10**places)
    a = F.abs(x)
    high = a.cast("float").cast("double")
    low = F.floor(a * by).cast("double")
    above = (high * by - (low + 0.5)) + (a - high) * by
    up = F.when(above > 0, 1.0).when(above < 0, 0.0).otherwise(low % 2)
    return F.signum(x) * (low + up) / by


def sharpness(pixels: Column, width: int) -> Column:
    """Population variance of the size of the Laplacian at the inner pixels of a picture of rows of a width, row by row in one array; null without inner pixels."""
    n = F.size(pixels)
    inner = F.filter(F.sequence(F.lit(width), F.greatest(n - width - 1, F.lit(width))), lambda p: (p < n - width) & (p % width > 0) & (p % width < width - 1))
    at = lambda p: F.get(pixels, p)
    edges = F.transform(inner, lambda p: F.abs(at(p - width) + at(p + width) + at(p - 1) + at(p + 1) - 4 * at(p)))
    return F.when(F.size(edges) > 0, F.pow(deviation(edges), F.lit(2.0)))
