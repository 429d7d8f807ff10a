"""Precision-aware rounding of reported values, as decimal expressions that stay in the JVM."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two digits short of the widest decimal, so that differences keep all places.
VALUE = "decimal(36,10)"
#: Places that VALUE can be rounded to; further ones leave it as it is.
PLACES = range(-25, 10)
#: Places that most facts report; these have a rounding of their own, the rest share a slower one.
COMMON = (0, 2, -3, 1, 3, -6, 4)


def as_decimal(text: Column) -> Column:
    """A lexical value as a decimal; null where it is none."""
    return F.trim(text).try_cast(VALUE)


def rounded_to(value: Column, places: Column) -> Column:
    """value, half to even, at a number of decimal places that differs by row.

    Rounding functions want a literal number of places, and a branch for each place makes code that is too
    large to compile, so all but the common ones take the remainder by the place's unit from a constant array.
    """
    def unit(times: str) -> Column:
        return F.get(F.array(*(F.lit(f"{Decimal(times) * Decimal(10) ** -d:f}").cast(VALUE) for d in PLACES)), places - PLACES[0])

    rest = F.pmod(value, unit("1"))
    below = (value - rest).cast(VALUE)
    up = (rest > unit("0.5")) | ((rest == unit("0.5")) & (F.pmod(below, unit("2")) != 0))
    inside = F.when(up, (below + unit("1")).cast(VALUE)).otherwise(below)
    general = F.when(places.between(PLACES[0], PLACES[-1]), inside).otherwise(value)
    return reduce(lambda rest, d: F.when(places == d, F.bround(value, d).cast(VALUE)).otherwise(rest), reversed(COMMON), general)


#: accuracy(): values stay as they are; precisions lie from PRECISION on.
EXACT, PRECISION = 500, 1000


def accuracy(decimals: Column, precision: Column) -> Column:
    """decimals and precision as one int, which aggregates without objects: precision goes first, INF in either is exact."""
    p, d = F.trim(precision), F.trim(decimals)
    return (
        F.when(F.coalesce(p == "INF", F.lit(False)) | F.coalesce(d == "INF", F.lit(False)), EXACT)
        .when(F.coalesce(p != "", F.lit(False)), F.coalesce(p.try_cast("int"), F.lit(0)) + PRECISION)
        .otherwise(F.coalesce(d.try_cast("int"), F.lit(EXACT)))
    )


def round_accurately(value: Column, accurate: Column, magnitude_of: Column | None = None) -> Column:
    """A value rounded as its fact's accuracy asks; null (not a number) at precision 0.

    magnitude_of is the reported value where another one (a computed total) is rounded like it.
    """
    reported = value if magnitude_of is None else magnitude_of
    magnitude = F.floor(F.log10(F.abs(reported).cast("double"))).cast("int")
    places = F.when(accurate > PRECISION, accurate - PRECISION - magnitude - 1).otherwise(accurate)
    by_precision = accurate > PRECISION
    # a value or a reported value of zero has no magnitude
    return (
        F.when(accurate == EXACT, value)
        .when(accurate == PRECISION, F.lit(None).cast(VALUE))
        .when(by_precision & (value == 0), F.lit(0).cast(VALUE))
        .when(by_precision & (reported == 0), F.lit(None).cast(VALUE))
        .otherwise(rounded_to(value, F.coalesce(places, F.lit(EXACT))))
    )


def round_reported(value: Column, decimals: Column, precision: Column, magnitude_of: Column | None = None) -> Column:
    return round_accurately(value, accuracy(decimals, precision), magnitude_of)
