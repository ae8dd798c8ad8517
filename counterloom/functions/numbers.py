"""Numeric text, unit conversion and rounding."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

_NUMBER_CHARACTERS = "0123456789+-.eE \t\r\n"
_INFINITY = float("inf")


def plain_double(text: Column) -> Column:
    """Decimal text, blanks around it allowed, as a double; other text as null.

    Spark's cast drops the blanks, but also takes type suffixes, hex floats and
    names such as NaN; only digits, signs, a point and an exponent may reach it.
    """
    plain = F.btrim(text, F.lit(_NUMBER_CHARACTERS)) == ""
    return F.when(plain, text.try_cast("double"))


def is_finite(value: Column) -> Column:
    return (value > -_INFINITY) & (value < _INFINITY)


def to_number(text: Column) -> Column:
    """Numeric text as a finite double, other text as null."""
    value = plain_double(text)
    return F.when(is_finite(value), value)


def is_byte_rate(metric: Column) -> Column:
    return F.contains(F.lower(metric), F.lit("bytes total/sec"))


def mbps_name(metric: Column) -> Column:
    return F.replace(metric, F.lit("Bytes"), F.lit("Mbps"))


def bytes_to_mbps(value: Column) -> Column:
    return value * 8 / 1_000_000


def round_half_even(value: Column) -> Column:
    """Whole numbers, ties to even, no negative zero."""
    return F.bround(value, 0) + F.lit(0.0)


# Sums of doubles in whole units of 2^-62, so that they do not depend on the order in
# which tasks and partial results are added. A value gives two whole numbers below
# 2^62, each added in two halves: a sum of longs is exact up to 2^32 rows.
_HALF = 31
_UNIT_BITS = 2 * _HALF
_LOW = (1 << _HALF) - 1
_DECIMAL = "decimal(38,0)"


def exact_units(value: Column) -> Column:
    """Aggregate: the sum in units of 2^-62 as a decimal; null if it needs more digits.

    Bits of a value below the unit are cut off, which touches only values under
    2^-9; a sum of 2^64 or more has no exact form.
    """
    size = F.abs(value)
    whole = F.floor(size)
    part = F.floor((size - whole) * float(1 << _UNIT_BITS))
    sign = F.when(value < 0, -1).otherwise(1).cast("long")
    inside = size < float(1 << _UNIT_BITS)

    def halves(number: Column) -> Column:
        high, low = F.shiftright(number, _HALF), number.bitwiseAND(F.lit(_LOW).cast("long"))
        high, low = (F.sum(F.when(inside, sign * half)).cast(_DECIMAL) for half in (high, low))
        return F.try_add(F.try_multiply(high, F.lit(1 << _HALF).cast("decimal(10,0)")), low)

    unit = F.lit(str(1 << _UNIT_BITS)).cast("decimal(19,0)")
    total = F.try_add(F.try_multiply(halves(whole), unit).cast(_DECIMAL), halves(part)).cast(_DECIMAL)
    return F.when(F.count(value) == F.count(F.when(inside, value)), total)


def units_to_double(units: Column) -> Column:
    return units.cast("double") / float(1 << _UNIT_BITS)


def exact_sum(value: Column) -> Column:
    """Aggregate: the sum of all values, the same in any order; rounded once."""
    return F.coalesce(units_to_double(exact_units(value)), F.sum(value))


def exact_mean(value: Column) -> Column:
    return exact_sum(value) / F.nullif(F.count(value), F.lit(0))


def merged_sum(units: Column, rough: Column, window: WindowSpec | None = None) -> Column:
    """Aggregate over partial sums: their exact units, or their doubles where one has none."""

    def of(aggregate: Column) -> Column:
        return aggregate if window is None else aggregate.over(window)

    whole = of(F.count(units)) == of(F.count(rough))
    exact = F.when(whole, units_to_double(of(F.try_sum(units))))
    return F.coalesce(exact, of(F.sum(rough)))
