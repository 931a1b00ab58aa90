"""Scalar functions with IEEE results where SQL would fail or give null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INF, NAN = float("inf"), float("nan")


def num(x) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def truth(condition: Column) -> Column:
    """1.0 where the condition holds, else 0.0; an unknown one does not hold."""
    return F.when(condition, 1.0).otherwise(0.0)


def divide(a, b) -> Column:
    a, b = num(a), num(b)
    # The quotient is only formed where the divisor is not zero.
    zero = F.when(F.isnan(a) | (a == 0), NAN).when(a > 0, INF).otherwise(-INF)
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def remainder(a, b) -> Column:
    a, b = num(a), num(b)
    return F.when(b == 0, NAN).otherwise(a % F.when(b == 0, 1.0).otherwise(b))


def log(x) -> Column:
    x = num(x)
    return F.when(x == 0, -INF).when((x < 0) | F.isnan(x), NAN).otherwise(F.ln(x))


def round_half_up(x, digits) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits, so halves go towards plus infinity."""
    scale = F.pow(F.lit(10.0), num(digits))
    return F.floor(num(x) * scale + 0.5).cast("double") / scale


def larger(a, b) -> Column:
    a, b = num(a), num(b)
    return F.when(F.isnan(a) | F.isnan(b), b).when(a > b, a).otherwise(b)


def smaller(a, b) -> Column:
    a, b = num(a), num(b)
    return F.when(F.isnan(a) | F.isnan(b), b).when(a < b, a).otherwise(b)


def both(a, b) -> Column:
    return truth((num(a) != 0) & (num(b) != 0))


def either(a, b) -> Column:
    return truth((num(a) != 0) | (num(b) != 0))


def negated(a) -> Column:
    return truth(num(a) == 0)


def choose(condition, then, otherwise) -> Column:
    return F.when(num(condition) != 0, num(then)).otherwise(num(otherwise))


def holds(x) -> Column:
    """A condition given as a number: true from 0.5."""
    return num(x) >= 0.5


def instant(millis: Column) -> Column:
    return F.timestamp_millis(millis.cast("long"))


def seconds(m: Column) -> Column:
    return F.second(instant(m)).cast("double")


def minutes(m: Column) -> Column:
    return F.minute(instant(m)).cast("double")


def hours(m: Column) -> Column:
    return F.hour(instant(m)).cast("double")


def day(m: Column) -> Column:
    return F.dayofmonth(instant(m)).cast("double")


def month(m: Column) -> Column:
    """January is 0."""
    return (F.month(instant(m)) - 1).cast("double")


def year(m: Column) -> Column:
    return F.year(instant(m)).cast("double")


def day_of_week(m: Column) -> Column:
    """Sunday is 0."""
    return (F.dayofweek(instant(m)) - 1).cast("double")


def array_remove_first(array: Column, value) -> Column:
    """The array without the first occurrence of a value."""
    at = F.array_position(array, value)
    return F.when(at > 0, F.concat(F.slice(array, F.lit(1), (at - 1).cast("int")), F.slice(array, (at + 1).cast("int"), F.size(array)))).otherwise(array)
