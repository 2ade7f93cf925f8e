"""Column functions. All stay inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(x: Column, y: Column, to: tuple) -> Column:
    """Straight-line distance from (x, y) to a point of numbers or columns."""
    dx, dy = x - to[0], y - to[1]
    return F.sqrt(dx * dx + dy * dy)


def within(x: Column, y: Column, base: tuple, radius: float) -> Column:
    return distance(x, y, base) <= F.lit(float(radius))


def seconds(ms: Column) -> Column:
    """Milliseconds to seconds as double; a plain 1000.0 would make a decimal."""
    return ms / F.lit(1000).cast("double")


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, null when b is zero or null."""
    return a / F.nullif(b, F.lit(0).cast("double"))


def diff_quotient(now: Column, before: Column, t_now: Column, t_before: Column,
                  undefined: Column) -> Column:
    """Change per second between two samples.

    ``undefined`` is the value when the earlier sample is missing or is the same
    instant; pass a null or a zero of type double.
    """
    quotient = (now - before) / F.nullif(seconds(t_now - t_before), F.lit(0).cast("double"))
    return F.when(t_before.isNull() | (t_now == t_before), undefined).otherwise(quotient)


def to_int(text: Column) -> Column:
    """Text to int; anything but an optionally signed run of digits is null."""
    return F.when(text.rlike("^-?[0-9]+$"), text.try_cast("int"))


def known(text: Column) -> Column:
    """Text with the 'NA' marker turned into null."""
    return F.nullif(text, F.lit("NA"))


def pad3(code: Column) -> Column:
    """Zeros on the left up to three characters; longer text is left alone."""
    return F.when(F.length(code) < 3, F.lpad(code, 3, "0")).otherwise(code)


def title_label(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def has_features(all_present=(), any_present=()) -> Column:
    """Every column of the first list and some column of the second is not null."""
    tests = [F.col(c).isNotNull() for c in all_present]
    if any_present:
        tests.append(any_of(F.col(c).isNotNull() for c in any_present))
    return all_of(tests)


def max_if(value: Column, condition: Column) -> Column:
    return F.max(F.when(condition, value))


def rate(condition: Column) -> Column:
    """Share of rows for which the condition holds."""
    return F.avg(condition.cast("double"))
