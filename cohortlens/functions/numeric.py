"""Small numeric column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(value) -> Column:
    if isinstance(value, str):
        return F.col(value)
    return value if isinstance(value, Column) else F.lit(value)


def r6(value) -> Column:
    """Six decimals, halves away from zero, in plain double arithmetic.

    ``F.round`` on a double goes through BigDecimal per row; this stays in generated code.  For report values (scores,
    rates, axes), which are far below 9e12.
    """
    c = column(value).cast("double")
    return F.signum(c) * F.floor(F.abs(c) * 1e6 + 0.5) / 1e6


def clamp(value: Column, low: float, high: float) -> Column:
    """``greatest`` and ``least`` skip nulls, so a null value has to be kept apart."""
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def rescale(value: Column, low: float, high: float) -> Column:
    """[low, high] to [-1, 1], clamped; an empty interval gives 0."""
    if high <= low:
        return F.when(value.isNotNull(), F.lit(0.0))
    return clamp((value - low) / (high - low) * 2.0 - 1.0, -1.0, 1.0)


def mean_of(*values: Column) -> Column:
    return reduce(lambda a, b: a + b, values) / len(values)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives null for a zero denominator (ANSI mode would raise)."""
    return numerator / F.nullif(denominator, F.lit(0))


def labels(*pairs: tuple[Column, str]) -> Column:
    """Array of the labels whose condition holds, in the order given."""
    return F.filter(F.array(*[F.when(cond, F.lit(text)) for cond, text in pairs]), lambda x: x.isNotNull())


def labels_or(default: str, *pairs: tuple[Column, str]) -> Column:
    """As ``labels``; a single ``default`` when none holds."""
    found = labels(*pairs)
    return F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found)


def pick(*pairs: tuple[Column, object], otherwise=None) -> Column:
    """First value whose condition holds."""
    head, *rest = pairs
    chain = F.when(head[0], column_or_literal(head[1]))
    for cond, value in rest:
        chain = chain.when(cond, column_or_literal(value))
    return chain.otherwise(column_or_literal(otherwise))


def column_or_literal(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def sum_known(*values: Column) -> Column:
    """Sum of the non-null values; null if all are null."""
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0)) for v in values])
    return F.when(F.coalesce(*values).isNotNull(), total)
