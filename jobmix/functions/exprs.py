"""Column expressions shared by the reports.  All are built-in functions, so
they stay inside whole-stage codegen."""

from __future__ import annotations

from decimal import Decimal
from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobmix.params import ALL

# SQL's 100.0 is a decimal literal; keeping the percentage in decimal until it
# is rounded gives half-up rounding of the exact quotient.
_HUNDRED = Decimal("100.0")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def multi_select(c, choices: Iterable[str]) -> Column:
    """Dashboard multi-select: ``All`` keeps everything, else membership.

    Resolved in Python, so an ``All`` choice adds no predicate at all and an
    empty list keeps nothing.
    """
    choices = list(choices)
    if ALL in choices:
        return F.lit(True)
    if not choices:
        return F.lit(False)
    return col(c).isin(choices)


def cond_count(pred: Column) -> Column:
    """``SUM(CASE WHEN pred THEN 1 ELSE 0 END)`` -- NULL (not 0) on empty input."""
    return F.sum(F.when(pred, F.lit(1)).otherwise(F.lit(0)))


def flag(pred: Column) -> Column:
    """``MAX(CASE WHEN pred THEN 1 ELSE 0 END)``: did any row satisfy ``pred``."""
    return F.max(F.when(pred, F.lit(1)).otherwise(F.lit(0)))


def pct(part, total, digits: int = 1) -> Column:
    """``ROUND(100.0 * part / NULLIF(total, 0), digits)`` as a double.

    Computed in decimal (as the SQL literal would be), rounded half-up, then
    cast to double for the caller.
    """
    quotient = F.try_divide(F.lit(_HUNDRED) * col(part).cast("decimal(20,0)"),
                            F.nullif(col(total), F.lit(0)).cast("decimal(20,0)"))
    return F.round(quotient, digits).cast("double")


def week_start(ts) -> Column:
    """Monday 00:00 of the week of ``ts`` (``date_trunc('WEEK', ts)``), as a date."""
    return F.date_trunc("week", col(ts)).cast("date")


def money(c, digits: int = 2) -> Column:
    """Round a decimal amount half-up and hand it out as a double."""
    return F.round(col(c), digits).cast("double")
