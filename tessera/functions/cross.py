"""Cross-sectional functions: one window per date."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .series import c, div

def D():  # noqa: N802  made late: a window needs a session
    """A date's rows."""
    return Window.partitionBy("date")


def rank(x, *by: str) -> Column:
    """Average-tie percentile rank in (0, 1] over non-null values of a date (and of further columns)."""
    x = c(x)
    w = Window.partitionBy("date", *by)
    ordered = w.orderBy(x.asc_nulls_last())
    ties = F.count(F.lit(1)).over(Window.partitionBy("date", *by, x))
    return F.when(x.isNotNull(), (F.rank().over(ordered) + (ties - 1) / F.lit(2.0)) / F.count(x).over(w))


def scale(x, k: float = 1.0) -> Column:
    return div(c(x) * F.lit(k), F.sum(F.abs(c(x))).over(D()))


def row_max(x) -> Column:
    return F.max(c(x)).over(D())


def row_min(x) -> Column:
    return F.min(c(x)).over(D())


def z(x, ddof: int = 1) -> Column:
    sd = (F.stddev_samp if ddof else F.stddev_pop)(c(x)).over(D())
    return div(c(x) - F.avg(c(x)).over(D()), sd)


def demean(x, *by: str) -> Column:
    return c(x) - F.avg(c(x)).over(Window.partitionBy("date", *by))


def median(x) -> Column:
    return F.percentile(c(x), F.lit(0.5)).over(D())


def sign(x) -> Column:
    return F.signum(c(x))


def log(x) -> Column:
    return F.when(c(x) > 0, F.ln(c(x)))


def emax(x, y) -> Column:
    return F.when(c(x).isNotNull() & c(y).isNotNull(), F.greatest(c(x), c(y)))


def emin(x, y) -> Column:
    return F.when(c(x).isNotNull() & c(y).isNotNull(), F.least(c(x), c(y)))
