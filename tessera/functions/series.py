"""Time-series functions over a panel (symbol, date): pure Column -> Column, one window partitioning by symbol.

NULL is the only missing marker. Full windows give NULL until they hold n values; division by zero gives NULL."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

def S() -> WindowSpec:  # noqa: N802  made late: a window needs a session
    """A symbol's rows by date."""
    return Window.partitionBy("symbol").orderBy("date")


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rows(n: int) -> WindowSpec:
    return S().rowsBetween(1 - n, 0)


def full(x: Column | str, n: int, e: Column) -> Column:
    return F.when(F.count(c(x)).over(rows(n)) == n, e)


def at_least(x: Column | str, n: int, m: int, e: Column) -> Column:
    return F.when(F.count(c(x)).over(rows(n)) >= m, e)


def min_periods(window: int, floor: int = 5) -> int:
    return min(window, max(2, min(floor, window // 2)))


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def delay(x, n: int) -> Column:
    return F.lag(c(x), n).over(S())


def delta(x, n: int) -> Column:
    return c(x) - delay(x, n)


def ts_sum(x, n: int) -> Column:
    return full(x, n, F.sum(c(x)).over(rows(n)))


def ts_mean(x, n: int) -> Column:
    return full(x, n, F.avg(c(x)).over(rows(n)))


def ts_std(x, n: int) -> Column:
    return full(x, n, F.stddev_samp(c(x)).over(rows(n)))


def ts_max(x, n: int) -> Column:
    return full(x, n, F.max(c(x)).over(rows(n)))


def ts_min(x, n: int) -> Column:
    return full(x, n, F.min(c(x)).over(rows(n)))


def _held(x, n: int) -> Column:
    return F.collect_list(c(x)).over(rows(n))


def ts_rank(x, n: int) -> Column:
    """Average rank of the last value within its window, over n."""
    a = _held(x, n)
    last = F.element_at(a, -1)
    below, equal = F.size(F.filter(a, lambda v: v < last)), F.size(F.filter(a, lambda v: v == last))
    return full(x, n, (below + (equal + 1) / F.lit(2.0)) / F.lit(float(n)))


def ts_argmax(x, n: int) -> Column:
    """1-based place of the first maximum."""
    a = _held(x, n)
    return full(x, n, F.array_position(a, F.array_max(a)))


def ts_argmin(x, n: int) -> Column:
    a = _held(x, n)
    return full(x, n, F.array_position(a, F.array_min(a)))


def low_day(x, n: int) -> Column:
    """Rows since the latest minimum."""
    a = _held(x, n)
    return full(x, n, F.array_position(F.reverse(a), F.array_min(a)) - 1)


def high_day(x, n: int) -> Column:
    a = _held(x, n)
    return full(x, n, F.array_position(F.reverse(a), F.array_max(a)) - 1)


def product(x, n: int) -> Column:
    return full(x, n, F.aggregate(_held(x, n), F.lit(1.0), lambda a, v: a * v))


def pairwise(x, y) -> tuple[Column, Column]:
    both = c(x).isNotNull() & c(y).isNotNull()
    return F.when(both, c(x)), F.when(both, c(y))


def corr_over(x, y, w: WindowSpec) -> Column:
    """Pearson correlation by moments; NULL for a constant side."""
    x, y = pairwise(x, y)
    return div(F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w))


def ts_corr(x, y, n: int) -> Column:
    """Rolling correlation; 0 where it is not defined but the window is full."""
    p, _ = pairwise(x, y)
    return full(p, n, F.coalesce(corr_over(x, y, rows(n)), F.lit(0.0)))


def ts_cov(x, y, n: int) -> Column:
    p, _ = pairwise(x, y)
    return full(p, n, F.covar_samp(*pairwise(x, y)).over(rows(n)))


def weighted(x, weights: list[float]) -> Column:
    """Sum of the last len(weights) values, oldest first, by weights; NULL if one is missing."""
    n = len(weights)
    return sum((delay(x, n - 1 - i) if i < n - 1 else c(x)) * F.lit(w) for i, w in enumerate(weights)) / F.lit(sum(weights))


def decay_linear(x, n: int) -> Column:
    return weighted(x, [float(i + 1) for i in range(n)])


def wma(x, n: int) -> Column:
    return weighted(x, [0.9 ** (n - 1 - i) for i in range(n)])


def slope(x, n: int, place: str = "n") -> Column:
    """Least-squares slope of x on its row number, full window."""
    return full(x, n, F.regr_slope(c(x), F.when(c(x).isNotNull(), F.col(place).cast("double"))).over(rows(n)))


def count_if(cond: Column, n: int) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).over(rows(n))


def sum_if(x, n: int, cond: Column) -> Column:
    return F.sum(F.when(cond, c(x)).otherwise(0.0)).over(rows(n))


def returns(x) -> Column:
    return div(c(x), delay(x, 1)) - 1


def skew(x, n: int, m: int) -> Column:
    """Bias-corrected skewness."""
    k = F.count(c(x)).over(rows(n)).cast("double")
    return F.when((k >= max(3, m)) & (F.stddev_pop(c(x)).over(rows(n)) > 0), F.skewness(c(x)).over(rows(n)) * F.sqrt(k * (k - 1)) / (k - 2))


def kurt(x, n: int, m: int) -> Column:
    """Bias-corrected excess kurtosis."""
    k = F.count(c(x)).over(rows(n)).cast("double")
    return F.when((k >= max(4, m)) & (F.stddev_pop(c(x)).over(rows(n)) > 0), (k - 1) / ((k - 2) * (k - 3)) * ((k + 1) * F.kurtosis(c(x)).over(rows(n)) + 6))


def tidy(x) -> Column:
    """Six decimals, with the boundary off natural ties, so that sums that differ in the last bit agree."""
    return F.floor(c(x) * F.lit(1e6) + F.lit(0.50037)) / F.lit(1e6)
