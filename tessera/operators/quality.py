"""Audits: each returns findings as rows and never raises on bad data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bar_audit(bars: DataFrame, expected: int, key: str = "symbol", time: str = "ts", row: str = "row_id") -> DataFrame:
    """Intraday bars: order inversions in input order, duplicates, gaps over 1.5 x expected seconds, broken OHLC."""
    by_row, by_time = Window.partitionBy(key).orderBy(row), Window.partitionBy(key).orderBy(time, row)
    step = F.unix_timestamp(time) - F.unix_timestamp(F.lag(time).over(by_time))
    x = bars.withColumns({"inversion": F.col(time) < F.lag(time).over(by_row), "duplicate": step == 0, "gap": step > 1.5 * expected})
    ids = ("inversion", "duplicate", "gap")
    return x.groupBy(key).agg(*(F.sum(F.coalesce(F.col(i), F.lit(False)).cast("long")).alias(i) for i in ids))


def adjustment_audit(a: DataFrame, tolerance: float = 0.02, jump: float = 0.4) -> DataFrame:
    """(symbol, date, close, adj_close, split_factor, cash_dividend): raw return after actions against the adjusted."""
    w = Window.partitionBy("symbol").orderBy("date")
    raw = F.try_divide(F.col("close") * F.coalesce("split_factor", F.lit(1.0)) + F.coalesce("cash_dividend", F.lit(0.0)), F.lag("close").over(w)) - 1
    adj = F.try_divide("adj_close", F.lag("adj_close").over(w)) - 1
    x = a.withColumns({"raw": raw, "adj": adj})
    finding = F.when(F.abs(F.col("raw") - F.col("adj")) > tolerance, "adjusted_return_mismatch").when(F.abs("adj") > jump, "jump")
    return x.withColumn("finding", finding).filter("finding is not null")


def single_quarter(y: DataFrame, value: str) -> DataFrame:
    """Year-to-date figures -> quarter, trailing four quarters and the same quarter a year ago; q is the ordinal
    year * 4 + quarter - 1, and a missing neighbour gives NULL."""
    w = Window.partitionBy("symbol").orderBy("q")
    before = F.when(F.lag("q").over(w) == F.col("q") - 1, F.lag(value).over(w))
    x = y.withColumn("single", F.when(F.col("q") % 4 == 0, F.col(value)).otherwise(F.col(value) - before))
    four = Window.partitionBy("symbol").orderBy("q").rangeBetween(-3, 0)
    x = x.withColumn("ttm", F.when(F.count("single").over(four) == 4, F.sum("single").over(four)))
    return x.withColumn("year_ago", F.when(F.lag("q", 4).over(w) == F.col("q") - 4, F.lag("single", 4).over(w)))


def no_rollback(reports: DataFrame) -> DataFrame:
    """Rows that carry the newest period known so far: a late report of an older one changes nothing."""
    w = Window.partitionBy("symbol").orderBy("available", "q").rowsBetween(Window.unboundedPreceding, 0)
    return reports.withColumn("newest", F.max("q").over(w)).withColumn("state", F.last(F.when(F.col("q") == F.col("newest"), F.col("value")), ignorenulls=True).over(w))


def universe(u: DataFrame) -> DataFrame:
    """Members of each date (dates without any included) and the mean return that survivors hide."""
    inside = (F.col("eligible") == "1") & (F.col("date") >= F.col("listed_at")) & (F.col("delisted_at").isNull() | (F.col("date") <= F.col("delisted_at")))
    return u.groupBy("date").agg(F.array_sort(F.collect_list(F.when(inside, F.col("symbol")))).alias("members"), F.avg(F.when(inside, F.col("return") - F.coalesce("delisting_return", "return"))).alias("bias"))


def panel_findings(p: DataFrame) -> DataFrame:
    """Point-in-time rows: malformed dates, availability not after disclosure or after the as-of date, repeated keys."""
    ok = lambda n: F.col(n).rlike(r"^\d{8}$")
    repeated = F.count("*").over(Window.partitionBy("symbol", "quarter", "as_of")) > 1
    tests = {"bad_date": ~(ok("disclosed") & ok("available") & ok("as_of")), "early": F.col("available") <= F.col("disclosed"), "future": F.col("available") > F.col("as_of"), "repeated": F.col("_repeated")}
    return p.withColumn("_repeated", repeated).select("symbol", "quarter", F.explode(F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())))).alias("finding"))


def kline_rules(b: DataFrame) -> DataFrame:
    """One row of shares: complete rows, sane OHLC, non-negative volume, changes over 25 %."""
    share = lambda e: F.avg(e.cast("double"))
    sane = (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close"))
    return b.agg(share(F.expr("open is not null and close is not null")).alias("complete"), share(sane).alias("ohlc"), share(F.col("volume") >= 0).alias("volume"), share(F.coalesce(F.abs("ret") > 0.25, F.lit(False))).alias("jumps"))


def f_score(t: DataFrame) -> DataFrame:
    """Nine-point score of (roa, cfo, droa, accrual, dleverage, dliquidity, issued, dmargin, dturnover)."""
    marks = ["roa > 0", "cfo > 0", "droa > 0", "cfo > roa", "dleverage < 0", "dliquidity > 0", "issued <= 0", "dmargin > 0", "dturnover > 0"]
    return t.withColumn("f_score", sum(F.when(F.expr(m), 1).otherwise(0) for m in marks))


def ratios(f: DataFrame) -> DataFrame:
    """Fundamental ratios of (price_cap, net_income, book, revenue, cash_flow, gross_profit, assets, debt)."""
    r = {"ep": ("net_income", "price_cap"), "bp": ("book", "price_cap"), "sp": ("revenue", "price_cap"), "cp": ("cash_flow", "price_cap"), "gpa": ("gross_profit", "assets"), "roe": ("net_income", "book"), "roa": ("net_income", "assets"), "margin": ("net_income", "revenue"), "leverage": ("debt", "assets"), "cash_quality": ("cash_flow", "net_income")}
    x = f.withColumns({n: F.try_divide(a, b) for n, (a, b) in r.items()})
    return x.withColumn("accruals", F.try_divide(F.col("net_income") - F.col("cash_flow"), F.col("assets")))
