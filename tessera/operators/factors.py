"""The factor grammar: base signal x transform x window, as Column expressions over staged bars."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import cross, series
from tessera.functions.series import S, at_least, div, min_periods, rows

#: Per window norm, lag, smooth, skip, fast, slow.
PARAMS = {5: (20, 1, 3, 5, 3, 5), 7: (20, 1, 3, 5, 3, 7), 10: (20, 2, 3, 5, 3, 10), 14: (28, 2, 4, 5, 4, 14)}


def fold(df: DataFrame, value: str, alpha: float, out: str) -> DataFrame:
    """Recursive mean y = (1 - alpha) y + alpha x per symbol, from the first non-null x; NULL before it. One pass over a
    symbol's rows, which one task holds as two columns."""

    def smooth(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("date")
        return t[["symbol", "date"]].assign(y=t["x"].ewm(alpha=alpha, adjust=False, ignore_na=True).mean())

    kinds = dict(df.dtypes)
    done = df.select("symbol", "date", F.col(value).alias("x")).groupBy("symbol").applyInPandas(smooth, f"symbol {kinds['symbol']}, date {kinds['date']}, y double")
    return df.join(done.withColumnRenamed("y", out), ["symbol", "date"])


def mean(x, w: int) -> Column:
    return at_least(x, w, min_periods(w), F.avg(series.c(x)).over(rows(w)))


def sd(x, w: int) -> Column:
    return at_least(x, w, min_periods(w), F.stddev_pop(series.c(x)).over(rows(w)))


def pct_rank(x, w: int) -> Column:
    """Average rank of the last value among the window's valid values, less a half."""
    a = F.collect_list(series.c(x)).over(rows(w))
    below, equal = F.size(F.filter(a, lambda v: v < series.c(x))), F.size(F.filter(a, lambda v: v == series.c(x)))
    return F.when(series.c(x).isNotNull(), at_least(x, w, min_periods(w), (below + (equal + 1) / F.lit(2.0)) / F.size(a) - F.lit(0.5)))


def base(df: DataFrame, name: str, w: int = 5) -> DataFrame:
    """Staged bars with column `value` for a base signal."""
    norm, lag, smooth, skip, fast, slow = PARAMS[w]
    m = min_periods(w)
    c, v = F.col("close"), F.col("volume")
    hi = at_least("high", w, m, F.max("high").over(rows(w)))
    lo = at_least("low", w, m, F.min("low").over(rows(w)))
    simple = {
        "return": lambda: div(c, F.lag("close", w).over(S())) - 1,
        "skip_return": lambda: div(F.lag("close", skip).over(S()), F.lag("close", skip + w).over(S())) - 1,
        "reversal": lambda: -(div(c, F.lag("close", w).over(S())) - 1),
        "sma_gap": lambda: div(c, mean("close", w)) - 1,
        "range_position": lambda: div(c - lo, hi - lo) - 0.5,
        "stoch": lambda: div(c - lo, hi - lo) - 0.5,
        "breakout": lambda: div(c, at_least("ph", w, m, F.max("ph").over(rows(w)))) - 1,
        "breakdown": lambda: -(div(c, at_least("pl", w, m, F.min("pl").over(rows(w)))) - 1),
        "atr_ratio": lambda: div(mean("tr", w), c),
        "range_ratio": lambda: mean("hl", w),
        "realized_vol": lambda: sd("ret", w),
        "downside_vol": lambda: sd("down", w),
        "trend_strength": lambda: div(div(c, F.lag("close", w).over(S())) - 1, sd("ret", w)),
        "efficiency": lambda: div(F.abs(c - F.lag("close", w).over(S())), at_least("absd", w, m, F.sum("absd").over(rows(w)))),
        "volume_ratio": lambda: div(v, mean("volume", w)) - 1,
        "volume_z": lambda: div(v - mean("volume", w), sd("volume", w)),
        "dollar_volume": lambda: div(F.col("cv"), mean("cv", w)) - 1,
        "price_volume_corr": lambda: at_least(series.pairwise("ret", "dv")[0], w, m, series.corr_over("ret", "dv", rows(w))),
        "gap_sum": lambda: at_least("gap", w, m, F.sum("gap").over(rows(w))),
        "intraday": lambda: mean("oc", w),
        "upper_wick": lambda: mean("up", w),
        "lower_wick": lambda: mean("dn", w),
        "drawdown": lambda: div(c, at_least("close", w, m, F.max("close").over(rows(w)))) - 1,
        "ts_rank_close": lambda: pct_rank("close", w),
        "ts_rank_volume": lambda: pct_rank("volume", w),
        "ret_skew": lambda: series.skew("ret", w, min_periods(w, 10)),
        "ret_kurt": lambda: series.kurt("ret", w, min_periods(w, 10)),
    }
    if name in simple:
        return df.withColumn("value", simple[name]())
    if name == "ema_gap":
        return fold(df, "close", 2 / (w + 1), "e").withColumn("value", F.when(F.col("n") >= m, div(c, F.col("e")) - 1))
    if name == "dual_ema_gap":
        both = fold(fold(df, "close", 2 / (fast + 1), "e"), "close", 2 / (slow + 1), "g")
        return both.withColumn("value", F.when(F.col("n") >= max(min_periods(fast), min_periods(slow)), div(F.col("e") - F.col("g"), c)))
    if name in ("rsi", "rsi_reversal"):
        both = fold(fold(df.withColumn("gain", F.when(F.col("pc").isNotNull(), F.col("gain"))).withColumn("loss", F.when(F.col("pc").isNotNull(), F.col("loss"))), "gain", 1 / w, "e"), "loss", 1 / w, "g")
        rsi = F.when(F.col("n") > m, div(F.col("e"), F.col("e") + F.col("g"))) - 0.5
        return both.withColumn("value", rsi if name == "rsi" else -rsi)
    if name == "sma_slope":
        k = min(30, max(5, w // 2))
        return df.withColumn("sma", mean("close", w)).withColumn("value", div(series.slope("sma", k), c))
    if name == "obv_slope":
        obv = df.withColumn("obv", F.sum(F.coalesce("flow", F.lit(0.0))).over(S().rowsBetween(Window.unboundedPreceding, 0)))
        return obv.withColumn("value", div(series.slope("obv", min(w, 60)), mean("volume", w)))
    raise ValueError(f"unknown base {name}")


BASES = "return skip_return reversal sma_gap ema_gap dual_ema_gap sma_slope range_position breakout breakdown rsi rsi_reversal stoch atr_ratio range_ratio realized_vol downside_vol trend_strength efficiency volume_ratio volume_z dollar_volume price_volume_corr obv_slope gap_sum intraday upper_wick lower_wick drawdown ts_rank_close ts_rank_volume ret_skew ret_kurt".split()
TRANSFORMS = "raw neg z delta smooth rank vol_scaled stability confirm_volume compress".split()


def transform(df: DataFrame, name: str, w: int = 5) -> DataFrame:
    """`value` turned by a transform."""
    norm, lag, smooth, *_ = PARAMS[w]
    x = F.col("value")
    simple = {
        "raw": lambda: x,
        "neg": lambda: -x,
        "z": lambda: div(x - mean("value", norm), sd("value", norm)),
        "delta": lambda: x - F.lag("value", lag).over(S()),
        "rank": lambda: pct_rank("value", norm),
        "vol_scaled": lambda: div(x, sd("ret", norm)),
        "stability": lambda: div(x, sd("value", norm)),
        "confirm_volume": lambda: x * div(F.col("volume"), mean("volume", norm)),
        "compress": lambda: F.tanh(x),
    }
    if name == "smooth":
        seen = F.count("value").over(S().rowsBetween(Window.unboundedPreceding, 0))
        return fold(df, "value", 2 / (smooth + 1), "e").withColumn("k", seen).withColumn("value", F.when(F.col("k") >= min_periods(smooth, 3), F.col("e")))
    return df.withColumn("value", simple[name]())


def factor(df: DataFrame, spec: tuple[str, str, int]) -> DataFrame:
    """(base, transform, window) -> staged bars with `value`."""
    return transform(base(df, spec[0], spec[2]), spec[1], spec[2])


def signals(df: DataFrame, quantile: float = 0.8) -> DataFrame:
    """Per-date percentile rank, long at or over the quantile, short at or under its complement, and what changes."""
    ranked = df.withColumn("pct", cross.rank("value"))
    side = F.when(F.col("pct") >= quantile, 1).when(F.col("pct") <= 1 - quantile, -1).otherwise(0)
    held = ranked.withColumn("signal", side).withColumn("position", F.coalesce(F.lag("signal").over(S()), F.lit(0)))
    action = F.when(F.col("signal") > F.col("position"), "buy").when(F.col("signal") < F.col("position"), "sell").otherwise("hold")
    return held.withColumn("exit", (F.col("position") != 0) & (F.col("signal") == 0)).withColumn("action", action)
