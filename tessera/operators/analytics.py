"""Evaluation, portfolio, risk and validation analytics over the long panel."""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tessera.functions import cross
from tessera.functions.series import S, div, pairwise, rows
from tessera.sources.panel import checkpointed


def corr(x: str | Column, y: str | Column) -> Column:
    """Aggregate Pearson correlation over pairs; NULL for a constant side."""
    a, b = pairwise(x, y)
    return div(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def forward_return(df: DataFrame, h: int, kind: str = "raw") -> DataFrame:
    """open[t + 1 + h] / open[t + 1] - 1; market_neutral: less the date's mean; rank: centred percentile rank."""
    out = df.withColumn("fwd", div(F.lead("open", 1 + h).over(S()), F.lead("open", 1).over(S())) - 1)
    if kind == "market_neutral":
        return out.withColumn("fwd", cross.demean("fwd"))
    return out.withColumn("fwd", cross.rank("fwd") - 0.5) if kind == "rank" else out


def daily_ic(df: DataFrame, *by: str, least: int = 8) -> DataFrame:
    """Per date (and group): Pearson and rank IC of value against fwd over rows that have both, counts over `least`."""
    both = df.filter("value is not null and fwd is not null")
    ranked = both.withColumn("rv", cross.rank("value", *by)).withColumn("rf", cross.rank("fwd", *by))
    return ranked.groupBy("date", *by).agg(corr("value", "fwd").alias("ic"), corr("rv", "rf").alias("rank_ic"), F.count("*").alias("n")).filter(F.col("n") >= least)


def ic_by_horizon(df: DataFrame, horizons: tuple[int, ...], exact=lambda x: x, least: int = 8) -> DataFrame:
    """(horizon, date, ic) of `value` against the returns over each horizon: one scan, one window and one aggregate for
    all horizons; `exact` turns values and returns before they are correlated."""
    names = {h: f"fwd{h}" for h in horizons}
    first = F.lead("open", 1).over(S())
    d = df.withColumns({n: div(F.lead("open", 1 + h).over(S()), first) - 1 for h, n in names.items()}).select("date", exact("value").alias("value"), *(exact(n).alias(n) for n in names.values()))
    both = lambda n: F.count(F.when(F.col("value").isNotNull(), F.col(n)))
    wide = d.groupBy("date").agg(*(F.when(both(n) >= least, corr("value", n)).alias(str(h)) for h, n in names.items()))
    return wide.unpivot("date", [str(h) for h in horizons], "horizon", "ic").select(F.col("horizon").cast("int"), "date", "ic")


def half_life_interval(ic: DataFrame, block: int = 20, draws: int = 500, level: float = 0.95, seed: int = 7) -> tuple[float, float, float] | None:
    """Half-life of exponential decay of |mean IC| over horizons, with a moving-block bootstrap interval over dates.
    (horizon, date, ic) reaches the driver as a row per date; dates that lack a horizon go. Draws that do not decay count
    as infinite; None where there are fewer dates than a block or fewer than two horizons."""
    rows = ic.groupBy("date").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("horizon", "ic")))).alias("m")).orderBy("date").collect()
    places = sorted({h for r in rows for h in r["m"]})
    held = np.array([[r["m"][h] for h in places] for r in rows if all(r["m"].get(h) is not None for h in places)], float)
    if len(held) < block or len(places) < 2:
        return None
    x = np.array(places, float) - np.mean(places)
    rng = np.random.default_rng(seed)
    found = []
    for draw in range(draws + 1):
        starts = rng.integers(0, len(held) - block + 1, -(-len(held) // block))
        pick = np.arange(len(held)) if draw == 0 else (starts[:, None] + np.arange(block)).ravel()[: len(held)]
        rate = float(x @ np.log(np.maximum(np.abs(held[pick].mean(axis=0)), 1e-12)) / (x @ x))
        found.append(math.log(2) / -rate if rate < 0 else math.inf)
    low, high = np.sort(found[1:])[[int(draws * (1 - level) / 2), min(draws - 1, int(draws * (1 + level) / 2))]]
    return found[0], float(low), float(high)


def summary(ic: DataFrame, h: int = 5, *by: str) -> DataFrame:
    m, s = F.avg("ic"), F.stddev_samp("ic")
    return ic.groupBy(*by).agg(m.alias("ic_mean"), s.alias("ic_std"), (div(m, s) * math.sqrt(252 / h)).alias("icir"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"), F.count("ic").alias("dates"))


def buckets(df: DataFrame, q: int) -> DataFrame:
    """(lo, hi] buckets of the per-date percentile rank."""
    return df.filter("value is not null and fwd is not null").withColumn("bucket", F.ceil(cross.rank("value") * q).cast("int"))


def turnover(df: DataFrame, top: float = 0.8) -> DataFrame:
    """Equal weights over the top ranks; half the absolute change of weights from one date to the next, per date."""
    held = df.withColumn("w", (cross.rank("value") >= top).cast("double"))
    held = held.withColumn("w", F.coalesce(div(F.col("w"), F.sum("w").over(Window.partitionBy("date"))), F.lit(0.0)))
    return held.withColumn("dw", F.abs(F.col("w") - F.coalesce(F.lag("w").over(S()), F.lit(0.0)))).groupBy("date").agg((F.sum("dw") / 2).alias("turnover"))


def basket_overlap(df: DataFrame, top: float = 0.8) -> DataFrame:
    """Jaccard similarity of a date's top basket with that of the date before. A basket is at most all symbols."""
    baskets = df.withColumn("_r", cross.rank("value")).filter(F.col("_r") >= top)
    b = baskets.groupBy("date").agg(F.collect_set("symbol").alias("b"))
    before = F.lag("b").over(Window.orderBy("date"))  # a row per date
    return b.withColumn("p", before).filter("p is not null").select("date", (F.size(F.array_intersect("b", "p")) / F.size(F.array_union("b", "p"))).alias("jaccard"))


def sleeves(df: DataFrame, h: int = 5, top: float = 0.9, fee_bps: float = 15.0) -> DataFrame:
    """Overlapping long-only sleeves: every date opens one of 1 / h over the top names; held h dates, weights summed by
    a window; date, gross and net return of the next close, turnover and the log of NAV."""
    w = df.withColumn("r", cross.rank("value")).withColumn("pick", F.coalesce((F.col("r") >= top).cast("double"), F.lit(0.0)))
    w = w.withColumn("entry", F.coalesce(div(F.col("pick"), F.sum("pick").over(Window.partitionBy("date"))), F.lit(0.0)) / h)
    w = w.withColumn("weight", F.sum("entry").over(rows(h))).withColumn("next", F.lead("ret").over(S()))
    w = w.withColumn("dw", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(S()), F.lit(0.0))))
    per = w.groupBy("date").agg(F.sum(F.col("weight") * F.coalesce("next", F.lit(0.0))).alias("gross"), (F.sum("dw") / 2).alias("turnover"))
    per = per.withColumn("net", F.col("gross") - F.col("turnover") * 2 * fee_bps / 1e4)
    return per.withColumn("log_nav", F.sum(F.log1p("net")).over(Window.orderBy("date")))  # a row per date


def dossier(returns: DataFrame, by: str = "symbol", periods: int = 52) -> DataFrame:
    """Return and risk figures of each series of (by, date, ret)."""
    w = Window.partitionBy(by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    x = returns.filter("ret is not null and ret > -1").withColumn("nav", F.exp(F.sum(F.log1p("ret")).over(w)))
    x = x.withColumn("dd", F.col("nav") / F.greatest(F.lit(1.0), F.max("nav").over(w)) - 1)
    mean, sd, low = F.avg("ret"), F.stddev_samp("ret"), F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret")))
    root = math.sqrt(periods)
    return x.groupBy(by).agg(
        (F.exp(F.sum(F.log1p("ret"))) - 1).alias("total"),
        (mean * periods).alias("ann_mean"),
        (sd * root).alias("ann_vol"),
        (div(mean, sd) * root).alias("sharpe"),
        (div(mean, low) * root).alias("sortino"),
        F.min("dd").alias("mdd"),
        F.avg((F.col("ret") > 0).cast("double")).alias("win"),
        F.max("ret").alias("best"),
        F.min("ret").alias("worst"),
    )


def brinson(sectors: DataFrame, *by: str) -> DataFrame:
    """Brinson-Fachler effects of (sector, w_p, w_b, r_p, r_b): allocation, selection, interaction."""
    total = F.sum(F.col("w_b") * F.col("r_b")).over(Window.partitionBy(*by)) if by else F.sum(F.col("w_b") * F.col("r_b")).over(Window.partitionBy(F.lit(1)))
    x = sectors.withColumn("r_total", total)
    dw, dr = F.col("w_p") - F.col("w_b"), F.col("r_p") - F.col("r_b")
    return x.withColumns({"allocation": dw * (F.col("r_b") - F.col("r_total")), "selection": F.col("w_b") * dr, "interaction": dw * dr})


def carino(a: Column, b: Column) -> Column:
    """Linking coefficient of two returns, 1 / (1 + a) where they meet."""
    near = F.abs(a - b) < 1e-12
    return F.when(near, 1 / (1 + a)).otherwise((F.log1p(a) - F.log1p(b)) / F.when(~near, a - b))


def implementation_shortfall(fills: DataFrame) -> DataFrame:
    """bps of (side, price, arrival, vwap, quantity): timing, slippage and their sum."""
    s = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    bps = lambda a, b: div(s * (a - b), b) * 1e4
    return fills.withColumns({"timing": bps(F.col("vwap"), F.col("arrival")), "slippage": bps(F.col("price"), F.col("vwap")), "shortfall": bps(F.col("price"), F.col("arrival"))})


def exposures(df: DataFrame, *keep: str) -> DataFrame:
    """Style exposures of staged bars: size, momentum, short reversal, volatility and beta, standardised per date."""
    caps = df.withColumn("lag_cap", F.lag("amount").over(S()))
    market = div(F.sum(F.col("lag_cap") * F.col("ret")).over(cross.D()), F.sum(F.when(F.col("ret").isNotNull(), F.col("lag_cap"))).over(cross.D()))
    x = caps.withColumn("mkt", market)
    w = rows(60)
    p, q = pairwise("ret", "mkt")
    x = x.withColumns({"size": cross.log("amount"), "momentum": div(F.lag("close", 4).over(S()), F.lag("close", 26).over(S())) - 1, "reversal": -(div(F.col("close"), F.lag("close", 4).over(S())) - 1), "vol": F.when(F.count("ret").over(rows(20)) >= 5, F.stddev_pop("ret").over(rows(20))), "beta": F.when(F.count(p).over(w) >= 20, div(F.covar_samp(p, q).over(w), F.var_pop(q).over(w)))})
    return x.select("date", "symbol", "ret", *keep, *(cross.z(n, 0).alias(n) for n in ("size", "momentum", "reversal", "vol", "beta")))


def ewma_specific(df: DataFrame, half_life: float = 60.0) -> DataFrame:
    """Exponentially weighted variance of `ret` per symbol, newest row weighs one."""
    lam = 0.5 ** (1 / half_life)
    age = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("date").desc())) - 1
    x = df.filter("ret is not null").withColumn("w", F.pow(F.lit(lam), age))
    m = x.groupBy("symbol").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("ret")).alias("s1"), F.sum(F.col("w") * F.col("ret") ** 2).alias("s2"), F.count("*").alias("k")).filter("k >= 5")
    return m.select("symbol", (F.col("s2") / F.col("sw") - (F.col("s1") / F.col("sw")) ** 2).alias("variance"))


def rolling_beta(df: DataFrame, n: int = 60) -> DataFrame:
    """Rolling CAPM of ret on mkt: alpha, beta, R2 and residual volatility over full windows."""
    w = rows(n)
    p, q = pairwise("ret", "mkt")
    ok = F.count(p).over(w) >= n
    beta = div(F.covar_samp(p, q).over(w), F.var_samp(q).over(w))
    x = df.withColumn("beta", F.when(ok, beta)).withColumn("alpha", F.when(ok, F.avg(p).over(w) - F.col("beta") * F.avg(q).over(w)))
    r2 = div(F.covar_samp(p, q).over(w) ** 2, F.var_samp(p).over(w) * F.var_samp(q).over(w))
    return x.withColumn("r2", F.when(ok, r2)).withColumn("resid_vol", F.when(ok, F.sqrt(F.var_samp(p).over(w) * (1 - F.col("r2")) * (n - 1) / (n - 2))))


def percentile_rank(x: str, w) -> Column:
    """Mid-rank percentile (0-100) of the current value within a frame."""
    a = F.collect_list(x).over(w)
    return 100.0 * (F.size(F.filter(a, lambda v: v < F.col(x))) + 0.5 * F.size(F.filter(a, lambda v: v == F.col(x)))) / F.size(a)


def liquidate(h: DataFrame, redemption: float, rate: float = 0.2, days: float = 1.0) -> DataFrame:
    """Pro-rata redemption of (symbol, position_value, adv, spread_bps, volatility): sold, days to sell and cost in bps
    (half spread plus square-root impact)."""
    share = div(F.lit(redemption), F.sum("position_value").over(Window.partitionBy(F.lit(1))))
    x = h.withColumn("sold", F.least(F.col("position_value"), F.col("position_value") * share))
    return x.withColumn("sell_days", div(F.col("sold"), F.col("adv") * rate)).withColumn("cost_bps", F.col("spread_bps") / 2 + F.col("volatility") * F.sqrt(div(F.col("sold"), F.col("adv") * days)) * 1e4)


def pbo_splits(blocks: int) -> list[tuple[int, ...]]:
    return list(combinations(range(blocks), blocks // 2))


def pbo(trials: DataFrame, blocks: int = 16) -> DataFrame:
    """Probability of backtest overfitting by CSCV over (trial, block, ret): split, the trial best inside, its rank outside.

    A trial's block moments are one row, and its Sharpe ratios of all C(blocks, blocks / 2) splits are made and used up in
    the task that holds it, twice: first each task gives its best trial of each split, then, where the best stand, how
    many of its trials fall below them. So tasks hand on a row per split, and the driver holds one per split."""
    moments = trials.filter(F.col("block").between(0, blocks - 1)).groupBy("trial", "block").agg(F.count("ret").alias("n"), F.sum("ret").alias("s1"), F.sum(F.col("ret") * F.col("ret")).alias("s2"))
    at = lambda c, k: F.coalesce(F.max(F.when(F.col("block") == k, F.col(c))).cast("double"), F.lit(0.0)).alias(f"{c}_{k}")
    wide = moments.groupBy("trial").agg(*(at(c, k) for c in ("n", "s1", "s2") for k in range(blocks)))
    wide = checkpointed(wide.repartition(4 * trials.sparkSession.sparkContext.defaultParallelism, "trial").sortWithinPartitions("trial"))  # few bytes, much work
    kind, low = trials.schema["trial"].dataType.simpleString(), blocks // 2
    masks = np.array([sum(1 << k for k in split) for split in pbo_splits(blocks)])

    def sums(x: np.ndarray) -> np.ndarray:
        """Sums over all subsets of x's rows: no other order of adding, so equal trials have equal Sharpe ratios."""
        out = np.zeros((1, x.shape[1]))
        for row in x:
            out = np.concatenate([out, out + row])
        return out

    def chunks(batches, sides):
        """Trials (256 at most), a slice of splits, and the Sharpe ratios inside or outside: splits x trials, NaN if none."""
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                m = np.stack([part.column(k).to_numpy() for k in range(1, 1 + 3 * blocks)]).reshape(3, blocks, -1)
                halves = [(sums(x[:low]), sums(x[low:])) for x in m]
                for k in range(0, len(masks), 512):
                    out = []
                    for side in sides:
                        mask = masks[k : k + 512] ^ (0 if side == "inner" else (1 << blocks) - 1)
                        n, s1, s2 = (a[mask & ((1 << low) - 1)] + b[mask >> low] for a, b in halves)
                        with np.errstate(divide="ignore", invalid="ignore"):
                            sd = np.sqrt(np.maximum(0.0, (s2 - s1 * s1 / n) / (n - 1)))
                            out.append(np.where((n > 1) & (sd > 0), s1 / n / sd, np.nan))
                    yield part, slice(k, k + 512), out

    def best(batches):
        top, outer, trial = np.full(len(masks), -np.inf), np.full(len(masks), np.nan), [None] * len(masks)
        seen = np.zeros(len(masks), bool)
        for part, at, (x, y) in chunks(batches, ("inner", "outer")):
            x = np.where(np.isnan(x), -np.inf, x)
            place, rows = x.argmax(axis=1), np.arange(len(x))  # trials come in order: the first of equals is the smallest
            won = np.flatnonzero((x[rows, place] > top[at]) | ~seen[at])
            top[at][won], outer[at][won] = x[won, place[won]], y[won, place[won]]
            seen[at] = True
            names = part.column(0).take(pa.array(place[won]))
            for i, name in zip(won, names, strict=True):
                trial[at.start + i] = name
        if seen.all():
            none = lambda v: pa.array(v, pa.float64(), mask=~np.isfinite(v))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(masks)), pa.int32()), pa.array([t.as_py() for t in trial], trial[0].type), none(top), none(outer)], names=["split", "trial", "inner", "outer"])

    w = Window.partitionBy("split").orderBy(F.col("inner").desc_nulls_last(), "trial")
    found = wide.mapInArrow(best, f"split int, trial {kind}, inner double, outer double").withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").select("split", "trial", "outer")
    found = checkpointed(found)
    marks = np.full(len(masks), np.nan)
    for r in found.filter("outer is not null").select("split", "outer").collect():
        marks[r["split"]] = r["outer"]

    def below(batches):
        count, many = np.zeros(len(masks), np.int64), 0
        for part, at, (y,) in chunks(batches, ("outer",)):
            least = marks[at, None]
            count[at] += ((y < least) | (np.isnan(y) & ~np.isnan(least))).sum(axis=1)
            many += part.num_rows if at.start == 0 else 0
        if many:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(masks)), pa.int32()), pa.array(count), pa.array(np.full(len(masks), many))], names=["split", "below", "k"])

    ranks = wide.mapInArrow(below, "split int, below long, k long").groupBy("split").agg((F.sum("below") + 1).alias("rank"), F.sum("k").alias("k"))
    r = found.join(ranks, "split").withColumn("omega", F.col("rank") / (F.col("k") + 1.0))
    return r.select("split", "trial", "omega", F.ln(F.col("omega") / (1 - F.col("omega"))).alias("logit"))


def sharpe_stats(returns: DataFrame, by: str) -> DataFrame:
    """Sharpe (ddof 1), population skew and kurtosis (not excess) and count per series."""
    return returns.groupBy(by).agg(div(F.avg("ret"), F.stddev_samp("ret")).alias("sr"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurt"), F.count("ret").alias("n"))


def probabilistic_sharpe(sr: float, n: int, skew: float, kurt: float, benchmark: float = 0.0) -> float:
    v = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    return NormalDist().cdf((sr - benchmark) * math.sqrt(n - 1) / math.sqrt(v)) if v > 0 else float("nan")


def expected_max_sharpe(variance: float, trials: int) -> float:
    g, nd = 0.5772156649015329, NormalDist()
    return math.sqrt(variance) * ((1 - g) * nd.inv_cdf(1 - 1 / trials) + g * nd.inv_cdf(1 - 1 / (trials * math.e)))


def deflated_sharpe(sr: float, n: int, skew: float, kurt: float, variance: float, trials: int) -> float:
    return probabilistic_sharpe(sr, n, skew, kurt, expected_max_sharpe(variance, trials))


def min_track_record(sr: float, skew: float, kurt: float, benchmark: float = 0.0, level: float = 0.95) -> float:
    return 1 + (1 - skew * sr + (kurt - 1) / 4 * sr * sr) * (NormalDist().inv_cdf(level) / (sr - benchmark)) ** 2


def adjusted_p(p: list[float], how: str) -> list[float]:
    """Bonferroni, Holm or Benjamini-Hochberg-Yekutieli adjusted p-values, in input order."""
    m, order = len(p), sorted(range(len(p)), key=p.__getitem__)
    out = [0.0] * m
    if how == "bonferroni":
        return [min(1.0, m * x) for x in p]
    if how == "holm":
        top = 0.0
        for k, i in enumerate(order):
            top = out[i] = min(1.0, max(top, (m - k) * p[i]))
        return out
    harmonic, low = sum(1 / k for k in range(1, m + 1)), 1.0
    for k in range(m, 0, -1):
        low = out[order[k - 1]] = min(low, m * harmonic / k * p[order[k - 1]])
    return out


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with `nth`, each row's place from 0 in the order: ranges are numbered by themselves and shifted by what the
    ranges before them hold (a row per range reaches the driver)."""
    held = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    before, shift = 0, []
    for r in held.groupBy("_range").count().orderBy("_range").collect():
        shift.append((r["_range"], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(shift, "_range int, _before long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return held.withColumn("_place", place).join(F.broadcast(offsets), "_range").withColumn("nth", F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def purged_folds(spans: DataFrame, k: int, embargo: int) -> DataFrame:
    """(id, begin, finish) in row order -> (fold, id, role): test rows by contiguous blocks; train rows are those whose
    span touches neither the block's span nor the embargo after it. Folds are k rows."""
    n = spans.count()
    placed = numbered(spans, "id").withColumn("fold", F.floor(F.col("nth") * k / F.lit(max(1, n))).cast("int")).drop("nth")
    per = placed.groupBy("fold").agg(F.min("begin").alias("a"), F.max("finish").alias("b"))
    other = placed.withColumnRenamed("fold", "own").join(F.broadcast(per), how="cross")
    role = F.when(F.col("own") == F.col("fold"), "test").when((F.col("finish") < F.col("a")) | (F.col("begin") > F.col("b") + embargo), "train").otherwise("purged")
    return other.select("fold", "id", role.alias("role"))


def newey_west_t(df: DataFrame, value: str, by: str, order: str, lags: int = 4) -> DataFrame:
    """Mean and HAC t-statistic per group, Bartlett weights."""
    w = Window.partitionBy(by).orderBy(order)
    x = df.filter(F.col(value).isNotNull()).withColumn("e", F.col(value) - F.avg(value).over(Window.partitionBy(by)))
    x = x.withColumns({f"g{j}": F.col("e") * F.lag("e", j).over(w) for j in range(1, lags + 1)})
    long = F.sum(F.col("e") ** 2) + sum(2 * (1 - j / (lags + 1)) * F.coalesce(F.sum(f"g{j}"), F.lit(0.0)) for j in range(1, lags + 1))
    return x.groupBy(by).agg(F.avg(value).alias("mean"), F.count("*").alias("n"), div(F.avg(value) * F.count("*"), F.sqrt(F.greatest(long, F.lit(0.0)))).alias("t"))


def gram(df: DataFrame, names: list[str], y: str):
    """X'X and X'y with an intercept by one aggregate; a (k + 1) x (k + 2) matrix on the driver."""
    cols = [F.lit(1.0), *map(F.col, names), F.col(y)]
    k = len(cols)
    at = [(i, j) for i in range(k - 1) for j in range(i, k)]
    got = df.dropna(subset=[*names, y]).agg(*(F.sum(cols[i] * cols[j]).alias(f"m{i}_{j}") for i, j in at)).first()
    m = np.zeros((k - 1, k))
    for (i, j), v in zip(at, got, strict=True):
        m[i, j] = v or 0.0
        if j < k - 1:
            m[j, i] = m[i, j]
    return m[:, :-1], m[:, -1]


def ridge(df: DataFrame, names: list[str], y: str, alpha: float) -> dict[str, float]:
    """Ridge by normal equations; the intercept is not penalised."""
    xx, xy = gram(df, names, y)
    penalty = np.eye(len(xx)) * alpha
    penalty[0, 0] = 0
    return dict(zip(["intercept", *names], (np.linalg.pinv(xx + penalty) @ xy).tolist(), strict=True))


def mrmr(df: DataFrame, names: list[str], y: str, k: int) -> list[str]:
    """Greedy selection by F statistic over mean absolute correlation (floor 0.001), from one pass of moments."""
    got = df.dropna(subset=[*names, y]).agg(F.count("*").alias("n"), *(F.corr(a, b).alias(f"r{i}_{j}") for i, a in enumerate([*names, y]) for j, b in enumerate([*names, y]) if i < j)).first()
    m = len(names)
    r = lambda i, j: abs(got[f"r{min(i, j)}_{max(i, j)}"] or 0.0)
    gain = [r(i, m) ** 2 / max(1e-12, 1 - r(i, m) ** 2) * (got["n"] - 2) for i in range(m)]
    chosen: list[int] = []
    while len(chosen) < min(k, m):
        rest = [i for i in range(m) if i not in chosen]
        chosen.append(max(rest, key=lambda i: (gain[i] / max(0.001, sum(r(i, j) for j in chosen) / len(chosen)) if chosen else gain[i], -i)))
    return [names[i] for i in chosen]


def daily_ols(df: DataFrame, names: list[str], y: str) -> DataFrame:
    """Per-date least squares (a matrix solve per date, one cross-section in memory): date, name, beta."""

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna()
        if len(p) < max(10, 3 * len(names)):
            return pd.DataFrame({"date": pd.Series([], dtype=object), "name": pd.Series([], dtype=object), "beta": pd.Series([], dtype=float)})
        x = np.column_stack([np.ones(len(p)), p[names]])
        b = np.linalg.lstsq(x, p[y].to_numpy(), rcond=None)[0]
        return pd.DataFrame({"date": p["date"].iloc[0], "name": ["intercept", *names], "beta": b})

    return df.select("date", *names, y).groupBy("date").applyInPandas(solve, "date date, name string, beta double")


def prefix_invariant(build, df: DataFrame, cut) -> int:
    """Rows of a causal operator's output up to `cut` that change when later input is withheld: zero for a clean one."""
    whole = build(df).filter(F.col("date") <= cut)
    short = build(df.filter(F.col("date") <= cut))
    return whole.exceptAll(short).count() + short.exceptAll(whole).count()

