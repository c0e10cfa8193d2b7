"""Market-flow monitors, cost calibration and dependence measures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.series import div

from . import joins

#: Below this a strength has no direction; a resonance starts and a divergence is led beyond these.
DEADBAND, RESONANCE, LEAD = 0.05, 0.1, 0.2


def changes(levels: DataFrame, by: list[str], order: list[str], value: str, relative: bool = True) -> DataFrame:
    """Change of each non-null level to the one before (relative to its size; zero before: zero), and its z score over
    the whole series (no spread: zero). First rows, which have no change, are left out."""
    w, all_ = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by)
    before = F.lag(value).over(w)
    step = F.col(value) - before
    change = F.when(before == 0, 0.0).otherwise(F.try_divide(step, F.abs(before))) if relative else step
    x = levels.filter(F.col(value).isNotNull()).withColumn("_before", before).withColumn("change", change).filter("_before is not null").drop("_before")
    sd = F.stddev_pop("change").over(all_)
    return x.withColumn("z", F.coalesce(div(F.col("change") - F.avg("change").over(all_), sd), F.lit(0.0)))


def strength(levels: DataFrame, by: list[str], order: list[str], value: str, relative: bool = True) -> DataFrame:
    """Per series the z score of its last change, the change itself and the last level."""
    last = F.struct(*order)
    x = changes(levels, by, order, value, relative)
    return x.groupBy(*by).agg(F.max_by("z", last).alias("strength"), F.max_by("change", last).alias("change"), F.max_by(value, last).alias("latest"), F.max(order[0]).alias("seen"), F.count("*").alias("n"))


def consensus(strengths: DataFrame, by: str) -> DataFrame:
    """Per key over the strengths of its sources: how many point up and down, the majority's share and a direction."""
    up, down = F.count_if(F.col("strength") > DEADBAND), F.count_if(F.col("strength") < -DEADBAND)
    x = strengths.groupBy(by).agg(up.alias("up"), down.alias("down"))
    n = F.col("up") + F.col("down")
    label = F.when(n == 0, "neutral").when(F.col("down") == 0, "inflow").when(F.col("up") == 0, "outflow").otherwise("divergence")
    return x.select(by, "up", "down", F.coalesce(F.try_divide(F.greatest("up", "down"), n), F.lit(0.0)).alias("score"), label.alias("direction"), ((n >= 2) & (F.least("up", "down") == 0)).alias("agreed"))


def strength_series(levels: DataFrame, by: str, source: str, order: list[str], value: str) -> DataFrame:
    """Per key and position (first changes aligned) the mean z score of the sources that reach it."""
    x = changes(levels, [by, source], order, value)
    x = x.withColumn("position", F.row_number().over(Window.partitionBy(by, source).orderBy(*order)))
    return x.groupBy(by, "position").agg(F.avg("z").alias("strength"))


def decayed(x: Column, days: Column, half_life: float) -> Column:
    return x * F.pow(F.lit(2.0), -days / half_life)


def resonance(a: Column, b: Column) -> Column:
    """Pattern of two signals, thresholds strict."""
    t, lead = RESONANCE, LEAD
    return F.when((a > t) & (b > t), "bullish_resonance").when((a < -t) & (b < -t), "bearish_resonance").when((a > lead) & (b < -t), "cautious_divergence").when((a < -lead) & (b > t), "dangerous_divergence").otherwise("none")


def priced_fills(fills: DataFrame, quotes: DataFrame, bars: DataFrame, on: str, by: str, commission_bps: float = 0.0) -> DataFrame:
    """Fills (side, quantity, price) with the last quote (bid, ask) and bar (close, volume) before or at them: reference
    price, slippage, spread, participation and total cost. Two as-of joins, each one shuffle on the key."""
    x = joins.asof(joins.asof(fills, quotes, on, by, ["bid", "ask"]), bars, on, by, ["close", "volume"])
    sign = F.when(F.lower("side") == "buy", 1.0).when(F.lower("side") == "sell", -1.0)
    x = x.withColumn("mid", (F.col("bid") + F.col("ask")) / 2).withColumn("reference", F.coalesce("mid", "close"))
    x = x.withColumn("slippage_bps", sign * div(F.col("price") - F.col("reference"), F.col("reference")) * 1e4)
    return x.withColumns({"spread_bps": div(F.col("ask") - F.col("bid"), F.col("mid")) * 1e4, "participation": div(F.col("quantity"), F.col("volume")), "total_bps": F.col("slippage_bps") + commission_bps})


def impact(priced: DataFrame) -> DataFrame:
    """One row: fills, covered share, median and 95th percentile of cost, and the fit |slippage| = a + b sqrt(share).
    The fit is null unless every share of volume is positive."""
    usable = F.col("participation").isNotNull() & F.col("slippage_bps").isNotNull()
    x, y = F.when(usable & (F.col("participation") > 0), F.sqrt("participation")), F.when(usable, F.abs("slippage_bps"))
    ok = F.count_if(usable & (F.col("participation") <= 0)) == 0
    return priced.agg(F.count("*").alias("fills"), F.avg(F.col("reference").isNotNull().cast("double")).alias("coverage"), F.percentile("total_bps", F.lit(0.5)).alias("median_bps"), F.percentile("total_bps", F.lit(0.95)).alias("p95_bps"), F.when(ok, F.regr_intercept(y, x)).alias("intercept"), F.when(ok, F.regr_slope(y, x)).alias("slope"))


def bin_of(x: Column, edges: Column) -> Column:
    """Right-closed bin by distinct inner edges: how many of them lie below x."""
    return F.size(F.filter(F.array_distinct(edges), lambda e: e < x))


def cost_curve(priced: DataFrame, bins: int = 5) -> DataFrame:
    """Costs by quantile bin of participation; equal edges make one bin."""
    x = priced.filter("participation is not null and slippage_bps is not null")
    edges = x.agg(F.percentile("participation", F.array(*(F.lit(k / bins) for k in range(1, bins)))).alias("_edges"))  # one row
    x = x.join(F.broadcast(edges), how="cross").withColumn("bin", bin_of(F.col("participation"), F.col("_edges")))
    return x.groupBy("bin").agg(F.count("*").alias("n"), F.percentile("total_bps", F.lit(0.5)).alias("median_bps"), F.percentile("total_bps", F.lit(0.95)).alias("p95_bps"), F.percentile("participation", F.lit(0.5)).alias("participation"))


def mutual_information(df: DataFrame, x: str, y: str, by: str = "date", bins: int = 10, least: int = 30) -> DataFrame:
    """Normalised mutual information of two columns per group over quantile bins (few distinct values: their own bins)."""
    both = df.select(by, F.col(x).alias("_x"), F.col(y).alias("_y")).filter("_x is not null and _y is not null")
    cuts = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    edges = both.groupBy(by).agg(F.count("*").alias("_n"), *(F.percentile(c, cuts).alias(f"{c}e") for c in ("_x", "_y")), *(F.count_distinct(c).alias(f"{c}d") for c in ("_x", "_y"))).filter(F.col("_n") >= least)
    label = lambda c: F.when(F.col(f"{c}d") <= bins, F.col(c)).otherwise(bin_of(F.col(c), F.col(f"{c}e")).cast("double"))
    cells = both.join(edges, by).groupBy(by, label("_x").alias("bx"), label("_y").alias("by_")).agg(F.count("*").alias("c"))
    total = lambda *k: F.sum("c").over(Window.partitionBy(by, *k))
    cells = cells.withColumns({"n": total(), "nx": total("bx"), "ny": total("by_")})
    share = lambda c: F.col(c) / F.col("n")
    m = cells.groupBy(by).agg(F.sum(share("c") * F.ln(F.col("c") * F.col("n") / (F.col("nx") * F.col("ny")))).alias("mi"), F.sum(-share("c") * F.ln(share("nx"))).alias("hx"), F.sum(-share("c") * F.ln(share("ny"))).alias("hy"))
    return m.select(by, F.coalesce(div(F.col("mi"), F.sqrt(F.col("hx") * F.col("hy"))), F.lit(0.0)).alias("nmi"))


def distance_products(x: np.ndarray, y: np.ndarray) -> float:
    """Sum of |xi - xj| |yi - yj| over all ordered pairs, in n log n steps. With the points placed in order of x, it is the
    sum of (xj - xi) (yj - yi) with the sign turned where y falls from i to j. Those pairs are found by halving: of a block
    of places in order of y, each point of the upper half meets the sums over the lower half's points above it."""
    n, order = len(x), np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    at, fell = np.argsort(y, kind="stable"), 0.0
    for bit in range((n - 1).bit_length() - 1, -1, -1):
        low, block = (at >> bit & 1) == 0, at >> (bit + 1)
        begin = np.flatnonzero(np.diff(block, prepend=-1))
        sizes = np.diff(begin, append=n)
        px, py = x[at], y[at]

        def above(v: np.ndarray) -> np.ndarray:
            c = np.cumsum(np.where(low, v, 0.0))
            return (np.repeat(c[begin + sizes - 1], sizes) - c)[~low]

        qx, qy = px[~low], py[~low]
        fell += float((above(np.ones(n)) * qx * qy - qx * above(py) - qy * above(px) + above(px * py)).sum())
        at = at[np.argsort(at >> bit, kind="stable")]
    return float(2 * (n * (x @ y) - x.sum() * y.sum()) - 4 * fell)


def mean_distances(v: np.ndarray) -> np.ndarray:
    """Each point's mean distance from all, itself included."""
    n, order = len(v), np.argsort(v, kind="stable")
    s, out = v[order], np.empty(len(v))
    below = np.cumsum(s) - s
    out[order] = ((2 * np.arange(n) - n) * s + s.sum() - 2 * below) / n
    return out


def dcor(x: np.ndarray, y: np.ndarray, block: int = 512) -> float:
    """Distance correlation in n log n steps and memory of n; up to `block` points from the distances themselves."""
    n = len(x)
    if n < 4:
        return float("nan")
    if x.min() == x.max() or y.min() == y.max():
        return 0.0
    if n <= block:
        centred = lambda v: (a := np.abs(v[:, None] - v)) - (m := a.mean(axis=1))[:, None] - m + m.mean()
        a, b = centred(x), centred(y)
        xy, xx, yy = (a * b).sum(), (a * a).sum(), (b * b).sum()
    else:
        x, y = ((v - np.median(v)) / (v.max() - v.min()) for v in (x, y))
        mx, my = mean_distances(x), mean_distances(y)
        squares = lambda v: 2 * (n * (v @ v) - v.sum() ** 2)
        rest = lambda p, q: -2 * n * (p @ q) + n * n * p.mean() * q.mean()
        xy, xx, yy = distance_products(x, y) + rest(mx, my), squares(x) + rest(mx, mx), squares(y) + rest(my, my)
    return float(np.sqrt(max(0.0, xy)) / np.sqrt(np.sqrt(xx * yy))) if xx > 0 and yy > 0 else 0.0


def distance_correlation(df: DataFrame, x: str, y: str, by: str = "date", least: int = 30) -> DataFrame:
    """Per group, both columns clipped to their 1st and 99th percentiles."""

    def each(p: pd.DataFrame) -> pd.DataFrame:
        v = p[[x, y]].dropna().to_numpy(float)
        if len(v) < least:
            return pd.DataFrame(columns=[by, "dcor"], dtype=object)
        v = np.clip(v, *np.percentile(v, [1, 99], axis=0))
        return pd.DataFrame({by: [p[by].iloc[0]], "dcor": [dcor(v[:, 0], v[:, 1])]})

    return df.select(by, x, y).groupBy(by).applyInPandas(each, f"{by} {dict(df.dtypes)[by]}, dcor double")


def decay_fit(ic: DataFrame) -> DataFrame:
    """(horizon, ic_mean) -> exponential half-life and power-law exponent of |ic| by least squares on logs."""
    y, h = F.when(F.col("ic_mean") != 0, F.ln(F.abs("ic_mean"))), F.col("horizon").cast("double")
    return ic.agg(F.regr_slope(y, h).alias("rate"), F.regr_slope(y, F.ln(h)).alias("exponent")).select("rate", "exponent", F.when(F.col("rate") < 0, F.lit(float(np.log(2))) / -F.col("rate")).alias("half_life"))
