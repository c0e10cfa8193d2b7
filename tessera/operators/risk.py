"""Factor risk model and portfolio construction.

Sums over dates and symbols are aggregates in Spark. Only matrices of factors (or of the assets of an optimiser) reach
the driver, and MOST bounds their side."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST = 3000


def to_matrix(df: DataFrame, i: str = "i", j: str = "j", value: str = "value") -> tuple[list[str], np.ndarray]:
    """A square long matrix on the driver; its side is checked first."""
    side = df.select(i).distinct().count()
    if side > MOST:
        raise ValueError(f"a matrix of side {side} exceeds {MOST}")
    got = df.select(i, j, value).toPandas()
    names = sorted(got[i].unique())
    return names, got.pivot(index=i, columns=j, values=value).reindex(index=names, columns=names).fillna(0.0).to_numpy(float)


def from_matrix(spark: SparkSession, names: list[str], m: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(a, b, float(m[x, y])) for x, a in enumerate(names) for y, b in enumerate(names)], "i string, j string, value double")


def nearest_psd(m: np.ndarray, least: float = 1e-12) -> np.ndarray:
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return (vectors * np.maximum(values, least)) @ vectors.T


def factor_returns(panel: DataFrame, styles: list[str], sector: str, cap: str = "cap", fwd: str = "fwd", penalty: float = 1e-8) -> DataFrame:
    """Weighted least squares of each date's forward returns on styles and sector indicators: date, kind (factor or
    specific), name, value. Weights are the roots of caps. A date with too few names gives no rows; a date's
    cross-section, the symbols it lists, is what one task holds."""

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna()
        p = p[p[cap] > 0]
        groups = sorted(p[sector].unique())
        x = np.column_stack([p[styles].to_numpy(float), *((p[sector] == g).to_numpy(float) for g in groups)])
        names = [*styles, *groups]
        if len(p) < len(names) + 2:
            return pd.DataFrame(columns=["date", "kind", "name", "value"], dtype=object)
        y, w = p[fwd].to_numpy(float), np.sqrt(p[cap].to_numpy(float))
        beta = np.linalg.solve((x.T * w) @ x + penalty * np.eye(len(names)), (x.T * w) @ y)
        parts = [("factor", n, b) for n, b in zip(names, beta, strict=True)] + [("specific", str(s), r) for s, r in zip(p["symbol"], y - x @ beta, strict=True)]
        return pd.DataFrame([(p["date"].iloc[0], *t) for t in parts], columns=["date", "kind", "name", "value"])

    cols = panel.select("date", F.col("symbol").cast("string").alias("symbol"), *styles, sector, cap, fwd)
    return cols.groupBy("date").applyInPandas(solve, "date date, kind string, name string, value double")


def complete_dates(returns: DataFrame) -> DataFrame:
    """(date, name, value) on the dates on which every name has a value."""
    x = returns.filter("value is not null")
    names = x.select("name").distinct().count()
    full = x.groupBy("date").agg(F.count("*").alias("_k")).filter(F.col("_k") == names).select("date")
    return x.join(full, "date", "left_semi")


def _weighted(returns: DataFrame, half_life: float | None) -> DataFrame:
    x = complete_dates(returns)
    age = F.row_number().over(Window.orderBy(F.col("date").desc())) - 1  # a row per date
    ages = x.select("date").distinct().withColumn("w", F.pow(F.lit(0.5 ** (1 / half_life)), age) if half_life else F.lit(1.0))
    return x.join(ages, "date")


def covariance(returns: DataFrame, half_life: float | None = None, periods: int = 1, sample: bool = True) -> DataFrame:
    """(date, name, value) -> (i, j, value): exponentially weighted about the weighted mean, or plain (sample: n - 1)."""
    x = _weighted(returns, half_life)
    means = x.groupBy("name").agg(F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum("w")).alias("m"))
    x = x.join(means, "name").withColumn("e", F.col("value") - F.col("m"))
    a, b = x.select("date", "w", F.col("name").alias("i"), F.col("e").alias("p")), x.select("date", F.col("name").alias("j"), F.col("e").alias("q"))
    total = F.sum("w") - 1 if sample and not half_life else F.sum("w")
    return a.join(b, "date").groupBy("i", "j").agg((F.try_divide(F.sum(F.col("w") * F.col("p") * F.col("q")), total) * periods).alias("value"))


def factor_covariance(returns: DataFrame, half_life: float = 90.0, periods: int = 252) -> DataFrame:
    """Annualised weighted covariance of factor returns with negative eigenvalues clipped."""
    names, m = to_matrix(covariance(returns, half_life, periods))
    return from_matrix(returns.sparkSession, names, nearest_psd(m))


def ledoit_wolf(returns: DataFrame) -> tuple[DataFrame, float]:
    """Covariance shrunk to a scaled identity, and the shrinkage. Besides the covariance it takes one more aggregate:
    the sum over dates of the fourth power of the demeaned vector's norm."""
    names, s = to_matrix(covariance(returns, sample=False))
    x = _weighted(returns, None)
    means = x.groupBy("name").agg(F.avg("value").alias("m"))
    norms = x.join(means, "name").groupBy("date").agg(F.sum((F.col("value") - F.col("m")) ** 2).alias("q"))
    n, fourth = norms.agg(F.count("*"), F.sum(F.col("q") ** 2)).first()
    p, mu = len(s), np.trace(s) / len(s)
    spread = ((s - mu * np.eye(p)) ** 2).sum() / p
    noise = min((fourth / n - (s**2).sum()) / (n * p), spread)
    shrink = float(noise / spread) if spread > 0 else 0.0
    return from_matrix(returns.sparkSession, names, (1 - shrink) * s + shrink * mu * np.eye(p)), shrink


def asset_covariance(exposures: DataFrame, factors: DataFrame, specific: DataFrame, side: int = 2000) -> DataFrame:
    """X F X' + D of (symbol, name, x), (i, j, value) and (symbol, variance): every pair of symbols, as the matrix has.

    Symbols are packed into blocks of about `side` with their exposures as arrays; what is shuffled is pairs of blocks, and
    pairs of symbols are made by the task that hands them on."""
    names = sorted(r[0] for r in factors.select("j").distinct().limit(MOST + 1).collect())
    if len(names) > MOST:
        raise ValueError(f"a matrix of side over {MOST}")
    total = lambda df, key: df.groupBy("symbol", F.col(key).alias("j")).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))
    xf = total(exposures.join(factors, exposures.name == factors.i).select("symbol", "j", (F.col("x") * F.col("value")).alias("v")), "j")
    x = total(exposures.select("symbol", "name", F.col("x").alias("v")), "name")
    blocks = max(1, round(x.select("symbol").distinct().count() / side))

    def packed(df: DataFrame, value: str, *more: str) -> DataFrame:
        """A row per block: its symbols, each with a value or none for each of the names."""
        held = df.groupBy("symbol", *more).agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias("_m"))
        line = F.struct(F.col("symbol").alias(value[0] + "_symbol"), *more, F.transform(F.array(*map(F.lit, names)), lambda n: F.try_element_at("_m", n)).alias(value))
        return held.groupBy(F.pmod(F.xxhash64("symbol"), F.lit(blocks)).alias("_b")).agg(F.collect_list(line).alias(f"{value}s")).drop("_b")

    spread = min(blocks * blocks, 32 * exposures.sparkSession.sparkContext.defaultParallelism)
    pairs = packed(xf.join(specific, "symbol", "left"), "left", "variance").join(packed(x, "right"), how="cross").repartition(spread)
    pairs = pairs.select("rights", F.inline("lefts")).select("l_symbol", "variance", "left", F.inline("rights"))
    terms = [F.col("left")[k] * F.col("right")[k] for k in range(len(names))]
    met = reduce(or_, (t.isNotNull() for t in terms), F.lit(False))
    common = sum((F.coalesce(t, F.lit(0.0)) for t in terms), F.lit(0.0))
    own = F.when(F.col("l_symbol") == F.col("r_symbol"), F.coalesce("variance", F.lit(0.0))).otherwise(0.0)
    rows = pairs.filter(met).select(F.col("l_symbol").alias("symbol"), F.col("r_symbol").alias("other"), (common + own).alias("value"))
    alone = specific.join(xf.join(x, ["symbol", "j"]).select("symbol").distinct(), "symbol", "left_anti")  # no factor meets them
    return rows.unionByName(alone.select("symbol", F.col("symbol").alias("other"), F.coalesce("variance", F.lit(0.0)).alias("value")))


def decompose_risk(weights: DataFrame, exposures: DataFrame, factors: DataFrame, specific: DataFrame) -> DataFrame:
    """Euler contributions to variance and volatility per factor, and one row `specific`: name, exposure, variance,
    volatility, share. A symbol without a specific variance takes the median one."""
    b = weights.join(exposures, "symbol").groupBy("name").agg(F.sum(F.col("w") * F.col("x")).alias("exposure"))
    fb = factors.join(b.withColumnRenamed("name", "j"), "j").groupBy("i").agg(F.sum(F.col("value") * F.col("exposure")).alias("fb"))
    rows = b.join(fb, b.name == fb.i).select("name", "exposure", (F.col("exposure") * F.col("fb")).alias("variance"))
    middle = specific.agg(F.percentile("variance", F.lit(0.5)).alias("_mid"))  # one row
    own = weights.join(specific, "symbol", "left").join(F.broadcast(middle), how="cross").agg(F.sum(F.col("w") ** 2 * F.coalesce("variance", "_mid")).alias("variance"))
    rows = rows.unionByName(own.select(F.lit("specific").alias("name"), F.lit(None).cast("double").alias("exposure"), "variance"))
    total = F.sum("variance").over(Window.partitionBy(F.lit(1)))  # a row per factor
    return rows.withColumn("volatility", F.try_divide("variance", F.sqrt(F.greatest(total, F.lit(0.0))))).withColumn("share", F.try_divide("variance", total))


# Optimisers: long-only (or bounded) weights over the assets of a covariance on the driver.

Project = Callable[[np.ndarray], np.ndarray]


def box_sum(low: float, high: float, total: float = 1.0) -> Project:
    """Onto weights within [low, high] that sum to total."""

    def run(v: np.ndarray) -> np.ndarray:
        if not low * len(v) - 1e-12 <= total <= high * len(v) + 1e-12:
            raise ValueError("the bounds leave no weights with this sum")
        kinks = np.sort(np.concatenate([v - high, v - low]))  # the sum falls linearly between two of them
        at = lambda t: float(np.clip(v - t, low, high).sum())
        i, j = 0, len(kinks) - 1
        while j - i > 1:
            k = (i + j) // 2
            i, j = (k, j) if at(kinks[k]) >= total else (i, k)
        top, bottom = at(kinks[i]), at(kinks[j])
        share = (top - total) / (top - bottom) if top > bottom else 0.0
        return np.clip(v - (kinks[i] + share * (kinks[j] - kinks[i])), low, high)

    return run


def half_space(normal: np.ndarray, most: float) -> Project:
    """Onto normal . w <= most: a sector's cap, or a bound of an exposure."""
    size = float(normal @ normal)
    return lambda v: v - normal * max(0.0, (normal @ v - most) / size) if size else v


def turnover_ball(before: np.ndarray, most: float) -> Project:
    """Onto sum |w - before| <= most."""

    def run(v: np.ndarray) -> np.ndarray:
        d = v - before
        if np.abs(d).sum() <= most:
            return v
        u = np.sort(np.abs(d))[::-1]
        c = (np.cumsum(u) - most) / np.arange(1, len(u) + 1)
        cut = c[np.flatnonzero(u > c)[-1]]
        return before + np.sign(d) * np.maximum(np.abs(d) - cut, 0)

    return run


def intersect(sets: list[Project], rounds: int = 3000) -> Project:
    """Dykstra's alternating projections onto what all sets share."""
    if len(sets) == 1:
        return sets[0]

    def run(v: np.ndarray) -> np.ndarray:
        back = [np.zeros_like(v) for _ in sets]
        for _ in range(rounds):
            moved = 0.0
            for k, s in enumerate(sets):
                u = s(v + back[k])
                rest, v = v + back[k] - u, u
                moved, back[k] = max(moved, float(np.abs(rest - back[k]).max())), rest
            if moved < 1e-11:  # the point alone may rest while the corrections still move
                break
        return v

    return run


def _objective(kind: str, m: np.ndarray, mean: np.ndarray | None, risk_aversion: float) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    sd = np.sqrt(np.diag(m))

    def f(w: np.ndarray) -> tuple[float, np.ndarray]:
        mw = m @ w
        var = max(float(w @ mw), 1e-300)
        vol = np.sqrt(var)
        if kind == "min_variance":
            return var, 2 * mw
        if kind == "mean_variance":
            return risk_aversion / 2 * var - float(mean @ w), risk_aversion * mw - mean
        if kind == "max_sharpe":
            top = float(mean @ w)
            return -top / vol, -mean / vol + top * mw / vol**3
        if kind == "max_diversification":
            top = float(sd @ w)
            return -top / vol, -sd / vol + top * mw / vol**3
        if kind == "risk_parity":
            share = w * mw / var
            d = share - 1 / len(w)
            return float(d @ d), 2 * (d * mw + m @ (d * w)) / var - 4 * float(d @ share) * mw / var
        raise ValueError(f"unknown objective: {kind}")

    return f


def optimize(m: np.ndarray, kind: str, mean: np.ndarray | None = None, risk_aversion: float = 5.0, cap: float = 1.0, low: float = 0.0, sets: tuple[Project, ...] = (), steps: int = 4000) -> np.ndarray:
    """Weights that sum to one by projected gradients with backtracking. kind: min_variance, mean_variance, max_sharpe,
    risk_parity or max_diversification; sets: further constraints (half_space, turnover_ball)."""
    m = m / np.trace(m) * len(m) if kind in ("min_variance", "risk_parity", "max_diversification") else m
    f, onto = _objective(kind, m, mean, risk_aversion), intersect([*sets, box_sum(low, cap)])
    w = onto(np.full(len(m), 1 / len(m)))
    value, grad = f(w)
    step = 1.0
    for _ in range(steps):
        while True:
            new = onto(w - step * grad)
            d = new - w
            got, after = f(new)
            if got <= value + float(grad @ d) + float(d @ d) / (2 * step) + 1e-15 or step < 1e-12:
                break
            step /= 2
        moved = np.abs(d).max()
        w, value, grad = new, got, after
        if moved < 1e-9:
            break
        step *= 1.6
    return w


def frontier(m: np.ndarray, mean: np.ndarray, points: int = 25, cap: float = 1.0) -> list[tuple[float, float, float]]:
    """(risk aversion, return, volatility) along geometric risk aversions from 0.5 to 50."""
    out = []
    for a in np.geomspace(0.5, 50, points):
        w = optimize(m, "mean_variance", mean, float(a), cap)
        out.append((float(a), float(mean @ w), float(np.sqrt(w @ m @ w))))
    return out


def risk_contributions(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """(name, w) and (i, j, value) -> name and its share of the portfolio's variance."""
    other = weights.select(F.col("name").alias("j"), F.col("w").alias("wj"))
    rows = cov.join(other, "j").join(weights, cov.i == weights.name).groupBy("name").agg(F.sum(F.col("w") * F.col("wj") * F.col("value")).alias("c"))
    return rows.select("name", F.try_divide("c", F.sum("c").over(Window.partitionBy(F.lit(1)))).alias("share"))  # a row per asset
