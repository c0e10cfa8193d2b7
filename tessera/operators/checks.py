"""Validation of signals and tables: splits, folds, stability, time-series diagnostics, contracts, integrity."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import cross, series
from tessera.functions.series import S, div
from tessera.operators import analytics

#: Keys of an automation contract.
CONTRACT_KEYS = ["schema_version", "id", "mode", "architecture", "trigger", "goal", "allowed_actions", "delivery", "budgets", "stop_rules", "approval_gates"]
CONTRACT_NESTED = {
    "trigger": ["kind", "dedupe_key", "concurrency"],
    "goal": ["statement", "evidence", "verifier"],
    "delivery": ["mode", "branch", "pr"],
    "budgets": ["max_iterations", "max_minutes", "max_cost", "max_tool_retries"],
    "stop_rules": ["success", "no_progress", "hard_stops", "escalate_to"],
}
#: Extensions by media kind.
IMAGES, VIDEOS = ["jpg", "jpeg", "png", "webp", "gif", "bmp", "avif", "heic", "heif", "svg"], ["mp4", "m4v", "mov", "webm", "mkv"]


def date_places(df: DataFrame) -> DataFrame:
    """Distinct dates with their place from the start (0) and the end (0): a row a date, so one task orders them."""
    w = Window.orderBy("date")
    d = df.select("date").distinct()
    return d.select("date", (F.row_number().over(w) - 1).alias("place"), (F.row_number().over(Window.orderBy(F.desc("date"))) - 1).alias("left"))


def split(dates: DataFrame, train: float, valid: float, embargo: int) -> DataFrame:
    """date, part: train, valid and oos by share of dates; the last `embargo` dates before a border belong to none."""
    n = F.col("place") + F.col("left") + 1
    a, b = F.floor(n * F.lit(train)), F.floor(n * F.lit(train + valid))
    part = F.when(F.col("place") < a - embargo, "train").when((F.col("place") >= a) & (F.col("place") < b - embargo), "valid").when(F.col("place") >= b, "oos")
    return dates.select("date", part.alias("part")).filter("part is not null")


def fold_masks(dates: DataFrame, folds: int, embargo: int) -> DataFrame:
    """Causal folds: fold k tests on the k-th of folds + 1 equal runs of dates and fits on all before, less the embargo."""
    n = F.col("place") + F.col("left") + 1
    run = F.floor(F.col("place") * F.lit(folds + 1) / n)
    d = dates.select("date", "place", n.alias("n"), run.alias("run")).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    start = F.ceil(F.col("fold") * F.col("n") / F.lit(folds + 1))
    use = F.when(F.col("run") == F.col("fold"), "test").when(F.col("place") < start - embargo, "fit")
    return d.select("fold", "date", use.alias("use")).filter("use is not null")


def covered(df: DataFrame, value: str, least: float) -> DataFrame:
    """Symbols that hold a value on at least a share of all dates."""
    days = df.select(F.countDistinct("date").alias("days"))
    held = df.groupBy("symbol").agg(F.count(value).alias("held"))
    return held.join(F.broadcast(days), how="cross").filter(F.col("held") >= least * F.col("days")).select("symbol", "held")  # days: one row


def rank_autocorrelation(df: DataFrame, lag: int = 1) -> DataFrame:
    """Per date: correlation of the percentile rank with the symbol's rank `lag` rows earlier, and how many had both."""
    r = df.withColumn("r", cross.rank("value")).withColumn("p", F.lag("r", lag).over(S())).filter("r is not null and p is not null")
    return r.groupBy("date").agg(analytics.corr("r", "p").alias("autocorrelation"), F.count("*").alias("n")).filter("n >= 8")


def transitions(df: DataFrame, q: int = 5) -> DataFrame:
    """Shares of moves between a symbol's successive quantile buckets."""
    place = F.ceil(cross.rank("value") * q).cast("int")
    b = df.filter("value is not null").withColumn("bucket", place).withColumn("before", F.lag("bucket").over(S())).filter("before is not null")
    n = b.groupBy("before", "bucket").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("before")))


def diagnostics(df: DataFrame, by: str = "symbol", value: str = "close", least: int = 30) -> DataFrame:
    """Per series: half-life of mean reversion, Dickey-Fuller t (constant, no lags) and Hurst exponent (slope of the log
    deviation of differences over 1, 2, 4, 8, 16 rows on the log of the distance). Series under `least` rows go."""
    w = Window.partitionBy(by).orderBy("date")
    x = F.ln(value)
    steps = (1, 2, 4, 8, 16)
    d = df.filter(F.col(value) > 0).select(by, x.alias("x"), F.lag(x).over(w).alias("p"), *(x - F.lag(x, k).over(w) for k in steps)).toDF(by, "x", "p", *(f"d{k}" for k in steps))
    y = F.col("x") - F.col("p")
    p = F.when(y.isNotNull(), F.col("p"))
    a = d.groupBy(by).agg(F.count("*").alias("n"), F.count(p).cast("double").alias("m"), F.regr_slope(y, p).alias("b"), F.regr_sxx(y, p).alias("sxx"), F.regr_syy(y, p).alias("syy"), *(F.ln(F.nullif(F.stddev_pop(f"d{k}"), F.lit(0.0))).alias(f"s{k}") for k in steps))
    places = [math.log(k) for k in steps]
    mid = sum(places) / len(places)
    hurst = sum(F.col(f"s{k}") * F.lit((v - mid) / sum((u - mid) ** 2 for u in places)) for k, v in zip(steps, places))
    rest = (F.col("syy") - F.col("b") * F.col("b") * F.col("sxx")) / (F.col("m") - 2)
    t = div(F.col("b"), F.sqrt(div(F.when(rest > 0, rest), F.col("sxx"))))
    half = F.when((F.col("b") < 0) & (F.col("b") > -1), -F.lit(math.log(2)) / F.ln(F.col("b") + 1))
    return a.filter(F.col("n") >= least).select(by, "n", half.alias("half_life"), t.alias("df_t"), hurst.alias("hurst"))


def calibration_line(f: DataFrame, p: str, y: str, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of outcomes on the logit of forecasts, by reweighted least squares; a round
    is one aggregate of five sums. Forecasts are kept off 0 and 1 by 1e-6; a singular step ends the fit."""
    clipped = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    d = f.filter(f"{p} is not null and {y} is not null").select(F.ln(clipped / (1 - clipped)).alias("x"), F.col(y).cast("double").alias("y")).persist()
    a, b = 0.0, 1.0
    for _ in range(rounds):
        m = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
        w, e = m * (1 - m), F.col("y") - m
        s = d.agg(*(F.sum(v) for v in (w, w * F.col("x"), w * F.col("x") * F.col("x"), e, e * F.col("x")))).first()
        if s[0] is None or abs(s[0] * s[2] - s[1] * s[1]) < 1e-12:
            break
        det = s[0] * s[2] - s[1] * s[1]
        da, db = (s[2] * s[3] - s[1] * s[4]) / det, (s[0] * s[4] - s[1] * s[3]) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-10:
            break
    d.unpersist()
    return b, a


def haircut(sr: float, n: int, tests: int, how: str = "bonferroni", rank: int = 1) -> tuple[float, float]:
    """Sharpe ratio and p-value after allowing for `tests` trials, `rank` being the trial's place among them (1: best)."""
    t, nd = sr * math.sqrt(n), NormalDist()
    p = math.erfc(abs(t) / math.sqrt(2))
    times = {"bonferroni": tests, "holm": tests - rank + 1, "bhy": tests * sum(1 / i for i in range(1, tests + 1)) / rank}[how]
    q = min(1.0, max(p * times, 1e-300))
    back = -nd.inv_cdf(q / 2) if q < 1 else 0.0
    return math.copysign(back, sr) / math.sqrt(n), q


def sage_values(model, x: np.ndarray, y: np.ndarray, background: np.ndarray, orders: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard error of each feature's share in a model's gain in squared error. Features enter in a random
    order; those not yet in are imputed from background rows, over which predictions are averaged. One running mean and
    variance a feature (Welford), so nothing grows with `orders`."""
    rng = np.random.default_rng(seed)
    k = x.shape[1]
    mean, m2 = np.zeros(k), np.zeros(k)

    def loss(known: np.ndarray) -> float:
        filled = np.where(known, x[:, None, :], background[None, :, :]).reshape(-1, k)
        return float(np.mean((np.asarray(model(filled)).reshape(len(x), len(background)).mean(axis=1) - y) ** 2))

    for i in range(orders):
        known = np.zeros(k, bool)
        before = loss(known)
        for j in rng.permutation(k):
            known[j] = True
            after = loss(known)
            step = before - after - mean[j]
            mean[j] += step / (i + 1)
            m2[j] += step * (before - after - mean[j])
            before = after
    return mean, np.sqrt(m2 / max(1, orders - 1) / orders)


def contract_findings(text: Column) -> Column:
    """Errors of a JSON contract as a sorted array of strings; text that is no JSON object has one."""
    def at(*path: str) -> Column:
        return F.try_variant_get(F.try_parse_json(text), "$." + ".".join(path), "variant")

    def kind(v: Column) -> Column:
        return F.schema_of_variant(v)

    found = [F.when(at(k).isNull(), f"missing top-level key: {k}") for k in CONTRACT_KEYS]
    for parent, keys in CONTRACT_NESTED.items():
        nested = at(parent).isNull() | kind(at(parent)).startswith("OBJECT")
        found.append(F.when(~nested, f"{parent} must be an object"))
        found += [F.when(nested & at(parent, k).isNull(), f"missing {parent}.{k}") for k in keys]
    mode = F.try_variant_get(F.try_parse_json(text), "$.delivery.mode", "string")
    found.append(F.when(mode == "direct-main", "direct-main delivery is forbidden"))
    doc = F.try_parse_json(text)
    return F.when(doc.isNull() | ~F.coalesce(kind(doc).startswith("OBJECT"), F.lit(False)), F.array(F.lit("invalid contract"))).otherwise(F.array_sort(F.array_compact(F.array(*found))))


def extension(url: Column) -> Column:
    """Extension of an address's path in lower case, else its format parameter; jpeg reads jpg."""
    path = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    ext = F.lower(F.regexp_extract(path, r"[^/]\.([A-Za-z0-9]+)$", 1))
    ext = F.when(ext != "", ext).otherwise(F.lower(F.regexp_extract(url, r"[?&]format=([A-Za-z0-9]+)", 1)))
    return F.when(ext == "jpeg", "jpg").when(ext != "", ext)


def media_kind(url: Column, content_type: Column, hint: Column) -> Column:
    """image or video: by content type, else extension, else (no telling content type) hint, else a data address."""
    ct, ext = F.lower(F.trim(F.coalesce(F.split_part(content_type, F.lit(";"), F.lit(1)), F.lit("")))), extension(url)
    told = (ct != "") & (ct != "application/octet-stream")
    return (
        F.when(ct.startswith("image/"), "image").when(ct.startswith("video/"), "video")
        .when(ext.isin(*IMAGES), "image").when(ext.isin(*VIDEOS), "video")
        .when(told, F.lit(None).cast("string")).when(hint.isNotNull(), hint)
        .when(url.startswith("data:image/"), "image").when(url.startswith("data:video/"), "video")
    )


def sage_linear(df: DataFrame, betas: dict[str, float], y: str) -> dict[str, float]:
    """Exact shares of a linear model's gain in squared error over all rows: a feature left out is imputed by its mean,
    which for a linear model is the average over background rows. The losses of all subsets are one aggregate, so at most
    ten features; rows that lack a value go."""
    names = [n for n in betas if n in df.columns]
    if len(names) > 10:
        raise ValueError("at most ten features")
    d = df.select(*names, F.col(y).alias("_y")).na.drop()
    means = d.agg(*(F.avg(n) for n in names)).first()
    if not names or means[0] is None:
        return dict.fromkeys(names, 0.0)
    rest = F.lit(float(betas.get("intercept", 0.0)))
    part = lambda m: sum((F.lit(float(betas[n])) * (F.col(n) if m >> i & 1 else F.lit(means[i])) for i, n in enumerate(names)), rest)
    loss = d.agg(*(F.avg(F.pow(F.col("_y") - part(m), F.lit(2.0))) for m in range(1 << len(names)))).first()
    k = len(names)

    def share(i: int) -> float:
        without = [m for m in range(1 << k) if not m >> i & 1]
        return sum((loss[m] - loss[m | 1 << i]) / (k * math.comb(k - 1, m.bit_count())) for m in without)

    return {n: share(i) for i, n in enumerate(names)}


def overfit(sr: float, n: int, skew: float, kurt: float, variance: float, trials: int, level: float = 0.95) -> tuple[float, float, float, float, bool]:
    """Probabilistic and deflated Sharpe, least track record, Bonferroni haircut, and whether all of them hold."""
    from .analytics import deflated_sharpe, min_track_record, probabilistic_sharpe

    n, trials = int(n), int(trials)
    psr, dsr = probabilistic_sharpe(sr, n, skew, kurt), deflated_sharpe(sr, n, skew, kurt, variance, trials)
    length, cut = min_track_record(sr, skew, kurt), haircut(sr, n, trials)[0]
    return psr, dsr, length, cut, bool(dsr >= level and cut * 52**0.5 >= 0.5 and length <= n)
