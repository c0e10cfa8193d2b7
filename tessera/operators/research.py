"""Research operators over panels: residuals, blends, library rules, composite scores, attribution, costs, health checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import cross
from tessera.functions.series import S, div, rows

#: Column names that an executions file may use for each field.
FILL_NAMES = {
    "datetime": ["datetime", "time", "timestamp", "date"],
    "symbol": ["symbol", "code", "ticker"],
    "side": ["side", "direction", "bs"],
    "price": ["price", "px"],
    "qty": ["qty", "quantity", "shares", "volume"],
}
#: Costs in bps and the coefficient of the square-root law.
COMMISSION_BPS, STAMP_BPS, TRANSFER_BPS, IMPACT = 2.5, 5.0, 0.1, 0.1


def fills(raw: DataFrame) -> DataFrame:
    """Executions under any of the known names (any case, spaces, a byte order mark) with the fields of FILL_NAMES."""
    plain = {n.replace("﻿", "").strip().lower(): n for n in raw.columns}
    found = {field: next((plain[a] for a in names if a in plain), None) for field, names in FILL_NAMES.items()}
    if missing := [f for f, n in found.items() if n is None]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    out = raw.select(*(F.col(f"`{n}`").alias(f) for f, n in found.items()))
    side = F.when(F.lower(F.substring(F.trim(F.col("side").cast("string")), 1, 1)) == "b", "buy").otherwise("sell")
    return out.withColumns({"side": side, "price": F.expr("try_cast(price AS double)"), "qty": F.expr("try_cast(qty AS double)")})


def library(docs: DataFrame, text: str, entry: str) -> DataFrame:
    """A row for each entry of JSON documents that are a list of entries or an object with a list under `factors`."""
    listed = F.when(F.ltrim(F.col(text)).startswith("["), F.from_json(text, f"array<{entry}>")).otherwise(F.from_json(text, f"struct<factors:array<{entry}>>")["factors"])
    return docs.select(F.explode(listed).alias("entry")).select("entry.*")


def with_benchmark(df: DataFrame, benchmark: DataFrame, value: str) -> DataFrame:
    """A series with a row a date, joined to all symbols; the planner broadcasts it when it is small."""
    return df.join(benchmark.select("date", value), "date", "left")


def numeric_features(df: DataFrame, include: list[str] | None = None, exclude: tuple[str, ...] = ()) -> list[str]:
    """Names of the columns to use: those asked for, or all numeric ones, without the excluded; others are refused."""
    kinds = dict(df.dtypes)
    number = lambda n: kinds[n] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[n].startswith("decimal")
    names = [n for n in (include or [n for n in df.columns if number(n)]) if n not in exclude]
    if bad := [n for n in names if n not in kinds or not number(n)]:
        raise ValueError(f"not numeric columns: {', '.join(bad)}")
    return names


def fixed_windows(places: DataFrame, train: tuple[str, str], valid: tuple[str, str], embargo: int) -> DataFrame:
    """date and role of a fixed split; refused if fewer than `embargo` dates lie between the two windows."""
    if not train[0] <= train[1] < valid[0] <= valid[1]:
        raise ValueError("windows must follow one another")
    gap = places.filter((F.col("date") > F.to_date(F.lit(train[1]))) & (F.col("date") < F.to_date(F.lit(valid[0])))).count()
    if gap < embargo:
        raise ValueError(f"{gap} dates between the windows, {embargo} required")
    role = F.when(F.col("date").between(*(F.to_date(F.lit(x)) for x in train)), "train").when(F.col("date").between(*(F.to_date(F.lit(x)) for x in valid)), "valid")
    return places.select("date", role.alias("role")).filter("role is not null")


def tradable(df: DataFrame, limit: float = 0.1) -> DataFrame:
    """can_buy and can_sell: not closed (some volume), and not up, or down, to the limit."""
    open_ = F.coalesce(F.col("volume") > 0, F.lit(False))
    move = F.coalesce(F.col("ret"), F.lit(0.0))
    return df.withColumns({"can_buy": open_ & (move < limit), "can_sell": open_ & (move > -limit)})


def missing_snapshots(panel: DataFrame) -> DataFrame:
    """(symbol, date) of month ends at which a symbol has no row; month ends are the last dates of the panel's months."""
    ends = panel.groupBy(F.trunc("date", "month").alias("m")).agg(F.max("date").alias("date")).select("date")
    grid = panel.select("symbol").distinct().join(ends, how="cross")  # the very grid that is asked about: symbols x months
    return grid.join(panel.select("symbol", "date"), ["symbol", "date"], "left_anti")


def rolling_median_z(x: str, n: int = 252, least: int = 63, bound: float = 3.0) -> Column:
    """(x - rolling median) / rolling deviation (ddof 0), clipped; NULL under `least` values."""
    w = rows(n)
    z = div(F.col(x) - F.percentile(F.col(x), F.lit(0.5)).over(w), F.stddev_pop(x).over(w))
    return F.when((F.count(x).over(w) >= least) & z.isNotNull(), F.greatest(F.lit(-bound), F.least(F.lit(bound), z)))


def blend_weights(reports: DataFrame, score: str, ir: str, cap: float = 0.35) -> DataFrame:
    """Equal, score and IR weights over a row per factor: shares of what is positive, cut at the cap and scaled to one."""
    every = Window.partitionBy()  # a row a factor
    n = F.count("*").over(every)

    def shares(x: str) -> Column:
        raw = F.greatest(F.lit(0.0), F.col(x))
        return F.when(F.sum(raw).over(every) > 0, F.least(F.lit(cap), raw / F.sum(raw).over(every))).otherwise(1.0 / n)

    cut = reports.withColumns({"_s": shares(score), "_i": shares(ir), "equal": 1.0 / n})
    return cut.withColumns({"by_score": F.col("_s") / F.sum("_s").over(every), "by_ir": F.col("_i") / F.sum("_i").over(every)}).drop("_s", "_i")


def residualize(df: DataFrame, y: str, styles: list[str], sector: str, least: int = 30) -> DataFrame:
    """Rows with all values present and `residual`: y less its daily least-squares fit on sector dummies and styles.

    Dummies are taken out by sector means; styles one after the other, each cleared of those before (Gram-Schmidt, which
    gives the residual of the joint fit). All by windows over dates. NULL under max(least, 3 * regressors) rows."""
    day, cell = Window.partitionBy("date"), Window.partitionBy("date", sector)
    out = df.dropna(subset=[y, sector, *styles])
    out = out.withColumns({f"_{n}": F.col(n) - F.avg(n).over(cell) for n in (y, *styles)})
    out = out.withColumn("_k", F.size(F.collect_set(sector).over(day)) - 1 + len(styles)).withColumn("_n", F.count("*").over(day))
    for i, s in enumerate(styles):
        rest = [y, *styles[i + 1 :]]
        # a style that nothing is left of but rounding takes no part
        left = F.sum(F.col(f"_{s}") ** 2).over(day)
        slopes = {f"_b_{n}": F.when(left > 1e-18, F.sum(F.col(f"_{n}") * F.col(f"_{s}")).over(day) / left).otherwise(0.0) for n in rest}
        out = out.withColumns(slopes)
        out = out.withColumns({f"_{n}": F.col(f"_{n}") - F.col(f"_b_{n}") * F.col(f"_{s}") for n in rest}).drop(*slopes)
    value = F.when(F.col("_n") >= F.greatest(F.lit(least), 3 * F.col("_k")), F.col(f"_{y}"))
    return out.select(*df.columns, value.alias("residual"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def primary_score(ir: Column, sharpe: Column, annual: Column, drawdown: Column, mono: Column, turnover: Column) -> Column:
    """Composite score of a factor; every term is clipped before it is weighted."""
    terms = [
        (0.20, clip(ir / 3.0, -2.0, 2.0)),
        (0.30, clip(sharpe + 0.5, -2.0, 2.0)),
        (0.30, clip(annual / 0.10, -2.0, 2.0)),
        (0.20, clip(1 + drawdown / 0.30, -2.0, 1.0)),
        (0.10, clip(mono, -1.0, 1.0)),
        (0.10, -clip(turnover / 30.0 - 1, 0.0, 3.0)),
    ]
    return sum((F.lit(w) * t for w, t in terms[1:]), F.lit(terms[0][0]) * terms[0][1])


#: Metrics that a library entry must have.
METRICS = ("ICIR", "RankICIR", "O-ICIR", "O-RankICIR", "O-HybridICIR")


def library_verdicts(factors: DataFrame, least_hybrid: float = 0.2, most_decay: float | None = None, consistent: bool = False) -> DataFrame:
    """Entries (name, status, direction_consistent and METRICS as columns) with retention, decay, reasons and kept."""
    m = {n: F.col(f"`{n}`") for n in METRICS}
    finite = {n: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))) for n, c in m.items()}
    whole = finite["ICIR"] & finite["RankICIR"] & finite["O-ICIR"] & finite["O-RankICIR"]
    usable = whole & (m["ICIR"] > 0) & (m["RankICIR"] > 0)
    worst = F.when(usable, F.least(m["O-ICIR"] / m["ICIR"], m["O-RankICIR"] / m["RankICIR"]))
    checks = [(m[n].isNull(), f"missing_or_invalid_metric:{n}") for n in METRICS]
    checks += [(m[n].isNotNull() & ~finite[n], f"nonfinite_metric:{n}") for n in METRICS]
    checks += [(F.coalesce(F.lower(F.trim("status")), F.lit("")) != "effective", "status_not_effective")]
    checks += [(~F.coalesce("direction_consistent", F.lit(False)), "direction_inconsistent")] if consistent else []
    checks += [(finite["O-HybridICIR"] & (m["O-HybridICIR"] < least_hybrid), "o_hybrid_icir_below_threshold")]
    checks += [(whole & (m[n] <= 0), f"nonpositive_insample_metric:{n}") for n in ("ICIR", "RankICIR")]
    checks += [(worst < 1 - most_decay - 1e-12, "decay_above_threshold")] if most_decay is not None else []
    out = factors.withColumns({"worst_retention": worst, "decay": 1 - worst, "reasons": F.array_compact(F.array(*(F.when(c, why) for c, why in checks)))})
    return out.withColumn("kept", F.size("reasons") == 0)


def attribution(df: DataFrame, portfolio: str, benchmark: str, value: str, styles: tuple[str, str]) -> DataFrame:
    """Per date: portfolio and benchmark return, active return, contributions of two styles (their daily least-squares
    returns times active exposure), the specific rest, and Carino's coefficient. A row a date comes out."""
    a, b = styles
    active = F.col(portfolio) - F.col(benchmark)
    both = lambda x, y: F.covar_samp(F.col(x), F.col(y))
    g = df.dropna(subset=[value, a, b]).groupBy("date").agg(
        F.sum(F.col(portfolio) * F.col(value)).alias("rp"),
        F.sum(F.col(benchmark) * F.col(value)).alias("rb"),
        F.sum(active * F.col(a)).alias("xa"),
        F.sum(active * F.col(b)).alias("xb"),
        *(both(x, y).alias(n) for n, x, y in (("aa", a, a), ("bb", b, b), ("ab", a, b), ("ya", value, a), ("yb", value, b))),
    )
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    fa = div(F.col("ya") * F.col("bb") - F.col("yb") * F.col("ab"), det)
    fb = div(F.col("yb") * F.col("aa") - F.col("ya") * F.col("ab"), det)
    g = g.withColumns({"active": F.col("rp") - F.col("rb"), a: F.col("xa") * fa, b: F.col("xb") * fb})
    g = g.withColumn("specific", F.col("active") - F.col(a) - F.col(b))
    near = F.abs(F.col("active")) < 1e-12
    k = F.when(near, 1 / (1 + F.col("rp"))).otherwise((F.log1p("rp") - F.log1p("rb")) / F.col("active"))
    return g.select("date", "rp", "rb", "active", a, b, "specific", k.alias("k"))


def linked(periods: DataFrame, names: list[str]) -> DataFrame:
    """Effects over all periods, scaled by Carino's coefficients so that they add up to the compounded active return."""
    sums = periods.agg(F.sum(F.log1p("rp")).alias("lp"), F.sum(F.log1p("rb")).alias("lb"), *(F.sum(F.col(n) * F.col("k")).alias(n) for n in names))
    active = F.exp("lp") - F.exp("lb")
    scale = F.when(F.abs(F.col("lp") - F.col("lb")) < 1e-12, F.exp(-F.col("lp"))).otherwise((F.col("lp") - F.col("lb")) / active)
    return sums.select(active.alias("active"), *((F.col(n) / scale).alias(n) for n in names))


def shortfall(executions: DataFrame) -> DataFrame:
    """Costs in bps of (symbol, side, price, qty, arrival, bench, adv, sigma_day, half_spread): timing, impact by the
    square-root law, spread, fees (stamp duty on sells of the mainland exchanges), slippage, and their sum."""
    d = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    bps = lambda x: F.round(x * 1e4 * 100, 0) / 100  # noqa: E731  the number itself is rounded, not its shortest decimals
    stamp = (F.col("side") != "buy") & F.upper(F.col("symbol").cast("string")).rlike(r"\.(SH|SZ|BJ)$")
    out = executions.withColumns(
        {
            "timing": bps(F.coalesce(div(d * (F.col("bench") - F.col("arrival")), F.col("arrival")), F.lit(0.0))),
            "impact": bps(F.when(F.col("adv") > 0, IMPACT * F.col("sigma_day") * F.sqrt(F.col("qty") / F.col("adv"))).otherwise(0.0)),
            "spread": bps(F.coalesce("half_spread", F.lit(0.0))),
            "fees": F.lit(COMMISSION_BPS + TRANSFER_BPS) + F.when(stamp, STAMP_BPS).otherwise(0.0),
            "slippage": bps(F.coalesce(div(d * (F.col("price") - F.col("bench")), F.col("bench")), F.lit(0.0))),
        }
    )
    return out.withColumn("total", sum((F.col(n) for n in ("impact", "spread", "fees", "slippage")), F.col("timing")))


def mean_of_hundredths(name: str) -> Column:
    """Mean, to one decimal with halves away from zero, of a column of whole hundredths: their sum is one of integers,
    so a mean that ends in 5 rounds the same way whatever the order of rows."""
    total, n = F.sum(F.round(F.col(name) * 100, 0).cast("long")), F.count(name)
    tenths = F.call_function("div", F.abs(total) + 5 * n, F.nullif(10 * n, F.lit(0)))
    return F.when(total < 0, -tenths).otherwise(tenths) / 10.0


def index_factor(df: DataFrame, momentum: int = 126, reversal: int = 21, vol: int = 63) -> DataFrame:
    """z(momentum) + 0.25 z(reversal) + 0.25 z(low volatility) per date, all one row late."""
    back = lambda n: div(F.lag("close", 1).over(S()), F.lag("close", n + 1).over(S())) - 1
    sd = F.when(F.count("ret").over(rows(vol)) == vol, F.stddev_samp("ret").over(rows(vol)))
    out = df.withColumn("_v", sd).withColumns({"_m": back(momentum), "_r": -back(reversal), "_l": -F.lag("_v", 1).over(S())})
    return out.withColumn("value", cross.z("_m") + 0.25 * cross.z("_r") + 0.25 * cross.z("_l")).drop("_v", "_m", "_r", "_l")


def deciles(df: DataFrame, signal: str, value: str, groups: int = 10) -> DataFrame:
    """Group of yesterday's signal by average-tie rank, and the group's mean return, per date."""
    late = df.withColumn("_s", F.lag(signal, 1).over(S())).withColumn("decile", F.ceil(cross.rank("_s") * groups).cast("int"))
    return late.filter("decile is not null").groupBy("date", "decile").agg(F.avg(value).alias("ret"), F.count(value).alias("n"))


def health(periods: DataFrame, holdings: DataFrame, horizon: int = 5, top: float = 0.1) -> DataFrame:
    """One row: holdings, turnover, drawdown and invested share of a backtest, each with whether it looks sound.
    periods: date, turnover, log_nav; holdings: date, held, universe."""
    peak = F.max("log_nav").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))  # a row a date
    p = periods.withColumn("_dd", F.exp(F.col("log_nav") - F.greatest(F.lit(0.0), peak)) - 1).agg(F.avg("turnover").alias("turnover"), F.min("_dd").alias("drawdown"))
    h = holdings.agg(F.avg("held").alias("held"), (F.avg("universe") * top).alias("expected"), F.avg((F.col("held") > 0).cast("double")).alias("invested"))
    t = 2.0 / horizon
    return p.join(h, how="cross").select(
        "held", "expected", F.col("held").between(0.7 * F.col("expected"), 1.1 * F.col("expected")).alias("held_ok"),
        "turnover", F.col("turnover").between(0.5 * t, 1.5 * t).alias("turnover_ok"),
        "drawdown", ((F.col("drawdown") > -0.5) & (F.col("drawdown") < -0.05)).alias("drawdown_ok"),
        "invested", (F.col("invested") > 0.8).alias("invested_ok"),
    )


def quarter_chunks(quarters: DataFrame, most: int = 20) -> DataFrame:
    """Runs of at most `most` quarters, in order: chunk, first, last, n. A row a quarter goes in."""
    placed = quarters.select("quarter").distinct().withColumn("chunk", F.floor((F.row_number().over(Window.orderBy("quarter")) - 1) / most).cast("int"))
    return placed.groupBy("chunk").agg(F.min("quarter").alias("first"), F.max("quarter").alias("last"), F.count("*").alias("n"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """ECE and MCE of bins (n, p, y): mean gap by share, and the greatest gap; bins without rows count for nothing."""
    gap = F.abs(F.col("p") - F.col("y"))
    return bins.agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def month_ends_turn(dates: DataFrame, before: int = 1, after: int = 3) -> DataFrame:
    """Dates with `turn`: among the last `before` or the first `after` of their month."""
    m = Window.partitionBy(F.trunc("date", "month"))
    return dates.withColumn("turn", (F.row_number().over(m.orderBy("date")) <= after) | (F.row_number().over(m.orderBy(F.desc("date"))) <= before))


def false_discovery(tests: DataFrame, p: str) -> DataFrame:
    """Benjamini-Hochberg adjusted p, over a row a test."""
    up = Window.orderBy(F.col(p).desc(), "name")
    ranked = tests.withColumn("_k", F.row_number().over(Window.orderBy(p, F.desc("name")))).withColumn("_q", F.col(p) * F.count("*").over(Window.partitionBy()) / F.col("_k"))
    return ranked.withColumn("adjusted", F.least(F.lit(1.0), F.min("_q").over(up.rowsBetween(Window.unboundedPreceding, 0)))).drop("_k", "_q")
