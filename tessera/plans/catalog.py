"""Registered queries: each operator over the derived panel, with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import cross, series
from tessera.operators import analytics, checks, factors, joins, quality, text
from tessera.plans import extras, markets, studies
from tessera.plans import oracle as O
from tessera.sources.panel import bars, checkpointed, densify, industries, staged, table

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
tidy = series.tidy


def add(name: str, plan: Callable, sql: str | None = None) -> None:
    Q[name] = plan
    if sql:
        SQL[name] = sql


def column(name: str, build: Callable[[], Column], sql: str) -> None:
    """A window expression over staged bars."""
    add(name, lambda spark, d: staged(spark, d).select("symbol", "date", tidy(build()).alias("value")), O.value(sql))


def _series() -> None:
    x, v = "close", "volume"
    lst = "list(close) OVER w10"
    column("w01_delay", lambda: series.delay(x, 5), "lag(close, 5) OVER s")
    column("w02_delta", lambda: series.delta(x, 5), "close - lag(close, 5) OVER s")
    column("w03_ts_sum", lambda: series.ts_sum(x, 10), O.full(x, 10, "sum(close) OVER w10"))
    column("w04_ts_mean", lambda: series.ts_mean(v, 20), O.full(v, 20, "avg(volume) OVER w20"))
    column("w05_ts_std", lambda: series.ts_std("ret", 10), O.full("ret", 10, "stddev_samp(ret) OVER w10"))
    column("w06_ts_max", lambda: series.ts_max(x, 10) - series.ts_min(x, 10), O.full(x, 10, "max(close) OVER w10 - min(close) OVER w10"))
    column("w07_ts_rank", lambda: series.ts_rank(x, 10), O.full(x, 10, O.rank(x, 10)))
    column("w08_ts_argmax", lambda: series.ts_argmax(x, 10), O.full(x, 10, f"list_position({lst}, list_max({lst}))"))
    column("w08_ts_argmin", lambda: series.ts_argmin(x, 10), O.full(x, 10, f"list_position({lst}, list_min({lst}))"))
    column("w09_product", lambda: series.product("oc", 3), O.full("oc", 3, "list_reduce(list(oc) OVER w3, lambda a, v: a * v)"))
    column("w10_corr", lambda: series.ts_corr(x, v, 10), O.full(x, 10, f"coalesce({O.corr(x, v, 'w10')}, 0)"))
    column("w11_cov", lambda: series.ts_cov("ret", "dv", 10), O.full("CASE WHEN dv IS NOT NULL THEN ret END", 10, "covar_samp(ret, dv) OVER w10"))
    add("w12_ema", lambda s, d: factors.fold(staged(s, d), x, 1 / 3, "e").select("symbol", "date", tidy("e").alias("value")), O.value(O.fold(x, 1 / 3)))
    column("w13_decay_linear", lambda: series.decay_linear(x, 5), "(" + " + ".join(f"{5 - k}.0::DOUBLE * lag(close, {k}) OVER s" for k in range(4, -1, -1)) + ") / 15.0::DOUBLE")
    column("w14_wma", lambda: series.wma(x, 5), "(" + " + ".join(f"{0.9**k!r}::DOUBLE * lag(close, {k}) OVER s" for k in range(4, -1, -1)) + f") / {sum(0.9**k for k in range(4, -1, -1))!r}::DOUBLE")
    column("w15_regbeta", lambda: series.slope(x, 10), O.full(x, 10, "regr_slope(close, n::DOUBLE) OVER w10"))
    column("w16_lowday", lambda: series.low_day(x, 10), O.full(x, 10, f"list_position(list_reverse({lst}), list_min({lst})) - 1"))
    column("w16_highday", lambda: series.high_day(x, 10), O.full(x, 10, f"list_position(list_reverse({lst}), list_max({lst})) - 1"))
    column("w17_count", lambda: series.count_if(F.col("ret") > 0, 10), "sum(CASE WHEN ret > 0 THEN 1 ELSE 0 END) OVER w10")
    column("w17_sumif", lambda: series.sum_if(v, 10, F.col("ret") > 0), "sum(CASE WHEN ret > 0 THEN volume ELSE 0 END) OVER w10")
    column("w18_returns", lambda: series.returns(x), "close / nullif(lag(close) OVER s, 0) - 1")
    column("w19_rank", lambda: cross.rank("ret"), O.pct("ret"))
    column("w20_scale", lambda: cross.scale("ret"), "ret / nullif(sum(abs(ret)) OVER d, 0)")
    column("w21_row_max", lambda: cross.row_max(x) - cross.row_min(x), "max(close) OVER d - min(close) OVER d")
    column("w22_elementwise", lambda: cross.sign("ret") * cross.emax("open", x) + cross.emin("open", x) + cross.log(v) + F.abs("ret"), "sign(ret) * greatest(open, close) + least(open, close) + ln(volume) + abs(ret)")


def _factors() -> None:
    m, w = 2, 5
    c, r5 = "close", "close / nullif(lag(close, 5) OVER s, 0) - 1"
    mean = lambda e: O.some(e, w, m, f"avg({e}) OVER w5")
    sd = lambda e: O.some(e, w, m, f"stddev_pop({e}) OVER w5")
    span = "(close - min(low) OVER w5) / nullif(max(high) OVER w5 - min(low) OVER w5, 0) - 0.5"
    rsi = f"{O.fold('gain', 0.2)} / nullif({O.fold('gain', 0.2)} + {O.fold('loss', 0.2)}, 0)"
    sql = {
        "return": r5,
        "skip_return": "lag(close, 5) OVER s / nullif(lag(close, 10) OVER s, 0) - 1",
        "reversal": f"-({r5})",
        "sma_gap": f"close / ({mean(c)}) - 1",
        "ema_gap": f"CASE WHEN n >= 2 THEN close / {O.fold(c, 2 / 6)} - 1 END",
        "dual_ema_gap": f"CASE WHEN n >= 2 THEN ({O.fold(c, 2 / 4)} - {O.fold(c, 2 / 6)}) / close END",
        "range_position": O.some("high", w, m, span),
        "stoch": O.some("high", w, m, span),
        "breakout": O.some("ph", w, m, "close / max(ph) OVER w5 - 1"),
        "breakdown": O.some("pl", w, m, "-(close / min(pl) OVER w5 - 1)"),
        "rsi": f"CASE WHEN n > 2 THEN {rsi} - 0.5 END",
        "rsi_reversal": f"CASE WHEN n > 2 THEN -({rsi} - 0.5) END",
        "atr_ratio": f"({mean('tr')}) / close",
        "range_ratio": mean("hl"),
        "realized_vol": sd("ret"),
        "downside_vol": sd("down"),
        "trend_strength": f"({r5}) / nullif({sd('ret')}, 0)",
        "efficiency": f"abs(close - lag(close, 5) OVER s) / nullif({O.some('absd', w, m, 'sum(absd) OVER w5')}, 0)",
        "volume_ratio": f"volume / ({mean('volume')}) - 1",
        "volume_z": f"(volume - ({mean('volume')})) / nullif({sd('volume')}, 0)",
        "dollar_volume": f"cv / ({mean('cv')}) - 1",
        "price_volume_corr": O.some("CASE WHEN dv IS NOT NULL THEN ret END", w, m, O.corr("ret", "dv", "w5")),
        "gap_sum": O.some("gap", w, m, "sum(gap) OVER w5"),
        "intraday": mean("oc"),
        "upper_wick": mean("up"),
        "lower_wick": mean("dn"),
        "drawdown": O.some(c, w, m, "close / max(close) OVER w5 - 1"),
        "ts_rank_close": O.some(c, w, m, f"{O.rank(c, 5)} - 0.5"),
        "ts_rank_volume": O.some("volume", w, m, f"{O.rank('volume', 5)} - 0.5"),
        "ret_skew": "CASE WHEN count(ret) OVER w5 >= 3 AND stddev_pop(ret) OVER w5 > 0 THEN skewness(ret) OVER w5 END",
        "ret_kurt": "CASE WHEN count(ret) OVER w5 >= 4 AND stddev_pop(ret) OVER w5 > 0 THEN kurtosis(ret) OVER w5 END",
    }
    staged2 = {
        "sma_slope": (f", t AS (SELECT *, {mean(c)} AS sma FROM b {O.WINDOWS})", f"({O.full('sma', 5, 'regr_slope(sma, n::DOUBLE) OVER w5')}) / close"),
        "obv_slope": (f", t AS (SELECT *, sum(coalesce(flow, 0)) OVER u AS obv FROM b {O.WINDOWS})", f"({O.full('obv', 5, 'regr_slope(obv, n::DOUBLE) OVER w5')}) / ({mean('volume')})"),
    }
    for i, name in enumerate(factors.BASES):
        plan = lambda s, d, name=name: factors.base(staged(s, d), name).select("symbol", "date", tidy("value").alias("value"))
        twin = O.value(staged2[name][1], staged2[name][0], "t") if name in staged2 else O.value(sql[name])
        add(f"f{i + 1:02d}_{name}", plan, twin)
    mean20, sd20 = (lambda e: O.some(e, 20, 5, f"avg({e}) OVER w20")), (lambda e: O.some(e, 20, 5, f"stddev_pop({e}) OVER w20"))
    value = {
        "raw": "x",
        "neg": "-x",
        "z": f"(x - ({mean20('x')})) / nullif({sd20('x')}, 0)",
        "delta": "x - lag(x) OVER s",
        "smooth": f"CASE WHEN count(x) OVER u >= 2 THEN {O.fold('x', 2 / 4)} END",
        "rank": f"CASE WHEN x IS NOT NULL THEN {O.some('x', 20, 5, O.rank('x', 20) + ' - 0.5')} END",
        "vol_scaled": f"x / nullif({sd20('ret')}, 0)",
        "stability": f"x / nullif({sd20('x')}, 0)",
        "confirm_volume": f"x * volume / ({mean20('volume')})",
        "compress": "tanh(x)",
    }
    first = f", t AS (SELECT *, {r5} AS x FROM b {O.WINDOWS})"
    for i, name in enumerate(factors.TRANSFORMS):
        plan = lambda s, d, name=name: factors.factor(staged(s, d), ("return", name, 5)).select("symbol", "date", tidy("value").alias("value"))
        add(f"t{max(0, i - 1):02d}_{name}", plan, O.value(value[name], first, "t"))
    z = f"(x - ({mean20('x')})) / nullif({sd20('x')}, 0)"
    add(
        "t10_signals",
        lambda s, d: flagship(s, d),
        f"WITH {O.STAGED}{first}, z AS (SELECT symbol, date, {O.tidy(z)} AS value FROM t {O.WINDOWS}), p AS (SELECT *, {O.pct('value')} AS pct FROM z), "
        "g AS (SELECT *, CASE WHEN pct >= 0.8::DOUBLE THEN 1 WHEN pct <= 1 - 0.8::DOUBLE THEN -1 ELSE 0 END AS signal FROM p), "
        "h AS (SELECT *, coalesce(lag(signal) OVER (PARTITION BY symbol ORDER BY date), 0) AS position FROM g) "
        "SELECT symbol, date, value, pct, signal, position, position <> 0 AND signal = 0 AS exit, CASE WHEN signal > position THEN 'buy' WHEN signal < position THEN 'sell' ELSE 'hold' END AS action FROM h",
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = factors.factor(staged(spark, sf_dir), ("return", "z", 5)).withColumn("value", tidy("value"))
    return factors.signals(v).select("symbol", "date", "value", "pct", "signal", "position", "exit", "action")


def _valued(s: SparkSession, d: str, h: int = 1) -> DataFrame:
    """Bars with value = five-row return and fwd = return of the next h opens, both tidy."""
    b = analytics.forward_return(factors.base(staged(s, d), "return"), h)
    return b.withColumn("value", tidy("value")).withColumn("fwd", tidy("fwd"))


def _sql_valued(h: int = 1) -> str:
    v, f = O.tidy("close / nullif(lag(close, 5) OVER s, 0) - 1"), O.tidy(f"lead(open, {1 + h}) OVER s / nullif(lead(open, 1) OVER s, 0) - 1")
    return f"WITH {O.STAGED}, t AS (SELECT *, {v} AS value, {f} AS fwd FROM b {O.WINDOWS})"


def _cross() -> None:
    med = "quantile_cont(ret, 0.5) OVER d"

    def mad(s, d, k=3.0):
        a = staged(s, d).withColumn("m", cross.median("ret")).withColumn("a", F.abs(F.col("ret") - F.col("m")))
        a = a.withColumn("mad", cross.median("a") * 1.4826).withColumn("x", F.when(F.col("ret").isNotNull(), F.greatest(F.col("m") - k * F.col("mad"), F.least(F.col("m") + k * F.col("mad"), F.col("ret")))))
        return a.select("symbol", "date", tidy(cross.z("x")).alias("value"))

    add("x01_mad_z", mad, f"WITH {O.STAGED}, t AS (SELECT *, {med} AS m FROM b {O.WINDOWS}), t2 AS (SELECT *, quantile_cont(abs(ret - m), 0.5) OVER d * 1.4826::DOUBLE AS mad FROM t {O.WINDOWS}), t3 AS (SELECT *, CASE WHEN ret IS NOT NULL THEN greatest(m - 3.0::DOUBLE * mad, least(m + 3.0::DOUBLE * mad, ret)) END AS x FROM t2) SELECT symbol, date, {O.tidy('(x - avg(x) OVER d) / nullif(stddev_samp(x) OVER d, 0)')} AS value FROM t3 {O.WINDOWS}")
    column("x03_z_pop", lambda: cross.z("ret", 0), "(ret - avg(ret) OVER d) / nullif(stddev_pop(ret) OVER d, 0)")
    lo, hi = "quantile_cont(ret, 0.05) OVER d", "quantile_cont(ret, 0.95) OVER d"
    column("x04_quantile_winsor", lambda: F.when(F.col("ret").isNotNull(), F.greatest(F.percentile("ret", F.lit(0.05)).over(cross.D()), F.least(F.percentile("ret", F.lit(0.95)).over(cross.D()), F.col("ret")))), f"CASE WHEN ret IS NOT NULL THEN greatest({lo}, least({hi}, ret)) END")
    column("x06_label_rank", lambda: cross.rank("ret") - 0.5, f"({O.pct('ret')}) - 0.5")
    column("x07_median_fill", lambda: F.coalesce(F.col("ret"), cross.median("ret")), f"coalesce(ret, {med})")

    def fitted(s, d):
        b = staged(s, d)
        stats = b.filter("date < date'1996-01-01'").agg(F.avg("ret").alias("m"), F.stddev_pop("ret").alias("sd"), F.percentile("ret", F.lit(0.5)).alias("med"))
        return b.join(F.broadcast(stats), how="cross").select("symbol", "date", tidy(series.div(F.coalesce("ret", "med") - F.col("m"), F.col("sd"))).alias("value"))  # stats: one row

    add("x08_fitted_transform", fitted, f"WITH {O.STAGED}, f AS (SELECT avg(ret) AS m, stddev_pop(ret) AS sd, quantile_cont(ret, 0.5) AS med FROM b WHERE date < '1996-01-01') SELECT symbol, date, {O.tidy('(coalesce(ret, med) - m) / nullif(sd, 0)')} AS value FROM b, f")
    add("x09_industry_neutral", lambda s, d: staged(s, d).join(industries(s, d), "symbol").select("symbol", "date", tidy(cross.demean("ret", "sector")).alias("value")), f"WITH {O.STAGED} SELECT symbol, date, {O.tidy('ret - avg(ret) OVER (PARTITION BY date, n_name)')} AS value FROM b JOIN supplier ON s_suppkey = symbol JOIN nation ON n_nationkey = s_nationkey")
    add("x09_style_neutral_ols", lambda s, d: analytics.daily_ols(analytics.exposures(staged(s, d)), ["size", "vol"], "ret"))
    column("x10_blend", lambda: (2 * cross.z("ret") - cross.z("dv")) / 3, "(2 * ((ret - avg(ret) OVER d) / nullif(stddev_samp(ret) OVER d, 0)) - (dv - avg(dv) OVER d) / nullif(stddev_samp(dv) OVER d, 0)) / 3")


def _evaluate() -> None:
    t = _sql_valued()
    ic = t + f", k AS (SELECT * FROM t WHERE value IS NOT NULL AND fwd IS NOT NULL), r AS (SELECT *, {O.pct('value')} AS rv, {O.pct('fwd')} AS rf FROM k), i AS (SELECT date, covar_pop(value, fwd) / nullif(stddev_pop(value) * stddev_pop(fwd), 0) AS ic, covar_pop(rv, rf) / nullif(stddev_pop(rv) * stddev_pop(rf), 0) AS rank_ic, count(*) AS n FROM r GROUP BY date HAVING count(*) >= 8)"
    add("e01_forward_return", lambda s, d: analytics.forward_return(staged(s, d), 5).select("symbol", "date", tidy("fwd").alias("value")), O.value("lead(open, 6) OVER s / nullif(lead(open, 1) OVER s, 0) - 1"))
    add("e03_daily_ic", lambda s, d: analytics.daily_ic(_valued(s, d)).select("date", tidy("ic").alias("ic"), tidy("rank_ic").alias("rank_ic"), "n"), ic + f" SELECT date, {O.tidy('ic')} AS ic, {O.tidy('rank_ic')} AS rank_ic, n FROM i")
    add("e08_ic_summary", lambda s, d: analytics.summary(analytics.daily_ic(_valued(s, d))).select(tidy("ic_mean").alias("ic_mean"), tidy("ic_std").alias("ic_std"), tidy("icir").alias("icir"), tidy("positive").alias("positive"), "dates"), ic + f" SELECT {O.tidy('avg(ic)')} AS ic_mean, {O.tidy('stddev_samp(ic)')} AS ic_std, {O.tidy('avg(ic) / stddev_samp(ic) * sqrt(252 / 5.0::DOUBLE)')} AS icir, {O.tidy('avg((ic > 0)::INT)')} AS positive, count(ic) AS dates FROM i")
    w = lambda: Window.orderBy("date")
    add("e07_ic_timeline", lambda s, d: analytics.daily_ic(_valued(s, d)).select("date", tidy(F.sum("ic").over(w())).alias("cumulative"), tidy(F.avg("ic").over(w().rowsBetween(-59, 0))).alias("rolling")), ic + f" SELECT date, {O.tidy('sum(ic) OVER (ORDER BY date)')} AS cumulative, {O.tidy('avg(ic) OVER (ORDER BY date ROWS 59 PRECEDING)')} AS rolling FROM i")

    def horizons(s, d):
        return analytics.ic_by_horizon(factors.base(staged(s, d), "return"), (1, 3, 5, 10), tidy)

    def decay(s, d):
        ic = horizons(s, d)
        return ic.groupBy("horizon").agg(tidy(F.avg("ic")).alias("ic_mean"), tidy(series.div(F.avg("ic"), F.stddev_samp("ic")) * F.sqrt(F.lit(252.0) / F.col("horizon"))).alias("icir"))

    def decay_sql(h):
        return "(" + _sql_valued(h) + f", k AS (SELECT * FROM t WHERE value IS NOT NULL AND fwd IS NOT NULL), i AS (SELECT date, covar_pop(value, fwd) / nullif(stddev_pop(value) * stddev_pop(fwd), 0) AS ic FROM k GROUP BY date HAVING count(*) >= 8) SELECT {h} AS horizon, {O.tidy('avg(ic)')} AS ic_mean, {O.tidy(f'avg(ic) / stddev_samp(ic) * sqrt(252 / {h}.0::DOUBLE)')} AS icir FROM i)"

    add("e15_half_life_interval", lambda s, d: s.createDataFrame([analytics.half_life_interval(horizons(s, d)) or (None, None, None)], "half_life double, low double, high double"))
    add("e05_ic_decay", decay, " UNION ALL ".join(map(decay_sql, (1, 3, 5, 10))))
    add("e06_ic_by_sector", lambda s, d: analytics.summary(analytics.daily_ic(_valued(s, d).join(industries(s, d), "symbol"), "sector", least=3), 5, "sector").select("sector", tidy("ic_mean").alias("ic_mean"), "dates"), t + f", k AS (SELECT t.*, n_name AS sector FROM t JOIN supplier ON s_suppkey = symbol JOIN nation ON n_nationkey = s_nationkey WHERE value IS NOT NULL AND fwd IS NOT NULL), i AS (SELECT date, sector, covar_pop(value, fwd) / nullif(stddev_pop(value) * stddev_pop(fwd), 0) AS ic FROM k GROUP BY ALL HAVING count(*) >= 3) SELECT sector, {O.tidy('avg(ic)')} AS ic_mean, count(ic) AS dates FROM i GROUP BY sector")
    bk = t + f", k AS (SELECT * FROM t WHERE value IS NOT NULL AND fwd IS NOT NULL), q AS (SELECT *, ceil(({O.pct('value')}) * 5)::INT AS bucket FROM k), g AS (SELECT date, bucket, avg(fwd) AS m FROM q GROUP BY ALL)"

    def quint(s, d):
        g = analytics.buckets(_valued(s, d), 5).groupBy("date", "bucket").agg(F.avg("fwd").alias("m"))
        return g.groupBy("bucket").agg(tidy(F.avg("m")).alias("mean"), F.count("*").alias("dates"))

    add("a10_quantile_returns", quint, bk + f" SELECT bucket, {O.tidy('avg(m)')} AS mean, count(*) AS dates FROM g GROUP BY bucket")
    add("e09_monotonicity", lambda s, d: quint(s, d).agg(tidy(analytics.corr(F.col("bucket").cast("double"), "mean")).alias("monotonicity")), bk + f", m AS (SELECT bucket, {O.tidy('avg(m)')} AS mean FROM g GROUP BY bucket) SELECT {O.tidy('corr(bucket, mean)')} AS monotonicity FROM m")
    add("e10_turnover", lambda s, d: analytics.turnover(_valued(s, d)).select("date", tidy("turnover").alias("turnover")), t + f", h AS (SELECT *, coalesce((({O.pct('value')}) >= 0.8::DOUBLE)::INT, 0)::DOUBLE AS p FROM t), w AS (SELECT *, coalesce(p / nullif(sum(p) OVER (PARTITION BY date), 0), 0) AS w FROM h), e AS (SELECT *, abs(w - coalesce(lag(w) OVER (PARTITION BY symbol ORDER BY date), 0)) AS dw FROM w) SELECT date, {O.tidy('sum(dw) / 2')} AS turnover FROM e GROUP BY date")
    add("r02_basket_overlap", lambda s, d: analytics.basket_overlap(_valued(s, d)).select("date", tidy("jaccard").alias("jaccard")), t + f", h AS (SELECT *, ({O.pct('value')}) AS r FROM t), g AS (SELECT date, list(symbol) AS b FROM h WHERE r >= 0.8::DOUBLE GROUP BY date), p AS (SELECT date, b, lag(b) OVER (ORDER BY date) AS a FROM g) SELECT date, {O.tidy('len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))')} AS jaccard FROM p WHERE a IS NOT NULL")
    add("e12_factor_correlation", lambda s, d: factors.base(staged(s, d), "return").withColumn("rv", cross.rank(tidy("value"))).withColumn("ro", cross.rank(tidy("oc"))).agg(tidy(analytics.corr("rv", "ro")).alias("rho")), t + f", r AS (SELECT {O.pct('value')} AS rv, {O.pct('o')} AS ro FROM (SELECT *, {O.tidy('oc')} AS o FROM t)) SELECT {O.tidy('corr(rv, ro)')} AS rho FROM r")
    add("r01_top_decile", lambda s, d: _valued(s, d).withColumn("r", cross.rank("value")).filter("r > 0.9").select("symbol", "date", "value"), t + f", h AS (SELECT *, ({O.pct('value')}) AS r FROM t) SELECT symbol, date, value FROM h WHERE r > 0.9::DOUBLE")
    add("e18_ridge", lambda s, d: s.createDataFrame([(k, float(v)) for k, v in analytics.ridge(_valued(s, d).withColumn("g", F.col("oc")), ["value", "g"], "fwd", 1.0).items()], "name string, beta double"))
    add("r05_mrmr", lambda s, d: s.createDataFrame([(i, n) for i, n in enumerate(analytics.mrmr(_valued(s, d), ["value", "oc", "gap", "dv"], "fwd", 3))], "place int, name string"))


def _joins() -> None:
    fills = lambda s, d: table(s, d, "events").filter("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    quotes = lambda s, d: table(s, d, "events").filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("quote"))
    pre = "WITH f AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'), q AS (SELECT user_id, ts, max(value) AS quote FROM events WHERE event_type = 'view' GROUP BY ALL)"
    cols = "event_id, f.user_id, f.ts, value, quote"
    for name, strict, forward, op in (("j03_asof_backward", False, False, ">="), ("j05_asof_strict", True, False, ">"), ("j07_asof_forward", False, True, "<="), ("j07_asof_forward_strict", True, True, "<")):
        add(name, lambda s, d, a=strict, b=forward: joins.asof(fills(s, d), quotes(s, d), "ts", "user_id", ["quote"], a, b), f"{pre} SELECT {cols} FROM f ASOF LEFT JOIN q ON f.user_id = q.user_id AND f.ts {op} q.ts")
    add("j06_band", lambda s, d: joins.band(fills(s, d), quotes(s, d), "ts", "user_id", 1800, ["quote"]).groupBy("event_id").agg(F.count("*").alias("n"), tidy(F.avg("quote")).alias("mean")), f"{pre} SELECT event_id, count(*) AS n, {O.tidy('avg(quote)')} AS mean FROM f JOIN q ON f.user_id = q.user_id AND q.ts BETWEEN f.ts - INTERVAL 1800 SECOND AND f.ts + INTERVAL 1800 SECOND GROUP BY event_id")
    add("j06_nearest", lambda s, d: joins.nearest(fills(s, d), quotes(s, d), "ts", "user_id", ["quote"]), f"{pre} SELECT {cols} FROM f LEFT JOIN q ON f.user_id = q.user_id QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(q.ts) - epoch_us(f.ts)), q.ts) = 1")

    def vint(s, d):
        v = table(s, d, "orders").groupBy("o_custkey", F.date_trunc("quarter", "o_orderdate").cast("date").alias("quarter"), F.col("o_orderdate").cast("date").alias("disclosed")).agg(F.sum("o_totalprice").alias("value"))
        dates = s.createDataFrame([("1995-06-30",), ("1996-12-31",)], "d string").select(F.to_date("d").alias("as_of"))
        return joins.vintages(v, dates, ["o_custkey", "quarter"]).select("as_of", "o_custkey", "quarter", "disclosed", tidy("value").alias("value"))

    add("j08_pit_vintage", vint, f"WITH v AS (SELECT o_custkey, date_trunc('quarter', o_orderdate)::DATE AS quarter, o_orderdate::DATE AS disclosed, sum(o_totalprice) AS value FROM orders GROUP BY ALL), a AS (SELECT unnest([DATE '1995-06-30', DATE '1996-12-31']) AS as_of) SELECT as_of, o_custkey, quarter, disclosed, {O.tidy('value')} AS value FROM v JOIN a ON disclosed < as_of QUALIFY row_number() OVER (PARTITION BY as_of, o_custkey, quarter ORDER BY disclosed DESC) = 1")

    def outer(s, d):
        side = lambda odd: table(s, d, "orders").filter(f"o_orderkey % 3 <> {odd}").groupBy("o_custkey").agg(F.max("o_totalprice").alias("value"), F.max(F.col("o_orderdate").cast("date")).alias("available"))
        return joins.merge_sources(side(0), side(1), ["o_custkey"], "value", "available")

    one = lambda k: f"(SELECT o_custkey, max(o_totalprice) AS v, max(o_orderdate)::DATE AS t FROM orders WHERE o_orderkey % 3 <> {k} GROUP BY 1)"
    add("j09_full_outer", outer, f"SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN b.t IS NOT NULL AND (a.t IS NULL OR b.t >= a.t) THEN b.v ELSE a.v END AS value, greatest(a.t, b.t) AS available, CASE WHEN b.t IS NULL THEN 'base' WHEN a.t IS NULL THEN 'extended' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'matched' ELSE 'conflict' END AS origin FROM {one(0)} a FULL JOIN {one(1)} b ON a.o_custkey = b.o_custkey")
    add("j02_inner", lambda s, d: staged(s, d).join(industries(s, d), "symbol").groupBy("sector").agg(F.count("*").alias("n")), f"WITH {O.BARS} SELECT n_name AS sector, count(*) AS n FROM bars JOIN supplier ON s_suppkey = symbol JOIN nation ON n_nationkey = s_nationkey GROUP BY 1")
    add("j14_anti", lambda s, d: table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
    add("j17_semi", lambda s, d: table(s, d, "customer").join(table(s, d, "orders").filter("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
    add("j10_densify", lambda s, d: densify(bars(s, d).select("date", "symbol", "close")).groupBy("date").agg(F.count("*").alias("cells"), F.count("close").alias("held")), f"WITH {O.BARS}, g AS (SELECT d.date, y.symbol FROM (SELECT DISTINCT date FROM bars) d, (SELECT DISTINCT symbol FROM bars) y) SELECT g.date, count(*) AS cells, count(close) AS held FROM g LEFT JOIN bars USING (date, symbol) GROUP BY 1")

    def chain(s, d):
        e = table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("node"), F.when(F.col("turn") > F.min("turn").over(Window.partitionBy("conv_id")), F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")) + F.col("conv_id") * 1000).alias("parent"))
        return joins.reply_depth(e, "node", "parent").withColumn("depth", F.col("depth").cast("int"))

    add("j20_reply_chain", chain, "SELECT conv_id * 1000 + turn AS node, conv_id * 1000 + min(turn) OVER (PARTITION BY conv_id) AS root, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS depth FROM conversations")


def _portfolio() -> None:
    t = _sql_valued()
    add("a02_grouping_sets", lambda s, d: table(s, d, "events").groupingSets([["event_type"], ["user_id"], []], "event_type", "user_id").agg(F.count("*").alias("n"), tidy(F.sum("value")).alias("total")), f"SELECT event_type, user_id, count(*) AS n, {O.tidy('sum(value)')} AS total FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())")
    add("a03_vwap_twap", lambda s, d: table(s, d, "lineitem").groupBy("l_suppkey").agg(tidy(F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity"))).alias("vwap"), tidy(F.avg(F.col("l_extendedprice") / F.col("l_quantity"))).alias("twap")), f"SELECT l_suppkey, {O.tidy('sum(l_extendedprice) / sum(l_quantity)')} AS vwap, {O.tidy('avg(l_extendedprice / l_quantity)')} AS twap FROM lineitem GROUP BY 1")
    add("a01_quantile_bins", lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), tidy(F.percentile("l_extendedprice", F.lit(0.5))).alias("median"), tidy(F.percentile("l_extendedprice", F.lit(0.95))).alias("p95")), f"SELECT l_returnflag, count(*) AS n, {O.tidy('quantile_cont(l_extendedprice, 0.5)')} AS median, {O.tidy('quantile_cont(l_extendedprice, 0.95)')} AS p95 FROM lineitem GROUP BY 1")
    dos = ("total", "ann_mean", "ann_vol", "sharpe", "sortino", "mdd", "win", "best", "worst")
    add(
        "a07_dossier",
        lambda s, d: analytics.dossier(staged(s, d)).select("symbol", *(tidy(n).alias(n) for n in dos)),
        f"WITH {O.STAGED}, x AS (SELECT symbol, date, ret, exp(sum(ln(1 + ret)) OVER u) AS nav FROM b WHERE ret > -1 {O.WINDOWS}), y AS (SELECT *, nav / greatest(1.0::DOUBLE, max(nav) OVER u) - 1 AS dd FROM x {O.WINDOWS}) SELECT symbol, "
        + ", ".join(f"{O.tidy(e)} AS {n}" for n, e in zip(dos, ("exp(sum(ln(1 + ret))) - 1", "avg(ret) * 52", "stddev_samp(ret) * sqrt(52)", "avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(52)", "avg(ret) / nullif(stddev_samp(ret) FILTER (ret < 0), 0) * sqrt(52)", "min(dd)", "avg((ret > 0)::INT)", "max(ret)", "min(ret)"), strict=True))
        + " FROM y GROUP BY symbol",
    )
    add(
        "b01_sleeves",
        lambda s, d: analytics.sleeves(_valued(s, d)).select("date", *(tidy(n).alias(n) for n in ("gross", "net", "turnover", "log_nav"))),
        t + f", h AS (SELECT *, coalesce((({O.pct('value')}) >= 0.9::DOUBLE)::INT, 0)::DOUBLE AS p FROM t), e AS (SELECT *, coalesce(p / nullif(sum(p) OVER (PARTITION BY date), 0), 0) / 5 AS entry FROM h), w AS (SELECT *, sum(entry) OVER w5 AS weight, lead(ret) OVER s AS nxt FROM e {O.WINDOWS}), g AS (SELECT *, abs(weight - coalesce(lag(weight) OVER s, 0)) AS dw FROM w {O.WINDOWS}), z AS (SELECT date, sum(weight * coalesce(nxt, 0)) AS gross, sum(dw) / 2 AS turnover FROM g GROUP BY date), y AS (SELECT *, gross - turnover * 2 * 15 / 1e4 AS net FROM z) SELECT date, {O.tidy('gross')} AS gross, {O.tidy('net')} AS net, {O.tidy('turnover')} AS turnover, {O.tidy("sum(ln(1 + net)) OVER (ORDER BY date)")} AS log_nav FROM y",
    )

    def sectors(s, d):
        x = staged(s, d).join(industries(s, d), "symbol").filter("ret is not null")
        tot = Window.partitionBy("date")
        g = x.groupBy("date", "sector").agg(F.sum("amount").alias("a"), F.count("*").cast("double").alias("k"), F.sum(F.col("amount") * F.col("ret")).alias("ar"), F.avg("ret").alias("r_b"))
        g = g.select("date", "sector", (F.col("a") / F.sum("a").over(tot)).alias("w_p"), (F.col("k") / F.sum("k").over(tot)).alias("w_b"), (F.col("ar") / F.col("a")).alias("r_p"), "r_b")
        return analytics.brinson(g, "date").select("date", "sector", *(tidy(n).alias(n) for n in ("allocation", "selection", "interaction")))

    add("b05_brinson", sectors, f"WITH {O.STAGED}, g AS (SELECT date, n_name AS sector, sum(amount) AS a, count(*)::DOUBLE AS k, sum(amount * ret) AS ar, avg(ret) AS r_b FROM b JOIN supplier ON s_suppkey = symbol JOIN nation ON n_nationkey = s_nationkey WHERE ret IS NOT NULL GROUP BY ALL), w AS (SELECT date, sector, a / sum(a) OVER d AS w_p, k / sum(k) OVER d AS w_b, ar / a AS r_p, r_b FROM g WINDOW d AS (PARTITION BY date)), x AS (SELECT *, sum(w_b * r_b) OVER (PARTITION BY date) AS r FROM w) SELECT date, sector, {O.tidy('(w_p - w_b) * (r_b - r)')} AS allocation, {O.tidy('w_b * (r_p - r_b)')} AS selection, {O.tidy('(w_p - w_b) * (r_p - r_b)')} AS interaction FROM x")
    column("b06_carino", lambda: analytics.carino(F.col("oc"), F.col("gap")), "CASE WHEN abs(oc - gap) < 1e-12 THEN 1 / (1 + oc) ELSE (ln(1 + oc) - ln(1 + gap)) / (oc - gap) END")
    column("b11_regime", lambda: F.when((series.div(F.col("close"), series.delay("close", 19)) > 1.05) & (F.col("close") > series.ts_mean("close", 60)), 1.0).when((series.div(F.col("close"), series.delay("close", 19)) < 0.95) & (F.col("close") < series.ts_mean("close", 60)), -1.0).otherwise(0.0), "CASE WHEN close / lag(close, 19) OVER s > 1.05::DOUBLE AND close > (" + O.full("close", 60, "avg(close) OVER w60") + ") THEN 1 WHEN close / lag(close, 19) OVER s < 0.95::DOUBLE AND close < (" + O.full("close", 60, "avg(close) OVER w60") + ") THEN -1 ELSE 0 END")

    def pairs(s, d):
        b = staged(s, d).select("date", "symbol", "ret")
        j = b.filter("symbol = 1").select("date", F.col("ret").alias("x")).join(b.filter("symbol = 2").select("date", F.col("ret").alias("y")), "date")
        return j.agg(tidy(analytics.corr("x", "y")).alias("corr"), tidy(series.div(F.covar_samp("x", "y"), F.var_samp(F.when(F.col("x").isNotNull(), F.col("y"))))).alias("beta"))

    add("b13_pair", pairs, f"WITH {O.STAGED} SELECT {O.tidy('corr(p.ret, q.ret)')} AS corr, {O.tidy('covar_samp(p.ret, q.ret) / var_samp(CASE WHEN p.ret IS NOT NULL THEN q.ret END)')} AS beta FROM b p JOIN b q USING (date) WHERE p.symbol = 1 AND q.symbol = 2")
    styles = ("size", "momentum", "reversal", "vol", "beta")
    zs = ", ".join(f"{O.tidy(f'({n} - avg({n}) OVER d) / nullif(stddev_pop({n}) OVER d, 0)')} AS {n}" for n in styles)
    add("q02_exposures", lambda s, d: analytics.exposures(staged(s, d)).select("symbol", "date", *(tidy(n).alias(n) for n in styles)), f"WITH {O.STAGED}, c AS (SELECT *, lag(amount) OVER s AS lc FROM b {O.WINDOWS}), k AS (SELECT *, sum(lc * ret) OVER d / nullif(sum(lc) FILTER (ret IS NOT NULL) OVER d, 0) AS mkt FROM c {O.WINDOWS}), x AS (SELECT symbol, date, ln(amount) AS size, lag(close, 4) OVER s / nullif(lag(close, 26) OVER s, 0) - 1 AS momentum, -(close / nullif(lag(close, 4) OVER s, 0) - 1) AS reversal, CASE WHEN count(ret) OVER w20 >= 5 THEN stddev_pop(ret) OVER w20 END AS vol, CASE WHEN count(CASE WHEN mkt IS NOT NULL THEN ret END) OVER w60 >= 20 THEN covar_samp(ret, mkt) OVER w60 / nullif(var_pop(CASE WHEN ret IS NOT NULL THEN mkt END) OVER w60, 0) END AS beta FROM k {O.WINDOWS}) SELECT symbol, date, {zs} FROM x WINDOW d AS (PARTITION BY date)")
    add("q06_specific_risk", lambda s, d: analytics.ewma_specific(staged(s, d)).select("symbol", tidy("variance").alias("variance")), f"WITH {O.STAGED}, a AS (SELECT symbol, ret, pow({0.5 ** (1 / 60.0)!r}::DOUBLE, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) - 1) AS w FROM b WHERE ret IS NOT NULL) SELECT symbol, {O.tidy('sum(w * ret * ret) / sum(w) - (sum(w * ret) / sum(w)) ** 2')} AS variance FROM a GROUP BY symbol HAVING count(*) >= 5")

    def beta(s, d):
        b = staged(s, d).withColumn("mkt", F.avg("ret").over(cross.D()))
        return analytics.rolling_beta(b, 20).select("symbol", "date", *(tidy(n).alias(n) for n in ("alpha", "beta", "r2")))

    bt = "covar_samp(ret, mkt) OVER w20 / nullif(var_samp(CASE WHEN ret IS NOT NULL THEN mkt END) OVER w20, 0)"
    both = "count(CASE WHEN mkt IS NOT NULL THEN ret END) OVER w20 >= 20"
    add("q14_rolling_beta", beta, f"WITH {O.STAGED}, m AS (SELECT *, avg(ret) OVER d AS mkt FROM b {O.WINDOWS}) SELECT symbol, date, {O.tidy(f'CASE WHEN {both} THEN {bt} END')} AS beta, {O.tidy(f'CASE WHEN {both} THEN avg(ret) OVER w20 - ({bt}) * avg(CASE WHEN ret IS NOT NULL THEN mkt END) OVER w20 END')} AS alpha, {O.tidy(f'CASE WHEN {both} THEN pow(covar_samp(ret, mkt) OVER w20, 2) / nullif(var_samp(ret) OVER w20 * var_samp(CASE WHEN ret IS NOT NULL THEN mkt END) OVER w20, 0) END')} AS r2 FROM m {O.WINDOWS}")
    add("q18_crowding", lambda s, d: staged(s, d).select("symbol", "date", tidy(analytics.percentile_rank("volume", series.rows(20))).alias("value")), O.value("100.0::DOUBLE * (len(list_filter(list(volume) OVER w20, lambda v: v < volume)) + 0.5::DOUBLE * len(list_filter(list(volume) OVER w20, lambda v: v = volume))) / len(list(volume) OVER w20)"))
    add("a21_hhi", lambda s, d: bars(s, d).groupBy("date").agg(tidy(F.sum(F.col("amount") ** 2) / F.sum("amount") ** 2).alias("hhi")), f"WITH {O.BARS} SELECT date, {O.tidy('sum(amount * amount) / (sum(amount) * sum(amount))')} AS hhi FROM bars GROUP BY date")
    add("q15_liquidity", lambda s, d: analytics.liquidate(table(s, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("symbol"), F.col("s_acctbal").alias("position_value"), (F.col("s_acctbal") / 2).alias("adv"), F.lit(10.0).alias("spread_bps"), F.lit(0.02).alias("volatility")), 1000.0).select("symbol", tidy("sold").alias("sold"), tidy("cost_bps").alias("cost_bps")), f"WITH x AS (SELECT s_suppkey AS symbol, s_acctbal AS v, least(s_acctbal, s_acctbal * (1000.0::DOUBLE / sum(s_acctbal) OVER ())) AS sold FROM supplier WHERE s_acctbal > 0) SELECT symbol, {O.tidy('sold')} AS sold, {O.tidy('10.0::DOUBLE / 2 + 0.02::DOUBLE * sqrt(sold / (v / 2)) * 1e4')} AS cost_bps FROM x")


def _validate() -> None:
    add("v01_sharpe_moments", lambda s, d: analytics.sharpe_stats(staged(s, d).filter("ret is not null"), "symbol").select("symbol", tidy("sr").alias("sr"), "n"), f"WITH {O.STAGED} SELECT symbol, {O.tidy('avg(ret) / nullif(stddev_samp(ret), 0)')} AS sr, count(ret) AS n FROM b WHERE ret IS NOT NULL GROUP BY symbol")

    def trials(s, d):
        """All symbols as trials, the dates in 16 blocks of neighbours."""
        r = checkpointed(staged(s, d).filter("ret is not null").select("symbol", "date", "ret"))
        dates = checks.date_places(r)
        blocked = dates.select("date", F.floor(F.col("place") * 16 / (F.col("place") + F.col("left") + 1)).cast("int").alias("block"))
        return r.join(blocked, "date").select(F.col("symbol").alias("trial"), "block", "ret")

    moments = "CASE WHEN (m >> block) & 1 = {} THEN {} END"
    parts = ", ".join(f"sum({moments.format(side, c)}) AS {c}{side}" for side in (0, 1) for c in ("n", "a", "q"))
    sharpe = "(a{0} / n{0}) / nullif(sqrt(greatest(0, (q{0} - a{0} * a{0} / n{0}) / (n{0} - 1))), 0)"
    add(
        "v03_pbo",
        lambda s, d: analytics.pbo(trials(s, d), 16).agg(F.count("*").alias("splits"), F.round(F.avg((F.col("logit") <= 0).cast("double")), 3).alias("pbo")),
        f"""WITH {O.STAGED}, r AS (SELECT symbol, date, ret FROM b WHERE ret IS NOT NULL),
  p AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS place, count(*) OVER () AS many FROM (SELECT DISTINCT date FROM r)),
  k AS (SELECT symbol, floor(place * 16 / many)::INT AS block, count(*)::DOUBLE AS n, sum(ret) AS a, sum(ret * ret) AS q FROM r JOIN p USING (date) GROUP BY ALL),
  x AS (SELECT range AS m FROM range(65536) WHERE bit_count(range) = 8),
  g AS (SELECT m, symbol, {parts} FROM k CROSS JOIN x GROUP BY ALL),
  h AS (SELECT m, symbol, {sharpe.format(1)} AS inner_, {sharpe.format(0)} AS outer_ FROM g),
  w AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY inner_ DESC NULLS LAST, symbol) AS best, rank() OVER (PARTITION BY m ORDER BY outer_ ASC NULLS FIRST) AS rk, count(*) OVER (PARTITION BY m) AS n FROM h)
SELECT count(*) AS splits, round(avg((ln((rk / (n + 1.0::DOUBLE)) / (1 - rk / (n + 1.0::DOUBLE))) <= 0)::INT), 3) AS pbo FROM w WHERE best = 1""",
    )
    add("v05_purged_kfold", lambda s, d: analytics.purged_folds(table(s, d, "orders").select(F.col("o_custkey").alias("c"), F.datediff("o_orderdate", F.lit("1990-01-01")).alias("begin")).groupBy("begin").agg(F.count("*").alias("n")).select(F.col("begin").alias("id"), "begin", (F.col("begin") + 10).alias("finish")), 5, 7).groupBy("fold", "role").agg(F.count("*").alias("n")), "WITH s AS (SELECT DISTINCT date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS id FROM orders), p AS (SELECT id, id AS a, id + 10 AS b, ((row_number() OVER (ORDER BY id) - 1) * 5 // count(*) OVER ())::INT AS own FROM s), f AS (SELECT own AS fold, min(a) AS lo, max(b) AS hi FROM p GROUP BY own) SELECT fold, CASE WHEN own = fold THEN 'test' WHEN b < lo OR a > hi + 7 THEN 'train' ELSE 'purged' END AS role, count(*) AS n FROM p, f GROUP BY ALL")
    add("v09_weekday", lambda s, d: analytics.newey_west_t(table(s, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count("*").cast("double").alias("x")).withColumn("weekday", F.weekday("date")), "x", "weekday", "date").select("weekday", "n", tidy("mean").alias("mean"), tidy("t").alias("t")), "WITH x AS (SELECT o_orderdate::DATE AS date, count(*)::DOUBLE AS x FROM orders GROUP BY 1), e AS (SELECT date, (isodow(date) - 1)::INT AS weekday, x, x - avg(x) OVER (PARTITION BY isodow(date)) AS e FROM x), l AS (SELECT *, " + ", ".join(f"e * lag(e, {j}) OVER (PARTITION BY weekday ORDER BY date) AS g{j}" for j in range(1, 5)) + f" FROM e) SELECT weekday, count(*) AS n, {O.tidy('avg(x)')} AS mean, {O.tidy('avg(x) * count(*) / sqrt(sum(e * e) + ' + ' + '.join(f'{2 * (1 - j / 5)!r}::DOUBLE * sum(g{j})' for j in range(1, 5)) + ')')} AS t FROM l GROUP BY weekday")
    prob = "least(0.999, n_chars / 5000.0::DOUBLE)"

    def forecasts(s, d):
        f = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select("doc_id", F.least(F.lit(0.999), F.col("n_chars") / 5000.0).alias("p"), F.col("quality").cast("double").alias("y"))
        return f.withColumn("bin", F.least(F.lit(9), F.floor(F.col("p") * 10)).cast("int"))

    add("a12_reliability", lambda s, d: forecasts(s, d).groupBy("bin").agg(F.count("*").alias("n"), tidy(F.avg("p")).alias("p"), tidy(F.avg("y")).alias("y"), tidy(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2.0)))).alias("brier")), f"WITH f AS (SELECT {prob} AS p, quality::DOUBLE AS y FROM documents JOIN labels USING (doc_id)) SELECT least(9, floor(p * 10))::INT AS bin, count(*) AS n, {O.tidy('avg(p)')} AS p, {O.tidy('avg(y)')} AS y, {O.tidy('avg((p - y) * (p - y))')} AS brier FROM f GROUP BY 1")
    add("v11_leak_check", lambda s, d: s.createDataFrame([("z_return", analytics.prefix_invariant(lambda b: factors.factor(b, ("return", "z", 5)).select("symbol", "date", tidy("value").alias("value")), staged(s, d), F.lit("1996-01-01").cast("date")))], "name string, changed long"), "SELECT 'z_return' AS name, 0::BIGINT AS changed")


def _quality() -> None:
    ytd = "WITH m AS (SELECT o_custkey AS symbol, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS q, sum(o_totalprice) AS v FROM orders GROUP BY ALL), y AS (SELECT symbol, q, sum(v) OVER (PARTITION BY symbol, q // 4 ORDER BY q) AS v FROM m)"

    def ttm(s, d):
        m = table(s, d, "orders").groupBy(F.col("o_custkey").alias("symbol"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).cast("long").alias("q")).agg(F.sum("o_totalprice").alias("v"))
        y = m.withColumn("v", F.sum("v").over(Window.partitionBy("symbol", F.floor(F.col("q") / 4)).orderBy("q")))
        return quality.single_quarter(y, "v").select("symbol", "q", tidy("single").alias("single"), tidy("ttm").alias("ttm"))

    add("g05_ttm", ttm, ytd + f", s AS (SELECT *, CASE WHEN q % 4 = 0 THEN v ELSE v - CASE WHEN lag(q) OVER w = q - 1 THEN lag(v) OVER w END END AS single FROM y WINDOW w AS (PARTITION BY symbol ORDER BY q)), t AS (SELECT *, CASE WHEN count(single) OVER f = 4 THEN sum(single) OVER f END AS ttm FROM s WINDOW f AS (PARTITION BY symbol ORDER BY q RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)) SELECT symbol, q, {O.tidy('single')} AS single, {O.tidy('ttm')} AS ttm FROM t")
    add("g01_bar_audit", lambda s, d: quality.bar_audit(table(s, d, "events").withColumnRenamed("event_id", "row_id"), 3600, "user_id"), "WITH e AS (SELECT user_id, ts < lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS i, date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS step FROM events) SELECT user_id, sum(coalesce(i, FALSE)::BIGINT)::BIGINT AS inversion, sum(coalesce(step = 0, FALSE)::BIGINT)::BIGINT AS duplicate, sum(coalesce(step > 1.5 * 3600, FALSE)::BIGINT)::BIGINT AS gap FROM e GROUP BY user_id")
    add("g11_kline_rules", lambda s, d: quality.kline_rules(staged(s, d)).select(*(tidy(n).alias(n) for n in ("complete", "ohlc", "volume", "jumps"))), f"WITH {O.STAGED} SELECT {O.tidy('avg((open IS NOT NULL AND close IS NOT NULL)::INT)')} AS complete, {O.tidy('avg((high >= greatest(open, close) AND low <= least(open, close))::INT)')} AS ohlc, {O.tidy('avg((volume >= 0)::INT)')} AS volume, {O.tidy('avg(coalesce(abs(ret) > 0.25, FALSE)::INT)')} AS jumps FROM b")
    add("g06_no_rollback", lambda s, d: quality.no_rollback(table(s, d, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderkey").alias("available"), (F.year("o_orderdate") * 4 + F.quarter("o_orderdate")).cast("long").alias("q"), F.col("o_totalprice").alias("value"))).select("symbol", "available", "newest", "state"), "WITH r AS (SELECT o_custkey AS symbol, o_orderkey AS available, year(o_orderdate) * 4 + quarter(o_orderdate) AS q, o_totalprice AS value FROM orders), n AS (SELECT *, max(q) OVER w AS newest FROM r WINDOW w AS (PARTITION BY symbol ORDER BY available, q ROWS UNBOUNDED PRECEDING)) SELECT symbol, available, newest, last_value(CASE WHEN q = newest THEN value END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY available, q ROWS UNBOUNDED PRECEDING) AS state FROM n")
    add("a24_repeated_keys", lambda s, d: table(s, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).filter("n > 1"), "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
    add("a13_month_ends", lambda s, d: table(s, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month")).agg(F.max("o_orderdate").cast("date").alias("last")), "SELECT date_trunc('month', o_orderdate)::DATE AS month, max(o_orderdate)::DATE AS last FROM orders GROUP BY 1")
    add("a14_latest_rows", lambda s, d: text.best_version(table(s, d, "orders"), "o_custkey", F.col("o_orderdate"), "o_orderkey").select("o_custkey", "o_orderkey"), "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")

    def streaks(s, d):
        x = staged(s, d).withColumn("g", F.row_number().over(series.S()) - F.row_number().over(Window.partitionBy("symbol", F.col("ret") > 0).orderBy("date")))
        return x.filter("ret > 0").groupBy("symbol", "g").agg(F.count("*").alias("n")).groupBy("symbol").agg(F.max("n").alias("longest"))

    add("a23_streaks", streaks, f"WITH {O.STAGED}, g AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - row_number() OVER (PARTITION BY symbol, ret > 0 ORDER BY date) AS g FROM b), n AS (SELECT symbol, g, count(*) AS n FROM g WHERE ret > 0 GROUP BY ALL) SELECT symbol, max(n) AS longest FROM n GROUP BY symbol")


def _text() -> None:
    add("txt_word_count", lambda s, d: table(s, d, "documents").select("doc_id", text.word_count("text").cast("long").alias("words")), "SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')) + len(regexp_extract_all(coalesce(text, ''), '[\\x{4e00}-\\x{9fff}]')) AS words FROM documents")
    add("n01_slugify", lambda s, d: table(s, d, "part").select("p_partkey", text.slugify("p_name").alias("slug")), "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
    add("txt_html_title", lambda s, d: table(s, d, "pages").select("page_id", text.title("html").alias("title")), "SELECT page_id, nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), '') AS title FROM pages")
    add("n02_host", lambda s, d: table(s, d, "pages").groupBy(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("host")).agg(F.count("*").alias("n")), "SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
    rules = [("error", "bad"), ("purchase", "good")]
    add("n03_rules", lambda s, d: table(s, d, "events").groupBy(text.first_rule("event_type", rules, "other").alias("label")).agg(F.count("*").alias("n")), "SELECT CASE WHEN contains(lower(event_type), 'error') THEN 'bad' WHEN contains(lower(event_type), 'purchase') THEN 'good' ELSE 'other' END AS label, count(*) AS n FROM events GROUP BY 1")
    add("n04_iso_date", lambda s, d: table(s, d, "orders").select("o_orderkey", text.iso_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("iso")), "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")

    def ids(s, d):
        items = table(s, d, "part").select(F.col("p_brand").alias("code"), F.col("p_name").alias("name")).distinct()
        known = items.filter("name < 'm'").select("code", "name", F.row_number().over(Window.partitionBy("code").orderBy("name")).alias("seq"))
        return text.stable_ids(items, known)

    add("n08_stable_id", ids, "WITH i AS (SELECT DISTINCT p_brand AS code, p_name AS name FROM part), k AS (SELECT code, name, row_number() OVER (PARTITION BY code ORDER BY name) AS seq FROM i WHERE name < 'm'), t AS (SELECT code, max(seq) AS top FROM k GROUP BY code) SELECT i.code, i.name, coalesce(k.seq, coalesce(top, 0) + row_number() OVER (PARTITION BY i.code, k.seq IS NULL ORDER BY i.name))::INT AS seq FROM i LEFT JOIN k ON i.code = k.code AND i.name = k.name LEFT JOIN t ON t.code = i.code")
    add("n13_best_version", lambda s, d: text.best_version(table(s, d, "lineitem"), "l_orderkey", F.col("l_extendedprice"), "l_linenumber").select("l_orderkey", "l_linenumber", "l_extendedprice"), "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1")
    add("txt_chunks", lambda s, d: text.chunks(table(s, d, "documents"), "doc_id", "text", 200))
    add("n06_sentences", lambda s, d: text.sentences(table(s, d, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n")))
    add("n14_structure", lambda s, d: table(s, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.max(F.char_length("text")).cast("long").alias("longest"), F.sum(F.contains("text", F.lit("the")).cast("long")).alias("with_the")), "SELECT lang, count(*) AS n, max(length(text))::BIGINT AS longest, sum(contains(text, 'the')::BIGINT)::BIGINT AS with_the FROM documents GROUP BY lang")


for _register in (_series, _factors, _cross, _evaluate, _joins, _portfolio, _validate, _quality, _text):
    _register()
markets.register(add, Q, SQL, _valued, _sql_valued())
extras.register(add, _valued, _sql_valued())
studies.register(add, SQL, _valued, _sql_valued())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
