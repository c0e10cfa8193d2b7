"""Registered queries of risk, flows, costs, dependence, audits and transcripts, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.series import S, tidy
from tessera.operators import analytics, flows, quality, risk, text
from tessera.plans import oracle as O
from tessera.sources.panel import staged, table

HALF, WEEKS = 90.0, 52
STYLES = ["size", "momentum", "reversal", "vol", "beta"]
GROUPS = "supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey"
RETURNS = f"""{O.STAGED}, mp AS (SELECT s_suppkey AS symbol, r_name AS name FROM {GROUPS}),
rr AS (SELECT date, name, avg(ret) AS value FROM b JOIN mp USING (symbol) GROUP BY ALL HAVING avg(ret) IS NOT NULL),
cd AS (SELECT *, count(*) OVER (PARTITION BY date) AS k FROM rr), fu AS (SELECT date, name, value FROM cd WHERE k = (SELECT count(DISTINCT name) FROM rr)),
ag AS (SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS age FROM (SELECT DISTINCT date FROM fu))"""


def covariance_sql(weight: str, total: str, periods: int = 1) -> str:
    return f"""WITH {RETURNS}, wd AS (SELECT date, name, value, {weight} AS w FROM fu JOIN ag USING (date)), mu AS (SELECT name, sum(w * value) / sum(w) AS m FROM wd GROUP BY name),
ce AS (SELECT date, name, w, value - m AS e FROM wd JOIN mu USING (name)), cv AS (SELECT a.name AS i, b.name AS j, sum(a.w * a.e * b.e) / ({total}) * {periods} AS value FROM ce a JOIN ce b USING (date) GROUP BY ALL)"""


EWMA = covariance_sql(f"pow({0.5 ** (1 / HALF)!r}::DOUBLE, age)", "sum(a.w)", WEEKS)
SAMPLE = covariance_sql("1.0::DOUBLE", "sum(a.w) - 1")
SPECIFIC = ", sp AS (SELECT symbol, var_samp(b.ret - rr.value) AS variance FROM b JOIN mp USING (symbol) JOIN rr ON rr.date = b.date AND rr.name = mp.name GROUP BY symbol HAVING var_samp(b.ret - rr.value) IS NOT NULL)"


def regions(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.select(F.col("s_suppkey").alias("symbol"), F.col("r_name").alias("name"))


def region_returns(s: SparkSession, d: str) -> DataFrame:
    """A row per date and region: read several times by what follows, so kept."""
    return staged(s, d).join(regions(s, d), "symbol").groupBy("date", "name").agg(F.avg("ret").alias("value")).filter("value is not null").persist()


def specific(s: SparkSession, d: str) -> DataFrame:
    x = staged(s, d).join(regions(s, d), "symbol").join(region_returns(s, d), ["date", "name"])
    return x.groupBy("symbol").agg(F.var_samp(F.col("ret") - F.col("value")).alias("variance")).filter("variance is not null")


def _risk(add: Callable) -> None:
    rounded = lambda df: df.withColumn("value", tidy("value"))
    cov = lambda s, d: risk.factor_covariance(region_returns(s, d), HALF, WEEKS)

    def panel(s, d):
        x = staged(s, d).withColumn("fwd", F.lead("ret").over(S()))
        return analytics.exposures(x, "fwd", F.col("amount").alias("cap")).join(regions(s, d), "symbol")

    add("q04_factor_returns", lambda s, d: rounded(risk.factor_returns(panel(s, d), STYLES, "name")))
    add("q05_factor_covariance", lambda s, d: rounded(cov(s, d)), EWMA + f" SELECT i, j, {O.tidy('value')} AS value FROM cv")
    one_hot = lambda s, d: regions(s, d).withColumn("x", F.lit(1.0))
    add("q07_asset_covariance", lambda s, d: rounded(risk.asset_covariance(one_hot(s, d), cov(s, d), specific(s, d))), EWMA + SPECIFIC + f" SELECT a.symbol, c.symbol AS other, {O.tidy('cv.value + CASE WHEN a.symbol = c.symbol THEN coalesce(sp.variance, 0) ELSE 0 END')} AS value FROM cv JOIN mp a ON a.name = cv.i JOIN mp c ON c.name = cv.j LEFT JOIN sp ON sp.symbol = a.symbol")

    def euler(s, d):
        n = table(s, d, "supplier").count()
        w = table(s, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.lit(1 / n).alias("w"))
        x = risk.decompose_risk(w, one_hot(s, d), cov(s, d), specific(s, d))
        return x.select("name", *(tidy(n).alias(n) for n in ("exposure", "variance", "volatility", "share")))

    add(
        "q08_risk_decomposition",
        euler,
        EWMA + SPECIFIC + f", w AS (SELECT symbol, name, 1.0::DOUBLE / (SELECT count(*) FROM supplier) AS w FROM mp), ex AS (SELECT name, sum(w) AS exposure FROM w GROUP BY name), fb AS (SELECT i AS name, sum(value * exposure) AS f FROM cv JOIN ex ON ex.name = j GROUP BY 1), "
        "r AS (SELECT name, exposure, exposure * f AS variance FROM ex JOIN fb USING (name) UNION ALL SELECT 'specific', NULL, sum(w * w * coalesce(variance, (SELECT quantile_cont(variance, 0.5) FROM sp))) FROM w LEFT JOIN sp USING (symbol)) "
        f"SELECT name, {O.tidy('exposure')} AS exposure, {O.tidy('variance')} AS variance, {O.tidy('variance / sqrt(sum(variance) OVER ())')} AS volatility, {O.tidy('variance / sum(variance) OVER ()')} AS share FROM r",
    )
    add("q09_sample_covariance", lambda s, d: rounded(risk.covariance(region_returns(s, d))), SAMPLE + f" SELECT i, j, {O.tidy('value')} AS value FROM cv")
    plain = covariance_sql("1.0::DOUBLE", "sum(a.w)")
    add(
        "q09_ledoit_wolf",
        lambda s, d: rounded(risk.ledoit_wolf(region_returns(s, d))[0]),
        plain + ", t AS (SELECT count(DISTINCT i) AS p, sum(CASE WHEN i = j THEN value END) / count(DISTINCT i) AS mu, sum(value * value) AS sq FROM cv), nm AS (SELECT date, sum(e * e) AS q FROM ce GROUP BY date), "
        "h AS (SELECT any_value(p) AS p, any_value(mu) AS mu, any_value((sq - p * mu * mu) / p) AS spread, (sum(q * q) / count(*) - any_value(sq)) / (count(*) * any_value(p)) AS noise FROM nm, t), k AS (SELECT mu, least(noise, spread) / spread AS shrink FROM h) "
        f"SELECT i, j, {O.tidy('(1 - shrink) * value + CASE WHEN i = j THEN shrink * mu ELSE 0 END')} AS value FROM cv, k",
    )

    def inputs(s, d):
        names, m = risk.to_matrix(risk.covariance(region_returns(s, d), periods=WEEKS))
        means = dict(region_returns(s, d).groupBy("name").agg(F.avg("value")).collect())  # a row per region
        return names, m, np.array([means[n] for n in names]) * WEEKS

    def portfolios(s, d):
        names, m, mean = inputs(s, d)
        kinds = ("min_variance", "mean_variance", "max_sharpe", "risk_parity", "max_diversification")
        cap = max(0.4, 1 / len(names))
        rows = [(k, n, float(w)) for k in kinds for n, w in zip(names, risk.optimize(m, k, mean, cap=cap), strict=True)]
        return s.createDataFrame(rows, "objective string, name string, weight double").withColumn("weight", F.round("weight", 4))

    add("q10_optimizers", portfolios)
    add("q12_frontier", lambda s, d: s.createDataFrame(risk.frontier(*inputs(s, d)[1:]), "risk_aversion double, mean double, volatility double"))

    def contributions(s, d):
        c = risk.covariance(region_returns(s, d))
        w = c.select(F.col("i").alias("name")).distinct().withColumn("w", F.lit(1.0))
        return risk.risk_contributions(w, c).select("name", tidy("share").alias("share"))

    add("q13_risk_contributions", contributions, SAMPLE + f" SELECT i AS name, {O.tidy('sum(value) / sum(sum(value)) OVER ()')} AS share FROM cv GROUP BY i")


def _flows(add: Callable) -> None:
    by, order = ["user_id", "event_type"], ["ts", "event_id"]
    events = lambda s, d: table(s, d, "events")
    last = lambda s, d: flows.strength(events(s, d), by, order, "value")
    sql = """WITH ev AS (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events WHERE value IS NOT NULL),
ch AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE (value - p) / abs(p) END AS change FROM ev WHERE p IS NOT NULL),
zz AS (SELECT *, coalesce((change - avg(change) OVER g) / nullif(stddev_pop(change) OVER g, 0), 0) AS z, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS position FROM ch WINDOW g AS (PARTITION BY user_id, event_type)),
st AS (SELECT user_id, event_type, arg_max(z, row(ts, event_id)) AS strength, arg_max(change, row(ts, event_id)) AS change, arg_max(value, row(ts, event_id)) AS latest, max(ts) AS seen, count(*) AS n FROM zz GROUP BY ALL)"""
    add("q16_flow_strength", lambda s, d: last(s, d).select(*by, tidy("strength").alias("strength"), tidy("change").alias("change"), "latest", "n"), sql + f" SELECT user_id, event_type, {O.tidy('strength')} AS strength, {O.tidy('change')} AS change, latest, n FROM st")
    count = lambda sign: f"count(*) FILTER (strength {'> 0.05' if sign else '< -0.05'})"
    add(
        "q17_consensus",
        lambda s, d: flows.consensus(last(s, d), "user_id").withColumn("score", tidy("score")),
        sql + f", c AS (SELECT user_id, {count(1)} AS up, {count(0)} AS down FROM st GROUP BY user_id) SELECT user_id, up, down, {O.tidy('coalesce(greatest(up, down)::DOUBLE / nullif(up + down, 0), 0)')} AS score, CASE WHEN up + down = 0 THEN 'neutral' WHEN down = 0 THEN 'inflow' WHEN up = 0 THEN 'outflow' ELSE 'divergence' END AS direction, up + down >= 2 AND least(up, down) = 0 AS agreed FROM c",
    )
    add("q19_strength_series", lambda s, d: flows.strength_series(events(s, d), "user_id", "event_type", order, "value").select("user_id", F.col("position").cast("long").alias("position"), tidy("strength").alias("strength")), sql + f" SELECT user_id, position, {O.tidy('avg(z)')} AS strength FROM zz GROUP BY ALL")

    def faded(s, d):
        x = last(s, d)
        now = events(s, d).agg(F.max("ts").alias("now"))  # one row
        return x.join(F.broadcast(now), how="cross").select(*by, tidy(flows.decayed(F.col("strength"), F.datediff("now", "seen"), 5.0)).alias("strength"))

    add("q20_decayed_strength", faded, sql + f" SELECT user_id, event_type, {O.tidy('strength * pow(2.0::DOUBLE, -date_diff(' + chr(39) + 'day' + chr(39) + ', seen, (SELECT max(ts) FROM events)) / 5.0::DOUBLE)')} AS strength FROM st")
    one = lambda k: F.max(F.when(F.col("event_type") == k, F.col("strength")))
    add(
        "q21_resonance",
        lambda s, d: last(s, d).groupBy("user_id").agg(one("click").alias("a"), one("view").alias("b")).select("user_id", flows.resonance(F.col("a"), F.col("b")).alias("pattern")),
        sql + ", p AS (SELECT user_id, max(strength) FILTER (event_type = 'click') AS a, max(strength) FILTER (event_type = 'view') AS b FROM st GROUP BY user_id) SELECT user_id, CASE WHEN a > 0.1 AND b > 0.1 THEN 'bullish_resonance' WHEN a < -0.1 AND b < -0.1 THEN 'bearish_resonance' WHEN a > 0.2 AND b < -0.1 THEN 'cautious_divergence' WHEN a < -0.2 AND b > 0.1 THEN 'dangerous_divergence' ELSE 'none' END AS pattern FROM p",
    )

    def priced(s, d):
        e = events(s, d).filter("value > 0")
        fills = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"), F.col("value").alias("quantity"), F.col("value").alias("price"))
        level = lambda kind: e.filter(F.col("event_type") == kind).groupBy("user_id", "ts").agg(F.max("value").alias("v"))
        quotes = level("view").select("user_id", "ts", (F.col("v") * 0.99).alias("bid"), (F.col("v") * 1.01).alias("ask"))
        bars = level("click").select("user_id", "ts", F.col("v").alias("close"), (F.col("v") * 100).alias("volume"))
        return flows.priced_fills(fills, quotes, bars, "ts", "user_id", 1.0)

    fills = """WITH e AS (SELECT * FROM events WHERE value > 0), f AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS sgn, value AS price FROM e WHERE event_type = 'purchase'),
qt AS (SELECT user_id, ts, max(value) AS v FROM e WHERE event_type = 'view' GROUP BY ALL), br AS (SELECT user_id, ts, max(value) AS v FROM e WHERE event_type = 'click' GROUP BY ALL),
f2 AS (SELECT f.*, qt.v AS q FROM f ASOF LEFT JOIN qt ON f.user_id = qt.user_id AND f.ts >= qt.ts), f3 AS (SELECT f2.*, br.v AS c FROM f2 ASOF LEFT JOIN br ON f2.user_id = br.user_id AND f2.ts >= br.ts),
g AS (SELECT event_id, price, c, (q * 0.99::DOUBLE + q * 1.01::DOUBLE) / 2 AS mid, coalesce((q * 0.99::DOUBLE + q * 1.01::DOUBLE) / 2, c) AS ref, sgn FROM f3),
x AS (SELECT event_id, ref, sgn * (price - ref) / ref * 10000.0::DOUBLE AS slip, sgn * (price - ref) / ref * 10000.0::DOUBLE + 1 AS total, price / (c * 100) AS share FROM g)"""
    add("b09_priced_fills", lambda s, d: priced(s, d).select("event_id", tidy("slippage_bps").alias("slippage_bps"), tidy("participation").alias("participation")), fills + f" SELECT event_id, {O.tidy('slip')} AS slippage_bps, {O.tidy('share')} AS participation FROM x")
    names = ("coverage", "median_bps", "p95_bps", "intercept", "slope")
    add("b09_cost_fit", lambda s, d: flows.impact(priced(s, d)).select("fills", *(tidy(n).alias(n) for n in names)), fills + f" SELECT count(*) AS fills, {O.tidy('avg((ref IS NOT NULL)::INT)')} AS coverage, {O.tidy('quantile_cont(total, 0.5)')} AS median_bps, {O.tidy('quantile_cont(total, 0.95)')} AS p95_bps, {O.tidy('regr_intercept(abs(slip), sqrt(share))')} AS intercept, {O.tidy('regr_slope(abs(slip), sqrt(share))')} AS slope FROM x")
    add("b09_cost_curve", lambda s, d: flows.cost_curve(priced(s, d)).select("bin", "n", *(tidy(n).alias(n) for n in ("median_bps", "p95_bps", "participation"))), fills + f", y AS (SELECT * FROM x WHERE share IS NOT NULL AND slip IS NOT NULL), k AS (SELECT quantile_cont(share, [0.2, 0.4, 0.6, 0.8]) AS e FROM y), z AS (SELECT y.*, len(list_filter(list_distinct(e), lambda v: v < share))::INT AS bin FROM y, k) SELECT bin, count(*) AS n, {O.tidy('quantile_cont(total, 0.5)')} AS median_bps, {O.tidy('quantile_cont(total, 0.95)')} AS p95_bps, {O.tidy('quantile_cont(share, 0.5)')} AS participation FROM z GROUP BY bin")


def _dependence(add: Callable, plans: dict, sql: dict, valued: Callable, valued_sql: str) -> None:
    cuts = "[" + ", ".join(str(k / 10) for k in range(1, 10)) + "]"
    label = lambda c: f"CASE WHEN {c}d <= 10 THEN {c} ELSE len(list_filter(list_distinct({c}e), lambda v: v < {c}))::DOUBLE END"
    add(
        "e14_mutual_information",
        lambda s, d: flows.mutual_information(valued(s, d), "value", "fwd").select("date", tidy("nmi").alias("nmi")),
        valued_sql + f", k AS (SELECT date, value AS x, fwd AS y FROM t WHERE value IS NOT NULL AND fwd IS NOT NULL), ed AS (SELECT date, quantile_cont(x, {cuts}) AS xe, quantile_cont(y, {cuts}) AS ye, count(DISTINCT x) AS xd, count(DISTINCT y) AS yd FROM k GROUP BY date HAVING count(*) >= 30), "
        f"lb AS (SELECT date, {label('x')} AS bx, {label('y')} AS bw, count(*)::DOUBLE AS c FROM k JOIN ed USING (date) GROUP BY ALL), m AS (SELECT *, sum(c) OVER (PARTITION BY date) AS n, sum(c) OVER (PARTITION BY date, bx) AS nx, sum(c) OVER (PARTITION BY date, bw) AS ny FROM lb) "
        f"SELECT date, {O.tidy('coalesce(sum(c / n * ln(c * n / (nx * ny))) / nullif(sqrt(sum(-c / n * ln(nx / n)) * sum(-c / n * ln(ny / n))), 0), 0)')} AS nmi FROM m GROUP BY date",
    )
    add("e14_distance_correlation", lambda s, d: flows.distance_correlation(valued(s, d), "value", "fwd").withColumn("dcor", F.round("dcor", 6)))
    y, r = "CASE WHEN ic_mean <> 0 THEN ln(abs(ic_mean)) END", "regr_slope(CASE WHEN ic_mean <> 0 THEN ln(abs(ic_mean)) END, horizon::DOUBLE)"
    add("e15_decay_fit", lambda s, d: flows.decay_fit(plans["e05_ic_decay"](s, d)).select(*(tidy(n).alias(n) for n in ("rate", "exponent", "half_life"))), f"SELECT {O.tidy(r)} AS rate, {O.tidy(f'regr_slope({y}, ln(horizon))')} AS exponent, {O.tidy(f'CASE WHEN {r} < 0 THEN ln(2) / -({r}) END')} AS half_life FROM ({sql['e05_ic_decay']})")


def _audits(add: Callable) -> None:
    def actions(s, d):
        x = staged(s, d).select("symbol", "date", "close", F.col("close").alias("adj_close"), F.when(F.col("n") % 40 == 0, 2.0).otherwise(1.0).alias("split_factor"), F.when(F.col("n") % 30 == 0, F.lit(0.5)).alias("cash_dividend"))
        return quality.adjustment_audit(x).select("symbol", "date", "finding")

    add("g02_adjustments", actions, f"WITH {O.STAGED}, x AS (SELECT symbol, date, (close * CASE WHEN n % 40 = 0 THEN 2 ELSE 1 END + CASE WHEN n % 30 = 0 THEN 0.5::DOUBLE ELSE 0 END) / pc - 1 AS raw, close / pc - 1 AS adj FROM b), f AS (SELECT symbol, date, CASE WHEN abs(raw - adj) > 0.02::DOUBLE THEN 'adjusted_return_mismatch' WHEN abs(adj) > 0.4::DOUBLE THEN 'jump' END AS finding FROM x) SELECT * FROM f WHERE finding IS NOT NULL")

    def members(s, d):
        w = Window.partitionBy("symbol")
        x = staged(s, d).select("symbol", "date", F.when(F.col("volume") > 20, "1").otherwise("0").alias("eligible"), F.min("date").over(w).alias("listed_at"), F.when(F.col("symbol") % 3 == 0, F.date_sub(F.max("date").over(w), 100)).alias("delisted_at"), F.col("ret").alias("return"), F.when(F.col("n") % 10 == 0, F.lit(-0.3)).alias("delisting_return"))
        return quality.universe(x).select("date", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), tidy("bias").alias("bias"))

    inside = "volume > 20 AND (symbol % 3 <> 0 OR date <= mx - 100)"
    add("g03_universe", members, f"WITH {O.STAGED}, x AS (SELECT *, max(date) OVER (PARTITION BY symbol) AS mx FROM b) SELECT date, coalesce(array_to_string(list_sort(list(symbol) FILTER ({inside})), ','), '') AS members, {O.tidy(f'avg(ret - CASE WHEN n % 10 = 0 THEN -0.3::DOUBLE ELSE ret END) FILTER ({inside})')} AS bias FROM x GROUP BY date")

    def findings(s, d):
        day = lambda e: F.date_format(e, "yyyyMMdd")
        at = F.col("o_orderdate").cast("date")
        x = table(s, d, "orders").select(F.col("o_custkey").alias("symbol"), F.quarter("o_orderdate").alias("quarter"), F.when(F.col("o_orderkey") % 50 == 0, "unknown").otherwise(day(at)).alias("disclosed"), day(F.expr("date_add(cast(o_orderdate as date), cast(o_orderkey % 3 as int))")).alias("available"), day(F.date_add(at, 1)).alias("as_of"))
        return quality.panel_findings(x).groupBy("symbol", "finding").agg(F.count("*").alias("n"))

    add("g04_panel_findings", findings, """WITH o AS (SELECT o_custkey AS symbol, quarter(o_orderdate) AS q, CASE WHEN o_orderkey % 50 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y%m%d') END AS d, strftime(o_orderdate::DATE + (o_orderkey % 3)::INT, '%Y%m%d') AS a, strftime(o_orderdate::DATE + 1, '%Y%m%d') AS s FROM orders),
r AS (SELECT *, count(*) OVER (PARTITION BY symbol, q, s) AS k FROM o), f AS (SELECT symbol, 'bad_date' AS finding FROM r WHERE NOT regexp_full_match(d, '[0-9]{8}') UNION ALL SELECT symbol, 'early' FROM r WHERE a <= d UNION ALL SELECT symbol, 'future' FROM r WHERE a > s UNION ALL SELECT symbol, 'repeated' FROM r WHERE k > 1) SELECT symbol, finding, count(*) AS n FROM f GROUP BY ALL""")
    marks = {"roa": "c_acctbal / 1e4", "cfo": "(c_custkey % 7 - 3) / 1e1", "droa": "c_custkey % 5 - 2", "accrual": "0", "dleverage": "c_custkey % 3 - 1", "dliquidity": "c_custkey % 4 - 2", "issued": "c_custkey % 2", "dmargin": "c_custkey % 6 - 3", "dturnover": "c_custkey % 9 - 4"}
    score = " + ".join(f"({t})::INT" for t in ("roa > 0", "cfo > 0", "droa > 0", "cfo > roa", "dleverage < 0", "dliquidity > 0", "issued <= 0", "dmargin > 0", "dturnover > 0"))
    add("g14_f_score", lambda s, d: quality.f_score(table(s, d, "customer").select("c_custkey", *(F.expr(e).alias(n) for n, e in marks.items()))).select("c_custkey", "f_score"), "WITH m AS (SELECT c_custkey, " + ", ".join(f"{e} AS {n}" for n, e in marks.items()) + f" FROM customer) SELECT c_custkey, {score} AS f_score FROM m")
    items = {"price_cap": "sum(l_extendedprice) * 10", "net_income": "sum(l_extendedprice * l_discount)", "book": "sum(l_extendedprice) / 2", "revenue": "sum(l_extendedprice)", "cash_flow": "sum(l_extendedprice * l_tax)", "gross_profit": "sum(l_extendedprice * (1 - l_discount))", "assets": "sum(l_quantity) * 100", "debt": "sum(l_extendedprice) / 4"}
    made = {"ep": "net_income / nullif(price_cap, 0)", "roe": "net_income / nullif(book, 0)", "gpa": "gross_profit / nullif(assets, 0)", "margin": "net_income / nullif(revenue, 0)", "leverage": "debt / nullif(assets, 0)", "cash_quality": "cash_flow / nullif(net_income, 0)", "accruals": "(net_income - cash_flow) / nullif(assets, 0)"}
    add("g13_ratios", lambda s, d: quality.ratios(table(s, d, "lineitem").groupBy("l_suppkey").agg(*(F.expr(e).alias(n) for n, e in items.items()))).select("l_suppkey", *(tidy(n).alias(n) for n in made)), "WITH f AS (SELECT l_suppkey, " + ", ".join(f"{e} AS {n}" for n, e in items.items()) + " FROM lineitem GROUP BY 1) SELECT l_suppkey, " + ", ".join(f"{O.tidy(e)} AS {n}" for n, e in made.items()) + " FROM f")


def _transcripts(add: Callable) -> None:
    def cues(s, d):
        said = F.regexp_replace(F.col("text"), r"\s+", " ")
        clock = lambda t: F.concat(F.lpad(F.floor(t / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(t / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((t % 60).cast("string"), 2, "0"), F.lit(".250"))
        t = F.col("turn") * 5
        vtt = F.concat(F.lit("WEBVTT\n\n"), clock(t), F.lit(" --> "), clock(t + 4), F.lit(" align:start\n<c>"), said, F.lit("</c>\n"))
        c = table(s, d, "conversations").filter("text is not null").select("conv_id", "turn", F.explode(text.web_vtt(vtt)).alias("cue"))
        return c.select("conv_id", "turn", F.char_length("cue.text").cast("long").alias("n_chars"), "cue.start", "cue.duration")

    add("n05_web_vtt", cues, r"WITH c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS t FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, length(t) AS n_chars, turn * 5 + 0.25::DOUBLE AS start, 4.0::DOUBLE AS duration FROM c WHERE t <> ''")


def register(add: Callable, plans: dict, sql: dict, valued: Callable, valued_sql: str) -> None:
    _risk(add)
    _flows(add)
    _dependence(add, plans, sql, valued, valued_sql)
    _audits(add)
    _transcripts(add)
