"""Registered queries of the research operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import cross
from tessera.functions.series import S, tidy
from tessera.operators import analytics, checks, research
from tessera.plans import oracle as O
from tessera.sources.panel import bars, industries, staged, synthetic_bars, table

STAGED = f"WITH {O.STAGED}"
SECTORS = "JOIN supplier ON s_suppkey = symbol JOIN nation ON n_nationkey = s_nationkey"
IC = """k AS (SELECT * FROM t WHERE value IS NOT NULL AND fwd IS NOT NULL),
  i AS (SELECT date, covar_pop(value, fwd) / nullif(stddev_pop(value) * stddev_pop(fwd), 0) AS ic FROM k GROUP BY date HAVING count(*) >= 8)"""


def tidied(df: DataFrame, keys: list[str], *values: str) -> DataFrame:
    return df.select(*keys, *(tidy(v).alias(v) for v in values))


def sql_tidied(*values: str) -> str:
    return ", ".join(f"{O.tidy(v)} AS {v}" for v in values)


def clipped(x: str, low: float, high: float) -> str:
    return f"greatest({low!r}::DOUBLE, least({high!r}::DOUBLE, {x}))"


def _sources(add: Callable) -> None:
    def bench(s, d):
        b = staged(s, d)
        return tidied(research.with_benchmark(b, b.groupBy("date").agg(F.avg("ret").alias("bench")), "bench").withColumn("value", F.col("ret") - F.col("bench")), ["symbol", "date"], "value")

    add("s05_benchmark", bench, f"{STAGED}, m AS (SELECT date, avg(ret) AS bench FROM b GROUP BY date) SELECT symbol, date, {O.tidy('ret - bench')} AS value FROM b JOIN m USING (date)")

    def fills(s, d):
        raw = table(s, d, "lineitem").select("l_shipdate", "l_suppkey", F.when(F.col("l_linestatus") == "O", "Buy").otherwise("s").alias("x"), F.col("l_extendedprice").cast("string"), F.col("l_quantity").cast("string"))
        out = research.fills(raw.toDF("﻿DateTime", " Code", "Direction ", "Px", "Shares"))
        return out.groupBy("symbol", "side").agg(F.count("*").alias("n"), tidy(F.sum("qty")).alias("qty"), tidy(F.avg("price")).alias("price"))

    add("s06_fills", fills, f"SELECT l_suppkey AS symbol, CASE WHEN l_linestatus = 'O' THEN 'buy' ELSE 'sell' END AS side, count(*) AS n, {O.tidy('sum(l_quantity)')} AS qty, {O.tidy('avg(l_extendedprice)')} AS price FROM lineitem GROUP BY ALL")

    def library(s, d):
        one = table(s, d, "nation").agg(F.to_json(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key")))).alias("doc"))
        two = table(s, d, "region").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("r_name").alias("name"), F.col("r_regionkey").alias("key"))).alias("factors"))).alias("doc"))
        return research.library(one.unionByName(two), "doc", "struct<name:string,key:int>")

    add("s07_library", library, "SELECT n_name AS name, n_nationkey AS key FROM nation UNION ALL SELECT r_name, r_regionkey FROM region")
    u = "('0x' || substr(md5('11:' || range), {}, 8))::BIGINT / 4294967296.0::DOUBLE"
    add(
        "s10_synthetic_bars",
        lambda s, d: tidied(synthetic_bars(s, 12, 180, 11), ["symbol", "date"], "open", "close", "volume"),
        f"""WITH r AS (SELECT range, range // 180 AS symbol, range % 180 AS t, {u.format(1)} AS u, {u.format(9)} AS v FROM range(2160)),
x AS (SELECT symbol, DATE '2021-01-04' + (t // 5 * 7 + t % 5)::INT AS date, 100 + symbol + 10 * sin(t / 10.0::DOUBLE) + u AS close, u, v FROM r),
y AS (SELECT symbol, date, close * (1 + (v - 0.5::DOUBLE) / 50) AS open, close, floor(1000 * (1 + 9 * v)) AS volume FROM x)
SELECT symbol, date, {sql_tidied('open', 'close', 'volume')} FROM y""",
    )


def _panel(add: Callable) -> None:
    def features(s, d):
        c = table(s, d, "customer")
        names = research.numeric_features(c, exclude=("c_nationkey",))
        return c.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("x")) for n in names))).alias("f")).groupBy("f.name").agg(F.count("f.x").alias("n"), tidy(F.avg("f.x")).alias("mean"))

    add("p04_numeric_features", features, " UNION ALL ".join(f"SELECT '{n}' AS name, count({n}) AS n, {O.tidy(f'avg({n}::DOUBLE)')} AS mean FROM customer" for n in ("c_custkey", "c_acctbal")))
    add(
        "p09_fixed_windows",
        lambda s, d: research.fixed_windows(checks.date_places(bars(s, d)), ("1993-01-01", "1995-12-31"), ("1996-03-01", "1997-06-30"), 5),
        f"""WITH {O.BARS} SELECT DISTINCT date, CASE WHEN date <= DATE '1995-12-31' THEN 'train' ELSE 'valid' END AS role FROM bars
WHERE date BETWEEN DATE '1993-01-01' AND DATE '1995-12-31' OR date BETWEEN DATE '1996-03-01' AND DATE '1997-06-30'""",
    )
    add(
        "p12_tradable",
        lambda s, d: research.tradable(staged(s, d), 0.3).groupBy("date").agg(F.count_if("can_buy").alias("buy"), F.count_if("can_sell").alias("sell")),
        f"{STAGED} SELECT date, count(*) FILTER (volume > 0 AND coalesce(ret, 0) < 0.3::DOUBLE) AS buy, count(*) FILTER (volume > 0 AND coalesce(ret, 0) > -0.3::DOUBLE) AS sell FROM b GROUP BY date",
    )
    add(
        "j16_missing_snapshots",
        lambda s, d: research.missing_snapshots(bars(s, d)),
        f"""WITH {O.BARS}, e AS (SELECT max(date) AS date FROM bars GROUP BY date_trunc('month', date)),
g AS (SELECT symbol, date FROM (SELECT DISTINCT symbol FROM bars) CROSS JOIN e) SELECT symbol, date FROM g ANTI JOIN bars USING (symbol, date)""",
    )
    add(
        "x05_rolling_median_z",
        lambda s, d: staged(s, d).select("symbol", "date", tidy(research.rolling_median_z("ret", 60, 20)).alias("value")),
        f"""{STAGED}, q AS (SELECT symbol, date, count(ret) OVER w60 AS n, (ret - quantile_cont(ret, 0.5) OVER w60) / nullif(stddev_pop(ret) OVER w60, 0) AS z FROM b {O.WINDOWS})
SELECT symbol, date, CASE WHEN n >= 20 AND z IS NOT NULL THEN {O.tidy(clipped('z', -3.0, 3.0))} END AS value FROM q""",
    )
    reports = lambda s, d: table(s, d, "customer").groupBy("c_nationkey").agg((F.avg("c_acctbal") / 1000 - 4.3).alias("score"), (F.avg("c_acctbal") / F.stddev_samp("c_acctbal") - 1.3).alias("ir"))
    share = "CASE WHEN sum(greatest(0, {0})) OVER () > 0 THEN least(0.1::DOUBLE, greatest(0, {0}) / nullif(sum(greatest(0, {0})) OVER (), 0)) ELSE 1.0::DOUBLE / count(*) OVER () END"
    add(
        "x11_blend_weights",
        lambda s, d: tidied(research.blend_weights(reports(s, d), "score", "ir", 0.1), ["c_nationkey"], "equal", "by_score", "by_ir"),
        f"""WITH r AS (SELECT c_nationkey, avg(c_acctbal) / 1000 - 4.3::DOUBLE AS score, avg(c_acctbal) / stddev_samp(c_acctbal) - 1.3::DOUBLE AS ir FROM customer GROUP BY 1),
c AS (SELECT c_nationkey, {share.format('score')} AS a, {share.format('ir')} AS z FROM r)
SELECT c_nationkey, {O.tidy('1.0::DOUBLE / count(*) OVER ()')} AS equal, {O.tidy('a / sum(a) OVER ()')} AS by_score, {O.tidy('z / sum(z) OVER ()')} AS by_ir FROM c""",
    )
    styled = lambda s, d: staged(s, d).join(industries(s, d), "symbol").withColumn("size", F.ln("amount")).select("symbol", "date", "sector", "ret", "size", "hl")
    cell, day = "PARTITION BY date, sector", "PARTITION BY date"
    add(
        "x09_residual",
        lambda s, d: tidied(research.residualize(styled(s, d), "ret", ["size", "hl"], "sector"), ["symbol", "date"], "residual"),
        f"""{STAGED}, a AS (SELECT symbol, date, n_name AS sector, ret, ln(amount) AS size, hl FROM b {SECTORS} WHERE ret IS NOT NULL AND hl IS NOT NULL),
e AS (SELECT symbol, date, ret - avg(ret) OVER ({cell}) AS y, size - avg(size) OVER ({cell}) AS x, hl - avg(hl) OVER ({cell}) AS z,
  count(*) OVER ({day}) AS n, len(list_distinct(list(sector) OVER ({day}))) + 1 AS k FROM a),
f AS (SELECT *, sum(x * x) OVER ({day}) AS xx, sum(x * y) OVER ({day}) AS xy, sum(x * z) OVER ({day}) AS xz FROM e),
g AS (SELECT symbol, date, n, k, y - CASE WHEN xx > 1e-18::DOUBLE THEN xy / xx ELSE 0 END * x AS y, z - CASE WHEN xx > 1e-18::DOUBLE THEN xz / xx ELSE 0 END * x AS z FROM f),
h AS (SELECT *, sum(z * z) OVER ({day}) AS zz, sum(z * y) OVER ({day}) AS zy FROM g)
SELECT symbol, date, CASE WHEN n >= greatest(30, 3 * k) THEN {O.tidy('y - CASE WHEN zz > 1e-18::DOUBLE THEN zy / zz ELSE 0 END * z')} END AS residual FROM h""",
    )


def _ranking(add: Callable) -> None:
    order = Window.orderBy
    flagged = lambda s, d: table(s, d, "customer").select("c_custkey", (F.col("c_acctbal") < 0).alias("alert"), (F.col("c_nationkey") % 3).alias("consensus"), F.abs("c_acctbal").alias("strength"))
    by = ("alert", "consensus", "strength")

    def alerts(s, d):
        top = flagged(s, d).orderBy(*(F.desc(n) for n in by), "c_custkey").limit(50)
        return top.withColumn("place", F.row_number().over(order(*(F.desc(n) for n in by), "c_custkey"))).select("place", "c_custkey")

    add(
        "r06_alert_order",
        alerts,
        "SELECT row_number() OVER (ORDER BY c_acctbal < 0 DESC, c_nationkey % 3 DESC, abs(c_acctbal) DESC, c_custkey)::INT AS place, c_custkey FROM customer QUALIFY place <= 50",
    )
    add(
        "r07_top_contributors",
        lambda s, d: table(s, d, "supplier").groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("risk")).orderBy(F.abs("risk").desc(), "s_nationkey").limit(5).select("s_nationkey", tidy("risk").alias("risk")),
        f"SELECT s_nationkey, {O.tidy('sum(s_acctbal)')} AS risk FROM supplier GROUP BY 1 ORDER BY abs(sum(s_acctbal)) DESC, s_nationkey LIMIT 5",
    )
    add(
        "r08_first_issues",
        lambda s, d: table(s, d, "events").filter("value > 100").orderBy(F.desc("value"), "event_id").limit(20).select("event_id", "event_type"),
        "SELECT event_id, event_type FROM events WHERE value > 100 ORDER BY value DESC, event_id LIMIT 20",
    )
    add(
        "r10_date_sets",
        lambda s, d: staged(s, d).filter("volume > 60").select("date").distinct().exceptAll(staged(s, d).filter("ret > 0.5").select("date").distinct()),
        f"{STAGED} SELECT DISTINCT date FROM b WHERE volume > 60 EXCEPT SELECT date FROM b WHERE ret > 0.5::DOUBLE",
    )
    add(
        "r12_seeded_sample",
        lambda s, d: table(s, d, "part").filter(F.conv(F.substring(F.md5(F.concat(F.lit("7:"), F.col("p_partkey").cast("string"))), 1, 8), 16, 10).cast("long") % 10 == 0).select("p_partkey"),
        "SELECT p_partkey FROM part WHERE ('0x' || substr(md5('7:' || p_partkey), 1, 8))::BIGINT % 10 = 0",
    )


def _evaluation(add: Callable, valued: Callable, t: str) -> None:
    add(
        "e02_open_forward",
        lambda s, d: staged(s, d).select("symbol", "date", tidy(F.try_divide(F.lead("open", 2).over(S()), F.lead("open", 1).over(S())) - 1).alias("value")),
        O.value("lead(open, 2) OVER s / nullif(lead(open, 1) OVER s, 0) - 1"),
    )

    def scores(s, d):
        g = staged(s, d).groupBy("symbol").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("v"), F.min("ret").alias("low"), F.corr("ret", "dv").alias("c"), F.avg("dv").alias("dv"))
        ir = F.col("m") / F.col("v") * F.sqrt(F.lit(52.0))
        return g.select("symbol", tidy(research.primary_score(ir, ir / 2, F.col("m") * 5, F.col("low") / 4, F.col("c"), F.col("dv") * 40)).alias("score"))

    ir = "(m / v * sqrt(52.0::DOUBLE))"
    parts = [(0.2, clipped(f"{ir} / 3.0::DOUBLE", -2.0, 2.0)), (0.3, clipped(f"{ir} / 2 + 0.5::DOUBLE", -2.0, 2.0)), (0.3, clipped("m * 5 / 0.1::DOUBLE", -2.0, 2.0)), (0.2, clipped("1 + low / 4 / 0.3::DOUBLE", -2.0, 1.0)), (0.1, clipped("c", -1.0, 1.0)), (-0.1, clipped("dv * 40 / 30.0::DOUBLE - 1", 0.0, 3.0))]
    add(
        "e11_primary_score",
        scores,
        f"""{STAGED}, g AS (SELECT symbol, avg(ret) AS m, stddev_samp(ret) AS v, min(ret) AS low, corr(ret, dv) AS c, avg(dv) AS dv FROM b GROUP BY symbol)
SELECT symbol, {O.tidy(' + '.join(f'({w!r}::DOUBLE) * ({e})' for w, e in parts))} AS score FROM g""",
    )

    def verdicts(s, d):
        a = table(s, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m"), F.max("c_acctbal").alias("x"), F.min("c_acctbal").alias("l"))
        f = a.select(
            F.col("c_nationkey").alias("name"), F.when(F.col("c_nationkey") % 4 > 0, "Effective ").alias("status"), (F.col("c_nationkey") % 5 > 0).alias("direction_consistent"),
            (F.col("m") / 1000 - 4.4).alias("ICIR"), (F.col("x") / 10000).alias("RankICIR"), F.when(F.col("c_nationkey") % 7 > 0, F.col("m") / 1000 - 4.3).alias("O-ICIR"),
            F.col("x").alias("O-RankICIR"), (F.col("l") / -5000.0).alias("O-HybridICIR"),
        )
        out = research.library_verdicts(f, 0.19, 0.5, True)
        return out.select("name", "kept", tidy("worst_retention").alias("worst_retention"), F.array_join("reasons", ";").alias("reasons"))

    why = [
        ('"O-ICIR" IS NULL', "missing_or_invalid_metric:O-ICIR"),
        ("coalesce(lower(trim(status)), '') <> 'effective'", "status_not_effective"),
        ("NOT coalesce(direction_consistent, false)", "direction_inconsistent"),
        ('"O-HybridICIR" < 0.19::DOUBLE', "o_hybrid_icir_below_threshold"),
        ('"O-ICIR" IS NOT NULL AND "ICIR" <= 0', "nonpositive_insample_metric:ICIR"),
        ('"O-ICIR" IS NOT NULL AND "RankICIR" <= 0', "nonpositive_insample_metric:RankICIR"),
        ("worst_retention < 0.5::DOUBLE - 1e-12::DOUBLE", "decay_above_threshold"),
    ]
    listed = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{w}' END" for c, w in why) + "], lambda x: x IS NOT NULL), ';')"
    add(
        "e13_library_filter",
        verdicts,
        f"""WITH a AS (SELECT c_nationkey AS name, avg(c_acctbal) AS m, max(c_acctbal) AS x, min(c_acctbal) AS l FROM customer GROUP BY 1),
f AS (SELECT name, CASE WHEN name % 4 > 0 THEN 'Effective ' END AS status, name % 5 > 0 AS direction_consistent, m / 1000 - 4.4::DOUBLE AS "ICIR", x / 10000 AS "RankICIR",
  CASE WHEN name % 7 > 0 THEN m / 1000 - 4.3::DOUBLE END AS "O-ICIR", x AS "O-RankICIR", l / -5000.0::DOUBLE AS "O-HybridICIR" FROM a),
w AS (SELECT *, CASE WHEN "O-ICIR" IS NOT NULL AND "ICIR" > 0 AND "RankICIR" > 0 THEN least("O-ICIR" / "ICIR", "O-RankICIR" / "RankICIR") END AS worst_retention FROM f),
r AS (SELECT name, worst_retention, {listed} AS reasons FROM w)
SELECT name, reasons = '' AS kept, {O.tidy('worst_retention')} AS worst_retention, reasons FROM r""",
    )

    def packaged(s, d):
        ic = analytics.daily_ic(valued(s, d)).filter("ic is not null").withColumn("all", F.lit(1))
        hac = analytics.newey_west_t(ic, "ic", "all", "date").select("n", "mean", "t")
        spread = ic.agg(F.stddev_samp("ic").alias("sd"))
        return hac.join(spread, how="cross").select("n", tidy("mean").alias("mean"), tidy(F.col("mean") / F.col("sd")).alias("icir"), tidy("t").alias("t"))

    lags = ", ".join(f"e * lag(e, {j}) OVER (ORDER BY date) AS g{j}" for j in range(1, 5))
    long = "sum(e * e) + " + " + ".join(f"{2 * (1 - j / 5)!r}::DOUBLE * sum(g{j})" for j in range(1, 5))
    add(
        "e21_evaluation",
        packaged,
        f"""{t}, {IC}, e AS (SELECT date, ic, ic - avg(ic) OVER () AS e FROM i WHERE ic IS NOT NULL), l AS (SELECT *, {lags} FROM e)
SELECT count(*) AS n, {O.tidy('avg(ic)')} AS mean, {O.tidy('avg(ic) / stddev_samp(ic)')} AS icir, {O.tidy(f'avg(ic) * count(*) / sqrt({long})')} AS t FROM l""",
    )

    def market(s, d):
        m = staged(s, d).groupBy("date").agg(F.avg("ret").alias("r"))
        w = Window.orderBy("date")  # a row a date
        m = m.withColumn("score", tidy(F.sum("r").over(w.rowsBetween(-4, 0)))).withColumn("next", F.lead("r").over(w)).filter("score is not null and next is not null")
        every = Window.partitionBy()
        pct = (F.rank().over(w.orderBy("score")) + (F.count("*").over(Window.partitionBy("score")) - 1) / 2.0) / F.count("*").over(every)
        return m.withColumn("grp", F.ceil(pct * 5).cast("int")).groupBy("grp").agg(F.count("*").alias("n"), tidy(F.avg("next")).alias("mean"))

    add(
        "e22_market_score",
        market,
        f"""{STAGED}, m AS (SELECT date, avg(ret) AS r FROM b GROUP BY date), q AS (SELECT date, {O.tidy('sum(r) OVER (ORDER BY date ROWS 4 PRECEDING)')} AS score, lead(r) OVER (ORDER BY date) AS nxt FROM m),
k AS (SELECT * FROM q WHERE score IS NOT NULL AND nxt IS NOT NULL),
p AS (SELECT ceil((rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE) / count(*) OVER () * 5)::INT AS grp, nxt FROM k)
SELECT grp, count(*) AS n, {O.tidy('avg(nxt)')} AS mean FROM p GROUP BY grp""",
    )
    f = "SELECT least(0.999, n_chars / 5000.0::DOUBLE) AS p, quality::DOUBLE AS y FROM documents JOIN labels USING (doc_id)"

    def errors(s, d):
        x = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select(F.least(F.lit(0.999), F.col("n_chars") / 5000.0).alias("p"), F.col("quality").cast("double").alias("y"))
        bins = x.groupBy(F.floor(F.col("p") * 10).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("y").alias("y"))
        return tidied(research.calibration_error(bins), [], "ece", "mce")

    add(
        "a12_calibration_error",
        errors,
        f"WITH f AS ({f}), g AS (SELECT count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM f GROUP BY floor(p * 10)) SELECT {O.tidy('sum(gap * n) / sum(n)')} AS ece, {O.tidy('max(gap)')} AS mce FROM g",
    )


def _backtest(add: Callable, sql: dict, valued: Callable, t: str) -> None:
    def health(s, d):
        v = valued(s, d)
        p = analytics.sleeves(v)
        picks = v.withColumn("r", cross.rank("value")).groupBy("date").agg(F.count_if(F.col("r") >= 0.9).alias("held"), F.count("*").alias("universe"))
        out = research.health(p.select("date", tidy("turnover").alias("turnover"), tidy("log_nav").alias("log_nav")), picks)
        return tidied(out, ["held_ok", "turnover_ok", "drawdown_ok", "invested_ok"], "held", "expected", "turnover", "drawdown", "invested")

    add(
        "b02_health",
        health,
        f"""WITH z AS ({sql['b01_sleeves']}), y AS (SELECT turnover, exp(log_nav - greatest(0, max(log_nav) OVER (ORDER BY date))) - 1 AS dd FROM z),
p AS (SELECT avg(turnover) AS turnover, min(dd) AS drawdown FROM y),
h AS ({t}, r AS (SELECT date, ({O.pct('value')}) AS r FROM t), g AS (SELECT date, count(*) FILTER (r >= 0.9::DOUBLE) AS held, count(*) AS universe FROM r GROUP BY date)
  SELECT avg(held) AS held, avg(universe) * 0.1::DOUBLE AS expected, avg((held > 0)::INT) AS invested FROM g)
SELECT {sql_tidied('held', 'expected', 'turnover', 'drawdown', 'invested')}, held BETWEEN 0.7::DOUBLE * expected AND 1.1::DOUBLE * expected AS held_ok,
  turnover BETWEEN 0.2::DOUBLE AND 0.6::DOUBLE AS turnover_ok, drawdown > -0.5::DOUBLE AND drawdown < -0.05::DOUBLE AS drawdown_ok, invested > 0.8::DOUBLE AS invested_ok FROM p, h""",
    )
    add(
        "b04_deciles",
        lambda s, d: tidied(research.deciles(valued(s, d), "value", "ret"), ["date", "decile", "n"], "ret"),
        f"""{t}, h AS (SELECT *, lag(value) OVER (PARTITION BY symbol ORDER BY date) AS sig FROM t), q AS (SELECT date, ret, ceil(({O.pct('sig')}) * 10)::INT AS decile FROM h)
SELECT date, decile, count(ret) AS n, {O.tidy('avg(ret)')} AS ret FROM q WHERE decile IS NOT NULL GROUP BY ALL""",
    )

    def periods(s, d):
        x = staged(s, d).withColumn("ret", F.col("ret") / 100).withColumn("size", F.ln("amount")).dropna(subset=["ret", "size", "hl"])
        day = Window.partitionBy("date")
        top = (cross.rank("hl") >= 0.8).cast("double")
        x = x.withColumn("top", top).withColumn("wp", F.coalesce(F.try_divide("top", F.sum("top").over(day)), F.lit(0.0))).withColumn("wb", 1.0 / F.count("*").over(day))
        return research.attribution(x, "wp", "wb", "ret", ("size", "hl"))

    effects = ["size", "hl", "specific"]
    per = f"""{STAGED}, a AS (SELECT date, ret / 100 AS ret, ln(amount) AS size, hl FROM b WHERE ret IS NOT NULL AND hl IS NOT NULL), r AS (SELECT *, (({O.pct('hl')}) >= 0.8::DOUBLE)::INT AS top FROM a),
w AS (SELECT *, coalesce(top / nullif(sum(top) OVER (PARTITION BY date), 0), 0) AS wp, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) AS wb FROM r),
g AS (SELECT date, sum(wp * ret) AS rp, sum(wb * ret) AS rb, sum((wp - wb) * size) AS xa, sum((wp - wb) * hl) AS xb, covar_samp(size, size) AS aa, covar_samp(hl, hl) AS bb, covar_samp(size, hl) AS ab,
  covar_samp(ret, size) AS ya, covar_samp(ret, hl) AS yb FROM w GROUP BY date),
e AS (SELECT date, rp, rb, rp - rb AS active, xa * (ya * bb - yb * ab) / nullif(aa * bb - ab * ab, 0) AS size, xb * (yb * aa - ya * ab) / nullif(aa * bb - ab * ab, 0) AS hl FROM g),
x AS (SELECT *, active - size - hl AS specific, CASE WHEN abs(active) < 1e-12::DOUBLE THEN 1 / (1 + rp) ELSE (ln(1 + rp) - ln(1 + rb)) / active END AS k FROM e)"""
    big = "date >= '1996-01-01'"  # earlier weeks may hold too few symbols for a fit
    add("b07_factor_attribution", lambda s, d: tidied(periods(s, d), ["date"], "active", "size", "hl", "specific"), f"{per} SELECT date, {sql_tidied('active', *effects)} FROM x")
    add(
        "b06_linked_effects",
        lambda s, d: research.linked(periods(s, d).filter(big).filter("rp > -1 and rb > -1 and size is not null"), effects).select(*(F.round(n, 5).alias(n) for n in ("active", *effects))),
        f"""{per}, y AS (SELECT sum(ln(1 + rp)) AS lp, sum(ln(1 + rb)) AS lb, {', '.join(f'sum({n} * k) AS {n}' for n in effects)} FROM x WHERE {big} AND rp > -1 AND rb > -1 AND size IS NOT NULL)
SELECT round(exp(lp) - exp(lb), 5) AS active, {', '.join(f'round({n} * (exp(lp) - exp(lb)) / (lp - lb), 5) AS {n}' for n in effects)} FROM y""",
    )

    def costs(s, d):
        b = staged(s, d).withColumn("sd", F.stddev_samp("ret").over(Window.partitionBy("symbol"))).withColumn("adv", F.avg("volume").over(Window.partitionBy("symbol")))
        x = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("symbol"), F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"), F.date_trunc("week", "l_shipdate").cast("date").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty"))
        j = x.join(b.select("symbol", "date", F.col("open").alias("arrival"), (F.col("amount") / F.col("volume")).alias("bench"), "adv", F.coalesce(F.col("sd") / F.sqrt(F.lit(5.0)), F.lit(0.0)).alias("sigma_day"), (0.5 * (F.col("high") - F.col("low")) / F.col("close")).alias("half_spread")), ["symbol", "date"])
        out = research.shortfall(j.withColumn("symbol", F.concat(F.col("symbol").cast("string"), F.when(F.col("symbol") % 2 == 0, ".SH").otherwise(".HK"))))
        return out.groupBy("symbol").agg(F.count("*").alias("n"), *(research.mean_of_hundredths(n).alias(n) for n in ("timing", "impact", "spread", "fees", "slippage")))

    sign = "CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END"
    add(
        "b08_shortfall",
        costs,
        f"""{STAGED}, c AS (SELECT symbol, date, open, amount / volume AS bench, avg(volume) OVER q AS adv, coalesce(stddev_samp(ret) OVER q / sqrt(5.0::DOUBLE), 0) AS sg, 0.5::DOUBLE * (high - low) / close AS hs
  FROM b WINDOW q AS (PARTITION BY symbol)),
x AS (SELECT symbol, round({sign} * (bench - open) / open * 1e4::DOUBLE, 2) AS timing, round(0.1::DOUBLE * sg * sqrt(l_quantity / adv) * 1e4::DOUBLE, 2) AS impact, round(hs * 1e4::DOUBLE, 2) AS spread,
  2.6::DOUBLE + CASE WHEN l_linestatus <> 'O' AND symbol % 2 = 0 THEN 5 ELSE 0 END AS fees, round({sign} * (l_extendedprice / l_quantity - bench) / bench * 1e4::DOUBLE, 2) AS slippage
  FROM lineitem JOIN c ON symbol = l_suppkey AND date = date_trunc('week', l_shipdate)::DATE)
SELECT symbol || CASE WHEN symbol % 2 = 0 THEN '.SH' ELSE '.HK' END AS symbol, count(*) AS n, {', '.join(f'round(avg({n}), 1) AS {n}' for n in ('timing', 'impact', 'spread', 'fees', 'slippage'))} FROM x GROUP BY 1""",
    )
    z = lambda x: f"({x} - avg({x}) OVER d) / nullif(stddev_samp({x}) OVER d, 0)"
    back = lambda n: f"lag(close) OVER s / nullif(lag(close, {n + 1}) OVER s, 0) - 1"
    add(
        "b12_index_factor",
        lambda s, d: tidied(research.index_factor(staged(s, d), 20, 5, 10), ["symbol", "date"], "value"),
        f"""{STAGED}, v AS (SELECT *, CASE WHEN count(ret) OVER w10 = 10 THEN stddev_samp(ret) OVER w10 END AS sd FROM b {O.WINDOWS}),
m AS (SELECT symbol, date, {back(20)} AS m, -({back(5)}) AS r, -lag(sd) OVER s AS l FROM v {O.WINDOWS}),
q AS (SELECT symbol, date, {z('m')} AS m, {z('r')} AS r, {z('l')} AS l FROM m WINDOW d AS (PARTITION BY date))
SELECT symbol, date, {O.tidy('m + 0.25::DOUBLE * r + 0.25::DOUBLE * l')} AS value FROM q""",
    )
    add(
        "g09_quarter_chunks",
        lambda s, d: research.quarter_chunks(table(s, d, "orders").select((F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).cast("long").alias("quarter")), 6),
        """WITH q AS (SELECT DISTINCT year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS quarter FROM orders), c AS (SELECT quarter, ((row_number() OVER (ORDER BY quarter) - 1) // 6)::INT AS chunk FROM q)
SELECT chunk, min(quarter) AS first, max(quarter) AS last, count(*) AS n FROM c GROUP BY chunk""",
    )
    daily = "x AS (SELECT o_orderdate::DATE AS date, count(*)::DOUBLE AS x FROM orders GROUP BY 1)"
    counted = lambda s, d: table(s, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count("*").cast("double").alias("x"))
    hac = lambda by: f"""e AS (SELECT *, x - avg(x) OVER (PARTITION BY {by}) AS e FROM k), l AS (SELECT *, {', '.join(f'e * lag(e, {j}) OVER (PARTITION BY {by} ORDER BY date) AS g{j}' for j in range(1, 5))} FROM e)
SELECT {by}, count(*) AS n, {O.tidy('avg(x)')} AS mean, {O.tidy(f'avg(x) * count(*) / sqrt({long()})')} AS t FROM l GROUP BY {by}"""  # noqa: E731

    def long() -> str:
        return "sum(e * e) + " + " + ".join(f"{2 * (1 - j / 5)!r}::DOUBLE * sum(g{j})" for j in range(1, 5))

    show = lambda x, by: x.select(by, "n", tidy("mean").alias("mean"), tidy("t").alias("t"))
    add("v09_month", lambda s, d: show(analytics.newey_west_t(counted(s, d).withColumn("month", F.month("date").cast("long")), "x", "month", "date"), "month"), f"WITH {daily}, k AS (SELECT *, month(date) AS month FROM x), {hac('month')}")
    m = "PARTITION BY date_trunc('month', date)"
    add(
        "v09_turn_of_month",
        lambda s, d: show(analytics.newey_west_t(research.month_ends_turn(counted(s, d)), "x", "turn", "date"), "turn"),
        f"WITH {daily}, k AS (SELECT *, row_number() OVER ({m} ORDER BY date) <= 3 OR row_number() OVER ({m} ORDER BY date DESC) <= 1 AS turn FROM x), {hac('turn')}",
    )

    def fdr(s, d):
        t_ = staged(s, d).groupBy(F.col("symbol").alias("name")).agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("v"), F.count("ret").alias("n"))
        t_ = t_.filter("v > 0").select("name", (1 / (1 + F.col("m") * F.col("m") * F.col("n") / (F.col("v") * F.col("v")))).alias("p"))
        return tidied(research.false_discovery(t_, "p"), ["name"], "p", "adjusted")

    add(
        "v09_false_discovery",
        fdr,
        f"""{STAGED}, g AS (SELECT symbol AS name, avg(ret) AS m, stddev_samp(ret) AS v, count(ret) AS n FROM b GROUP BY symbol), p AS (SELECT name, 1 / (1 + m * m * n / (v * v)) AS p FROM g WHERE v > 0),
q AS (SELECT name, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, name DESC) AS q FROM p)
SELECT name, {O.tidy('p')} AS p, {O.tidy('least(1.0::DOUBLE, min(q) OVER (ORDER BY p DESC, name ROWS UNBOUNDED PRECEDING))')} AS adjusted FROM q""",
    )


def _overfit(add: Callable) -> None:
    def deflated(s: SparkSession, d: str) -> DataFrame:
        """Per symbol, as trials of one search: probabilistic and deflated Sharpe, least track record, haircut, verdict."""
        stats = analytics.sharpe_stats(staged(s, d).filter("ret is not null"), "symbol").filter("sr is not null and n > 2")
        spread = stats.agg(F.var_samp("sr").alias("variance"), F.count("*").alias("trials"))
        joined = stats.join(F.broadcast(spread), how="cross")  # one row

        def each(parts):
            for p in parts:
                out = [checks.overfit(*x) for x in zip(p.sr, p.n, p["skew"], p["kurt"], p.variance, p.trials, strict=True)]
                yield p[["symbol"]].assign(**{n: [o[i] for o in out] for i, n in enumerate(("psr", "dsr", "min_length", "haircut", "passed"))})

        return joined.select("symbol", "sr", "n", "skew", "kurt", "variance", "trials").mapInPandas(each, "symbol long, psr double, dsr double, min_length double, haircut double, passed boolean")

    add("v02_v06_overfit_verdict", deflated)


def register(add: Callable, sql: dict, valued: Callable, valued_sql: str) -> None:
    _sources(add)
    _panel(add)
    _ranking(add)
    _evaluation(add, valued, valued_sql)
    _backtest(add, sql, valued, valued_sql)
    _overfit(add)
