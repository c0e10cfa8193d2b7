"""Registered queries of published alphas, splits, stability, diagnostics, costs, reconciliation and contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.series import tidy
from tessera.operators import alphas, analytics, checks, joins
from tessera.plans import oracle as O
from tessera.sources.panel import bars, melt, staged, table


def chain(*stages: dict[str, str]) -> str:
    """SQL stages over staged bars; the last holds `value`."""
    ctes = [f"t{i + 1} AS (SELECT * REPLACE ({', '.join(f'{e} AS {n}' for n, e in s.items() if n in seen) or 'date AS date'}){''.join(f', {e} AS {n}' for n, e in s.items() if n not in seen)} FROM {'b' if i == 0 else f't{i}'} {O.WINDOWS})" for i, (s, seen) in enumerate(zip(stages, [set().union(*map(set, stages[:k])) for k in range(len(stages))]))]
    return f"WITH {O.STAGED}, {', '.join(ctes)} SELECT symbol, date, {O.tidy('value')} AS value FROM t{len(stages)}"


def _alphas(add: Callable) -> None:
    lag = lambda e, k: f"lag({e}, {k}) OVER s"
    corr = lambda a, b, n: O.full(f"CASE WHEN {b} IS NOT NULL THEN {a} END", n, f"coalesce({O.corr(a, b, f'w{n}')}, 0)")
    ranked = lambda a, b: [{"p": a, "q": b}, {"p": O.pct("p"), "q": O.pct("q")}]
    turn = lambda n: [{"dc": f"close - {lag('close', 1)}"}, {"value": f"CASE WHEN {O.full('dc', n, f'min(dc) OVER w{n}')} > 0 THEN dc WHEN {O.full('dc', n, f'max(dc) OVER w{n}')} < 0 THEN dc ELSE -dc END"}]
    cov = lambda a: [*ranked(a, "volume"), {"cov": O.tidy(O.full("CASE WHEN q IS NOT NULL THEN p END", 5, "covar_samp(p, q) OVER w5"))}, {"value": f"-({O.pct('cov')})"}]
    vwap = "amount / nullif(volume, 0)"
    sql = {
        "003": [*ranked("open", "volume"), {"value": f"-({corr('p', 'q', 10)})"}],
        "006": [{"value": f"-({corr('open', 'volume', 10)})"}],
        "009": turn(5),
        "012": [{"value": f"-sign(volume - {lag('volume', 1)}) * (close - {lag('close', 1)})"}],
        "013": cov("close"),
        "016": cov("high"),
        "023": [{"value": f"CASE WHEN {O.full('high', 20, 'avg(high) OVER w20')} < high THEN -(high - {lag('high', 2)}) ELSE 0 END"}],
        "033": [{"p": "open / close - 1"}, {"value": O.pct("p")}],
        "041": [{"value": f"sqrt(high * low) - {vwap}"}],
        "042": [{"p": O.tidy(f"{vwap} - close"), "q": O.tidy(f"{vwap} + close")}, {"p": O.pct("p"), "q": O.pct("q")}, {"value": "p / nullif(q, 0)"}],
        "044": [{"q": O.pct("volume")}, {"value": f"-({corr('high', 'q', 5)})"}],
        "053": [{"p": "((close - low) - (high - close)) / nullif(close - low, 0)"}, {"value": f"-(p - {lag('p', 9)})"}],
        "054": [{"value": "-(low - close) * pow(open, 5) / nullif((low - high) * pow(close, 5), 0)"}],
        "101": [{"value": "(close - open) / (high - low + 0.001::DOUBLE)"}],
    }
    adv = O.full("volume", 20, "avg(volume) OVER w20")
    total = lambda x, n: O.full(x, n, f"sum({x}) OVER w{n}")
    sd = lambda x, n: O.full(x, n, f"stddev_samp({x}) OVER w{n}")
    most = lambda x, n, f="max": O.full(x, n, f"{f}({x}) OVER w{n}")
    place = lambda x, n: O.full(x, n, O.rank(x, n))
    ranks = lambda *names: {n: O.pct(n) for n in names}
    scale = lambda x: f"{x} / nullif(sum(abs({x})) OVER d, 0)"
    bend = f"({lag('close', 20)} - {lag('close', 10)}) / 10 - ({lag('close', 10)} - close) / 10"
    ends = "list(close) OVER w10"
    sql |= {
        "002": [{"p": O.tidy(f"ln(volume) - {lag('ln(volume)', 2)}"), "q": "oc"}, ranks("p", "q"), {"value": f"-({corr('p', 'q', 6)})"}],
        "004": [{"p": O.pct("low")}, {"value": f"-({place('p', 9)})"}],
        "010": [*turn(4), {"value": O.pct("value")}],
        "005": [{"vw": vwap}, {"p": O.tidy(f"open - {total('vw', 10)} / 10"), "q": O.tidy("close - vw")}, ranks("p", "q"), {"value": "-p * abs(q)"}],
        "007": [{"p": f"close - {lag('close', 7)}", "r": adv}, {"q": "abs(p)"}, {"value": f"CASE WHEN r < volume THEN -({place('q', 60)}) * sign(p) ELSE -1 END"}],
        "008": [{"p": f"{total('open', 5)} * {total('ret', 5)}"}, {"q": O.tidy(f"p - {lag('p', 10)}")}, {"value": f"-({O.pct('q')})"}],
        "011": [
            {"vw": f"{vwap} - close", "r": f"volume - {lag('volume', 3)}"},
            {"p": O.tidy(most("vw", 3)), "q": O.tidy(most("vw", 3, "min"))},
            ranks("p", "q", "r"),
            {"value": "(p + q) * r"},
        ],
        "014": [{"p": O.tidy(f"ret - {lag('ret', 3)}"), "q": corr("open", "volume", 10)}, ranks("p"), {"value": "-p * q"}],
        "015": [{"p": O.pct("high"), "q": O.pct("volume")}, {"k": O.tidy(corr("p", "q", 3))}, ranks("k"), {"value": f"-({total('k', 3)})"}],
        "017": [
            {"p": place("close", 10), "q": f"close - {lag('close', 1)}", "r": O.tidy(f"volume / ({adv})")},
            {"q": O.tidy(f"q - {lag('q', 1)}"), "r": place("r", 5)},
            ranks("p", "q", "r"),
            {"value": "-p * q * r"},
        ],
        "018": [{"p": "abs(close - open)"}, {"q": O.tidy(f"{sd('p', 5)} + (close - open) + {corr('close', 'open', 10)}")}, {"value": f"-({O.pct('q')})"}],
        "020": [{"p": "open - ph", "q": "open - pc", "r": "open - pl"}, ranks("p", "q", "r"), {"value": "-p * q * r"}],
        "022": [{"p": corr("high", "volume", 5), "q": O.tidy(sd("close", 20))}, {"p": f"p - {lag('p', 5)}", "q": O.pct("q")}, {"value": "-p * q"}],
        "025": [{"p": O.tidy(f"-ret * {adv} * ({vwap}) * (high - close)")}, {"value": O.pct("p")}],
        "026": [{"p": place("volume", 5), "q": place("high", 5)}, {"k": corr("p", "q", 5)}, {"value": f"-({most('k', 3)})"}],
        "028": [{"r": adv}, {"p": f"{corr('r', 'low', 5)} + (high + low) / 2 - close"}, {"value": scale("p")}],
        "030": [
            {"p": "sign(close - pc)"},
            {"q": f"p + {lag('p', 1)} + {lag('p', 2)}"},
            ranks("q"),
            {"value": f"(1 - q) * {total('volume', 5)} / {total('volume', 20)}"},
        ],
        "034": [{"p": O.tidy(f"{sd('ret', 2)} / nullif({sd('ret', 5)}, 0)"), "q": f"close - {lag('close', 1)}"}, ranks("p", "q"), {"k": O.tidy("2 - p - q")}, {"value": O.pct("k")}],
        "038": [{"p": place("close", 10), "q": "close / open"}, ranks("p", "q"), {"value": "-p * q"}],
        "040": [{"p": O.tidy(sd("high", 10)), "q": corr("high", "volume", 10)}, ranks("p"), {"value": "-p * q"}],
        "043": [{"p": O.tidy(f"volume / ({adv})"), "q": f"-(close - {lag('close', 7)})"}, {"value": f"({place('p', 20)}) * ({place('q', 8)})"}],
        "046": [{"p": bend}, {"value": "CASE WHEN p < 0 THEN 1 WHEN p > 0.25::DOUBLE THEN -1 ELSE pc - close END"}],
        "047": [
            {"p": "1 / close", "q": "high - close", "r": O.tidy(f"{vwap} - {lag(vwap, 5)}")},
            ranks("p", "q", "r"),
            {"value": f"p * volume / ({adv}) * (high * q / ({total('high', 5)} / 5)) - r"},
        ],
        "049": [{"p": bend}, {"value": "CASE WHEN p < -0.1::DOUBLE THEN 1 ELSE pc - close END"}],
        "050": [{"p": "volume", "q": O.tidy(vwap)}, ranks("p", "q"), {"k": O.tidy(corr("p", "q", 5))}, ranks("k"), {"value": f"-({most('k', 5)})"}],
        "051": [{"p": bend}, {"value": "CASE WHEN p < -0.05::DOUBLE THEN 1 ELSE pc - close END"}],
        "055": [
            {"p": O.tidy(f"(close - {most('low', 12, 'min')}) / nullif({most('high', 12)} - {most('low', 12, 'min')}, 0)"), "q": "volume"},
            ranks("p", "q"),
            {"value": f"-({corr('p', 'q', 6)})"},
        ],
        "060": [
            {"p": O.tidy("((close - low) - (high - close)) / nullif(high - low, 0) * volume"), "q": O.full("close", 10, f"list_position({ends}, list_max({ends}))")},
            ranks("p", "q"),
            {"p": scale("p"), "q": scale("q")},
            {"value": "q - 2 * p"},
        ],
        "083": [
            {"p": f"(high - low) / nullif({total('close', 5)} / 5, 0)", "k": O.tidy(f"{vwap} - close")},
            {"q": O.tidy(lag("p", 2)), "r": O.pct("volume")},
            ranks("q", "r"),
            {"value": "q * r / nullif(p / nullif(k, 0), 0)"},
        ],
    }
    for number in alphas.ALPHAS:
        plan = lambda s, d, n=number: alphas.alpha(staged(s, d), n).select("symbol", "date", tidy("value").alias("value"))
        add(f"alpha_{number}", plan, chain(*sql[number]) if number in sql else None)


DATES = "n AS (SELECT DISTINCT date FROM bars), t AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS place, row_number() OVER (ORDER BY date DESC) - 1 AS lft, count(*) OVER () AS n FROM n)"


def _panel(add: Callable) -> None:
    dates = lambda s, d: checks.date_places(bars(s, d))
    add("p02_pivot", lambda s, d: table(s, d, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity")).toDF("l_suppkey", "qty_a", "qty_n", "qty_r"), "SELECT l_suppkey, " + ", ".join(f"sum(l_quantity) FILTER (l_returnflag = '{k}') AS qty_{k.lower()}" for k in "ANR") + " FROM lineitem GROUP BY 1")
    add("p03_melt", lambda s, d: melt(bars(s, d).select("symbol", "date", "open", "high", "low", "close"), ["symbol", "date"]).select("symbol", "date", "name", tidy("value").alias("value")), f"WITH {O.BARS} SELECT symbol, date, name, {O.tidy('value')} AS value FROM (SELECT symbol, date, open, high, low, close FROM bars) UNPIVOT (value FOR name IN (open, high, low, close))")
    add("p05_covered_symbols", lambda s, d: checks.covered(staged(s, d).filter("date < date'1996-01-01'"), "ret", 0.8), f"WITH {O.STAGED}, k AS (SELECT * FROM b WHERE date < '1996-01-01') SELECT symbol, count(ret) AS held FROM k GROUP BY symbol HAVING count(ret) >= 0.8::DOUBLE * (SELECT count(DISTINCT date) FROM k)")
    add("p06_purge_tail", lambda s, d: bars(s, d).join(dates(s, d).filter("left >= 5").select("date"), "date", "left_semi").groupBy("date").agg(F.count("*").alias("n")), f"WITH {O.BARS}, {DATES} SELECT date, count(*) AS n FROM bars JOIN t USING (date) WHERE lft >= 5 GROUP BY date")
    add("p07_split", lambda s, d: checks.split(dates(s, d), 0.6, 0.2, 5), f"WITH {O.BARS}, {DATES}, a AS (SELECT *, floor(n * 0.6::DOUBLE) AS a, floor(n * {0.6 + 0.2!r}::DOUBLE) AS z FROM t) SELECT date, CASE WHEN place < a - 5 THEN 'train' WHEN place >= a AND place < z - 5 THEN 'valid' WHEN place >= z THEN 'oos' END AS part FROM a WHERE part IS NOT NULL")
    add("p08_fold_masks", lambda s, d: checks.fold_masks(dates(s, d), 4, 5), f"WITH {O.BARS}, {DATES}, a AS (SELECT *, floor(place * 5 / n::DOUBLE) AS run FROM t), f AS (SELECT *, unnest([1, 2, 3, 4]) AS fold FROM a) SELECT fold, date, CASE WHEN run = fold THEN 'test' WHEN place < ceil(fold * n / 5.0::DOUBLE) - 5 THEN 'fit' END AS use FROM f WHERE use IS NOT NULL")
    add("p11_market_route", lambda s, d: table(s, d, "customer").select("c_custkey", F.when(F.col("c_name").rlike("[02468]$"), "even").when(F.col("c_name").rlike("[13579]$"), "odd").otherwise("other").alias("market")), "SELECT c_custkey, CASE WHEN regexp_matches(c_name, '[02468]$') THEN 'even' WHEN regexp_matches(c_name, '[13579]$') THEN 'odd' ELSE 'other' END AS market FROM customer")
    add("k06_signal_export", lambda s, d: staged(s, d).filter("ret is not null and not isnan(ret)").select(F.date_format("date", "yyyyMMdd").cast("int").alias("date"), F.col("symbol").cast("int").alias("ticker"), tidy("ret").alias("prediction")), f"WITH {O.STAGED} SELECT strftime(date, '%Y%m%d')::INT AS date, symbol::INT AS ticker, {O.tidy('ret')} AS prediction FROM b WHERE ret IS NOT NULL")
    add("b03_monthly_returns", lambda s, d: staged(s, d).filter("ret > -1").groupBy("symbol", F.trunc("date", "month").alias("month")).agg(tidy(F.exp(F.sum(F.ln(F.col("ret") + 1))) - 1).alias("value")), f"WITH {O.STAGED} SELECT symbol, date_trunc('month', date)::DATE AS month, {O.tidy('exp(sum(ln(1 + ret))) - 1')} AS value FROM b WHERE ret > -1 GROUP BY ALL")
    add("a05_realized_vol", lambda s, d: staged(s, d).groupBy("symbol").agg(tidy(F.when(F.count("*") >= 3, F.nullif(F.stddev_samp(F.ln(F.try_divide("close", "pc"))) * F.sqrt(F.lit(52.0)), F.lit(0.0)))).alias("v")).select("symbol", F.coalesce("v", F.lit(0.3)).alias("vol")), f"WITH {O.STAGED} SELECT symbol, coalesce({O.tidy('CASE WHEN count(*) >= 3 THEN nullif(stddev_samp(ln(close / pc)) * sqrt(52.0::DOUBLE), 0) END')}, 0.3) AS vol FROM b GROUP BY symbol")

    def adv(s, d):
        day = table(s, d, "lineitem").groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("day")).agg(F.sum("l_quantity").alias("v"), F.count("*").alias("k")).filter("v > 0")
        a = day.groupBy("l_suppkey").agg(F.avg("v").alias("avg_day"), F.sum("k").alias("k"), F.count("*").alias("days"), F.sum("v").alias("total"))
        thin = F.col("k") / F.col("days") < 120
        return a.select("l_suppkey", tidy(F.when(thin, F.greatest("avg_day", F.col("total") / F.col("k") * 240)).otherwise(F.col("avg_day"))).alias("adv"))

    add("a06_adv", adv, f"WITH y AS (SELECT l_suppkey, l_shipdate::DATE AS day, sum(l_quantity) AS v, count(*) AS k FROM lineitem GROUP BY ALL HAVING sum(l_quantity) > 0), a AS (SELECT l_suppkey, avg(v) AS avg_day, sum(k) AS k, count(*) AS days, sum(v) AS total FROM y GROUP BY 1) SELECT l_suppkey, {O.tidy('CASE WHEN k / days < 120 THEN greatest(avg_day, total / k * 240) ELSE avg_day END')} AS adv FROM a")
    held = lambda s, d: table(s, d, "supplier").withColumn("w", F.col("s_acctbal") / 1e6)
    add("a08_constraints", lambda s, d: held(s, d).agg(*(tidy(F.sum(e)).alias(n) for n, e in (("gross", F.abs("w")), ("net", F.col("w")), ("longs", F.greatest("w", F.lit(0.0))), ("shorts", F.least("w", F.lit(0.0))))), F.count("*").alias("positions"), (F.max(F.abs("w")) > 0.009).alias("over")), f"WITH h AS (SELECT s_acctbal / 1e6 AS w FROM supplier) SELECT {O.tidy('sum(abs(w))')} AS gross, {O.tidy('sum(w)')} AS net, {O.tidy('sum(greatest(w, 0))')} AS longs, {O.tidy('sum(least(w, 0))')} AS shorts, count(*) AS positions, max(abs(w)) > 0.009::DOUBLE AS over FROM h")
    p = "least(greatest(least(0.999, n_chars / 5000.0::DOUBLE), 0.000001::DOUBLE), 0.999999::DOUBLE)"

    def metrics(s, d):
        f = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select("lang", F.least(F.lit(0.999), F.col("n_chars") / 5000.0).alias("p"), F.col("quality").cast("double").alias("y"))
        f = f.withColumn("p", F.least(F.greatest("p", F.lit(1e-6)), F.lit(0.999999)))
        g = f.rollup("lang").agg(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2.0))).alias("brier"), (-F.avg(F.col("y") * F.ln("p") + (1 - F.col("y")) * F.ln(1 - F.col("p")))).alias("log_loss"), F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double")).alias("accuracy"), F.avg("y").alias("positive"), F.count("*").alias("n"))
        return g.select("lang", "n", *(tidy(n).alias(n) for n in ("brier", "log_loss", "accuracy", "positive")))

    add("a11_forecast_metrics", metrics, f"WITH f AS (SELECT lang, {p} AS p, quality::DOUBLE AS y FROM documents JOIN labels USING (doc_id)) SELECT lang, count(*) AS n, {O.tidy('avg((p - y) * (p - y))')} AS brier, {O.tidy('-avg(y * ln(p) + (1 - y) * ln(1 - p))')} AS log_loss, {O.tidy('avg(((p >= 0.5) = (y = 1))::INT::DOUBLE)')} AS accuracy, {O.tidy('avg(y)')} AS positive FROM f GROUP BY ROLLUP (lang)")
    why = ("value IS NULL", "value < 5", "value > 100")
    reasons = lambda: F.array_compact(F.array(*(F.when(F.expr(w), n) for n, w in zip(("missing", "low", "high"), why))))
    add("a16_reason_histogram", lambda s, d: table(s, d, "events").select(F.explode(reasons()).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")), " UNION ALL ".join(f"SELECT '{n}' AS reason, count(*) AS n FROM events WHERE {w} HAVING count(*) > 0" for n, w in zip(("missing", "low", "high"), why)))
    add("a17_coverage", lambda s, d: staged(s, d).groupBy("date").agg(F.count_distinct("symbol").alias("symbols"), tidy(F.count("ret") / F.count("*")).alias("coverage")), f"WITH {O.STAGED} SELECT date, count(DISTINCT symbol) AS symbols, {O.tidy('count(ret) / count(*)')} AS coverage FROM b GROUP BY date")
    rank = "CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END"
    add("a20_worst_status", lambda s, d: table(s, d, "events").groupBy("user_id").agg(F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), F.max(F.expr(rank))).alias("status")), f"SELECT user_id, ['pass', 'warn', 'fail'][max({rank})] AS status FROM events GROUP BY user_id")

    def events(s, d):
        b = staged(s, d).withColumn("ab", F.col("ret") - F.avg("ret").over(Window.partitionBy("date")))
        near = Window.partitionBy("symbol").orderBy("date").rowsBetween(0, 4)
        b = b.withColumn("car", F.sum("ab").over(near)).withColumn("action", F.when(F.col("dv") > 2, "surge").when(F.col("dv") < -0.66, "drop"))
        return b.filter("action is not null").groupBy("action").agg(tidy(F.avg("car")).alias("car"), F.count("*").alias("n"))

    add("a19_event_study", events, f"WITH {O.STAGED}, e AS (SELECT *, ret - avg(ret) OVER (PARTITION BY date) AS ab FROM b), c AS (SELECT *, sum(ab) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS car, CASE WHEN dv > 2 THEN 'surge' WHEN dv < -0.66::DOUBLE THEN 'drop' END AS action FROM e) SELECT action, {O.tidy('avg(car)')} AS car, count(*) AS n FROM c WHERE action IS NOT NULL GROUP BY action")


def _joins(add: Callable) -> None:
    def relations(s, d):
        a, b = table(s, d, "documents").select("doc_id"), table(s, d, "labels").select(F.col("doc_id").alias("target"))
        j = a.join(b, F.col("doc_id") == F.col("target"), "left")
        return j.groupBy(F.when(F.col("target").isNull(), "missing").otherwise("resolved").alias("status")).agg(F.count("*").alias("n"))

    add("j13_relation_status", relations, "SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'resolved' END AS status, count(*) AS n FROM documents x LEFT JOIN labels l USING (doc_id) GROUP BY 1")

    def reconcile(s, d):
        one = lambda f: table(s, d, "lineitem").filter(f).groupBy("l_suppkey").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), F.sum("l_quantity").alias("v"))
        a, b = one("l_linenumber % 2 = 0"), one("l_linenumber % 2 = 1").withColumnsRenamed({"p": "p2", "v": "v2"})
        j = a.join(b, "l_suppkey")
        return j.agg(F.count("*").alias("n"), tidy(F.avg((F.abs(F.col("p") / F.col("p2") - 1) <= 0.05).cast("double"))).alias("price_ok"), (F.avg(F.try_divide("v", "v2").between(0.1, 10).cast("double")) >= 0.95).alias("volume_ok"))

    side = "(SELECT l_suppkey, avg(l_extendedprice / l_quantity) AS p, sum(l_quantity) AS v FROM lineitem WHERE l_linenumber % 2 = {} GROUP BY 1)"
    add("j18_reconcile", reconcile, f"SELECT count(*) AS n, {O.tidy('avg((abs(a.p / b.p - 1) <= 0.05::DOUBLE)::INT)')} AS price_ok, avg((a.v / b.v BETWEEN 0.1 AND 10)::INT) >= 0.95 AS volume_ok FROM {side.format(0)} a JOIN {side.format(1)} b USING (l_suppkey)")

    def chapters(s, d):
        e = table(s, d, "events").select("event_id", "user_id", "ts", "event_type")
        heads = e.filter("event_type = 'signup'").groupBy("user_id", "ts").agg(F.min("event_id").alias("chapter"))
        return joins.asof(e, heads, "ts", "user_id", ["chapter"]).filter("chapter is not null").groupBy("chapter").agg(F.count("*").alias("segments"))

    add("j19_chapters", chapters, "WITH h AS (SELECT user_id, ts, min(event_id) AS chapter FROM events WHERE event_type = 'signup' GROUP BY ALL), n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS stop FROM h) SELECT chapter, count(*) AS segments FROM events e JOIN n ON e.user_id = n.user_id AND e.ts >= n.ts AND (n.stop IS NULL OR e.ts < n.stop) GROUP BY chapter")

    def grid(s, d):
        """Parameter grid cut to a budget at even steps of its index; the grid is made from its index alone."""
        total, budget = 5 * 4 * 3, 25
        i = F.floor(F.col("id") * F.lit(total) / F.lit(budget)).cast("long")
        return s.range(budget).select(i.alias("place"), F.floor(i / 12).cast("int").alias("a"), F.floor(i / 3).cast("int").alias("q"), (i % 3).cast("int").alias("c")).select("place", "a", (F.col("q") % 4).alias("b"), "c")

    add("j21_budgeted_grid", grid, "WITH g AS (SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS place, a, b, c FROM range(5) x(a), range(4) y(b), range(3) z(c)) SELECT place, a::INT AS a, b::INT AS b, c::INT AS c FROM g WHERE place IN (SELECT floor(i * 60 / 25.0::DOUBLE)::BIGINT FROM range(25) r(i))")


def _checks(add: Callable, valued: Callable, sql_valued: str) -> None:
    t = sql_valued
    add("v08_rank_autocorrelation", lambda s, d: checks.rank_autocorrelation(valued(s, d)).select("date", tidy("autocorrelation").alias("autocorrelation"), "n"), t + f", h AS (SELECT *, {O.pct('value')} AS r FROM t), l AS (SELECT *, lag(r) OVER (PARTITION BY symbol ORDER BY date) AS p FROM h) SELECT date, {O.tidy('covar_pop(r, p) / nullif(stddev_pop(r) * stddev_pop(p), 0)')} AS autocorrelation, count(*) AS n FROM l WHERE r IS NOT NULL AND p IS NOT NULL GROUP BY date HAVING count(*) >= 8")
    add("v08_transitions", lambda s, d: checks.transitions(valued(s, d)).select("before", "bucket", "n", tidy("share").alias("share")), t + f", k AS (SELECT * FROM t WHERE value IS NOT NULL), q AS (SELECT *, ceil(({O.pct('value')}) * 5)::INT AS bucket FROM k), l AS (SELECT *, lag(bucket) OVER (PARTITION BY symbol ORDER BY date) AS before FROM q), g AS (SELECT before, bucket, count(*) AS n FROM l WHERE before IS NOT NULL GROUP BY ALL) SELECT before, bucket, n, {O.tidy('n / sum(n) OVER (PARTITION BY before)')} AS share FROM g")

    def walk(s, d):
        ic = analytics.daily_ic(valued(s, d)).select("date", "ic")
        m = checks.fold_masks(checks.date_places(bars(s, d)), 4, 5).join(ic, "date")
        g = m.groupBy("fold").agg(F.avg(F.when(F.col("use") == "fit", F.col("ic"))).alias("fit_ic"), F.avg(F.when(F.col("use") == "test", F.col("ic"))).alias("test_ic"))
        return g.select("fold", *(tidy(e).alias(n) for n, e in (("fit_ic", "fit_ic"), ("test_ic", "test_ic"), ("degradation", F.col("fit_ic") - F.col("test_ic")))))

    add("v07_walk_forward", walk, t + f", k AS (SELECT * FROM t WHERE value IS NOT NULL AND fwd IS NOT NULL), i AS (SELECT date, covar_pop(value, fwd) / nullif(stddev_pop(value) * stddev_pop(fwd), 0) AS ic FROM k GROUP BY date HAVING count(*) >= 8), {DATES.replace('t AS', 'dd AS')}, a AS (SELECT *, floor(place * 5 / n::DOUBLE) AS run FROM dd), f AS (SELECT *, unnest([1, 2, 3, 4]) AS fold FROM a), m AS (SELECT fold, date, CASE WHEN run = fold THEN 'test' WHEN place < ceil(fold * n / 5.0::DOUBLE) - 5 THEN 'fit' END AS use FROM f), g AS (SELECT fold, avg(ic) FILTER (use = 'fit') AS fit_ic, avg(ic) FILTER (use = 'test') AS test_ic FROM m JOIN i USING (date) WHERE use IS NOT NULL GROUP BY fold) SELECT fold, {O.tidy('fit_ic')} AS fit_ic, {O.tidy('test_ic')} AS test_ic, {O.tidy('fit_ic - test_ic')} AS degradation FROM g")
    add("v12_diagnostics", lambda s, d: checks.diagnostics(bars(s, d)).select("symbol", "n", *(tidy(n).alias(n) for n in ("half_life", "df_t", "hurst"))), f"WITH {O.BARS}, x AS (SELECT symbol, ln(close) AS x, " + ", ".join(f"ln(close) - lag(ln(close), {k}) OVER s AS d{k}" for k in (1, 2, 4, 8, 16)) + " FROM bars WHERE close > 0 WINDOW s AS (PARTITION BY symbol ORDER BY date)), a AS (SELECT symbol, count(*) AS n, count(d1) AS m, regr_slope(d1, x - d1) AS b, regr_sxx(d1, x - d1) AS sxx, regr_syy(d1, x - d1) AS syy, (" + " + ".join(f"ln(nullif(stddev_pop(d{k}), 0)) * {v}" for k, v in ((1, -2), (2, -1), (8, 1), (16, 2))) + f") / (10 * ln(2)) AS hurst FROM x GROUP BY symbol HAVING count(*) >= 30) SELECT symbol, n, {O.tidy('CASE WHEN b < 0 AND b > -1 THEN -ln(2) / ln(1 + b) END')} AS half_life, {O.tidy('b / sqrt((syy - b * b * sxx) / (m - 2) / sxx)')} AS df_t, {O.tidy('hurst')} AS hurst FROM a")

    def haircuts(s, d):
        stats = analytics.sharpe_stats(staged(s, d).filter("ret is not null"), "symbol").filter("sr is not null and n > 2")
        w = Window.orderBy(F.abs(F.col("sr") * F.sqrt("n")).desc(), "symbol")
        ranked = stats.withColumn("rank", F.row_number().over(w)).withColumn("tests", F.count("*").over(Window.partitionBy()))  # a row a trial
        def each(parts):
            for p in parts:
                for how in ("bonferroni", "holm", "bhy"):
                    out = [checks.haircut(a, b, c, how, e) for a, b, c, e in zip(p.sr, p.n, p.tests, p["rank"])]
                    yield p[["symbol"]].assign(how=how, sharpe=[o[0] for o in out], p=[o[1] for o in out])
        return ranked.mapInPandas(each, "symbol long, how string, sharpe double, p double")

    add("v04_haircut_sharpe", haircuts)

    def line(s: SparkSession, d: str) -> DataFrame:
        f = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select(F.least(F.lit(0.999), F.col("n_chars") / 5000.0).alias("p"), F.col("quality").alias("y"))
        return s.createDataFrame([checks.calibration_line(f, "p", "y")], "slope double, intercept double")

    add("v10_calibration_line", line)

    def shares(s: SparkSession, d: str) -> DataFrame:
        x = valued(s, d).persist()
        betas = analytics.ridge(x, ["value", "oc", "gap"], "fwd", 1.0)
        out = s.createDataFrame(list(checks.sage_linear(x, betas, "fwd").items()), "name string, share double")
        x.unpersist()
        return out

    add("e17_sage", shares)
    add("g08_ambiguous_vintages", lambda s, d: table(s, d, "orders").groupBy("o_custkey", F.trunc("o_orderdate", "quarter").alias("quarter")).agg(F.count_distinct("o_totalprice").alias("versions")).filter("versions > 1"), "SELECT o_custkey, date_trunc('quarter', o_orderdate)::DATE AS quarter, count(DISTINCT o_totalprice) AS versions FROM orders GROUP BY ALL HAVING count(DISTINCT o_totalprice) > 1")
    q = "quarter(o_orderdate)"
    add("g07_annualised", lambda s, d: table(s, d, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("year")).agg(tidy(F.sum("o_totalprice") * 4 / F.max(F.quarter("o_orderdate"))).alias("value")), f"SELECT o_custkey, year(o_orderdate) AS year, {O.tidy(f'sum(o_totalprice) * 4 / max({q})')} AS value FROM orders GROUP BY ALL")
    bad = {"null_key": "user_id IS NULL OR ts IS NULL", "null_value": "value IS NULL", "negative": "value < 0"}
    add("g10_integrity", lambda s, d: table(s, d, "events").agg(F.count("*").alias("n_rows"), *(F.count_if(F.expr(e)).alias(n) for n, e in bad.items()), (F.count("*") - F.count_distinct("user_id", "ts")).alias("repeated")), f"SELECT count(*) AS n_rows, {', '.join(f'count(*) FILTER ({e}) AS {n}' for n, e in bad.items())}, count(*) - count(DISTINCT (user_id, ts)) AS repeated FROM events")
    peek = r"shift\(-[0-9]+\)|center *= *True|tomorrow|future"
    add("g12_look_ahead_text", lambda s, d: table(s, d, "documents").select("doc_id", F.regexp_count("text", F.lit(peek)).cast("long").alias("hits")).filter("hits > 0"), f"SELECT doc_id, len(regexp_extract_all(text, '{peek}')) AS hits FROM documents WHERE regexp_matches(text, '{peek}')")
    kind = lambda u, t: checks.media_kind(u, t, F.lit("image"))
    types = "CASE page_id % 4 WHEN 0 THEN 'video/mp4; x=1' WHEN 1 THEN 'text/html' WHEN 2 THEN 'application/octet-stream' END"
    add("n07_media_kind", lambda s, d: table(s, d, "pages").select("page_id", kind(F.col("url"), F.expr(types)).alias("kind"), checks.extension(F.col("url")).alias("ext")))
    add("n11_folder_counts", lambda s, d: table(s, d, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://[^/]+/([^/?#]*)", 1).alias("folder")).agg(F.count("*").alias("n")), "SELECT coalesce(regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1), '') AS folder, count(*) AS n FROM pages GROUP BY 1")
    add("n12_contract", lambda s, d: table(s, d, "events").select("event_id", F.explode(checks.contract_findings(F.col("props"))).alias("finding")).groupBy("finding").agg(F.count("*").alias("n")))
    csv = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))
    line_of = lambda: F.concat_ws(",", csv("role"), csv("text"))
    add("n10_csv_round_trip", lambda s, d: table(s, d, "conversations").filter("text is not null").select("conv_id", "turn", F.from_csv(line_of(), F.lit("role string, text string"), {"escape": '"', "multiLine": "true"}).alias("r")).select("conv_id", "turn", F.char_length("r.text").cast("long").alias("chars")), "SELECT conv_id, turn, length(text) AS chars FROM conversations WHERE text IS NOT NULL")


def register(add: Callable, valued: Callable, sql_valued: str) -> None:
    _alphas(add)
    _panel(add)
    _joins(add)
    _checks(add, valued, sql_valued)
