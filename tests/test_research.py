"""Research operators: known answers, fixpoints, stores and twins over the smallest tables."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_panel import test_twins as twin

from tessera.operators import analytics, checks, factors, joins, research
from tessera.plans import catalog
from tessera.sources import panel

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["s07_library", "s10_synthetic_bars", "x11_blend_weights", "x09_residual", "e11_primary_score", "e13_library_filter", "e21_evaluation", "b04_deciles", "b06_linked_effects", "b08_shortfall", "j08_pit_vintage", "v09_false_discovery"])
def test_research_twins(spark, name):
    twin.__wrapped__(spark, name) if hasattr(twin, "__wrapped__") else twin(spark, name)


def test_replies_of_any_depth_and_orphans(spark):
    edges = [(i, i - 1 if i else None) for i in range(300)] + [(1000, 999), (1001, 1000)]
    got = {r.node: (r.root, r.depth) for r in joins.reply_depth(spark.createDataFrame(edges, "node long, parent long"), "node", "parent").collect()}
    assert got == {i: (0, i) for i in range(300)} | {1000: (1000, 0), 1001: (1000, 1)}
    with pytest.raises(ValueError, match="cycle"):
        joins.reply_depth(spark.createDataFrame([(1, 2), (2, 1)], "node long, parent long"), "node", "parent")
    assert joins.reply_depth(spark.createDataFrame([], "node long, parent long"), "node", "parent").collect() == []


def test_residuals_are_those_of_the_joint_fit(spark):
    rnd = np.random.default_rng(3)
    n = 80
    sector, a, b = rnd.integers(0, 4, n), rnd.normal(size=n), rnd.normal(size=n)
    y = 0.3 * a - 2 * b + sector + rnd.normal(size=n)
    df = spark.createDataFrame([(dt.date(2024, 1, 2), i, f"s{s}", float(p), float(q), float(v)) for i, (s, p, q, v) in enumerate(zip(sector, a, b, y))], "date date, symbol long, sector string, a double, b double, y double")
    got = {r.symbol: r.residual for r in research.residualize(df, "y", ["a", "b"], "sector").collect()}
    x = np.column_stack([sector == k for k in range(4)] + [a, b]).astype(float)
    want = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.allclose([got[i] for i in range(n)], want)
    assert all(r.residual is None for r in research.residualize(df.limit(20), "y", ["a", "b"], "sector").collect())


def test_recursive_mean_is_linear_in_rows(spark):
    start = dt.date(1900, 1, 1)
    rows = spark.range(32_000).select(F.lit("s").alias("symbol"), F.date_add(F.lit(start), F.col("id").cast("int")).alias("date"), F.when(F.col("id") > 1, F.sin("id")).alias("x"))
    factors.fold(rows.limit(100), "x", 0.2, "y").count()
    began = time.time()
    out = [r.y for r in factors.fold(rows, "x", 0.2, "y").orderBy("date").collect()]
    assert time.time() - began < 10 and out[:2] == [None, None]
    y = None
    for i in range(2, 32_000):
        v = float(np.sin(i))
        y = v if y is None else 0.8 * y + 0.2 * v
        assert out[i] == pytest.approx(y, abs=1e-9)


def test_numbered_follows_the_order(spark):
    df = spark.createDataFrame([(i * 7919 % 5000,) for i in range(5000)], "id long").repartition(7)
    assert all(r.nth == r.id for r in analytics.numbered(df, "id").collect())


def test_store_run_and_matrices(spark, tmp_path):
    bars = panel.synthetic_bars(spark, 3, 10, 1)
    store = panel.FactorStore(spark, str(tmp_path / "store"))
    store.save(bars.withColumn("value", F.col("close")), "a")
    store.save(bars.withColumn("value", F.col("open")), "b")
    wide = store.load_wide("a", "b")
    assert wide.count() == 30 and wide.join(bars, ["symbol", "date"]).filter("a <> close or b <> open").count() == 0
    assert "PartitionFilters: [isnotnull(factor" in store.spark.read.parquet(store.path).filter("factor = 'a'")._jdf.queryExecution().toString()
    store.clear()
    done = panel.save_run({"bars": bars}, str(tmp_path / "run"))
    assert [tuple(r)[:2] for r in done.collect()] == [("bars", 30)] and spark.read.json(str(tmp_path / "run/manifest")).count() == 1
    for n in panel.MATRICES:
        bars.withColumn("amount", F.lit(1.0)).groupBy("date").pivot("symbol").agg(F.first(n)).write.parquet(str(tmp_path / f"db/{n}.parquet"))
    assert panel.matrix_database(spark, str(tmp_path / "db")).count() == 30


def test_sources_and_sinks(spark, tmp_path):
    bars = panel.synthetic_bars(spark, 2, 20, 5).withColumn("symbol", F.concat(F.lit("ab"), F.col("symbol").cast("string")))
    bars.withColumn("volume", F.col("volume").cast("string")).write.option("header", True).csv(str(tmp_path / "csv"))
    bars.write.parquet(str(tmp_path / "p.parquet"))
    for path in ("csv", "p.parquet"):
        got = panel.scan(spark, str(tmp_path / path), "2021-01-05", "2021-01-08", ["ab1", "AB0"])
        assert got.count() == 8 and {r.symbol for r in got.collect()} == {"AB0", "AB1"}


def test_refusals(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, i), "x") for i in (1, 2, 3, 8, 9)], "date date, symbol string")
    with pytest.raises(ValueError, match="required"):
        research.fixed_windows(checks.date_places(df), ("2024-01-01", "2024-01-02"), ("2024-01-08", "2024-01-09"), 3)
    with pytest.raises(ValueError, match="numeric"):
        research.numeric_features(df, ["symbol"])
    with pytest.raises(ValueError, match="qty"):
        research.fills(df.toDF("Date", "Code").withColumns({"side": F.lit("b"), "price": F.lit("1")}))


def test_overfit_measures():
    psr, dsr, length, cut, passed = checks.overfit(0.4, 500, 0.0, 3.0, 0.01, 10)
    assert 0.99 < psr <= 1 and dsr > 0.95 and length < 500 and passed and cut > 0.1
    assert not checks.overfit(0.02, 100, 0.0, 3.0, 0.01, 1000)[-1]


def test_shortfall_means_are_exact_at_halves(spark, tmp_path):
    rows = [(k, 2, 1, 1.0, 100.0, "O" if k < 306 else "F", dt.datetime(1998, 1, 5)) for k in range(600)]  # fees: 2.6 + 5 * 294 / 600 = 5.05
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_linestatus string, l_shipdate timestamp").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = catalog.queries()["b08_shortfall"](spark, str(tmp_path)).first()
    assert (got.symbol, got.n, got.fees, got.timing) == ("2.SH", 600, 5.1, 0.0)
    x = [("a", "buy", 100.01005, 1.0, 100.0, 100.0, 1.0, 0.0, 0.0001015), ("a", "sell", 100.0, 1.0, 100.0, 100.0, 1.0, 0.0, None)]
    out = research.shortfall(spark.createDataFrame(x, "symbol string, side string, price double, qty double, arrival double, bench double, adv double, sigma_day double, half_spread double"))
    assert [r.spread for r in out.collect()] == [1.01, 0.0]  # 1.015 is less than its decimals say
    means = spark.createDataFrame([(-0.1, None), (-0.2, None)], "a double, b double").agg(research.mean_of_hundredths("a").alias("a"), research.mean_of_hundredths("b").alias("b")).first()
    assert means.a == -0.2 and means.b is None


def test_overfitting_agrees_with_brute_force_and_hands_on_no_trials(spark):
    rnd = np.random.default_rng(7)
    x = rnd.normal(size=(7, 4, 3))
    x[3] = x[1]  # equal trials: ties go to the smaller
    x[4] = 0.5  # no deviation, no Sharpe ratio
    rows = [(t, b, float(v)) for t in range(7) for b in range(4) for v in x[t, b] if t < 6] + [(6, 0, 1.0)]  # trial 6: one return
    out = analytics.pbo(spark.createDataFrame(rows, "trial long, block int, ret double"), 4)
    got = {r.split: r for r in out.collect()}
    assert "trial" not in "".join(part.split(")")[0] for part in out._jdf.queryExecution().toString().split("hashpartitioning(")[1:])
    for i, split in enumerate(analytics.pbo_splits(4)):
        sharpe = lambda t, bs: v.mean() / v.std(ddof=1) if t < 6 and t != 4 and len(v := x[t, bs].ravel()) else None
        inner, outer = ([sharpe(t, list(bs)) for t in range(7)] for bs in (split, set(range(4)) - set(split)))
        best = max((k for k in range(7) if inner[k] is not None), key=lambda k: (round(inner[k], 9), -k))
        rank = 1 + sum(v is None or v < outer[best] - 1e-9 for v in outer)
        assert (got[i].trial, got[i].omega) == (best, rank / 8)
