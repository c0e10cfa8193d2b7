"""Panel operators: twins over the smallest tables, hand-made joins, causality, identities and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import analytics, factors, joins, quality
from tessera.plans import catalog
from tessera.sources import panel
from tessera.streaming import events

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, dt.datetime) and not (v.hour or v.minute or v.second or v.microsecond):
        return v.date()
    return v


@pytest.mark.parametrize("name", ["w07_ts_rank", "w12_ema", "f23_price_volume_corr", "t10_signals", "x01_mad_z", "e03_daily_ic", "j03_asof_backward", "j07_asof_forward_strict", "j06_nearest", "b05_brinson", "g05_ttm", "n08_stable_id"])
def test_twins(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr)
    want = sorted((tuple(map(plain, r)) for r in con.sql(f"SELECT {', '.join(names)} FROM ({catalog.oracle_sql()[name]})").fetchall()), key=repr)
    assert got == want


def test_asof_by_hand(spark):
    left = spark.createDataFrame([(1, 5), (1, 10), (2, 1)], "k int, t int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 9, "b"), (2, 3, "c")], "k int, t int, v string")
    find = lambda **how: [r.v for r in joins.asof(left, right, "t", "k", ["v"], **how).orderBy("k", "t").collect()]
    assert find() == ["a", "b", None]
    assert find(strict=True) == [None, "b", None]
    assert find(forward=True) == ["a", None, "c"]
    assert find(forward=True, strict=True) == ["b", None, "c"]


def test_quarters_by_hand(spark):
    y = spark.createDataFrame([("s", 2023 * 4 + q, v) for q, v in enumerate((10.0, 30.0, 60.0, 100.0))] + [("s", 2024 * 4, 30.0)], "symbol string, q long, v double")
    got = quality.single_quarter(y, "v").orderBy("q").collect()
    assert [r.single for r in got] == [10.0, 20.0, 30.0, 40.0, 30.0]
    assert [r.ttm for r in got] == [None, None, None, 100.0, 120.0]


def test_factors_do_not_look_ahead(spark):
    b = panel.staged(spark, SF)
    build = lambda d: factors.factor(d, ("rsi", "z", 5)).select("symbol", "date", F.round("value", 6).alias("value"))
    assert analytics.prefix_invariant(build, b, F.lit("1997-01-01").cast("date")) == 0


def test_brinson_effects_sum_to_active_return(spark):
    x = spark.createDataFrame([("a", 0.6, 0.5, 0.10, 0.08), ("b", 0.4, 0.5, -0.02, 0.01)], "sector string, w_p double, w_b double, r_p double, r_b double")
    r = analytics.brinson(x).agg(F.sum(F.col("allocation") + F.col("selection") + F.col("interaction"))).first()[0]
    assert r == pytest.approx(0.6 * 0.10 - 0.4 * 0.02 - (0.5 * 0.08 + 0.5 * 0.01))


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="volume"):
        panel.require_columns(spark.createDataFrame([(1,)], "close int"), "close", "volume")


def test_minute_bars_stream(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/e")
    q = events.minute_bars(events.source(spark, f"{tmp_path}/e")).writeStream.format("memory").queryName("minute_bars").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("minute_bars").count() > 0
