"""Published alphas, splits, haircuts, calibration, feature shares, contracts and media kinds."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_panel import SF, TABLES, plain

from tessera.operators import alphas, checks
from tessera.plans import catalog


@pytest.mark.parametrize("name", ["alpha_009", "alpha_042", "alpha_017", "alpha_046", "alpha_083", "p07_split", "p08_fold_masks", "a11_forecast_metrics", "j19_chapters", "j21_budgeted_grid", "v07_walk_forward", "v08_transitions", "v12_diagnostics", "n10_csv_round_trip"])
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


def test_select_names():
    assert alphas.select(["a", "b", "c"], ["c", "a"], ["c"]) == ["a"]
    assert alphas.select(["a", "b"]) == ["a", "b"]
    with pytest.raises(ValueError):
        alphas.select(["a"], ["z"])


def test_embargo_leaves_a_gap(spark):
    days = spark.range(20).select(F.expr("date_add(date'2024-01-01', cast(id as int))").alias("date"))
    parts = {r["date"].day: r["part"] for r in checks.split(checks.date_places(days), 0.5, 0.25, 2).collect()}
    assert [d for d in range(1, 21) if d not in parts] == [9, 10, 14, 15]
    assert parts[8] == "train" and parts[13] == "valid" and parts[16] == parts[20] == "oos"


def test_split_of_an_empty_table(spark):
    none = spark.createDataFrame([], "date date")
    assert checks.split(checks.date_places(none), 0.5, 0.25, 2).count() == 0


def test_haircut():
    sr, p = checks.haircut(0.2, 250, 1)
    assert sr == pytest.approx(0.2) and p == pytest.approx(math.erfc(0.2 * math.sqrt(250) / math.sqrt(2)))
    assert checks.haircut(0.05, 100, 100) == (0.0, 1.0)
    assert checks.haircut(-0.3, 250, 10)[0] < 0
    assert checks.haircut(0.2, 250, 10, "holm", 10)[0] == pytest.approx(0.2)


def test_calibration_line_is_recovered(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=20000)
    y = rng.random(20000) < 1 / (1 + np.exp(-(0.3 + 0.5 * x)))
    f = spark.createDataFrame([(float(1 / (1 + math.exp(-a))), int(b)) for a, b in zip(x, y)] + [(None, 1)], "p double, y int")
    slope, intercept = checks.calibration_line(f, "p", "y")
    assert slope == pytest.approx(0.5, abs=0.06) and intercept == pytest.approx(0.3, abs=0.05)


def test_feature_shares_add_up():
    rng = np.random.default_rng(1)
    x, bg = rng.normal(size=(200, 3)), rng.normal(size=(50, 3))
    y = 2 * x[:, 0] + x[:, 1]
    model = lambda z: 2 * z[:, 0] + z[:, 1]
    share, error = checks.sage_values(model, x, y, bg, 20, 7)
    base = float(np.mean((model(bg).mean() - y) ** 2))
    assert share.sum() == pytest.approx(base)
    assert share[2] == pytest.approx(0, abs=1e-9) and share[0] > 2 * share[1] and (error >= 0).all()


def test_contract_findings(spark):
    good = {k: 1 for k in checks.CONTRACT_KEYS} | {k: {n: 1 for n in v} for k, v in checks.CONTRACT_NESTED.items()}
    bad = good | {"goal": 3, "delivery": {"mode": "direct-main", "branch": 1}}
    del bad["mode"]
    rows = [(0, json.dumps(good)), (1, json.dumps(bad)), (2, "no json"), (3, None), (4, "[1]")]
    got = {r["i"]: r["f"] for r in spark.createDataFrame(rows, "i int, t string").select("i", checks.contract_findings(F.col("t")).alias("f")).collect()}
    assert got[0] == [] and got[2] == got[3] == got[4] == ["invalid contract"]
    assert set(got[1]) == {"goal must be an object", "missing delivery.pr", "direct-main delivery is forbidden", "missing top-level key: mode"}


def test_media_kind(spark):
    rows = [
        ("https://h/a.PNG?x=1", None, None, "image", "png"),
        ("https://h/a.png", "video/mp4; q", None, "video", "png"),
        ("https://h/a", "text/html", "image", None, None),
        ("https://h/a", "application/octet-stream", "video", "video", None),
        ("https://h/a?format=jpeg", "", None, "image", "jpg"),
        ("data:video/mp4;base64,x", None, None, "video", None),
        ("https://h.mov", None, None, None, None),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, u string, t string, h string")
    got = df.select("i", checks.media_kind(F.col("u"), F.col("t"), F.col("h")).alias("k"), checks.extension(F.col("u")).alias("e")).orderBy("i").collect()
    assert [(r["k"], r["e"]) for r in got] == [r[3:] for r in rows]


def test_half_life_interval(spark):
    from tessera.operators import analytics

    rng = np.random.default_rng(2)
    rows = [(h, f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}", float(0.2 * 0.5 ** (h / 5) + rng.normal() * 0.01)) for d in range(200) for h in (1, 3, 5, 10)]
    ic = spark.createDataFrame(rows, "horizon int, date string, ic double")
    half, low, high = analytics.half_life_interval(ic, draws=100)
    assert low <= half <= high and half == pytest.approx(5, abs=0.5)
    assert analytics.half_life_interval(ic.limit(0)) is None


def test_linear_shares(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=500), rng.normal(size=500)
    df = spark.createDataFrame([(float(p), float(q), float(2 * p + q)) for p, q in zip(a, b)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    got = checks.sage_linear(df, {"a": 2.0, "b": 1.0}, "y")
    y = 2 * a + b
    assert sum(got.values()) == pytest.approx(float(np.mean((y - y.mean()) ** 2))) and got["a"] > 2 * got["b"] > 0
    assert checks.sage_linear(df.limit(0), {"a": 2.0}, "y") == {"a": 0.0}
