"""Risk model, optimisers, flows, costs, dependence measures, audits and transcripts."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_panel import SF, TABLES, plain

from tessera.operators import flows, quality, risk, text
from tessera.plans import catalog


@pytest.mark.parametrize("name", ["q05_factor_covariance", "q08_risk_decomposition", "q16_flow_strength", "q20_decayed_strength", "b09_cost_curve", "g03_universe", "g04_panel_findings", "n05_web_vtt"])
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


def test_factor_returns_are_recovered(spark):
    rng = np.random.default_rng(3)
    rows = []
    for day in (1, 2):
        for k in range(30):
            x = float(rng.normal())
            rows.append((day, k, x, "a" if k % 2 else "b", 1.0 + k, 0.5 * x * day + (0.1 if k % 2 else -0.2)))
    rows.append((3, 0, 1.0, "a", 1.0, 1.0))  # too few names
    p = spark.createDataFrame(rows, "d int, symbol int, style double, sector string, cap double, fwd double").withColumn("date", F.expr("date_add(date'2024-01-01', d)"))
    got = {(r["date"].day, r["name"]): r["value"] for r in risk.factor_returns(p, ["style"], "sector").filter("kind = 'factor'").collect()}
    assert set(got) == {(d, n) for d in (2, 3) for n in ("style", "a", "b")}
    for d in (1, 2):
        assert got[d + 1, "style"] == pytest.approx(0.5 * d, abs=1e-6)
        assert got[d + 1, "a"] == pytest.approx(0.1, abs=1e-6)


def test_covariances(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]])
    rows = [(t, f"n{k}", float(x[t, k])) for t in range(40) for k in range(3)] + [(99, "n0", 5.0)]  # an incomplete date
    r = spark.createDataFrame(rows, "date int, name string, value double")
    assert np.allclose(risk.to_matrix(risk.covariance(r))[1], np.cov(x.T))
    w = 0.5 ** (np.arange(39, -1, -1) / 10)
    w /= w.sum()
    e = x - w @ x
    assert np.allclose(risk.to_matrix(risk.factor_covariance(r, 10, 1))[1], (e.T * w) @ e)
    shrunk, share = risk.ledoit_wolf(r)
    s = np.cov(x.T, ddof=0)
    assert 0 < share < 1
    assert np.allclose(risk.to_matrix(shrunk)[1], (1 - share) * s + share * np.trace(s) / 3 * np.eye(3))


def test_optimizers():
    m = np.diag([0.04, 0.01, 0.0025])
    assert np.allclose(risk.optimize(m, "min_variance"), (1 / np.diag(m)) / (1 / np.diag(m)).sum(), atol=1e-5)
    sd = np.sqrt(np.diag(m))
    assert np.allclose(risk.optimize(m, "risk_parity"), (1 / sd) / (1 / sd).sum(), atol=1e-3)
    assert np.allclose(risk.optimize(m, "max_diversification"), (1 / sd) / (1 / sd).sum(), atol=1e-3)
    mean = np.array([0.1, 0.05, 0.02])
    best = np.linalg.solve(m, mean)
    assert np.allclose(risk.optimize(m, "max_sharpe", mean), best / best.sum(), atol=1e-3)
    assert risk.optimize(m, "min_variance", cap=0.5).max() <= 0.5 + 1e-9
    before = np.array([0.5, 0.3, 0.2])
    w = risk.optimize(m, "min_variance", sets=(risk.turnover_ball(before, 0.2), risk.half_space(np.array([1.0, 1.0, 0.0]), 0.75)))
    assert w.sum() == pytest.approx(1, abs=1e-6) and np.abs(w - before).sum() <= 0.2 + 1e-6 and w[:2].sum() <= 0.75 + 1e-6
    volatility = [v for _, _, v in risk.frontier(m, mean, 6)]
    assert all(a >= b - 1e-9 for a, b in zip(volatility, volatility[1:], strict=False))
    with pytest.raises(ValueError, match="bounds"):
        risk.box_sum(0.0, 0.2)(np.zeros(3))


def test_risk_parts_sum_to_total(spark):
    x = spark.createDataFrame([("a", "f", 1.0), ("b", "f", 0.5), ("b", "g", 2.0)], "symbol string, name string, x double")
    f = spark.createDataFrame([("f", "f", 0.04), ("f", "g", 0.01), ("g", "f", 0.01), ("g", "g", 0.09)], "i string, j string, value double")
    d = spark.createDataFrame([("a", 0.02), ("b", 0.03)], "symbol string, variance double")
    w = spark.createDataFrame([("a", 0.6), ("b", 0.4)], "symbol string, w double")
    full = {(r.symbol, r.other): r.value for r in risk.asset_covariance(x, f, d).collect()}
    total = sum(p * q * full[a, b] for a, p in (("a", 0.6), ("b", 0.4)) for b, q in (("a", 0.6), ("b", 0.4)))
    rows = risk.decompose_risk(w, x, f, d).collect()
    assert sum(r.variance for r in rows) == pytest.approx(total)
    assert sum(r.volatility for r in rows) == pytest.approx(total**0.5)


def test_asset_covariance_shuffles_no_pairs_of_symbols(spark):
    rng = np.random.default_rng(4)
    x = {(s, n): float(rng.normal()) for s in range(7) for n in "fgh" if (s + ord(n)) % 3}
    f = {(i, j): float(rng.normal()) for i in "fg" for j in "fg"}  # h has no factor
    d = {0: 0.5, 3: None, 8: 0.25}  # 8 has no exposures
    frames = [spark.createDataFrame([(*k, v) for k, v in m.items()], t) for m, t in ((x, "symbol long, name string, x double"), (f, "i string, j string, value double"))]
    out = risk.asset_covariance(*frames, spark.createDataFrame(list(d.items()), "symbol long, variance double"), side=2)
    want = {(8, 8): 0.25}
    for a in range(7):
        for b in range(7):
            terms = [x[a, i] * f[i, j] * x[b, j] for i, j in f if (a, i) in x and (b, j) in x]
            if terms or (a == b and a in d):
                want[a, b] = sum(terms) + ((d.get(a) or 0.0) if a == b else 0.0)
    got = {(r.symbol, r.other): r.value for r in out.collect()}
    assert got == pytest.approx(want) and out.count() == len(want)
    assert "other" not in "".join(part.split(")")[0] for part in out._jdf.queryExecution().toString().split("hashpartitioning(")[1:])


def test_resonance_thresholds(spark):
    cases = [(0.11, 0.11, "bullish_resonance"), (0.09, 0.09, "none"), (-0.11, -0.11, "bearish_resonance"), (0.21, -0.11, "cautious_divergence"), (-0.21, 0.11, "dangerous_divergence"), (None, 0.5, "none")]
    x = spark.createDataFrame(cases, "a double, b double, want string").withColumn("got", flows.resonance(F.col("a"), F.col("b")))
    assert x.filter("got <> want").count() == 0


def test_distance_correlation(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=70), rng.normal(size=70)
    centre = lambda v: (a := np.abs(v[:, None] - v)) - a.mean(0) - a.mean(1)[:, None] + a.mean()
    a, b = centre(x), centre(y)
    want = np.sqrt((a * b).mean()) / np.sqrt(np.sqrt((a * a).mean()) * np.sqrt((b * b).mean()))
    assert flows.dcor(x, y, 16) == pytest.approx(want)
    assert flows.dcor(x, 3 * x) == pytest.approx(1) and flows.dcor(x, np.zeros(70)) == 0
    rows = [(1, float(p), float(q)) for p, q in zip(x, y, strict=True)] + [(2, 1.0, 1.0)]
    got = flows.distance_correlation(spark.createDataFrame(rows, "date int, p double, q double"), "p", "q").collect()
    assert [r.date for r in got] == [1] and 0 <= got[0].dcor <= 1


def test_distance_correlation_of_many_points():
    rng = np.random.default_rng(2)
    for n, places in ((70, 9), (70, 0), (601, 1), (1000, 9)):
        x = np.round(rng.normal(size=n), places) + 1e6  # ties, far from zero
        y = np.round(0.3 * x + rng.normal(size=n), places)
        assert flows.dcor(x, y, 16) == pytest.approx(flows.dcor(x, y, n), abs=1e-9)
    x, y = rng.normal(size=60_000), rng.normal(size=60_000)
    began = time.time()
    assert 0 < flows.dcor(x, y) < 0.03 and time.time() - began < 10
    assert flows.dcor(x, np.full(60_000, 0.1)) == 0


def test_transcripts(spark):
    vtt = "WEBVTT\n\n00:00:00.080 --> 00:00:03.200 align:start position:0%\n<c.colorE5E5E5>Hello</c> world\n\n00:00:04.000 --> 00:00:05.800\nAgain\n"
    timed = json.dumps({"events": [{"tStartMs": 80, "dDurationMs": 3120, "segs": [{"utf8": "hello\nworld"}]}, {"tStartMs": 4000, "dDurationMs": 1800, "segs": [{"utf8": "again"}]}, {"tStartMs": 9}]})
    r = spark.createDataFrame([(vtt, timed, [("vtt", "a"), ("srv3", "b"), ("json3", "c")])], "v string, j string, t array<struct<ext: string, url: string>>").select(text.web_vtt("v").alias("v"), text.json3("j").alias("j"), text.best_track("t").alias("t")).first()
    assert [tuple(s) for s in r.v] == [("Hello world", 0.08, 3.12), ("Again", 4.0, 1.8)]
    assert [tuple(s) for s in r.j if s.text] == [("hello world", 0.08, 3.12), ("again", 4.0, 1.8)]
    assert r.t.url == "c"


def test_adjustments_by_hand(spark):
    rows = [("s", 1, 100.0, 50.0, 1.0, 0.0), ("s", 2, 50.0, 50.0, 2.0, 0.0), ("t", 1, 100.0, 50.0, 1.0, 0.0), ("t", 2, 50.0, 55.0, 2.0, 0.0)]
    x = spark.createDataFrame(rows, "symbol string, date int, close double, adj_close double, split_factor double, cash_dividend double")
    assert [(r.symbol, r.finding) for r in quality.adjustment_audit(x).collect()] == [("t", "adjusted_return_mismatch")]
