"""SQL twins of the registered plans, for an independent engine."""

from __future__ import annotations

BARS = """bars AS (
  SELECT l_suppkey AS symbol, date_trunc('week', l_shipdate)::DATE AS date, arg_min(p, k) AS open, max(p) AS high, min(p) AS low,
         arg_max(p, k) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
  FROM (SELECT *, l_extendedprice / l_quantity AS p, row(l_shipdate, l_orderkey, l_linenumber) AS k FROM lineitem) GROUP BY 1, 2)"""

STAGED = f"""{BARS},
lagged AS (SELECT *, lag(close) OVER s AS pc, close / nullif(lag(close) OVER s, 0) - 1 AS ret, volume / nullif(lag(volume) OVER s, 0) - 1 AS dv,
  lag(high) OVER s AS ph, lag(low) OVER s AS pl, row_number() OVER s AS n FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY date)),
b AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, (high - low) / close AS hl, open / pc - 1 AS gap, close / open - 1 AS oc,
  (high - greatest(open, close)) / nullif(high - low, 0) AS up, (least(open, close) - low) / nullif(high - low, 0) AS dn,
  CASE WHEN ret < 0 THEN ret ELSE 0 END AS down, abs(close - pc) AS absd, sign(close - pc) * volume AS flow, close * volume AS cv,
  CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS gain, CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS loss FROM lagged)"""

WINDOWS = "WINDOW s AS (PARTITION BY symbol ORDER BY date), d AS (PARTITION BY date), u AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), " + ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)" for n in (2, 3, 4, 5, 6, 8, 9, 10, 12, 20, 60))


def tidy(e: str) -> str:
    return f"floor(({e}) * 1e6 + 0.50037) / 1e6"


def full(x: str, n: int, e: str) -> str:
    return f"CASE WHEN count({x}) OVER w{n} = {n} THEN {e} END"


def some(x: str, n: int, m: int, e: str) -> str:
    return f"CASE WHEN count({x}) OVER w{n} >= {m} THEN {e} END"


def value(e: str, more: str = "", source: str = "b") -> str:
    """symbol, date and one tidy value."""
    return f"WITH {STAGED}{more} SELECT symbol, date, {tidy(e)} AS value FROM {source} {WINDOWS}"


def fold(x: str, alpha: float) -> str:
    """Recursive mean from the first non-null x, as a list over all rows up to the current one."""
    return f"list_reduce(list({x}) FILTER ({x} IS NOT NULL) OVER u, lambda a, v: a * {1 - alpha!r}::DOUBLE + v * {alpha!r}::DOUBLE)"


def corr(a: str, b: str, w: str) -> str:
    p, q = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return f"covar_pop({p}, {q}) OVER {w} / nullif(stddev_pop({p}) OVER {w} * stddev_pop({q}) OVER {w}, 0)"


def rank(x: str, w: int) -> str:
    a = f"list({x}) FILTER ({x} IS NOT NULL) OVER w{w}"
    return f"(len(list_filter({a}, lambda v: v < {x})) + (len(list_filter({a}, lambda v: v = {x})) + 1) / 2.0::DOUBLE) / len({a})"


def pct(x: str, by: str = "date") -> str:
    """Average-tie percentile rank of a date; for use in a select of its own."""
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} ASC NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE) / count({x}) OVER (PARTITION BY {by}) END"
