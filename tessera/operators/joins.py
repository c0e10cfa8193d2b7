"""Joins that Spark SQL lacks: as-of in both directions, band and nearest, point in time, chains of replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.panel import checkpointed

#: Rows of a side, counted first, up to which it is broadcast.
BROADCAST_ROWS = 10_000


def _us(x: str) -> Column:
    """Microseconds of a timestamp with or without zone."""
    return F.unix_micros(F.col(x).cast("timestamp"))


def asof(left: DataFrame, right: DataFrame, on: str, by: str, values: list[str], strict: bool = False, forward: bool = False) -> DataFrame:
    """Each left row with `values` of the last right row of its key at or before it (strict: before; forward: the next
    one instead). One shuffle on the key: both sides are put in one order and the last right row is carried along."""
    packed = F.struct(*values)
    a = left.select("*", F.lit(None).cast(right.select(packed.alias("v")).schema[0].dataType).alias("_v"), F.lit(True).alias("_left"))
    b = right.select(by, on, packed.alias("_v"), F.lit(False).alias("_left"))
    both = a.unionByName(b, allowMissingColumns=True)
    side = F.col("_left").desc() if strict else F.col("_left").asc()
    time = F.col(on).desc() if forward else F.col(on).asc()
    w = Window.partitionBy(by).orderBy(time, side).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_hit", F.last("_v", ignorenulls=True).over(w)).filter("_left")
    return found.select(*left.columns, *(F.col("_hit")[v].alias(v) for v in values))


def band(left: DataFrame, right: DataFrame, on: str, by: str, half: int, values: list[str]) -> DataFrame:
    """Pairs of one key whose times lie at most `half` seconds apart; equal-width bins make it an equi-join."""
    width = 2 * half
    a = left.withColumn("_bin", F.explode(F.array(*(F.floor(F.unix_timestamp(on) / width) + d for d in (-1, 0, 1)))))
    b = right.select(F.col(by).alias("_by"), F.col(on).alias("_on"), *values, F.floor(F.unix_timestamp(on) / width).alias("_bin2"))
    near = (F.col(by) == F.col("_by")) & (F.col("_bin") == F.col("_bin2")) & (F.abs(_us(on) - _us("_on")) <= half * 1_000_000)
    return a.join(b, near).drop("_bin", "_bin2", "_by")


def nearest(left: DataFrame, right: DataFrame, on: str, by: str, values: list[str]) -> DataFrame:
    """Each left row with the right row of its key that is closest in time (earlier of equals): the closer one of the
    as-of rows on either side."""
    r = right.withColumn("_t", F.col(on))
    back = asof(left, r, on, by, ["_t", *values]).withColumnsRenamed({"_t": "_tb", **{v: f"_b_{v}" for v in values}})
    both = asof(back, r, on, by, ["_t", *values], forward=True)
    us = _us(on)
    use_back = F.col("_tb").isNotNull() & (F.col("_t").isNull() | (us - _us("_tb") <= _us("_t") - us))
    return both.select(*left.columns, *(F.when(use_back, F.col(f"_b_{v}")).otherwise(F.col(v)).alias(v) for v in values))


def vintages(v: DataFrame, dates: DataFrame, keys: list[str]) -> DataFrame:
    """For each as-of date the latest row of each key disclosed before it (a disclosure counts from the day after).

    One shuffle by key: a key's rows and the as-of dates are put in one order, and every date takes the last row before it.
    The dates of a key are what is asked for, so no more rows arise than the result may hold."""
    own = v.select(*keys, F.col("disclosed").alias("_t"), F.lit(1).alias("_late"), F.struct(*v.columns).alias("_row"))
    asked = v.select(*keys).distinct().join(dates.select(F.col("as_of").alias("_t")).distinct(), how="cross").withColumn("_late", F.lit(0))
    order = Window.partitionBy(*keys).orderBy("_t", "_late").rowsBetween(Window.unboundedPreceding, 0)
    seen = own.unionByName(asked, allowMissingColumns=True).withColumn("_row", F.last("_row", ignorenulls=True).over(order))
    return seen.filter("_late = 0 and _row is not null").select(F.col("_t").alias("as_of"), "_row.*")


def merge_sources(a: DataFrame, b: DataFrame, keys: list[str], value: str, available: str) -> DataFrame:
    """Full outer join of two statement sources: the later availability wins, and where a row comes from."""
    x = a.select(*keys, F.col(value).alias("va"), F.col(available).alias("ta"))
    y = b.select(*keys, F.col(value).alias("vb"), F.col(available).alias("tb"))
    j = x.join(y, keys, "fullouter")
    newer_b = F.col("ta").isNull() | (F.col("tb") >= F.col("ta"))
    origin = F.when(F.col("tb").isNull(), "base").when(F.col("ta").isNull(), "extended").when(F.col("va").eqNullSafe(F.col("vb")), "matched").otherwise("conflict")
    return j.select(*keys, F.when(newer_b & F.col("tb").isNotNull(), F.col("vb")).otherwise(F.col("va")).alias(value), F.greatest("ta", "tb").alias(available), origin.alias("origin"))


def reply_depth(edges: DataFrame, node: str, parent: str) -> DataFrame:
    """node, root and depth of every node of a forest, by pointer doubling until nothing moves: log2(depth) joins.

    A node whose parent is not in the table is a root, as one without a parent is. A cycle is refused."""
    raw = edges.select(F.col(node).alias("node"), F.col(parent).alias("up"))
    have = raw.select(F.col("node").alias("there")).distinct()
    now = raw.join(have, F.col("up") == F.col("there"), "left")
    now = checkpointed(now.select("node", F.coalesce("there", "node").alias("up"), F.when(F.col("there").isNull(), 0).otherwise(1).cast("long").alias("depth")))
    before = now.agg(F.max("depth"), F.sum("depth"), F.count("*")).first()
    while before[0] and before[0] < before[2]:
        jump = now.select(F.col("node").alias("mid"), F.col("up").alias("top"), F.col("depth").alias("more"))
        now = checkpointed(now.join(jump, F.col("up") == F.col("mid")).select("node", F.col("top").alias("up"), (F.col("depth") + F.col("more")).alias("depth")))
        after = now.agg(F.max("depth"), F.sum("depth"), F.count("*")).first()
        if after == before:
            break
        before = after
    if before[0] and before[0] >= before[2]:  # deeper than there are nodes
        raise ValueError("the replies form a cycle")
    return now.select("node", F.col("up").alias("root"), "depth")
