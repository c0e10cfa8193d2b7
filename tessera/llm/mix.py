"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets: sources stand by code point (null last) and take the weights 5, 2, 1 in turn; together they get `share` times
all words by weight, but none more than `most` times its own; what that cuts off goes to the others by weight, until
none is above. That is min(most * size, level * weight) for one water level, found from running sums over sources.

Blocks: a source's documents are dealt to shards by a hash, ordered there by a seeded hash and strung together; the
string is cut into blocks of equal words: `block`, halved for a small source until its target holds LEAST blocks, down to
single words, so that small sources meet their targets too. A source's blocks, its target over the block size, are handed
to its shards one after the other by the highest quotient w / (2 a + 1), w being the shard's words and a the blocks that it
has. Blocks that a shard gets whatever the others do (the divisor is known to within half the number of shards) are given
at once; the few quotients near the divisor are ranked, a handful of rows for every SHARD words. A quota of whole rounds
takes every block that often; the rest of it falls on evenly spaced blocks from a seeded start, the order of documents
being random.

Null text: size 0. Null source: a source of its own, the last. Null id: ordered as the empty text. Repeated rows share
a place in the order and are strung one after the other. No words at all: targets 0. Empty table: no rows.
Only columns that are named are read. A hot source has more shards, never larger ones.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, arrow_type, column, give_back, has_columns, materialize, row_hash, shielded

WEIGHTS, SHARE, MOST, BLOCK, LEAST, SHARD, SEED = (5, 2, 1), 1.5, 2.0, 64, 64, 1 << 17, 17


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size long) -> with weight and target double. The windows see a row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    full = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("left_over", F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(full), F.lit(0.0)))
    w = w.withColumn("level", F.col("left_over") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(full), F.lit(0.0))))
    w = w.withColumn("water", F.min(F.struct(F.when(F.col("level") <= F.col("ratio"), F.col("ratio")).otherwise(F.lit(float("inf"))).alias("r"), F.col("level").alias("l"))).over(every)["l"])
    return w.select("source", "source_size", "weight", F.least("cap", F.col("water") * F.col("weight")).alias("target"))


def block_size(target: Column, block: int, least: int = LEAST) -> Column:
    """The greatest of block, block / 2, ... that goes into the target `least` times; 1 at least."""
    out = F.when(target >= block * least, block)
    size = block // 2
    while size > 1:
        out, size = out.when(target >= size * least, size), size // 2
    return out.otherwise(1)


def quotas(shards: DataFrame) -> DataFrame:
    """(source, shard, shard_size, seats) -> with `quota`: the seats of a source dealt to its shards by highest quotients
    shard_size / (2 a + 1), the lower shard first among equals. A quota lies within half a shard's share of the number of
    shards, and half a seat, of its share of the seats: only those quotients are ranked."""
    per = Window.partitionBy("source")
    part = F.col("shard_size") / F.sum("shard_size").over(per)
    t = shards.filter("shard_size > 0").withColumn("share", part * F.col("seats")).withColumn("slack", part * F.count("*").over(per) / 2 + 0.5)
    t = t.withColumn("sure", F.greatest(F.lit(0), F.floor(F.col("share") - F.col("slack")))).withColumn("left", F.col("seats") - F.sum("sure").over(per))
    t = t.withColumn("a", F.explode(F.sequence("sure", F.ceil(F.col("share") + F.col("slack")))))
    best = Window.partitionBy("source").orderBy((F.col("shard_size") / (2 * F.col("a") + 1)).desc(), "shard")
    t = t.withColumn("won", (F.row_number().over(best) <= F.col("left")).cast("long"))
    return t.groupBy("source", "shard").agg((F.max("sure") + F.sum("won")).alias("quota"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, shard: int = SHARD, seed: int = SEED, **how: object) -> DataFrame:
    """doc_id, size, source_size, target, taken, and where in the document the last, partial round falls: rounds long
    and the shard's block arithmetic (start, phase, rest, blocks, block) that `taken_before` reads."""
    has_columns(docs, doc_id, text, source)
    size = F.coalesce(F.regexp_count(column(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = materialize(
        docs.select(column(doc_id).alias("doc_id"), column(source).cast("string").alias("source"), size.alias("size")).withColumn("mark", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))),
        "sizes",
    )
    per = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), **how)
    b = rows.join(per, rows.source.eqNullSafe(per.source)).drop(per.source)
    b = b.withColumn("shard", F.conv(F.substring("mark", 1, 8), 16, 10).cast("long") % F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(shard))))
    within = Window.partitionBy("source", "shard")
    b = b.withColumn("start", F.sum("size").over(within.orderBy("mark", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    b = b.withColumn("shard_size", F.sum("size").over(within))
    b = b.withColumn("block", block_size(F.col("target"), block).cast("long")).withColumn("blocks", F.ceil(F.col("shard_size") / F.col("block")))
    seats = F.floor(F.max(F.col("target") / F.col("block")) + F.lit(0.5)).alias("seats")
    dealt = quotas(b.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), seats)).withColumnsRenamed({"source": "of", "shard": "at"})
    b = b.join(dealt, b.source.eqNullSafe(F.col("of")) & (b.shard == F.col("at")), "left")
    b = b.withColumn("quota", F.least(F.coalesce("quota", F.lit(0)), 2 * F.col("blocks")))
    n = F.greatest("blocks", F.lit(1))
    b = b.withColumn("rounds", F.floor(F.col("quota") / n)).withColumn("rest", F.col("quota") % n)
    b = b.withColumn("phase", F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("")), F.lit(":"), F.col("shard").cast("string"))), 1, 8), 16, 10).cast("long") % n)
    taken = F.col("rounds") * F.col("size") + taken_before(F.col("start") + F.col("size")) - taken_before(F.col("start"))
    return b.withColumn("taken", taken.cast("long")).select("doc_id", "size", "source_size", "target", "taken", "rounds", "start", "phase", "rest", "blocks", "block")


def taken_before(at):
    """Words of the shard's chosen blocks before word `at` (the partial round only)."""
    n = F.greatest("blocks", F.lit(1))
    j = F.floor(at / F.col("block"))

    def upto(k):
        return F.floor((k + F.col("phase")) * F.col("rest") / n)

    return (upto(j) - upto(F.lit(0))) * F.col("block") + (upto(j + 1) - upto(j)) * (at % F.col("block"))


def chosen_words(start: int, size: int, phase: int, rest: int, blocks: int, block: int) -> list[tuple[int, int]]:
    """Stretches (begin, end), in words of the document, that the partial round takes."""
    out: list[tuple[int, int]] = []
    n = max(1, blocks)
    for j in range(start // block, (start + size - 1) // block + 1) if size else ():
        if (j + 1 + phase) * rest // n > (j + phase) * rest // n:
            a, b = max(start, j * block) - start, min(start + size, (j + 1) * block) - start
            if out and out[-1][1] == a:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def taken_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix as documents: a row of docs for each whole round, and one for each stretch of the partial round (its text
    cut at words, n_chars following it if there is such a column). Documents without words are not taken. Other columns
    are kept whatever their names and types."""
    plan = mix(docs, doc_id, text, source)
    inner = shielded(docs)
    names = inner.columns
    key, body = (f"c{docs.columns.index(n)}" for n in (doc_id, text))
    # equal ids share a mark, so rows that repeat one are matched by their size as well
    keyed = inner.withColumn("of", F.coalesce(F.regexp_count(F.col(body).cast("string"), F.lit(WORD)), F.lit(0)).cast("long"))
    keyed = keyed.withColumn("nth", F.row_number().over(Window.partitionBy(key, "of").orderBy(row_hash(inner))))
    per = plan.select("doc_id", "size", "taken", "rounds", "start", "phase", "rest", "blocks", "block").withColumn("twin", F.row_number().over(Window.partitionBy("doc_id", "size").orderBy("start")))
    joined = keyed.join(per, F.col(key).eqNullSafe(per["doc_id"]) & (keyed["of"] == per["size"]) & (keyed["nth"] == per["twin"])).filter("taken > 0")
    joined = joined.select(*names, "rounds", "start", "size", "phase", "rest", "blocks", "block")
    at, chars = docs.columns.index(text), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1
    target = arrow_type(inner.schema)
    word = re.compile(WORD)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                rows, texts = [], []
                numbers = [part.column(len(names) + i).to_pylist() for i in range(7)]
                for i, (whole, rounds, start, size, phase, rest, blocks, block) in enumerate(zip(part.column(at).to_pylist(), *numbers, strict=True)):
                    rows += [i] * rounds
                    texts += [whole] * rounds
                    cuts = chosen_words(start, size, phase, rest, blocks, block)
                    if cuts == [(0, size)]:
                        rows.append(i)
                        texts.append(whole)
                    elif cuts:
                        spans = [m.span() for m in word.finditer(whole)]
                        for a, b in cuts:
                            rows.append(i)
                            texts.append(whole[spans[a][0] : spans[b - 1][1]])
                take = pa.array(rows, pa.int64())
                cols = [part.column(c).take(take) for c in range(len(names))]
                cols[at] = pa.array(texts, target.field(at).type)
                if chars >= 0:
                    cols[chars] = pa.array(list(map(len, texts)), target.field(chars).type)
                yield pa.RecordBatch.from_arrays(cols, names=names)
        give_back()

    return joined.mapInArrow(run, inner.schema).toDF(*docs.columns)


#: The same in SQL, for DuckDB.
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
                  md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS mark FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
r AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM r)::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0))
        / ((SELECT sum(weight) FROM r) - coalesce(sum(weight) OVER o, 0)) AS level FROM r
      WINDOW o AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio)) AS target FROM l),
b AS (SELECT d.*, source_size, target, ('0x' || substr(mark, 1, 8))::BIGINT % greatest(1, ceil(source_size::DOUBLE / {SHARD})::BIGINT) AS shard
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (sum(size) OVER (PARTITION BY source, shard ORDER BY mark, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start,
        (sum(size) OVER (PARTITION BY source, shard))::BIGINT AS shard_size FROM b),
g AS (SELECT *, CASE {' '.join(f'WHEN target >= {(BLOCK >> i) * LEAST} THEN {BLOCK >> i}' for i in range(BLOCK.bit_length() - 1))} ELSE 1 END::BIGINT AS block FROM c),
h AS (SELECT source, shard, sum(size)::BIGINT AS shard_size, floor(max(target / block) + 0.5::DOUBLE)::BIGINT AS seats FROM g GROUP BY ALL HAVING sum(size) > 0),
i AS (SELECT *, shard_size / (sum(shard_size) OVER o)::DOUBLE * seats AS share, shard_size / (sum(shard_size) OVER o)::DOUBLE * count(*) OVER o / 2 + 0.5::DOUBLE AS slack FROM h WINDOW o AS (PARTITION BY source)),
k AS (SELECT *, greatest(0, floor(share - slack)::BIGINT) AS sure FROM i),
m AS (SELECT *, (seats - sum(sure) OVER (PARTITION BY source))::BIGINT AS lft, unnest(range(sure, ceil(share + slack)::BIGINT + 1)) AS a FROM k),
n AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY shard_size / (2 * a + 1)::DOUBLE DESC, shard) <= lft)::INT AS won FROM m),
q AS (SELECT source, shard, max(sure) + sum(won) AS dealt FROM n GROUP BY ALL),
e AS (SELECT g.*, greatest(1, ceil(shard_size::DOUBLE / block)::BIGINT) AS n, least(coalesce(dealt, 0), 2 * ceil(shard_size::DOUBLE / block)::BIGINT)::BIGINT AS quota,
        ('0x' || substr(md5('{SEED}:' || coalesce(g.source, '') || ':' || g.shard::VARCHAR), 1, 8))::BIGINT AS p
      FROM g LEFT JOIN q ON g.source IS NOT DISTINCT FROM q.source AND g.shard = q.shard),
f AS (SELECT *, quota // n AS rounds, quota % n AS rest, p % n AS phase, start // block AS j, (start + size) // block AS k FROM e)
SELECT doc_id, size, source_size, target,
  (rounds * size + ((k + phase) * rest // n - (j + phase) * rest // n) * block
    + ((k + 1 + phase) * rest // n - (k + phase) * rest // n) * ((start + size) % block)
    - ((j + 1 + phase) * rest // n - (j + phase) * rest // n) * (start % block))::BIGINT AS taken
FROM f
"""
