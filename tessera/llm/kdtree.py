"""Exact top-k search by inner product with KD-trees per shard.

Vectors are dealt to shards by a hash of their id; a shard's tree halves the vectors at the median of the widest
dimension until LEAF are left, and keeps for every node the tight box of its vectors. A query's inner product with
anything in a box is at most sum(max(q * low, q * high)). A query visits leaves by falling bound (best first) and
stops when the bound is under its k-th score; boxes over leaves cut off whole subtrees before.

Queries come in blocks of BLOCK. Each block first searches one shard, its home; the k-th scores found there go with the
block to all other shards. A task holds one block and one shard, so memory does not depend on the table, and each
shard hands back at most k rows a query. Leaves are visited for many queries at once, by matrix products that are
exact: in doubles below 2 ** 53, else in 64-bit integers.

Null vectors and such that hold null or non-finite components take no part, nor do null ids. Queries meet vectors of
their own length only. Repeated rows, and rows that repeat an id: each is a candidate of its own and, if asked, a query
of its own, and the k best of all that the rows of a query id meet are ranked, as a join of the rows would; they are not
each other's candidates. Of equal scores the smaller id is first. Empty tables: no rows. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import has_columns, materialize

LEAF, SHARD, BLOCK = 256, 8192, 1024
LOWEST = np.iinfo(np.int64).min + 1  # can be negated


class Tree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids,))
        self.ids, self.vectors = ids[order], vectors[order]
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[np.ndarray] = []
        self._grow(np.arange(len(ids)))
        self.low_box, self.high_box = np.array(self.low), np.array(self.high)

    def _grow(self, rows: np.ndarray) -> int:
        at = len(self.low)
        part = self.vectors[rows]
        self.low.append(part.min(0))
        self.high.append(part.max(0))
        self.children.append(None)
        self.rows.append(rows)
        if len(rows) > LEAF:
            wide = int(np.argmax(self.high[at] - self.low[at]))
            cut = np.argpartition(part[:, wide], len(rows) // 2)
            half = len(rows) // 2
            self.children[at] = self._grow(rows[cut[:half]]), self._grow(rows[cut[half:]])
        return at

    def search(self, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids (m, k), best first; LOWEST where there are fewer or none can reach kth."""
        top = max(1, int(np.abs(self.vectors).max(initial=0))) * max(1, int(np.abs(queries).max(initial=0))) * queries.shape[1]
        kind = np.float64 if top < 1 << 53 else np.int64
        q = queries.astype(kind)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        low, high = self.low_box.astype(kind), self.high_box.astype(kind)
        bound = np.full((len(q), len(self.rows)), LOWEST, np.float64 if kind is np.float64 else np.int64)
        leaves, level = [], [0]
        while level:  # only boxes that some query can use are opened
            bound[:, level] = up @ high[level].T + down @ low[level].T
            nxt = []
            for n in level:
                if (bound[:, n] >= kth).any():
                    if self.children[n] is None:
                        leaves.append(n)
                    else:
                        nxt += self.children[n]
            level = nxt
        best = np.full((len(q), k), LOWEST, np.int64)
        who = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
        if not leaves:
            return best, who
        leaves = np.array(leaves)
        order = np.argsort(-bound[:, leaves], axis=1, kind="stable")
        kth = kth.copy()
        for turn in range(len(leaves)):
            leaf = leaves[order[:, turn]]
            live = bound[np.arange(len(q)), leaf] >= kth
            if not live.any():
                break
            for n in np.unique(leaf[live]):
                at = np.flatnonzero(live & (leaf == n))
                rows = self.rows[n]
                score = (q[at] @ self.vectors[rows].astype(kind).T).astype(np.int64)
                ids = self.ids[rows]
                use = (score >= kth[at, None]) & (ids[None, :] != query_ids[at, None])
                for i, ok, s in zip(at.tolist(), use, score, strict=True):
                    if ok.any():
                        s, w = np.append(best[i], s[ok]), np.append(who[i], ids[ok])
                        first = np.lexsort((w, -s))[:k] if len(s) <= 2 * k else self._top(s, w, k)
                        best[i], who[i] = s[first], w[first]
                        kth[i] = max(kth[i], best[i, -1])
        return best, who

    @staticmethod
    def _top(s: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
        near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
        return near[np.lexsort((w[near], -s[near]))[:k]]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), -1)


def _plant(table: pa.Table) -> pa.Table:
    """All vectors of one length in a shard -> the tree, pickled."""
    tree = Tree(table.column("vec_id").to_numpy(), _matrix(table.column("v")))
    return pa.table({"dim": table.column("dim")[:1], "shard": table.column("shard")[:1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})


def _bundle(table: pa.Table) -> pa.Table:
    """Queries of one length in a block -> ids and vectors in one row."""
    return pa.table({"dim": table.column("dim")[:1], "block": table.column("block")[:1], "ids": pa.array([table.column("vec_id").to_numpy().tobytes()]), "q": pa.array([_matrix(table.column("v")).tobytes()])})


def _search(k: int):
    """dim, ids, q, kth, tree -> query_id, vec_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, q, kth, tree in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                ids = np.frombuffer(ids, np.int64)
                q = np.frombuffer(q, np.int64).reshape(len(ids), dim)
                kth = np.frombuffer(kth, np.int64) if kth else np.full(len(ids), LOWEST + 1)
                best, who = pickle.loads(tree).search(ids, q, kth, k)  # noqa: S301  written by _plant above
                ok = best > LOWEST
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, ok.sum(1))), pa.array(who[ok]), pa.array(best[ok])], names=["query_id", "vec_id", "score"])

    return run


def _with_kth(k: int):
    """Queries of a block and what they found at home -> the block with its k-th scores."""

    def run(key: tuple, blocks: pa.Table, found: pa.Table) -> pa.Table:
        if not blocks.num_rows:
            return blocks.append_column("kth", pa.array([], pa.binary()))
        ids = np.frombuffer(blocks.column("ids")[0].as_py(), np.int64)
        kth = {}
        q, s = found.column("query_id").to_numpy(), found.column("score").to_numpy()
        order = np.lexsort((-s, q))
        q, s = q[order], s[order]
        at = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else []
        for a, n in zip(at, np.diff(np.append(at, len(q))), strict=True):
            if n >= k:
                kth[int(q[a])] = int(s[a + k - 1])
        values = np.array([kth.get(int(i), LOWEST + 1) for i in ids], np.int64)
        return blocks.append_column("kth", pa.array([values.tobytes()], pa.binary()))

    return run


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k best other rows."""
    has_columns(vectors, vec_id, embedding)
    x = F.col(embedding).cast("array<double>")
    good = F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    ints = vectors.filter(good).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale)).alias("v")).withColumn("dim", F.size("v"))
    ints = materialize(ints, "ints")
    count, asked = ints.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    shards, blocks = max(1, -(-count // SHARD)), max(1, -(-asked // BLOCK))
    deal = F.xxhash64("vec_id")
    sharded = ints.withColumn("shard", F.pmod(deal, F.lit(shards)).cast("int"))
    trees = materialize(sharded.groupBy("dim", "shard").applyInArrow(_plant, "dim int, shard int, tree binary"), "trees")
    queries = ints.filter(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.shiftright(deal, 20), F.lit(blocks)).cast("int"))
    bundled = materialize(queries.groupBy("dim", "block").applyInArrow(_bundle, "dim int, block int, ids binary, q binary"), "blocks")
    out = "query_id long, vec_id long, score long"
    home = bundled.withColumn("shard", F.col("block") % shards)
    at_home = materialize(home.join(trees, ["dim", "shard"]).select("dim", "ids", "q", F.lit(None).cast("binary").alias("kth"), "tree", "block").mapInArrow(_keep_block(_search(k)), f"dim int, block int, {out}"), "home")
    armed = home.groupBy("dim", "block").cogroup(at_home.groupBy("dim", "block")).applyInArrow(_with_kth(k), "dim int, block int, ids binary, q binary, shard int, kth binary")
    rest = armed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("other <> shard").select("dim", F.col("other").alias("shard"), "ids", "q", "kth")
    away = rest.join(trees, ["dim", "shard"]).select("dim", "ids", "q", "kth", "tree").mapInArrow(_search(k), out)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    every_hit = at_home.select("query_id", "vec_id", "score").unionByName(away)  # a candidate row is in one shard, so none is met twice
    return every_hit.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _keep_block(search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                for found in search(iter([part])):
                    n = found.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part.column(0)[0].as_py(), np.int32)), pa.array(np.full(n, part.column(5)[0].as_py(), np.int32)), *found.columns], names=["dim", "block", *found.schema.names])

    return run
