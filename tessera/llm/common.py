"""Helpers that the text operators share."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a text: runs of bytes other than space and TAB..CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a batch that are turned into Python objects at once.
SLICE = 128

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only a session that names none (a local one, as in tests) gets a folder of its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in the shared store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session has gone; the cluster's own cleaning has the rest
            return


atexit.register(_sweep)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared store, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tessera/{uuid.uuid4().hex}-{name}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared store and read it back: lineage ends there, and a lost
    executor costs no recomputation of what came before."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.tessera_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    drop_path(df.sparkSession, df.tessera_path)


def text_rows(batches: Iterator[pa.RecordBatch], at: int = 1) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Small slices of the batches, each with column `at` as UTF-8 bytes (null: empty)."""
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            part = batch.slice(k, SLICE)
            yield part, [x or b"" for x in part.column(at).cast(pa.binary()).to_pylist()]


def byte_slices(batches: Iterator[pa.RecordBatch], most: int, at: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about `most` bytes of text in column `at`; a longer text is one by itself."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        k = 0
        while k < batch.num_rows:
            end = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + most, "right")))
            yield batch.slice(k, end - k)
            k = end


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of texts as its UTF-8 bytes, one text after the other, and where each ends (null: empty)."""
    column = pc.fill_null(column.cast(pa.binary()), b"")
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and bounds[-1] else np.zeros(0, np.uint8)
    return data, bounds[1:] - bounds[0]


_kept: dict[str, tuple[object, object]] = {}


def kept(owner: str, key: object, make: Callable[[], object]) -> object:
    """What a worker keeps between tasks for one operator, made anew for another key. Workers serve all operators in
    turn, so what others left behind goes first: a worker never holds the tables of two."""
    for other in [o for o in _kept if o != owner]:
        del _kept[other]
    if owner not in _kept or _kept[owner][0] != key:
        _kept.pop(owner, None)
        _kept[owner] = (key, make())
    return _kept[owner][1]


def give_back() -> None:
    """Hand freed memory back to the system, which idle workers would otherwise hold on to."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def decode(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def arrow_type(schema: str | object) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)


def map_text(df: DataFrame, keys: list[str], text: str, out: str, each: Callable[[bytes], tuple]) -> DataFrame:
    """One row per row of df: its keys, then what each(text as bytes) returns, under the names of `out`.

    Rows never meet, so nothing is shuffled and memory is one slice of rows."""
    new = arrow_type(out)
    kept = df.select(*keys).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_rows(batches, len(keys)):
            made = list(zip(*map(each, texts), strict=True)) or [[] for _ in new]
            cols = [part.column(i) for i in range(len(keys))] + [pa.array(v, f.type) for v, f in zip(made, new, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, *new.names])
        give_back()

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), out])
    return df.select(*keys, column(text).cast("string").alias("_text")).mapInArrow(run, ddl)


def has_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def column(name: str) -> Column:
    """A column by its very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def shielded(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ... in order, so that none clashes with an operator's own."""
    return df.select(*(column(n).alias(f"c{i}") for i, n in enumerate(df.columns)))


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns; maps, which Spark does not hash, by their JSON."""
    return F.xxhash64(*(F.to_json(F.struct(column(f.name))) if "map<" in f.dataType.simpleString() else column(f.name) for f in df.schema))


def one_per_id(docs: DataFrame, doc_id: str, stay: DataFrame) -> DataFrame:
    """The rows of docs whose id is in stay (a column `id`); of rows that repeat an id one, and all rows without an id.
    Other columns are kept whatever their names and types."""
    inner = shielded(docs)
    key = f"c{docs.columns.index(doc_id)}"
    first = Window.partitionBy(key).orderBy(row_hash(inner))
    kept = inner.join(stay.select(F.col("id").alias(key)).distinct(), key, "left_semi").withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")
    return kept.unionByName(inner.filter(F.col(key).isNull())).toDF(*docs.columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_az(raw: bytes) -> bytes:
    """Lower-case A-Z only."""
    return raw.lower()


PATTERN_NAME = re.compile(r"[a-z_0-9]+")
