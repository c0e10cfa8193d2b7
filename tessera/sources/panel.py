"""Scans, role checks and the panels derived from the star schema."""

from __future__ import annotations

import hashlib
import json
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.series import S

OHLCV = ("date", "symbol", "open", "high", "low", "close", "volume")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def clean(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL."""
    return df.select(*(F.when(~F.isnan(n) & (F.abs(n) < F.lit(float("inf"))), F.col(n)).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes))


def scan(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, symbols: list[str] | None = None) -> DataFrame:
    """CSV or Parquet panel: lower-case names, dates of either form, numbers coerced, filters before any shuffle."""
    raw = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).csv(path)
    df = raw.toDF(*(n.strip().lower() for n in raw.columns))
    require_columns(df, *OHLCV)
    if dict(df.dtypes)["date"] != "date":
        df = df.withColumn("date", F.try_to_timestamp(F.regexp_replace(F.col("date").cast("string").substr(1, 10), "-", ""), F.lit("yyyyMMdd")).cast("date"))
    df = df.withColumn("symbol", F.upper(F.trim(F.col("symbol").cast("string"))))
    keep = F.lit(True)
    if start:
        keep &= F.col("date") >= F.to_date(F.lit(start))
    if end:
        keep &= F.col("date") <= F.to_date(F.lit(end))
    if symbols:
        keep &= F.col("symbol").isin(*(x.strip().upper() for x in symbols))
    numbers = [n for n in df.columns if n not in ("date", "symbol")]
    df = df.filter(keep).select("date", F.upper(F.col("symbol").cast("string")).alias("symbol"), *(F.expr(f"try_cast(`{n}` as double)").alias(n) for n in numbers))
    df = clean(df)
    if "amount" not in df.columns:
        df = df.withColumn("amount", F.col("close") * F.col("volume"))
    if "vwap" not in df.columns:
        df = df.withColumn("vwap", F.try_divide("amount", "volume"))
    return df


def unadjust(df: DataFrame) -> DataFrame:
    prices = [n for n in ("open", "high", "low", "close", "vwap") if n in df.columns]
    return df.withColumns({n: F.try_divide(F.col(n), F.col("adjfactor")) for n in prices})


def melt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Wide to long: one row per key, name and value."""
    return df.unpivot(keys, [n for n in df.columns if n not in keys], "name", "value")


def write_grid(keys: DataFrame, values: DataFrame, path: str) -> None:
    """Values on the keys' grid, eight decimals, as CSV."""
    out = keys.select("date", "symbol").distinct().join(values, ["date", "symbol"], "left")
    numbers = [n for n, t in out.dtypes if t == "double"]
    out.withColumns({n: F.round(n, 8) for n in numbers}).write.mode("overwrite").option("header", True).csv(path)


def manifest(df: DataFrame) -> dict:
    """Rows and an order-free hash of a table, to bind a cache to its input."""
    rows, mark = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return {"rows": rows, "hash": hashlib.sha256(json.dumps([rows, str(mark), df.dtypes]).encode()).hexdigest()}


def write_cache(df: DataFrame, path: str) -> dict:
    df.write.mode("overwrite").parquet(path)
    found = manifest(df.sparkSession.read.parquet(path))
    df.sparkSession.createDataFrame([(json.dumps(found),)], "manifest string").write.mode("overwrite").json(f"{path}.manifest")
    return found


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    want = json.loads(spark.read.json(f"{path}.manifest").first()[0])
    if manifest(df) != want:
        raise ValueError(f"{path} does not fit its manifest")
    return df


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir, its lineage cut. Only a local session may name none: it gets one
    of its own."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of line items: a supplier is a symbol, price over quantity its price."""
    first = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    p = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", p.alias("p"))
        .groupBy(F.col("l_suppkey").alias("symbol"), F.date_trunc("week", "l_shipdate").cast("date").alias("date"))
        .agg(F.min_by("p", first).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", first).alias("close"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"))
    )


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with the lagged columns that most factors read, over one window."""
    b = bars(spark, sf_dir)
    pc, pv = F.lag("close").over(S()), F.lag("volume").over(S())
    b = b.withColumns({"pc": pc, "ret": F.try_divide("close", pc) - 1, "dv": F.try_divide("volume", pv) - 1, "ph": F.lag("high").over(S()), "pl": F.lag("low").over(S()), "n": F.row_number().over(S())})
    span = F.col("high") - F.col("low")
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return b.withColumns(
        {
            "tr": F.greatest(span, F.abs(F.col("high") - F.col("pc")), F.abs(F.col("low") - F.col("pc"))),
            "hl": F.try_divide(span, "close"),
            "gap": F.try_divide("open", "pc") - 1,
            "oc": F.try_divide("close", "open") - 1,
            "up": F.try_divide(F.col("high") - top, span),
            "dn": F.try_divide(bottom - F.col("low"), span),
            "down": F.when(F.col("ret") < 0, F.col("ret")).otherwise(0.0),
            "absd": F.abs(F.col("close") - F.col("pc")),
            "flow": F.signum(F.col("close") - F.col("pc")) * F.col("volume"),
            "cv": F.col("close") * F.col("volume"),
            "gain": F.greatest(F.col("close") - F.col("pc"), F.lit(0.0)),
            "loss": F.greatest(F.col("pc") - F.col("close"), F.lit(0.0)),
        }
    )


def densify(df: DataFrame) -> DataFrame:
    """Every (date, symbol) cell: the grid of two distinct lists, each far smaller than the panel."""
    dates, symbols = df.select("date").distinct(), df.select("symbol").distinct()
    return dates.join(symbols, how="cross").join(df, ["date", "symbol"], "left")


def industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("symbol"), F.col("n_name").alias("sector"))


def synthetic_bars(spark: SparkSession, symbols: int, days: int, seed: int) -> DataFrame:
    """Bars of any size from their index alone: business days from 2021-01-04, seeded by hashes, so reruns agree."""
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    u, v = (F.conv(F.substring(mark, at, 8), 16, 10).cast("double") / 4294967296.0 for at in (1, 9))
    t = F.col("id") % days
    x = spark.range(symbols * days).select(
        F.floor(F.col("id") / days).alias("symbol"),
        F.date_add(F.to_date(F.lit("2021-01-04")), (F.floor(t / 5) * 7 + t % 5).cast("int")).alias("date"),
        t.alias("t"),
        u.alias("u"),
        v.alias("v"),
    )
    x = x.withColumn("close", 100 + F.col("symbol") + 10 * F.sin(F.col("t") / 10.0) + F.col("u")).withColumn("open", F.col("close") * (1 + (F.col("v") - 0.5) / 50))
    high, low = F.greatest("open", "close") * (1 + F.col("u") / 100), F.least("open", "close") * (1 - F.col("u") / 100)
    return x.select("symbol", "date", "open", high.alias("high"), low.alias("low"), "close", F.floor(1000 * (1 + 9 * F.col("v"))).cast("double").alias("volume"))


class FactorStore:
    """Factors as one table partitioned by name: reading some prunes to their folders; what is read is kept until cleared."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.held = spark, path, {}

    def save(self, df: DataFrame, name: str) -> None:
        require_columns(df, "symbol", "date", "value").select("symbol", "date", "value").write.mode("overwrite").parquet(f"{self.path}/factor={name}")

    def load(self, *names: str) -> DataFrame:
        if names not in self.held:
            self.held[names] = self.spark.read.parquet(self.path).filter(F.col("factor").isin(*names)).persist()
        return self.held[names]

    def load_wide(self, *names: str) -> DataFrame:
        return self.load(*names).groupBy("symbol", "date").pivot("factor", list(names)).agg(F.first("value"))

    def clear(self) -> None:
        for df in self.held.values():
            df.unpersist()
        self.held.clear()


def save_run(artifacts: dict[str, DataFrame], path: str) -> DataFrame:
    """Each artifact as Parquet in a folder of its name, then a manifest (name, row count, hash of all rows) as JSON, written
    last: a folder with a manifest is whole."""
    spark, lines = next(iter(artifacts.values())).sparkSession, []
    for name, df in artifacts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        back = spark.read.parquet(f"{path}/{name}")
        n, h = back.agg(F.count("*"), F.sum(F.xxhash64(*back.columns).cast("decimal(38,0)"))).first()
        lines.append((name, n, str(h)))
    out = spark.createDataFrame(lines, "name string, n long, hash string")
    out.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return out


#: Tables of a matrix database.
MATRICES = ("open", "high", "low", "close", "volume", "amount")


def matrix_database(spark: SparkSession, path: str, names: tuple[str, ...] = MATRICES) -> DataFrame:
    """A folder of wide Parquet tables (date and a column per symbol), one per field, as one long panel; all must be there."""
    out = None
    for n in names:
        wide = require_columns(spark.read.parquet(f"{path}/{n}.parquet"), "date")
        long = melt(wide, ["date"]).select("date", F.col("name").alias("symbol"), F.col("value").alias(n))
        out = long if out is None else out.join(long, ["date", "symbol"], "fullouter")
    return out
