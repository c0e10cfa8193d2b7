"""The registered queries of the subpackage: each operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fertility, kdtree, license, mix, pack, pii, ppm, simhash, similar, suffix, warc
from .common import column, discard, documents, materialize, shielded


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality(documents(spark, sf_dir), ["doc_id"])


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_texts(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(documents(spark, sf_dir), ["doc_id"])

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in pii.BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir), texts=False)


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license.licenses(documents(spark, sf_dir), ["doc_id"])
    base, hits = F.transform("base", lambda b: b["label"]), F.transform("hits", lambda h: h["label"])
    first, last = F.array_min(F.transform("base", lambda b: b["first"])), F.array_max(F.transform("base", lambda b: b["first"]))
    best = F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0)))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        first.alias("first_word"),
        last.alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, hits)), ",").alias("labels"),
        best.alias("score"),
    )


def op8_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(documents(spark, sf_dir)).drop("ids")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = materialize(warc.archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")), "archives")
    return warc.read_archives(written).drop("payload")


# Stages of the pipeline: documents in, documents out (but for the last). Documents have at least doc_id, text and source;
# columns beyond these are kept as they are, whatever their names and types. No rows in: no rows out.


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null and empty texts fail them; rows that repeat one another are judged
    alike, each for itself; a text of any length is judged whole. Without a column `lang`, bands go by script."""
    inner = shielded(docs)
    named = {n: f"c{i}" for i, n in enumerate(docs.columns)}
    lang = column(named["lang"]).cast("string") if "lang" in named else F.lit(None).cast("string")
    carried = inner.select(F.col(named["text"]).alias("text"), lang.alias("lang"), F.struct(*inner.columns).alias("row"))
    return fertility.quality(carried, ["row"]).filter("kept").select("row.*").toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of op1 (its width and radius); the pipeline has drop_similar_texts instead."""
    return simhash.keep_one(docs)


def drop_similar_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class of texts whose five-word shingles have a Jaccard similarity of 0.8
    or more. Of rows that repeat an id one stays; rows without an id stay; texts without words are one class. Texts of
    any length are compared whole."""
    return similar.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data replaced by their kind; n_chars, if there is such a column, follows the text. A row for each
    row; null texts stay null."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as whole rounds take it, and the words of it that the last, partial round takes. Documents
    without words are not taken; null sources are one source; null ids and repeated rows count like any other."""
    return mix.taken_texts(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids. Null and empty texts give the end token only; repeated rows and null ids
    are packed like any other; a text of any length is cut into as many pieces as it needs."""
    return pack.pack(docs)


STAGES: list[tuple[str, Callable]] = [
    ("quality rules", keep_quality),
    ("simhash near-dedup", drop_similar_texts),
    ("personal data", mask_personal_data),
    ("mixing sources", mix_sources),
    ("packing", pack_tokens),
]


def run_stages(spark: SparkSession, sf_dir: str, stages: list[tuple[str, Callable]] | None = None) -> DataFrame:
    """The stages in turn, each written to the shared store and read back; what a stage read goes once it is written."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in stages or STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_simhash, op2_fertility, op3_ppm, op4_pii, op5_mix, op6_suffix, op7_license, op8_kdtree, op9_pack, op10_warc)
    return {f.__name__: f for f in found} | {"pipeline": run_stages}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_mix": mix.ORACLE,
        "op8_kdtree": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
        "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS least FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to FROM m
""",
    }
