"""From documents to token ids: quality rules, near-duplicates, benchmark decontamination, secrets, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written and read again as the
next stage's docs. Stages hand over any further columns as they are, an empty table gives an empty one. All stages but the last return the columns of documents. SQL can't express the tokeniser
measures, the network and BPE, so there is no SQL for the rows; tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slideqa.llm import bpe, decontaminate, near_dup, quality, secrets
from slideqa.llm.tables import Saved, table


#: Bytes of text that go to a Python worker at a time: executors run several workers beside a full heap.
BATCH = 8 << 20


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text passes the quality rules. Null and empty texts fail; equal rows fare alike."""
    _small_batches(spark)
    return quality.good_documents(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near copies. Of several rows of that doc_id the one of
    the smallest hash stays, so a task that runs again chooses alike. Rows without doc_id, and documents without
    words, have no copies and stay."""
    _small_batches(spark)
    ids = near_dup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(ids, "doc_id", "left_semi").select(*docs.columns)
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not again.isEmpty():
        tied = kept.withColumn("_tie", F.xxhash64(*docs.columns))
        several = tied.join(again, "doc_id", "left_semi")
        first = several.groupBy("doc_id").agg(F.min("_tie").alias("_tie"))
        one = several.join(first, ["doc_id", "_tie"], "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
        kept = kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one)
    return kept.unionByName(docs.where("doc_id is null"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of documents that contain no benchmark item. Rows without doc_id are judged by their own text; null and
    empty texts contain nothing and stay."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets replaced by a placeholder; n_chars follows the text. A null text stays null."""
    _small_batches(spark)
    out = secrets.redacted_documents(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the text they decode to, and the ids: a row per row. A null text
    counts as empty."""
    _small_batches(spark)
    both = bpe.encoded(docs, back=True)
    return both.select("doc_id", *bpe.digests(F.col("ids"), F.col("text")), "ids")


STAGES = [
    ("quality_rules", keep_good),
    ("near_dedup", keep_one_of_each),
    ("decontamination", drop_benchmark),
    ("secret_scan", redact_secrets),
    ("bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        done = Saved(stage(spark, docs, sf_dir), name)
        if last:
            last.drop()
        docs, last = done.df, done
    return docs
