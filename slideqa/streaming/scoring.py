"""Predictions scored as they arrive. ``score_stream`` scores each line once, also over restarts, as the checkpoint
remembers files; ``score_new`` scores each question once, in whichever file it comes again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slideqa.operators.scoring import score_choices
from slideqa.sources.readers import split_lines
from slideqa.sources.shared import exists

RESULT = "question_id string, image string, question string, prediction string, ground_truth string, info struct<format: string, subcategory: string, belong_level: string, focus: string>"


def result_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Inference results of the JSON-lines files that appear in a folder; info becomes columns."""
    good, _ = split_lines(spark.readStream.text(folder))
    return good.select(F.from_json("value", RESULT).alias("r")).select("r.*").select("question_id", "image", "question", "prediction", "ground_truth", "info.*")


def score_stream(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Scores what is there and new, appends it as Parquet, and ends."""
    scored = score_choices(result_stream(spark, folder))
    return scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_new(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Scores the questions that ``out`` doesn't hold yet, and ends. What has been answered is read from the results
    themselves, the id column alone, so no state grows beside them. A batch has its own folder and is written over
    if it runs again; it leaves that folder out when it looks for what is done. Of several lines of one question in a
    batch the smallest counts. Lines without a question_id are all scored."""

    def add(batch: DataFrame, number: int) -> None:
        named = batch.where("question_id is not null").groupBy("question_id").agg(F.min(F.struct(*batch.columns)).alias("r")).select("r.*")
        if exists(spark, out):
            done = spark.read.schema("question_id string, batch long").parquet(out).where(F.col("batch") != number)
            named = named.join(done, "question_id", "left_anti")
        score_choices(named.unionByName(batch.where("question_id is null"))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return result_stream(spark, folder).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
