"""Writers: JSON lines, accepted and rejected rows with their statistics, nested documents, summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line, UTF-8, null fields left out."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def write_split(rows: DataFrame, path: str) -> dict[str, float]:
    """Rows as JSON lines in path/kind=accepted and path/kind=rejected, by whether they have a reject_reason, in one
    job that holds no rows back. Returns what that job has counted: total, success, filtered, success_rate (percent)."""
    counted, bad = Observation(), F.col("reject_reason").isNotNull()
    seen = rows.observe(counted, F.count(F.lit(1)).alias("total"), F.count_if(~bad).alias("success"), F.count_if(bad).alias("filtered"))
    lines = seen.select(F.to_json(F.struct(*rows.columns)).alias("value"), F.when(bad, "rejected").otherwise("accepted").alias("kind"))
    lines.write.mode("overwrite").partitionBy("kind").text(path)
    n = counted.get
    return {**n, "success_rate": 100 * n["success"] / n["total"] if n["total"] else 0.0}


def read_split(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """value: the lines of a kind, accepted or rejected."""
    return spark.read.schema("value string, kind string").text(path).where(F.col("kind") == kind).select("value")


def nested_lines(slides: DataFrame, clusters: DataFrame, regions: DataFrame) -> DataFrame:
    """slide_id, place, line: the lines of each slide's document, its clusters in it and their regions in them, in
    name order. A region is a line of its own, so no document is ever held as a whole: rows are sorted, and a line needs
    to know the one before it only. Clusters without slide and regions without cluster are left out."""
    inside = clusters.join(slides.select("slide_id"), "slide_id", "left_semi")
    met = regions.join(inside.select("slide_id", "cluster_id"), ["slide_id", "cluster_id"], "left_semi")
    none, text = F.lit(None).cast("string"), F.lit(None).cast("string")

    def rows(df: DataFrame, kind: int, body: F.Column, cluster: F.Column, magnification: F.Column = F.lit(None).cast("int"), order: F.Column = text) -> DataFrame:  # noqa: B008
        return df.select("slide_id", cluster.alias("cluster_id"), F.lit(kind).alias("kind"), magnification.cast("int").alias("magnification"), order.alias("order"), body.alias("body"))

    head = lambda df, tail: F.concat(F.regexp_replace(F.to_json(df), r"\}$", ""), F.lit(tail))
    last = F.lit("\U0010ffff")
    lines = rows(slides, 0, head(F.struct(*slides.columns), ',"clusters":['), none)
    lines = lines.unionByName(rows(inside, 1, head(F.struct("cluster_id", F.col("summary").alias("cluster_summary")), ',"rois":['), F.col("cluster_id")))
    lines = lines.unionByName(rows(met, 2, F.to_json(F.struct("magnification", "text")), F.col("cluster_id"), F.col("magnification"), F.col("text")))
    lines = lines.unionByName(rows(inside, 3, F.lit("]}"), F.col("cluster_id"))).unionByName(rows(slides, 4, F.lit("]}"), last))
    w = Window.partitionBy("slide_id").orderBy("cluster_id", "kind", "magnification", "order")
    before = F.lag("kind").over(w)
    follows = ((F.col("kind") == 2) & (before == 2)) | ((F.col("kind") == 1) & (before == 3))
    return lines.select("slide_id", F.row_number().over(w).alias("place"), F.concat(F.when(follows, ",").otherwise(""), "body").alias("line"))


def _framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of a file as one JSON array, a batch of lines at a time."""
    begun = False
    for batch in batches:
        if batch.num_rows:
            first = pc.equal(batch.column("place"), 1)
            begin = pc.if_else(first, ",", "")
            if not begun:
                begin = pa.array(["["] + begin.to_pylist()[1:])
            begun = True
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(begin, batch.column("line"), "")], ["value"])
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])


def write_nested(slides: DataFrame, clusters: DataFrame, regions: DataFrame, path: str) -> None:
    """Each file is a JSON array of slides' documents, written line by line: the memory of a task doesn't depend on
    how many regions a slide has. ``spark.read.json(path, multiLine=True)`` reads them."""
    lines = nested_lines(slides, clusters, regions).sortWithinPartitions("slide_id", "place")
    lines.select("place", "line").mapInArrow(_framed, "value string").write.mode("overwrite").text(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A small long table (group_type, group_key, metric, value) as one JSON document of nested objects."""
    inner = summary.groupBy("group_type", "group_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("m"))
    outer = inner.groupBy("group_type").agg(F.map_from_entries(F.collect_list(F.struct("group_key", "m"))).alias("g"))
    whole = outer.agg(F.map_from_entries(F.collect_list(F.struct("group_type", "g"))).alias("s"))
    whole.select(F.to_json("s").alias("value")).coalesce(1).write.mode("overwrite").text(path)
