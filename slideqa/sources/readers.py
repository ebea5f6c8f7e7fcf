"""Readers: JSON lines with a reject frame, session documents, manifests, labels, geometry, cases, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slideqa.functions.llm_text import json_or_null


def is_object(text: Column) -> Column:
    return F.coalesce(F.trim(text).startswith("{"), F.lit(False)) & json_or_null(text).isNotNull()


def split_lines(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Lines that hold a JSON object, and the bad ones with a reason. Blank lines are in neither."""
    rows = lines.where(F.trim(F.col(value)) != "")
    good = is_object(F.col(value))
    why = F.when(json_or_null(F.col(value)).isNull(), "not JSON").otherwise("not an object")
    return rows.where(good), rows.where(~good).withColumn("reason", why)


def read_jsonl(spark: SparkSession, path: str, schema: str, on_bad: str = "skip") -> tuple[DataFrame, DataFrame]:
    """Parsed rows, and bad lines. on_bad='fail' raises if there are any."""
    good, bad = split_lines(spark.read.text(path))
    if on_bad == "fail" and not bad.isEmpty():
        raise ValueError(f"bad lines in {path}")
    return good.select(F.from_json("value", schema).alias("r")).select("r.*"), bad


def session_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(session_[^/]*)", 1)


def session_time(session: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(session, r"(\d{8}_\d{6})$", 1), F.lit("yyyyMMdd_HHmmss"))


def document_items(documents: DataFrame, value: str = "value") -> DataFrame:
    """Whole JSON documents, an object or a list of objects each, to one row per object (item)."""
    first = F.substring(F.ltrim(F.col(value)), 1, 1)
    items = F.when(first == "[", F.from_json(value, "array<string>")).when(first == "{", F.array(value))
    return documents.withColumn("item", F.explode(items)).where(is_object(F.col("item"))).drop(value)


def read_sessions(spark: SparkSession, root: str, name: str = "inference_results.json") -> DataFrame:
    """session, item of every session's document; sessions without it give nothing."""
    files = spark.read.text(f"{root}/session_*/{name}", wholetext=True).withColumn("session", session_of(F.col("_metadata.file_path")))
    return document_items(files)


def read_question_lines(spark: SparkSession, root: str, merged: bool) -> DataFrame:
    """value (and session): one merged vqa.jsonl, or one in each session."""
    if merged:
        return spark.read.text(f"{root}/vqa.jsonl").withColumn("session", F.lit(None).cast("string"))
    return spark.read.text(f"{root}/session_*/vqa.jsonl").withColumn("session", session_of(F.col("_metadata.file_path")))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True)
    return rows.withColumn("id", F.col("id").cast("string"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """position, img, diagnosis, ihc, ptnm of a case list, or of a single case."""
    rows = document_items(spark.read.text(path, wholetext=True)).withColumn("position", F.monotonically_increasing_id())
    return rows.select("position", F.from_json("item", "img string, diagnosis string, ihc string, ptnm string").alias("c")).select("position", "c.*")


def parsed_features(documents: DataFrame, value: str = "value") -> DataFrame:
    """Adds features (matrix of floats), coords and reject_reason to feature documents: a bare matrix, or an object that
    holds one under features or summary_tokens, and coords perhaps. A flat list is a matrix of one row. Rejected are
    texts that aren't JSON, objects without a matrix, rows of unlike lengths, what isn't a number, and coords that
    aren't a pair a row."""
    text, first = F.col(value), F.substring(F.ltrim(F.col(value)), 1, 1)
    keyed = F.coalesce(F.get_json_object(text, "$.features"), F.get_json_object(text, "$.summary_tokens"))
    matrix = F.when(first == "[", F.trim(text)).when(first == "{", keyed)
    matrix = F.when(F.rlike(matrix, F.lit(r"^\[\s*[^\s\[\]]")), F.concat(F.lit("["), matrix, F.lit("]"))).otherwise(matrix)
    # generators keep the optimizer from repeating these large expressions wherever they are used
    texts = F.struct(json_or_null(text).isNotNull().alias("_json"), matrix.alias("_matrix"), F.when(first == "{", F.get_json_object(text, "$.coords")).alias("_coords"))
    rows = documents.select("*", F.inline(F.array(texts)))
    parsed = F.struct(F.from_json("_matrix", "array<array<float>>").alias("features"), F.from_json("_coords", "array<array<double>>").alias("coords"))
    rows = rows.select("*", F.inline(F.array(parsed)))
    bad = lambda m: F.coalesce(F.exists(m, lambda r: r.isNull() | F.exists(r, lambda x: x.isNull() | F.isnan(x))), F.lit(True))
    uneven = F.exists("features", lambda r: F.size(r) != F.size(F.get("features", F.lit(0))))
    pairs = F.coalesce((F.size("coords") == F.size("features")) & F.forall("coords", lambda c: (F.size(c) == 2) & ~F.exists(c, lambda x: x.isNull())), F.lit(False))
    why = F.when(~F.col("_json"), "not JSON").when(F.col("_matrix").isNull(), "no features").when(F.col("features").isNull() | bad(F.col("features")), "not numbers").when(uneven, "rows of unlike lengths")
    why = why.when(F.col("_coords").isNotNull() & ~pairs, "coords don't match")
    return rows.select("*", F.inline(F.array(F.struct(why.alias("reject_reason"))))).drop(value, "_json", "_matrix", "_coords")


def read_features(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Feature documents in root/slide_id=.../, one a file, as a row a patch (slide_id, patch_idx, x, y, feature) and as
    rejects (slide_id, reject_reason). Without coords x and y are null. A document must fit a row."""
    rows = parsed_features(spark.read.schema("value string, slide_id string").option("wholetext", True).text(root))
    good = rows.where("reject_reason is null").select("slide_id", F.posexplode("features").alias("patch_idx", "feature"), "coords")
    at = lambda i: F.get(F.get("coords", F.col("patch_idx")), F.lit(i))
    return good.select("slide_id", "patch_idx", at(0).alias("x"), at(1).alias("y"), "feature"), rows.where("reject_reason is not null").select("slide_id", "reject_reason")


def exploded_features(slides: DataFrame) -> DataFrame:
    """slide_id, patch_idx, x, y, feature from one matrix per slide (features, coords: arrays of arrays)."""
    rows = slides.select("slide_id", F.posexplode(F.arrays_zip("features", "coords")).alias("patch_idx", "p"))
    return rows.select("slide_id", "patch_idx", F.get("p.coords", F.lit(0)).alias("x"), F.get("p.coords", F.lit(1)).alias("y"), F.col("p.features").alias("feature"))


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """session, path, size of all files below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(session_of(F.col("path")).alias("session"), "path", F.col("length").alias("size"))
