"""From question records and session summaries to conversation records, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slideqa.functions.options import ANSWER_FIELDS, INDEX_FIELDS, answer_letters, answer_text, options_block, reject_reason

#: What a record's info may hold.
INFO_KEYS = [
    "belong_level", "belong_cluster_id", "belong_roi_mag", "focus", "subcategory", "format", "option_descriptions", "option_content", "choices", "explanation",
    "answer_key", "answer_keys", "correct_answers", "correct_answer", "answer_choice", "answer_options",
    "answer_index", "answer_indices", "answer_idx",
]
RECORD_FIELDS = ["qa_id", "id", "image_path", "image", "question", "options", "answer", *INFO_KEYS]
RECORD_SCHEMA = ", ".join(f"{f} string" for f in dict.fromkeys(RECORD_FIELDS))
IMAGE_TAG = "<image>"


def read_records(lines: DataFrame, value: str = "value") -> DataFrame:
    """Raw lines to one column per field; polymorphic fields stay text. Other columns stay."""
    return lines.withColumn("_r", F.from_json(value, RECORD_SCHEMA)).select("*", "_r.*").drop("_r", value)


def normalized(records: DataFrame) -> DataFrame:
    """Adds options_text, answer_text and reject_reason (null where accepted)."""
    fields = {f: F.col(f) for f in (*INDEX_FIELDS, *ANSWER_FIELDS)}
    block = options_block(F.col("options"), F.coalesce("option_descriptions", "option_content"), F.col("choices"))
    # a generator keeps the optimizer from repeating these large expressions wherever they are used
    out = records.select("*", F.inline(F.array(F.struct(block.alias("options_text"), answer_letters(fields).alias("_l")))))
    return out.withColumn("answer_text", answer_text(F.col("_l"))).withColumn("reject_reason", reject_reason(F.col("question"), F.col("_l"), F.col("format"), F.col("options_text"))).drop("_l")


def with_features(records: DataFrame, features: DataFrame, by: list[str], path: str = "image_path") -> DataFrame:
    """Rejects accepted records whose feature file isn't listed, and adds new_path, its flattened name.
    features: the columns of ``by`` and path; repeated listings count once."""
    keys = [*by, path]
    listed = features.select(*keys).distinct().withColumn("_there", F.lit(True))
    out = records.join(listed, keys, "left")
    missing = F.when(F.col("_there").isNull(), F.concat(F.lit("feature file not found: "), F.coalesce(path, F.lit(""))))
    out = out.withColumn("reject_reason", F.coalesce("reject_reason", missing))
    return out.withColumn("new_path", F.concat(F.lit("features/"), F.concat_ws("_", *by, F.regexp_replace(path, "^.*/", "")))).drop("_there")


def conversation(question: Column, options: Column, answer: Column) -> Column:
    human = F.concat(F.lit(IMAGE_TAG + "\n"), F.coalesce(question, F.lit("")), F.when(options != "", F.concat(F.lit("\n"), options)).otherwise(""))
    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    return F.array(turn("human", human), turn("gpt", answer))


def conversations(records: DataFrame, session: str | None = "session") -> DataFrame:
    """id, image, conversations, info of the accepted records. With a session, ids carry its name."""
    own = F.coalesce("qa_id", "id") if session else F.coalesce("id", "qa_id", F.lit(""))
    name = F.concat_ws("_", F.col(session), own) if session else own
    info = F.to_json(F.map_filter(F.create_map(*[x for k in INFO_KEYS for x in (F.lit(k), F.col(k))]), lambda k, v: v.isNotNull()))
    image = F.col("new_path") if "new_path" in records.columns else F.coalesce("image_path", "image")
    return records.where("reject_reason is null").select(name.alias("id"), image.alias("image"), conversation(F.col("question"), F.col("options_text"), F.col("answer_text")).alias("conversations"), info.alias("info"))


def rejects(records: DataFrame) -> DataFrame:
    return records.where("reject_reason is not null")


def conversion_stats(records: DataFrame) -> DataFrame:
    """One row: total, success, filtered, success_rate (percent)."""
    out = records.agg(F.count("*").alias("total"), F.count_if(F.col("reject_reason").isNull()).alias("success"), F.count_if(F.col("reject_reason").isNotNull()).alias("filtered"))
    return out.withColumn("success_rate", F.coalesce(F.try_divide(100 * F.col("success"), F.col("total")), F.lit(0.0)))


def to_inference(rows: DataFrame) -> DataFrame:
    """question_id, image, question (without image tag), answer, info."""
    value = lambda i: F.coalesce(F.get("conversations", i)["value"], F.lit(""))
    return rows.select(F.col("id").alias("question_id"), "image", F.trim(F.replace(value(0), F.lit(IMAGE_TAG), F.lit(""))).alias("question"), value(1).alias("answer"), "info")


def caption_fields(clusters: int = 3, magnifications: tuple[int, ...] = (10, 20)) -> list[tuple[str, str, str]]:
    """(summary key, image key, id suffix) of a session's captions, in order."""
    out = [("wsi_summary", "wsi_thumbnail_path", "")]
    for k in range(clusters):
        out.append((f"cluster_{k}_summary", f"cluster_{k}_image_path", f"_cluster_{k}"))
        out += [(f"cluster_{k}_roi_{m}x_summary", f"cluster_{k}_roi_{m}x_image_path", f"_cluster_{k}_{m}x") for m in magnifications]
    return out


def caption_conversations(sessions: DataFrame, prompt: str = "Describe this image.", clusters: int = 3) -> DataFrame:
    """sessions: session, fields (map of text). A conversation for each summary whose image is named."""
    pairs = F.array(*[F.struct(F.col("fields")[s].alias("summary"), F.col("fields")[i].alias("image"), F.lit(x).alias("suffix")) for s, i, x in caption_fields(clusters)])
    rows = sessions.select("session", F.coalesce(F.col("fields")["wsi_id"], F.lit("unknown")).alias("wsi_id"), F.inline(pairs)).where("summary is not null and image is not null")
    return rows.select(F.concat("session", F.lit("_"), "wsi_id", "suffix").alias("id"), "image", conversation(F.lit(prompt), F.lit(""), F.col("summary")).alias("conversations"), F.lit("{}").alias("info"))


def replace_paths(rows: DataFrame, paths: DataFrame, column: str) -> DataFrame:
    """Replaces image paths by feature paths where the map (image_path, feature_path) has one."""
    named = paths.select(F.col("image_path").alias(column), "feature_path").dropDuplicates([column])
    return rows.join(named, column, "left").withColumn(column, F.coalesce("feature_path", column)).select(*rows.columns)


def replace_in_session(sessions: DataFrame, paths: DataFrame) -> DataFrame:
    """The same for all values of a session's fields: exploded, joined and gathered again."""
    rows = sessions.select("session", F.explode("fields").alias("key", "value"))
    return replace_paths(rows, paths, "value").groupBy("session").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("fields"))


def referenced_images(rows: DataFrame) -> DataFrame:
    return rows.select("image").where("image is not null").distinct().orderBy("image")


def union_levels(*frames: tuple[str, DataFrame]) -> DataFrame:
    """Rows of all levels, tagged with belong_level; missing columns become null."""
    out = None
    for level, df in frames:
        tagged = df.withColumn("belong_level", F.lit(level))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
