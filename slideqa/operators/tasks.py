"""Prompt tasks from images, joining model output back, context, nested assembly, counts, job status, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slideqa.functions.llm_text import parsed_json, qa_items, stable_id

#: Task codes by level.
LEVEL_CODES = {"WSI": ["1.1", "1.2", "2.1", "2.4"], "Cluster": ["1.2", "1.3", "2.1", "2.2"], "ROI": ["1.3", "1.4", "2.1", "2.2", "2.3"]}
#: Prompts per code by format; difficulties and question formats.
RATIO = {"single": 2, "multi": 1, "caption": 2}
DIFFICULTIES, QUESTION_FORMATS = ["easy", "medium", "hard"], ["single", "multi"]
#: Category and subcategory by focus.
FOCUS = {
    "architecture": ("Morphological Analysis", "Regional Structure Description"),
    "stroma": ("Morphological Analysis", "Regional Structure Description"),
    "inflammation": ("Morphological Analysis", "Specific Feature Description"),
    "cytology": ("Morphological Analysis", "Specific Feature Description"),
    "necrosis": ("Morphological Analysis", "Specific Feature Description"),
    "nuclear_detail": ("Morphological Analysis", "Specific Feature Description"),
    "macro_architecture": ("Morphological Analysis", "Global Morphology Description"),
    "global_context": ("Morphological Analysis", "Global Morphology Description"),
    "diagnosis": ("Diagnosis", "Histological Typing"),
}
#: Least sizes of a session's outputs, kinds of question blocks.
LEAST_BYTES = {"inference_results.json": 100, "vqa.jsonl": 50}
QA_KINDS = ["qa_single_choice", "qa_multiple_choice", "caption_qa"]

#: Values from which the bounds of ranges are taken, and bounds a task, at most: a range holds a thousandth of a task's values.
RANK_SAMPLE, RANK_RANGES = 20_000, 1000


def _literal(rows: list[dict]):
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows])


def expand_tasks(images: DataFrame) -> DataFrame:
    """image rows (level) to prompt tasks: code, format, copy; narrow, as prompts are rendered last."""
    by_level = None
    for level, codes in LEVEL_CODES.items():
        rows = _literal([{"code": c, "format": f, "copy": i} for c in codes for f, n in RATIO.items() for i in range(1, n + 1)])
        by_level = F.when(F.col("level") == level, rows) if by_level is None else by_level.when(F.col("level") == level, rows)
    return images.select("*", F.inline(by_level)).withColumn("task_id", stable_id(F.col("image"), F.col("code"), F.col("format"), F.col("copy").cast("string"), prefix="task_"))


def expand_difficulties(images: DataFrame) -> DataFrame:
    """Seven tasks per image: each difficulty with each question format, and one caption."""
    rows = _literal([*({"difficulty": d, "format": f} for d in DIFFICULTIES for f in QUESTION_FORMATS), {"difficulty": "none", "format": "caption"}])
    return images.select("*", F.inline(rows))


def render_prompts(tasks: DataFrame, templates: DataFrame, fields: list[str]) -> DataFrame:
    """Adds prompt: the template of (code, format) with {name} replaced by the named columns."""
    out = tasks.join(templates, ["code", "format"], "left")
    prompt = F.col("template")
    for f in fields:
        prompt = F.replace(prompt, F.lit("{" + f + "}"), F.coalesce(F.col(f).cast("string"), F.lit("N/A")))
    return out.withColumn("prompt", prompt).drop("template")


def attach_outputs(tasks: DataFrame, outputs: DataFrame) -> DataFrame:
    """A row per question or caption of each task's output (task_id, text); failed tasks give none."""
    # sizes are estimated as if generators made no rows, so expanded tasks look small enough to broadcast: they are sorted and merged
    rows = tasks.join(outputs.hint("merge"), "task_id")
    # generators keep the optimizer from repeating these large expressions wherever they are used
    rows = rows.select(*tasks.columns, F.inline(F.array(parsed_json(F.col("text")))))
    rows = rows.select(*tasks.columns, F.inline(F.array(F.struct(qa_items(F.col("json")).alias("_i")))))
    rows = rows.select(*tasks.columns, F.posexplode("_i").alias("position", "item"))
    return rows.withColumn("id", stable_id(F.col("task_id"), F.col("position").cast("string")))


def with_context(regions: DataFrame, clusters: DataFrame, slides: DataFrame) -> DataFrame:
    """Region rows with their cluster's and slide's summaries."""
    c = clusters.select("slide_id", "cluster_id", F.col("summary").alias("cluster_summary"))
    s = slides.select("slide_id", F.col("summary").alias("slide_summary"))
    return regions.join(c, ["slide_id", "cluster_id"], "left").join(s, "slide_id", "left")


def gathered_texts(regions: DataFrame) -> DataFrame:
    """slide_id, cluster_id, texts: 'Mag {m}x: text' by magnification, parted by blank lines."""
    rows = F.array_sort(F.collect_list(F.struct("magnification", "text")))
    line = lambda r: F.concat(F.lit("Mag "), r["magnification"].cast("string"), F.lit("x: "), r["text"])
    return regions.groupBy("slide_id", "cluster_id").agg(rows.alias("r")).select("slide_id", "cluster_id", F.array_join(F.transform("r", line), "\n\n").alias("texts"))


def nested(slides: DataFrame, clusters: DataFrame, regions: DataFrame) -> DataFrame:
    """One row per slide with its clusters and their regions, in name order: a sink format."""
    r = regions.groupBy("slide_id", "cluster_id").agg(F.array_sort(F.collect_list(F.struct("magnification", "text"))).alias("rois"))
    c = clusters.join(r, ["slide_id", "cluster_id"], "left").groupBy("slide_id").agg(F.array_sort(F.collect_list(F.struct("cluster_id", F.col("summary").alias("cluster_summary"), "rois"))).alias("clusters"))
    return slides.join(c, "slide_id", "left")


def qa_counts(integrated: DataFrame, strict_keys: bool = False) -> DataFrame:
    """kind, count over slides, clusters and regions. integrated: wsi_results (map kind -> map), clusters
    (array of structs qa: map kind -> map, rois: array of such maps). strict_keys leaves out cluster blocks
    under prefixed names."""
    one = lambda block, kind: F.coalesce(F.size(F.map_keys(block[kind])), F.lit(0))
    rows = integrated.select("wsi_results", F.explode_outer("clusters").alias("c"))

    def inside(kind: str):
        own = one(F.col("c.qa"), kind) + (F.lit(0) if strict_keys else one(F.col("c.qa"), "cluster_" + kind))
        rois = F.aggregate(F.transform("c.rois", lambda r: one(r, kind)), F.lit(0), lambda a, x: a + x)
        return (own + F.coalesce(rois, F.lit(0))).alias(kind)

    inner = rows.select(*[inside(k) for k in QA_KINDS])
    outer = integrated.select(*[one(F.col("wsi_results"), k).alias(k) for k in QA_KINDS])
    total = outer.unionByName(inner).agg(*[F.sum(k).alias(k) for k in QA_KINDS])
    return total.unpivot([], QA_KINDS, "kind", "count")


def image_counts(listing: DataFrame) -> DataFrame:
    """kind (thumbnail, cluster, roi), count from a listing of paths."""
    p = F.col("path")
    kind = F.when(F.rlike(p, F.lit("(^|/)thumbnail\\.png$")), "thumbnail").when(p.endswith(".png") & p.contains("/clusters/"), "cluster").when(p.endswith(".png") & p.contains("/rois/"), "roi")
    return listing.withColumn("kind", kind).where("kind is not null").groupBy("kind").agg(F.count("*").alias("count"))


def focus_categories(rows: DataFrame) -> DataFrame:
    """Adds category and subcategory of the focus; rows of other focuses are left out."""
    m = lambda i: F.create_map(*[F.lit(x) for k, v in FOCUS.items() for x in (k, v[i])])
    return rows.withColumns({"category": m(0)[F.col("focus")], "subcategory": m(1)[F.col("focus")]}).where("category is not null")


def incomplete_sessions(listing: DataFrame) -> DataFrame:
    """session, reason: outputs that are missing or too small. listing: session, path, size."""
    name = F.regexp_replace("path", "^.*/", "")
    ok = {f: F.max(F.when((name == f) & (F.col("size") >= n), 1).otherwise(0)) for f, n in LEAST_BYTES.items()}
    rows = listing.groupBy("session").agg(*[v.alias(f"k{i}") for i, v in enumerate(ok.values())])
    why = F.concat_ws("; ", *[F.when(F.col(f"k{i}") == 0, f"{f} missing or too small") for i, f in enumerate(ok)])
    return rows.withColumn("reason", why).where("reason <> ''").select("session", "reason")


def pending_slides(candidates: DataFrame, status: DataFrame, target: int) -> DataFrame:
    """The first candidates in name order that are neither completed nor skipped, as many as the target lacks."""
    done = status.where("status = 'completed'").select("slide_id").distinct().count()
    rest = candidates.join(status.where("status in ('completed', 'skipped')").select("slide_id").distinct(), "slide_id", "left_anti")
    return rest.orderBy("slide_id").limit(max(0, target - done))


def incomplete_variants(listing: DataFrame, slides: DataFrame, suffixes: list[str]) -> DataFrame:
    """slide_id, missing: slides that lack some of their variant files (base, suffix), and which."""
    every = F.array_sort(F.array(*[F.lit(s) for s in suffixes]))
    have = listing.where(F.col("suffix").isin(suffixes)).groupBy(F.col("base").alias("slide_id")).agg(F.collect_set("suffix").alias("have"))
    rows = slides.select("slide_id").join(have, "slide_id", "left").withColumn("missing", F.array_sort(F.array_except(every, F.coalesce("have", F.array().cast("array<string>")))))
    return rows.where(F.size("missing") > 0).select("slide_id", F.array_join("missing", ",").alias("missing"))


def status_rollup(status: DataFrame, target: int, most_failures: int) -> DataFrame:
    """One row: completed, failed, skipped, target_reached, failure_limit_hit."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = status.agg(n("completed"), n("failed"), n("skipped"))
    return out.withColumns({"target_reached": F.col("completed") >= target, "failure_limit_hit": F.col("failed") >= most_failures})


def long_labels(labels: DataFrame, tasks: list[str]) -> DataFrame:
    """id, task, value; nulls are left out."""
    return labels.select("id", *[F.col(t).cast("string").alias(t) for t in tasks]).unpivot(["id"], tasks, "task", "value").where("value is not null")


def value_ranges(values: DataFrame, sample: int = RANK_SAMPLE, ranges: int = RANK_RANGES) -> DataFrame:
    """Adds range, a number that grows with value inside its task. Bounds are taken from the ``sample`` values of the
    smallest hashes, which are the same whenever the plan runs; a task has ``ranges`` bounds at most."""
    some = values.orderBy(F.xxhash64("task", "value"), "task", "value").limit(sample).collect()
    by_task: dict[str, list] = {}
    for r in sorted(some):
        by_task.setdefault(r.task, []).append(r.value)
    bounds = [(t, x[:: -(-len(x) // ranges)]) for t, x in by_task.items()]
    table = values.sparkSession.createDataFrame(bounds, values.select("task", F.array("value").alias("bounds")).schema)
    below = F.size(F.filter(F.coalesce("bounds", F.array().cast(table.schema["bounds"].dataType)), lambda b: b <= F.col("value")))
    return values.join(F.broadcast(table), "task", "left").select(*values.columns, below.alias("range"))


def label_ids(long: DataFrame, sample: int = RANK_SAMPLE, ranges: int = RANK_RANGES) -> DataFrame:
    """Adds label: the value's place among its task's sorted values. Distinct values are dealt to ranges, numbered in
    their range, and moved up by the counts of the ranges before it; no task's values meet in one place."""
    values = value_ranges(long.select("task", "value").distinct(), sample, ranges)
    counts = sorted(map(tuple, values.groupBy("task", "range").agg(F.count("*").alias("n")).collect()))
    before, offsets = {}, []
    for task, place, n in counts:
        offsets.append((task, place, before.get(task, 0)))
        before[task] = before.get(task, 0) + n
    offsets = values.sparkSession.createDataFrame(offsets, values.select("task", "range", F.lit(0).cast("long").alias("offset")).schema)
    inside = F.row_number().over(Window.partitionBy("task", "range").orderBy("value"))
    labels = values.withColumn("inside", inside).join(F.broadcast(offsets), ["task", "range"]).select("task", "value", (F.col("offset") + F.col("inside") - 1).cast("int").alias("label"))
    return long.join(F.broadcast(labels) if sum(before.values()) <= 100_000 else labels, ["task", "value"])


def class_inventory(long: DataFrame) -> DataFrame:
    """task, classes (sorted), n_classes, task_type (binary or multi), width (1 or n). Classes are sorted range by
    range; a task's row, which lists them all, is joined together from the sorted pieces."""
    pieces = value_ranges(long.select("task", "value").distinct()).groupBy("task", "range").agg(F.array_sort(F.collect_list("value")).alias("values"))
    out = pieces.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("range", "values"))).alias("p")).select("task", F.flatten(F.transform("p", lambda x: x["values"])).alias("classes")).withColumn("n_classes", F.size("classes"))
    return out.withColumns({"task_type": F.when(F.col("n_classes") == 2, "binary").otherwise("multi"), "width": F.when(F.col("n_classes") == 2, 1).otherwise(F.col("n_classes"))})


def labelled_in_all(labels: DataFrame, tasks: list[str]) -> DataFrame:
    return labels.dropna(subset=tasks)


def task_accuracy(scores: DataFrame) -> DataFrame:
    """task, total, accuracy: binary by sigmoid > 0.5, others by the largest logit (the first on ties)."""
    binary = (1 / (1 + F.exp(-F.get("logits", 0))) > 0.5).cast("int")
    multi = F.array_position("logits", F.array_max("logits")).cast("int") - 1
    hit = F.when(F.col("task_type") == "binary", binary).otherwise(multi) == F.col("label")
    return scores.groupBy("task").agg(F.count("*").alias("total"), F.avg(hit.cast("int")).alias("accuracy"))
