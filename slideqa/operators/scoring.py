"""Evaluation of predictions: task types, per-row scores, means, breakdowns, judge summaries, leaderboards."""

from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slideqa.functions.choices import choice_match, graded_score
from slideqa.functions.text_scores import meteor, rouge_l


def task_type(kind: Column, has_options: Column) -> Column:
    """choice or open_ended, by the format, or else by whether there are options."""
    k = F.lower(F.coalesce(kind, F.lit("")))
    return F.when(k.isin("single", "multi"), "choice").when(k.isin("open", "open-ended", "freeform"), "open_ended").when(has_options, "choice").otherwise("open_ended")


def score_choices(results: DataFrame, fold: bool = False, ordered: bool = False) -> DataFrame:
    """Adds exact_match, pred_letters, ref_letters and the graded score."""
    out = results.withColumn("_m", choice_match(F.col("prediction"), F.col("ground_truth"), fold, ordered)).select("*", "_m.exact_match", "_m.pred_letters", "_m.ref_letters").drop("_m")
    return out.withColumn("score", graded_score(F.col("format"), F.col("pred_letters"), F.col("ref_letters"), F.col("exact_match")))


def evenly_dealt(rows: DataFrame, cost: Column, tasks: int, key: str = "question_id") -> DataFrame:
    """The rows in ``tasks`` partitions of about the same cost. Rows of more than a fortieth of a task's share, forty a
    task at most, are placed one by one, the costliest first, where least is; the many others go by a hash of the key."""
    costs = rows.select(F.col(key).alias("key"), cost.alias("cost"))
    total = costs.agg(F.sum("cost")).first()[0] or 0
    heavy = costs.where(F.col("cost") > total / (40 * tasks)).groupBy("key").agg(F.sum("cost").alias("cost")).collect()
    filled = [((total - sum(r.cost for r in heavy)) / tasks, i) for i in range(tasks)]
    placed = []
    for r in sorted(heavy, key=lambda r: (-r.cost, str(r.key))):
        load, i = heapq.heappop(filled)
        heapq.heappush(filled, (load + r.cost, i))
        placed.append((r.key, i))
    bins = F.broadcast(rows.sparkSession.createDataFrame(placed, rows.select(F.col(key).alias(key), F.lit(0).alias("_bin")).schema))
    out = rows.join(bins, key, "left").withColumn("_bin", F.coalesce("_bin", F.pmod(F.xxhash64(key), F.lit(tasks)).cast("int")))
    return out.select(*rows.columns, "_bin").repartitionById(tasks, F.col("_bin")).drop("_bin")


def score_texts(results: DataFrame, chunk: int | None = None) -> DataFrame:
    """Adds ROUGE-L and METEOR columns. Rows whose texts differ much in length can be dealt to ``chunk`` tasks first,
    by cost: linear in the characters, and their product where texts are long."""
    p, r = F.col("prediction"), F.col("ground_truth")
    n, m = (F.coalesce(F.length(c), F.lit(0)) for c in (p, r))
    rows = evenly_dealt(results, n + m + n * m.cast("double") / 50_000 + 1, chunk) if chunk else results
    return rows.withColumn("_r", rouge_l(p, r)).withColumn("_m", meteor(p, r)).select("*", "_r.*", "_m.*").drop("_r", "_m")


def choice_accuracy(scored: DataFrame) -> DataFrame:
    """One row: correct, total, accuracy (0 where there is nothing)."""
    return scored.agg(F.count_if("exact_match").alias("correct"), F.count("*").alias("total"), F.coalesce(F.avg(F.col("exact_match").cast("int")), F.lit(0.0)).alias("accuracy"))


def text_means(scored: DataFrame) -> DataFrame:
    """One row: the mean of each text score (0 where there is nothing). precision and recall are METEOR's."""
    names = ["rouge_l_precision", "rouge_l_recall", "rouge_l_fmeasure", "meteor_score", "precision", "recall", "fmean", "penalty"]
    return scored.agg(F.count("*").alias("total"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names])


def has_options(results: DataFrame) -> Column:
    """Whether a row carries options or choices; tables may lack either column."""
    given = [F.col(c).isNotNull() for c in ("options", "choices") if c in results.columns]
    return reduce(lambda a, b: a | b, given, F.lit(False))


def evaluate(results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Choice details, open-text details, and a long table (group_type, group_key, metric, value). Rows without a
    known format are choices where they have options or choices."""
    typed = results.withColumn("task_type", task_type(F.col("format"), has_options(results)))
    choices = score_choices(typed.where("task_type = 'choice'"))
    texts = score_texts(typed.where("task_type = 'open_ended'"))
    long = lambda df, kind: df.unpivot([], df.columns, "metric", "value").select(F.lit("task_type").alias("group_type"), F.lit(kind).alias("group_key"), "metric", F.col("value").cast("double").alias("value"))
    as_double = lambda df: df.select(*[F.col(c).cast("double").alias(c) for c in df.columns])
    return choices, texts, long(as_double(choice_accuracy(choices)), "choice").unionByName(long(as_double(text_means(texts)), "open_ended"))


def major_category(subcategory: Column) -> Column:
    return F.substring_index(subcategory, ".", 1)


def score_breakdown(scored: DataFrame) -> DataFrame:
    """group_type, group_key, group_key2, total, score, accuracy (percent) over seven groupings.

    Rows are summed on the finest key first, so the grouping sets expand a few hundred rows, not the corpus.
    """
    unknown = lambda c: F.coalesce(F.col(c), F.lit("unknown")).alias(c)
    fine = scored.select(unknown("subcategory"), unknown("format"), unknown("belong_level"), "score")
    fine = fine.groupBy("subcategory", "format", "belong_level").agg(F.count("*").alias("n"), F.sum("score").alias("s"))
    fine = fine.withColumn("major", major_category(F.col("subcategory")))
    keys = ["subcategory", "format", "major", "belong_level"]
    sets = [[], ["subcategory"], ["format"], ["major"], ["major", "belong_level"], ["major", "format"], ["belong_level"]]
    out = fine.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(F.sum("n").alias("total"), F.sum("s").alias("score"), *[F.grouping(c).alias(f"g_{c}") for c in keys])
    used = {c: F.col(f"g_{c}") == 0 for c in keys}
    kind = F.when(used["major"] & used["belong_level"], "major_level").when(used["major"] & used["format"], "major_format").when(used["major"], "major_category")
    kind = kind.when(used["subcategory"], "subcategory").when(used["format"], "format").when(used["belong_level"], "belong_level").otherwise("total")
    first = F.when(used["major"], F.col("major")).when(used["subcategory"], F.col("subcategory")).when(used["format"], F.col("format")).when(used["belong_level"], F.col("belong_level")).otherwise("all")
    second = F.when(used["major"] & used["belong_level"], F.col("belong_level")).when(used["major"] & used["format"], F.col("format")).otherwise("")
    return out.select(kind.alias("group_type"), first.alias("group_key"), second.alias("group_key2"), "total", "score", (100 * F.col("score") / F.col("total")).alias("accuracy"))


def ordered_report(report: DataFrame) -> DataFrame:
    """A report by its group's type and keys: a few rows, in the order they are printed in."""
    return report.orderBy(*[c for c in ("group_type", "group_key", "group_key2") if c in report.columns])


def judge_rows(results: DataFrame, precision: str = "precision", relevance: str = "relevance") -> DataFrame:
    """Adds wsi_precision, wsi_relevance (rounded to 4; 0 where a text is missing) and wsi_eval_error."""
    given = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    both = given("prediction") & given("ground_truth")
    value = lambda c: F.when(both, F.round(F.coalesce(F.col(c), F.lit(0.0)), 4)).otherwise(0.0)
    return results.withColumns({"wsi_precision": value(precision), "wsi_relevance": value(relevance), "wsi_eval_error": F.when(both, "").otherwise("missing prediction or ground_truth")})


def judge_summary(judged: DataFrame) -> DataFrame:
    """group_type (overall, focus, subcategory), group_key, count and the means rounded to 4, in one pass."""
    rows = judged.select(*[F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in ("focus", "subcategory")], "wsi_precision", "wsi_relevance")
    out = rows.groupingSets([[], [F.col("focus")], [F.col("subcategory")]], "focus", "subcategory").agg(F.count("*").alias("count"), F.round(F.avg("wsi_precision"), 4).alias("wsi_precision_mean"), F.round(F.avg("wsi_relevance"), 4).alias("wsi_relevance_mean"), F.grouping("focus").alias("g1"), F.grouping("subcategory").alias("g2"))
    kind = F.when(F.col("g1") == 0, "focus").when(F.col("g2") == 0, "subcategory").otherwise("overall")
    return out.select(kind.alias("group_type"), F.when(F.col("g1") == 0, F.col("focus")).when(F.col("g2") == 0, F.col("subcategory")).otherwise("all").alias("group_key"), "count", "wsi_precision_mean", "wsi_relevance_mean")


def leaderboard(values: DataFrame, top: int = 2) -> DataFrame:
    """(model, metric, value) -> the ``top`` ranks of each metric, ties sharing a rank."""
    w = Window.partitionBy("metric").orderBy(F.desc("value"))
    return values.withColumn("rank", F.dense_rank().over(w)).where(F.col("rank") <= top)


def named_subcategories(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Adds the name of each subcategory code and its major category. names: subcategory, name; a code list."""
    return rows.join(names, "subcategory", "left").withColumn("major", major_category(F.col("subcategory")))


def category_shares(rows: DataFrame) -> DataFrame:
    """(category, subcategory) -> count, total of the category, share in percent."""
    w = Window.partitionBy("category")
    out = rows.groupBy("category", "subcategory").agg(F.count("*").alias("count"))
    return out.withColumn("category_total", F.sum("count").over(w)).withColumn("share", 100 * F.col("count") / F.col("category_total"))


def remaining(questions: DataFrame, answered: DataFrame) -> DataFrame:
    """The questions whose question_id has no answer yet."""
    return questions.join(answered.select("question_id").distinct(), "question_id", "left_anti")


def resumed(questions: DataFrame, answered: DataFrame, score) -> DataFrame:
    """Old answers and those of the remaining questions, as ``score`` gives them."""
    return answered.unionByName(score(remaining(questions, answered)), allowMissingColumns=True)


def relational_meteor(results: DataFrame) -> DataFrame:
    """question_id, matches, chunks, from word rows: the k-th of a word meets the k-th of it on the other
    side; a chunk ends where either place doesn't go up by one. The check of the vectorised form."""
    word = lambda c: F.filter(F.split(F.lower(F.col(c)), r"[^\p{L}\p{N}'-]+"), lambda x: x != "")
    side = lambda c, i: results.select("question_id", F.posexplode(word(c)).alias(i, "t")).withColumn("k", F.row_number().over(Window.partitionBy("question_id", "t").orderBy(i)))
    met = side("prediction", "p").join(side("ground_truth", "r"), ["question_id", "t", "k"])
    w = Window.partitionBy("question_id").orderBy("p")
    starts = (F.col("p") != F.lag("p").over(w) + 1) | (F.col("r") != F.lag("r").over(w) + 1) | F.lag("p").over(w).isNull()
    return met.withColumn("s", starts).groupBy("question_id").agg(F.count("*").alias("matches"), F.count_if("s").alias("chunks"))
