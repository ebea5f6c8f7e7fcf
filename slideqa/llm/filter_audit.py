"""What filters cost in every order: for each part of a corpus, each order of five filters and each step, how many
documents go there, and what would have gone anyway.

A document is reduced to a mask of the filters that it fails. Documents are counted by (part, mask), at most 32 cells a
part. Each cell is folded over the array of all 120 orders, which is a literal of fixed size in the plan: ``aggregate``
walks an order, ``transform`` all of them, and 600 structs of counts come out. The structs of a part's cells are
summed element by element, and so are an element's filters over all orders (the Shapley sums).

Words and characters are counted by built-in functions over whole texts. Copies are found by SHA-256 of the text: the
smallest doc_id of each digest is joined back by (doc_id, digest), so a text that a third of all rows share isn't a
hot key.

Defined results: a null text is an empty one, a null part an empty string. A row without doc_id has no smaller
doc_id beside it and is none: it neither repeats nor is repeated, and has no labels. Rows of one doc_id and one text
don't repeat each other. A document is good (toxic) if any label row of its doc_id says so. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slideqa.llm.tables import Saved, table

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
SYMBOLS = "[#$%&*|]"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
_SPACE = "[ \\t-\\r]+"


def orders() -> list[str]:
    """All orders of the filters, sorted."""
    return ["".join(p) for p in permutations(FILTERS)]


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A, B, C and D. Word arrays are let go before the next row."""
    words = F.array_remove(F.split(text, _SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * F.length(text), F.rlike(text, F.lit(SYMBOLS))]


def _mask(failures: list[Column]) -> Column:
    out = F.lit(0)
    for i, f in enumerate(failures):
        out = out + F.when(f, 1 << i).otherwise(0)
    return out


def masks(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """part, mask (bit i: fails the i-th filter), good, toxic: a row per row of docs."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    narrow = Saved(rows.select("doc_id", "part", _mask(text_failures(F.col("text"))).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "masks").df
    named = narrow.where("doc_id is not null")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    copy = F.when(F.col("_first"), 0).otherwise(1 << FILTERS.index("E"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    judged = named.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left").select("part", (F.col("mask") + copy).alias("mask"), flag("good"), flag("toxic"))
    nameless = narrow.where("doc_id is null").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return judged.unionByName(nameless)


def _every_order() -> Column:
    return F.split(F.lit(",".join(orders())), ",")


def _bit(letter: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), F.instr(F.lit(FILTERS), letter) - 1)


def _folded(mask: Column, n: Column, good: Column, toxic: Column) -> Column:
    """600 structs of counts of one cell: the steps of each order, one order after the other."""
    none, zero = F.array().cast(f"array<struct<{', '.join(f'{c}: bigint' for c in COUNTS)}>>"), F.lit(0).cast("long")

    def step(state: Column, letter: Column) -> Column:
        bit = _bit(letter)
        fails, here = mask.bitwiseAND(bit) != 0, state["alive"]
        now = fails & here
        values = [F.when(here & ~fails, n).otherwise(zero), F.when(now, n).otherwise(zero), F.when(fails & ~here, n).otherwise(zero), F.when(mask == bit, n).otherwise(zero), F.when(now, good).otherwise(zero), F.when(now, toxic).otherwise(zero)]
        return F.struct((here & ~fails).alias("alive"), F.concat(state["out"], F.array(F.struct(*[v.alias(c) for v, c in zip(values, COUNTS, strict=True)]))).alias("out"))

    walk = lambda order: F.aggregate(F.split(order, ""), F.struct(F.lit(True).alias("alive"), none.alias("out")), step, lambda s: s["out"])
    return F.flatten(F.transform(_every_order(), walk))


def audit(cells: DataFrame) -> DataFrame:
    """cells: part, mask, n, good, toxic (counts) -> 600 rows a part. A part has 32 cells at most, so what meets in
    one row is bounded."""
    folded = cells.select("part", _folded(F.col("mask"), F.col("n"), F.col("good"), F.col("toxic")).alias("steps"))
    gathered = folded.groupBy("part").agg(F.collect_list("steps").alias("all"))
    add = lambda a, b: F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS])
    summed = gathered.select("part", F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.element_at("all", 1), lambda s, x: F.zip_with(s, x, add)).alias("steps"))
    of = lambda order: F.transform(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda i: F.struct(order.alias("filter_order"), i.alias("step"), F.substring(order, i, F.lit(1)).alias("filter")))
    names = F.flatten(F.transform(_every_order(), of))
    rows = summed.select("part", F.inline(F.zip_with(names, F.col("steps"), lambda a, b: F.struct(a["filter_order"].alias("filter_order"), a["step"].alias("step"), a["filter"].alias("filter"), *[b[c].alias(c) for c in COUNTS]))))
    shapley = rows.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return rows.join(shapley, ["part", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley", "filter")


def filter_audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, the counts, shapley, filter. See the module for what is counted."""
    count = lambda c: F.count_if(F.col(c)).alias(c)
    cells = masks(docs, labels, part_col).groupBy("part", "mask").agg(F.count("*").alias("n"), count("good"), count("toxic"))
    return audit(cells)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
        'C': 100 * len(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * len(text),
        'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(w.doc_id > first, false)} AS fails,
        coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, [x.key for x in map_entries(map {'A': fails.A, 'B': fails.B, 'C': fails.C, 'D': fails.D, 'E': fails.E}) if x.value] AS bad, good, toxic FROM f),
c AS (SELECT part, bad, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step::INTEGER AS step, filter_order[step] AS filter, string_split(filter_order[1:step - 1], '') AS before FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5),
r AS (SELECT part, filter_order, step, filter,
        coalesce(sum(n) FILTER (NOT list_has_any(bad, list_append(before, filter))), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (list_contains(bad, filter) AND NOT list_has_any(bad, before)), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (list_contains(bad, filter) AND list_has_any(bad, before)), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (bad = [filter]), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (list_contains(bad, filter) AND NOT list_has_any(bad, before)), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (list_contains(bad, filter) AND NOT list_has_any(bad, before)), 0)::BIGINT AS toxic_lost
    FROM c, s GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
"""
