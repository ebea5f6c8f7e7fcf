"""Benchmark decontamination: which documents contain which benchmark items.

Containment MinHash. Items are partitioned by size (distinct 5-word shingles, powers of two). An item's
signature is its smallest shingle hashes, as many as its partition needs for this promise: a document that
contains ``percent`` of the item's shingles holds at least ``hits`` of the signature, whatever shingles it
lacks (each lacking shingle can take away one signature member at most). So the search misses nothing,
and the long document side is only probed, never sketched. Candidates are verified by the exact shingles,
as strings. All of it is DataFrame functions.

Defined results: words are `[^\\x20\\x09-\\x0D]+` of the text with all letters in lower case, not A-Z alone; with
fewer than five words the whole sequence is the one shingle. Such an item is in a document if its words stand there one
after another, so documents are also cut to runs of as many words as such items have (no further runs if there are no
such items). Null or word-less texts hold none and match nothing. Rows with the same doc_id (or item_id) are one
document (item); rows without an id are not reported, but clean_documents judges them by their text. Empty tables
give no rows. Texts are never cut. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slideqa.llm.tables import Saved, table

PERCENT, SHINGLE = 75, 5
#: Words from which an item inside a longer document removes it.
LEAST_INSIDE = 3
#: Signature members beyond the least number: more of them must be hit, so fewer false candidates arise.
SPARE = 4
#: Rows up to which a side is broadcast: about 40 MB of hashes or 200 MB of shingle strings at most.
BROADCAST_ROWS = 1_000_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text.cast("string")), r"[\x20\x09-\x0D]+"), "")


def _windows(w: Column, of: Callable[[list[Column]], Column], shorter: Sequence[int] = ()) -> Column:
    """``of`` the words of each 5-word window, of a shorter text all its words, and of the windows of ``shorter``
    lengths. ``of`` takes five words; those that a window lacks are null."""

    def runs(n: int) -> Column:
        blank = [F.lit(None).cast("string")] * (SHINGLE - n)
        return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(0))), lambda x, i: of([x, *(F.get(w, i + k) for k in range(1, n)), *blank]))

    whole = F.array(of([F.get(w, F.lit(k)) for k in range(SHINGLE)]))
    own = F.when(F.size(w) >= SHINGLE, runs(SHINGLE)).when(F.size(w) > 0, whole)
    return F.concat(own, *map(runs, shorter)) if shorter else own


def _hashed(df: DataFrame, id_col: str, text_col: str, shorter: Sequence[int] = ()) -> DataFrame:
    """id, h: the hashes of a text's shingles, repeated ones included."""
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), _words(F.col(text_col)).alias("w"))
    return rows.select("id", F.explode(_windows(F.col("w"), lambda ws: F.xxhash64(*ws), shorter)).alias("h"))


def _grams(df: DataFrame, id_col: str, text_col: str, shorter: Sequence[int] = ()) -> DataFrame:
    """id, h, gram: hashes and words of a text's shingles."""
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), _words(F.col(text_col)).alias("w"))
    return rows.select("id", F.inline(_windows(F.col("w"), lambda ws: F.struct(F.xxhash64(*ws).alias("h"), F.concat_ws(" ", *ws).alias("gram")), shorter)))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contained_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = PERCENT, least_inside: int = 1) -> DataFrame:
    """doc_id, item_id, n_item (the item's shingles), n_shared (those in the document), containment: a row
    for each pair with 100 * n_shared >= percent * n_item. Items of fewer than ``least_inside`` words are found as
    whole texts only."""
    grams = Saved(_grams(items, item_id, item_text).withColumnRenamed("id", "item_id").distinct(), "items")
    sizes = grams.df.groupBy("item_id").agg(F.count("*").alias("n_item"))
    # size partitions: `upper` is the largest size of the item's partition
    upper = F.pow(F.lit(2.0), F.ceil(F.log2("n_item"))).cast("long")
    needed = F.ceil(F.col("n_item") * percent / 100).cast("long")
    sizes = sizes.withColumn("length", F.least("n_item", upper - F.ceil(upper * percent / 100).cast("long") + 1 + SPARE)).withColumn("hits", F.col("length") - (F.col("n_item") - needed))
    members = grams.df.groupBy("item_id").agg(F.array_sort(F.collect_set("h")).alias("hs")).join(sizes, "item_id")
    signatures = Saved(members.select("item_id", "n_item", "hits", F.explode(F.slice("hs", F.lit(1), F.col("length").cast("int"))).alias("h")), "signatures")
    n_signatures, n_grams = signatures.df.count(), grams.df.count()
    lengths = grams.df.select(F.size(F.split("gram", " ")).alias("n")).where(f"n < {SHINGLE} and n >= {least_inside}").distinct()
    shorter = sorted(r.n for r in lengths.collect())

    probes = _hashed(docs, doc_id, doc_text, shorter).withColumnRenamed("id", "doc_id")
    met = probes.join(_small(signatures.df, n_signatures), "h").groupBy("doc_id", "item_id", "n_item", "hits").agg(F.count_distinct("h").alias("found"))
    candidates = Saved(met.where("found >= hits").select("doc_id", "item_id", "n_item"), "candidates")

    n_candidates = candidates.df.count()
    ids = candidates.df.select(F.col("doc_id").alias("id")).distinct()
    some = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(doc_text).alias("text")).join(_small(ids, n_candidates), "id", "left_semi")
    held = _grams(some, "id", "text", shorter).select(F.col("id").alias("doc_id"), "gram")
    shared = held.join(_small(grams.df.select("item_id", "gram").distinct(), n_grams), "gram").join(_small(candidates.df, n_candidates), ["doc_id", "item_id"])
    counted = shared.groupBy("doc_id", "item_id", "n_item").agg(F.count_distinct("gram").alias("n_shared"))
    shared = counted.where(f"100 * n_shared >= {percent} * n_item").select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    out = Saved(shared, "contained")
    for x in (grams, signatures, candidates):
        x.drop()
    return out.df


def clean_documents(docs: DataFrame, items: DataFrame, percent: int = PERCENT, least_inside: int = LEAST_INSIDE) -> DataFrame:
    """docs without those that contain an item; their columns and rows otherwise as they are. All rows of a doc_id
    go if one of them does; rows without a doc_id are judged by their own text. Items of one or two words stand in
    ordinary prose, so by default only documents that are nothing else go for them."""
    hit = contained_items(docs, items, percent=percent, least_inside=least_inside).select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(_small(hit, hit.count()), "doc_id", "left_anti").select(*docs.columns)
    nameless = docs.where("doc_id is null")
    if nameless.isEmpty():
        return named
    by_text = nameless.select(F.xxhash64("text").alias("doc_id"), "text")
    hit = contained_items(by_text, items, percent=percent, least_inside=least_inside).select(F.col("doc_id").alias("of_text")).distinct()
    return named.unionByName(nameless.join(_small(hit, hit.count()), F.xxhash64("text") == F.col("of_text"), "left_anti").select(*docs.columns))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH t AS (SELECT 0 AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents
           UNION ALL SELECT 1, item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') FROM benchmark),
g AS (SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM t
      UNION SELECT kind, id, unnest([array_to_string(w[i:i+k-1], ' ') FOR i IN range(1, len(w) - k + 2)])
      FROM t, (SELECT DISTINCT len(w) AS k FROM t WHERE kind = 1 AND len(w) BETWEEN 1 AND 4) WHERE kind = 0 AND len(w) >= k),
n AS (SELECT id, count(*) AS n FROM g WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, n.n AS n_item, count(*) AS n_shared, count(*) / n.n AS containment
FROM g d JOIN g b ON d.s = b.s AND d.kind = 0 AND b.kind = 1 JOIN n ON n.id = b.id
GROUP BY d.id, b.id, n.n HAVING 100 * count(*) >= 75 * n.n
"""
