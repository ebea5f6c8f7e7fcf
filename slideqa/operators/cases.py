"""Case metadata and geometry look-ups by slide: exact by default, substring matching only when asked for."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slideqa.functions.llm_text import ihc_text, ptnm_code

#: Characters of all parts up to which one automaton, about 50 bytes each, is held by every task.
AUTOMATON = 1_000_000


def stem(name: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in source order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def by_stem(slides: DataFrame, cases: DataFrame) -> DataFrame:
    """Left join by the exact stem of img; case_missing tells slides without a case."""
    named = first_by(cases.withColumn("slide_id", stem(F.col("img"))), ["slide_id"], ["position"])
    return slides.join(named, "slide_id", "left").withColumn("case_missing", F.col("img").isNull())


def by_name_or_stem(slides: DataFrame, cases: DataFrame, extension: str = ".svs") -> DataFrame:
    """slide_id, diagnosis: img equals the file name, or its stem is the slide; first match, else N/A."""
    full = cases.select("position", "diagnosis", F.col("img").alias("key"))
    keys = slides.select("slide_id", F.explode(F.array(F.concat("slide_id", F.lit(extension)), F.col("slide_id"))).alias("key"))
    stems = cases.select("position", "diagnosis", stem(F.col("img")).alias("key"))
    met = keys.join(full.unionByName(stems), "key")
    first = met.groupBy("slide_id").agg(F.min(F.struct("position", "diagnosis")).alias("m")).select("slide_id", F.col("m.diagnosis").alias("diagnosis"))
    return slides.join(first, "slide_id", "left").select(*[c for c in slides.columns], F.coalesce("diagnosis", F.lit("N/A")).alias("diagnosis"))


@lru_cache(maxsize=2)
def _automaton(parts: Broadcast):
    """Finds the place of the first of the parts that lies in a name; built once a worker."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, part in enumerate(parts.value):
        if part:
            out.add_word(part, i)
    if len(out):
        out.make_automaton()
    everywhere = parts.value.index("") if "" in parts.value else None
    return out, everywhere


def _first_in(name: str | None, automaton, everywhere: int | None) -> int | None:
    if name is None:
        return None
    found = min((i for _, i in automaton.iter(name)), default=None) if len(automaton) else None
    return min((i for i in (found, everywhere) if i is not None), default=None)


def first_part(names: DataFrame, parts: DataFrame, most: int = AUTOMATON) -> DataFrame:
    """names (with name) and part: of the parts (part, unique; order) that lie in the name, the first by order. Names
    without one are left out. Names run through an automaton of all parts, a row a name; where the parts have more
    than ``most`` characters, names are cut into their substrings of the lengths that occur and joined by equality."""
    parts = parts.where("part is not null")
    if parts.agg(F.coalesce(F.sum(F.greatest(F.length("part"), F.lit(1))), F.lit(0))).first()[0] > most:
        met = _parts_met(names, parts).groupBy(*names.columns).agg(F.min(F.struct("order", "part")).alias("m"))
        return met.select(*names.columns, F.col("m.part").alias("part"))
    sent = names.sparkSession.sparkContext.broadcast([r.part for r in parts.orderBy("order", "part").select("part").collect()])

    @F.pandas_udf("string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            automaton, everywhere = _automaton(sent)
            at = [_first_in(name, automaton, everywhere) for name in batch]
            yield pd.Series([None if i is None else sent.value[i] for i in at], dtype=object)

    return names.withColumn("part", found("name")).where("part is not null")


def _parts_met(names: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of names (name) with each row of parts (part) that is contained in the name. Names are cut into
    their substrings of the lengths that parts have, so it is a join by equality, whatever the number of parts."""
    lengths = parts.select(F.length("part").alias("n")).agg(F.sort_array(F.collect_set("n"))).first()[0]

    def cut(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length("name") - n + 1), lambda i: F.substring(F.col("name"), i, F.lit(n)))
        return F.when(F.length("name") >= n, every).otherwise(F.array().cast("array<string>"))

    return names.select("*", F.explode(F.array_distinct(F.concat(*map(cut, lengths)))).alias("part")).join(parts, "part")


def by_substring(slides: DataFrame, cases: DataFrame, extension: str = ".svs") -> DataFrame:
    """slide_id, the whole case row, ihc, ptnm: of the first case in order whose stem lies in the slide's file name."""
    rows = cases.select(stem(F.col("img")).alias("part"), F.struct("position", F.struct(*cases.columns).alias("row")).alias("order"))
    parts = rows.where("part is not null").groupBy("part").agg(F.min("order").alias("order"))
    named = slides.select("slide_id").distinct().withColumn("name", F.concat("slide_id", F.lit(extension)))
    first = first_part(named, parts).join(parts, "part").select("slide_id", "order.row.*")
    out, n_a = slides.select("slide_id").join(first, "slide_id", "left"), F.lit("N/A")
    kept = [F.coalesce(c, n_a).alias(c) if c == "diagnosis" else F.col(c) for c in cases.columns]
    return out.select("slide_id", *kept, F.coalesce(ihc_text(F.col("diagnosis")), n_a).alias("ihc"), F.coalesce(ptnm_code(F.col("diagnosis")), n_a).alias("ptnm"))


def geometry_with_fallback(slides: DataFrame, geometry: DataFrame, position: str = "position") -> DataFrame:
    """Clusters of each slide by exact id; slides without any take those of the first id, by position, that is part
    of theirs. Without a position column the smallest such id is the first."""
    exact = slides.select("slide_id").join(geometry, "slide_id")
    rest = slides.select("slide_id").join(geometry.select("slide_id").distinct(), "slide_id", "left_anti")
    order = F.min(position) if position in geometry.columns else F.lit(0)
    parts = geometry.groupBy(F.col("slide_id").alias("part")).agg(order.alias("order"))
    first = first_part(rest.select("slide_id", F.col("slide_id").alias("name")).distinct(), parts).select("slide_id", F.col("part").alias("other"))
    found = first.join(geometry.withColumnRenamed("slide_id", "other"), "other").drop("other")
    return exact.unionByName(found)


def in_all(slides: DataFrame, *others: DataFrame) -> DataFrame:
    """Slides that every other frame has, too."""
    for o in others:
        slides = slides.join(o.select("slide_id").distinct(), "slide_id", "left_semi")
    return slides


def restricted(slides: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slides of a list, and the listed ids that have no slide."""
    ids = wanted.select("slide_id").distinct()
    return slides.join(ids, "slide_id", "left_semi"), ids.join(slides, "slide_id", "left_anti")
