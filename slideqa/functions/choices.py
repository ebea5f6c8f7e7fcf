"""Choice answers: isolated option letters, exact match, graded score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def option_letters(text: Column, fold: bool = False) -> Column:
    """Letters A-Z that no other Latin letter touches, in order; fold also takes a-z, as capitals."""
    kind = "A-Za-z" if fold else "A-Z"
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?<![a-zA-Z])[{kind}](?![a-zA-Z])"), 0)
    return F.transform(found, F.upper) if fold else found


def reference_letters(text: Column, fold: bool = False) -> Column:
    """Isolated letters, or else every capital of the text."""
    isolated = option_letters(text, fold)
    capitals = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\p{Lu}"), 0)
    return F.when(F.size(isolated) > 0, isolated).otherwise(capitals)


def choice_match(prediction: Column, reference: Column, fold: bool = False, ordered: bool = False) -> Column:
    """Struct of exact_match, score, pred_letters, ref_letters, all_found, no_extra.

    all_found: the prediction holds each reference letter as often as the reference does (or begins with
    them in order); no_extra: both hold the same letters.
    """
    p, r = option_letters(prediction, fold), reference_letters(reference, fold)
    if ordered:
        found = F.slice(p, F.lit(1), F.size(r)) == r
    else:
        count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
        found = F.forall(r, lambda x: count(p, x) >= count(r, x))
    same = F.array_sort(F.array_distinct(p)) == F.array_sort(F.array_distinct(r))
    exact = found & same
    return F.struct(exact.alias("exact_match"), exact.cast("double").alias("score"), p.alias("pred_letters"), r.alias("ref_letters"), found.alias("all_found"), same.alias("no_extra"))


def graded_score(kind: Column, pred_letters: Column, ref_letters: Column, exact: Column) -> Column:
    """multi: 1 for equal letter sets, 0.5 for a non-empty proper subset, else 0; others: 1 for an exact match."""
    p, r = F.array_distinct(pred_letters), F.array_distinct(ref_letters)
    inside, missing = F.size(F.array_except(p, r)) == 0, F.size(F.array_except(r, p)) > 0
    multi = F.when(~inside, 0.0).when(~missing, 1.0).when(F.size(p) > 0, 0.5).otherwise(0.0)
    return F.when(kind == "multi", multi).otherwise(F.when(F.coalesce(exact, F.lit(False)), 1.0).otherwise(0.0))
