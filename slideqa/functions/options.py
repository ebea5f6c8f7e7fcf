"""Options and answers of question records.

Polymorphic fields hold JSON text: objects and arrays as they are, strings without quotes, as reading a
string column from JSON gives them. The first character tells the shape. Object keys keep their order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Answer fields in order of priority.
INDEX_FIELDS = ("answer_index", "answer_indices", "answer_idx")
ANSWER_FIELDS = ("answer_key", "answer_keys", "correct_answers", "correct_answer", "answer_choice", "answer_options", "answer")
SHORTEST_OPTIONS = 10  # fixed value


def shape(raw: Column) -> Column:
    """object, array, text, or null."""
    first = F.substring(F.ltrim(raw), 1, 1)
    return F.when(raw.isNull() | (F.trim(raw) == "null"), None).when(first == "{", "object").when(first == "[", "array").otherwise("text")


def entries(raw: Column) -> Column:
    """Array of (key, value) of a JSON object, in its own order; null for other shapes."""
    return F.when(shape(raw) == "object", F.map_entries(F.from_json(raw, "map<string,string>")))


def items(raw: Column) -> Column:
    """Array of strings of a JSON array; null for other shapes."""
    return F.when(shape(raw) == "array", F.from_json(raw, "array<string>"))


def normalized_option(text: Column) -> Column:
    """'A: x', 'A. x' and 'A x' to 'A. x'; other texts trimmed."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    form = r"(?d)^([A-Z])[.:\s]+(.*)$"
    rest = F.regexp_replace(F.regexp_extract(t, form, 2), r"^\s+|\s+$", "")
    return F.when(F.rlike(t, F.lit(r"(?d)^[A-Z][.:\s]+.*$")), F.concat(F.regexp_extract(t, form, 1), F.lit(". "), rest)).otherwise(t)


def _lines(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(". "), F.coalesce(e["value"], F.lit("None")))), "\n")


def options_block(options: Column, descriptions: Column | None = None, choices: Column | None = None) -> Column:
    """All encodings of options as lines 'A. text'. A non-empty choices object wins; keys in an array take
    their texts from descriptions, if there are any; arrays of objects use key and label."""
    none = F.lit(None).cast("string")
    descriptions, choices = none if descriptions is None else descriptions, none if choices is None else choices
    chosen, own, listed, texts = entries(choices), entries(options), items(options), entries(descriptions)
    named = F.map_from_entries(texts)
    pairs = F.transform(listed, lambda x: F.from_json(x, "map<string,string>"))
    labelled = F.array_join(F.transform(pairs, lambda m: F.concat(m["key"], F.lit(". "), m["label"])), "\n")
    first = F.get(listed, 0)
    has_label = F.map_contains_key(F.get(pairs, 0), "key") & F.map_contains_key(F.get(pairs, 0), "label")
    described = F.array_join(F.transform(F.filter(listed, lambda k: F.map_contains_key(named, k)), lambda k: F.concat(k, F.lit(". "), named[k])), "\n")
    split = F.array_join(F.transform(F.split(options, ","), normalized_option), "\n")
    return (
        F.when(F.size(chosen) > 0, _lines(chosen))
        .when(own.isNotNull(), _lines(own))
        .when(shape(options) == "text", split)
        .when(F.size(listed) > 0, F.when(shape(first) == "object", F.when(has_label, labelled).otherwise(F.array_join(listed, "\n"))).when(F.size(texts) > 0, described).otherwise(F.array_join(F.transform(listed, normalized_option), "\n")))
        .otherwise("")
    )


def index_letter(index: Column) -> Column:
    number = F.rlike(index, F.lit(r"^\d+$"))
    return F.when(number, F.char(F.lit(65) + F.when(number, index).try_cast("int"))).otherwise(index)


def index_letters(raw: Column) -> Column:
    """An index, or an array of them, as an array of letters."""
    return F.when(shape(raw) == "array", F.transform(items(raw), index_letter)).when(raw.isNotNull(), F.array(index_letter(raw)))


def is_true(raw: Column) -> Column:
    """Whether the value counts as given: not null, empty, zero, false, or an empty array or object."""
    return F.coalesce(~F.regexp_replace(raw, r"\s", "").isin("", "[]", "{}", "0", "0.0", "false", "null"), F.lit(False))


def _as_list(raw: Column) -> Column:
    return F.when(shape(raw) == "array", items(raw)).when(raw.isNotNull(), F.array(raw))


def answer_letters(fields: dict[str, Column]) -> Column:
    """The answer as an array: the first index field that isn't null, as letters, or else the first other
    field that is given. Missing fields may be left out."""
    # an index field decides by being there, even if it holds nothing; the others by truth
    out = F.when(F.lit(False), F.array(F.lit("")))
    for f in INDEX_FIELDS:
        if f in fields:
            out = out.when(shape(fields[f]).isNotNull(), index_letters(fields[f]))
    for f in ANSWER_FIELDS:
        if f in fields:
            out = out.when(is_true(fields[f]), _as_list(fields[f]))
    return out


def answer_text(letters: Column) -> Column:
    return F.coalesce(F.array_join(letters, ", "), F.lit(""))


def reject_reason(question: Column, letters: Column, kind: Column, block: Column) -> Column:
    """Why a record is rejected, or null."""
    empty = question.isNull() | (F.regexp_replace(question, r"\s", "") == "")
    unanswered = letters.isNull() | (F.size(letters) == 0) | (F.size(F.filter(letters, lambda x: x != "")) == 0)
    short = kind.isin("single", "multi") & (F.length(block) < SHORTEST_OPTIONS)
    told = F.concat(F.lit("format="), kind, F.lit(f" and options length<{SHORTEST_OPTIONS} (actual="), F.length(block).cast("string"), F.lit(")"))
    return F.when(empty, "empty question").when(unanswered, "empty answer").when(short, told)
