"""URL filters as a sort-merge range join.

A rule (host, path, action) fits its host and all subdomains where the url's path starts with the rule's.
Canonical keys reverse the host's labels and append the path, so a rule covers one interval of keys. A url
emits a key for each of its host's suffixes down to the deepest rule; rules and keys are dealt out by key
range, sorted, and swept once with a stack of the rules that are open: at any key the top of the stack is
the longest rule of that suffix. A rule that spans several ranges goes to each of them, so ranges are
independent. Among suffixes the longest rule (host + path, then host) wins.

Only distinct (host, path) pairs are swept; a url that many rows share costs one key a suffix. Pages without a
host meet no rule and are not joined. Urls of a ``HOT``-th of all rows or more, of which there are HOT at most,
are broadcast with their verdicts; all other pages are joined by (host, path).

Defined results: a null url, or one without `://`, has an empty host and path and meets no rule; where
rules of the same host and path disagree, block wins; urls without a rule get the default action. Repeated
rows give repeated results; an empty table gives no rows, an empty table of rules the default action for all.
Urls of any length are judged whole. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slideqa.llm.tables import Saved, table

#: The rules that the query fixes.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
ALLOW, BLOCK = "allow", "block"
#: Key ranges for each shuffle partition, and sampled keys for each range.
RANGES, SAMPLES = 4, 20
#: A url that this part of all rows share is not joined by its key.
HOT = 1000
_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_KEYS = "range int, key string, is_rule int, host string, path string, rule_host string, rule_path string, action string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, *_AZ), F.lit("")), F.coalesce(path, F.lit(""))


def suffix_keys(host: str, path: str, depth: int) -> Iterator[str]:
    """A key for each suffix of the host with up to ``depth`` labels."""
    labels = host.split(".")[::-1]
    key = ""
    for label in labels[:depth]:
        key += label + "\x01"
        yield key + "\x00" + path


def _keyed(depth: int, bounds: list[str]):
    """Rows (host, path, action): null action for urls. To keys, each with its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, path, action in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if action is None:
                    rows += [(bisect_right(bounds, key), key, 1, host, path, None, None, None) for key in suffix_keys(host, path, depth)]
                else:
                    *_, key = suffix_keys(host, path, host.count(".") + 1)
                    for k in range(bisect_right(bounds, key), bisect_right(bounds, key + "\U0010ffff") + 1):
                        rows.append((k, key, 0, None, None, host, path, action))
            names = [x.split()[0] for x in _KEYS.split(", ")]
            kinds = [pa.int32() if i in (0, 2) else pa.string() for i in range(8)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(8)], names)

    return run


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by (range, key, is_rule). The stack holds the rules whose interval the key lies in."""
    now, stack = None, []
    for batch in batches:
        found = []
        for k, key, is_url, host, path, rule_host, rule_path, action in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != now:
                now, stack = k, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                stack.append((key, rule_host, rule_path, action))
            elif stack:
                found.append((host, path, *stack[-1][1:]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.string()) for i in range(5)], ["host", "path", "rule_host", "rule_path", "action"])


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = ALLOW, hot: int = HOT) -> DataFrame:
    """page_id, host, path, rule (host + path, or null), verdict: a row per row of pages.
    rules: host, path, action (allow or block)."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    named = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = named.where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("n"))
    rules = rules.where("host is not null and path is not null and action is not null")
    rules = Saved(rules.select(F.translate("host", *_AZ).alias("host"), "path", "action").groupBy("host", "path").agg(F.max("action").alias("action")), "rules")
    depth = rules.df.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    urls = Saved(urls, "urls")
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # evenly spread sample of the urls: the smallest hashes, as many as the ranges need
    sample = urls.df.select(F.xxhash64("host", "path").alias("x"), "host", "path").orderBy("x", "host", "path").limit(ranges * SAMPLES).collect()
    keys = sorted(key for r in sample for key in suffix_keys(r.host, r.path, depth))
    bounds = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)} if keys else ())

    both = urls.df.select("host", "path", F.lit(None).cast("string").alias("action")).unionByName(rules.df)
    dealt = both.mapInArrow(_keyed(depth, bounds), _KEYS).repartition("range").sortWithinPartitions("range", "key", "is_rule")
    hits = dealt.mapInArrow(_swept, "host string, path string, rule_host string, rule_path string, action string")
    rule = F.concat("rule_host", "rule_path")
    total = urls.df.agg(F.sum("n")).first()[0] or 0
    none = F.lit(None).cast("string")
    often = urls.df.where(F.col("n") * hot >= total).select("host", "path", none.alias("rule_host"), none.alias("rule_path"), none.alias("action"), F.lit(True).alias("often"))
    every = hits.withColumn("often", F.lit(False)).unionByName(often)
    longest = F.max(F.struct(F.length(rule).alias("n"), F.length("rule_host").alias("m"), rule.alias("rule"), "action")).alias("best")
    best = every.groupBy("host", "path").agg(longest, F.max("often").alias("often")).select("host", "path", "best.rule", "best.action", "often")
    best = Saved(best, "verdicts").df
    rules.drop()
    urls.drop()

    known = named.join(F.broadcast(best.where("often")), ["host", "path"], "left")
    rest = known.where("host <> '' and often is null").select("page_id", "host", "path").join(best.where("not often"), ["host", "path"], "left")
    out = known.where("host = '' or often").unionByName(rest)
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return url_verdicts(table(spark, sf_dir, "pages"), rules)


OP3_SQL = r"""
WITH r(h, p, a) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
x AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM v),
m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(a, length(h || p)) AS a FROM x JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT x.page_id, host, path, rule, coalesce(a, 'allow') AS verdict FROM x LEFT JOIN m USING (page_id)
"""
