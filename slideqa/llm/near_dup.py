"""MinHash near-duplicates with HyperMinHash sketches.

Each text's set of distinct 5-word shingles (64-bit hashes) is sketched in one pass: a hash picks one of
``BUCKETS`` buckets, each bucket keeps its smallest remainder, compressed to the count of leading zeros and
``MANTISSA`` bits after them. Texts with equal sets (by a 128-bit digest) become one node, named by a number of its
own; a document may hold several nodes. Bands of ROWS compressed registers, empty buckets filled from others in a
fixed order, bring candidates together; the collision-corrected Jaccard estimate of the sketches thins them and the
full sets decide: shingles of the words themselves, not of hashes.

A shingle that no other node of the search has can lie in no intersection. So each node's own shingles are
counted over all nodes that share a bucket: a node of n shingles, u of them its own, meets another in at
most n - u, which rules out most candidates for certain (all that merely share a passage).

Members of one band bucket are never all paired. First each node is paired with the best of its buckets'
pivots, the members with the least share of own shingles; near copies nearly all join there. What is left are
buckets whose members lie in several components. Per bucket's largest component, the members outside it (the
queries) are held against all that share such a bucket, in blocks of bounded weight: a task gets one block of
queries and one of targets and intersects their full sets at once. It gives a link for each query and foreign
component at most, so nothing is lost and no list of pairs arises.

Defined results: null or word-less texts have an empty set and link with nothing. Rows with one doc_id are
one document, which links with what any of its texts is like. Rows without a doc_id are kept and link with nothing.
An empty table gives an empty one. Texts are never cut; a very long one is a block of its own. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slideqa.llm.graph import components
from slideqa.llm.tables import Saved, table
from slideqa.llm.text import LOWER, SHINGLE, flat, lean, mixed, shingles, slices, words

BUCKETS = 240
ROWS = 5
BANDS = BUCKETS // ROWS
MANTISSA = 10
REST_BITS = 40
EMPTY = 0xFFFF
#: Standard errors that the estimate may fall below the threshold before a candidate is dropped.
SLACK = 4.5
#: Shingles of a block, on average; a single larger set is a block of its own. Small blocks keep tasks alike.
BLOCK = 50_000
#: What a small set counts at least, so a block has BLOCK / LEAST_WEIGHT of them on average.
LEAST_WEIGHT = 100
#: Ids up to which a list of them is broadcast: about 30 MB.
BROADCAST_IDS = 1_000_000
#: Columns of the incidence matrices that are multiplied at a time.
CHUNK = 4096

_LOWER = LOWER.tobytes()
_ORDER = np.random.Generator(np.random.PCG64(7)).permuted(np.tile(np.arange(BUCKETS), (BUCKETS, 1)), axis=1)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BUCKETS registers a set: leading zeros * 2**MANTISSA + mantissa, or EMPTY."""
    least = np.full((len(sets), BUCKETS), 1 << REST_BITS, np.int64)
    if sets:
        h = mixed(np.concatenate(sets))
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        bucket = (((h >> np.uint64(40)) * np.uint64(BUCKETS)) >> np.uint64(24)).astype(np.int64)
        np.minimum.at(least.reshape(-1), row * BUCKETS + bucket, (h & np.uint64((1 << REST_BITS) - 1)).astype(np.int64))
    fraction, exponent = np.frexp(least.astype(np.float64))
    code = (REST_BITS - exponent).astype(np.int64) * (1 << MANTISSA) + ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    code[least == 0] = REST_BITS << MANTISSA
    code[least == 1 << REST_BITS] = EMPTY
    return code.astype(np.uint16)


def filled(codes: np.ndarray) -> np.ndarray:
    """Registers with each empty bucket filled from the first filled one in the bucket's own order."""
    out = codes.copy()
    rows, cols = np.nonzero(codes == EMPTY)
    some = (codes != EMPTY).any(axis=1)
    keep = some[rows]
    rows, cols = rows[keep], cols[keep]
    for k in range(BUCKETS):
        if not len(rows):
            break
        got = codes[rows, _ORDER[cols, k]]
        hit = got != EMPTY
        out[rows[hit], cols[hit]] = got[hit]
        rows, cols = rows[~hit], cols[~hit]
    return out


def band_keys(codes: np.ndarray, columns: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit key for each row and band; columns: (bands, registers) of positions."""
    full = filled(codes).astype(np.uint64)
    keys = np.broadcast_to(mixed(np.arange(len(columns), dtype=np.uint64) + np.uint64(1000 * salt + 1)), (len(codes), len(columns))).copy()
    for j in range(columns.shape[1]):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + full[:, columns[:, j]])
    return keys.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates from equal registers, less the collisions expected of disjoint sets, and the
    number of buckets that they rest on."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    equal = ((a == b) & (a != EMPTY)).sum(axis=1)
    ratio = np.maximum(n_a, n_b) / np.maximum(1, np.minimum(n_a, n_b))
    chance = 0.169919487159739 * BUCKETS / 2**MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(0, equal - chance) / np.maximum(1, used), used


def word_shingles(text: str) -> set[tuple[bytes, ...]]:
    """The distinct 5-word shingles, as words; of fewer words the whole sequence."""
    w = text.encode().translate(_LOWER).split()
    return set(zip(*(w[i:] for i in range(SHINGLE)), strict=False)) if len(w) >= SHINGLE else {tuple(w)} if w else set()


def similar(a: set, b: set, percent: int = 75) -> bool:
    """100 * intersection >= percent * union, both with members."""
    if not a or not b or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(a & b)
    return 100 * common >= percent * (len(a) + len(b) - common)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            data, offsets = flat(part.column(1))
            sets = list(shingles(words(data, offsets, keyed=True), part.num_rows))
            digests = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            whole = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            codes = registers(sets)
            sizes = np.array([len(s) for s in sets], np.int64)
            sketch = pa.array([codes[i].tobytes() if sizes[i] > 2 else None for i in range(len(sets))], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sizes), pa.array(np.ascontiguousarray(whole[:, 0])), pa.array(np.ascontiguousarray(whole[:, 1])), sketch], ["doc_id", "tie", "n_shingles", "set_a", "set_b", "sketch"])


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = np.arange(BUCKETS).reshape(BANDS, ROWS)
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            keys = band_keys(_codes(part.column(1)), columns, 0)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], ["key", "id"])


def _likely(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                t = percent / 100
                n_a, n_b = batch.column(2).to_numpy(), batch.column(4).to_numpy()
                got, used = estimate(_codes(batch.column(3)), _codes(batch.column(5)), n_a, n_b)
                union = (n_a + n_b) / (1 + t)
                rest = np.maximum(0, 1 - used / np.maximum(1, union)) + 1 / np.maximum(1, used)
                keep = got >= t - SLACK * np.sqrt(t * (1 - t) / np.maximum(1, used) * np.minimum(1, rest))
                keep &= 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
                keep = pa.array(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, set()
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                a = batch.column(0)[i].as_py()
                if a != last:
                    last, one = a, word_shingles(batch.column(2)[i].as_py())
                if similar(one, word_shingles(batch.column(3)[i].as_py()), percent):
                    good.append(i)
            keep = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    return run


def _links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int) -> Saved:
    """The pairs (a, b) whose full sets are similar enough."""
    a = nodes.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    b = nodes.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    near = pairs.join(b, "b").join(a, "a").select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(lean(_likely(percent)), "a long, b long")
    near = Saved(near, "near")
    links = Saved(_confirmed(near.df, texts, percent), "links")
    near.drop()
    return links


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar enough by their texts' words."""
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(lean(_verified(percent)), "a long, b long")


def _own_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = list(shingles(words(*flat(part.column(1)), keyed=True), part.num_rows))
            ids = np.repeat(part.column(0).to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(ids)], ["h", "id"])


def _small(ids: DataFrame) -> DataFrame:
    """Ids for a semi-join: broadcast only if counted to be few, so that texts needn't move."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _possible(percent: int) -> str:
    """Whether nodes (n_a, u_a) and (n_b, u_b) can be similar enough, by sizes and own shingles."""
    both = "least(n_a - u_a, n_b - u_b)"
    return f"100 * {both} >= {percent} * (n_a + n_b - {both})"


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id is it): a row
    per row of docs. Links: 100 * intersection >= percent * union of the shingle sets."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    sketched = Saved(docs.select("doc_id", "text", "tie").mapInArrow(lean(_sketched), "doc_id long, tie long, n_shingles long, set_a long, set_b long, sketch binary"), "sketched")
    rows = Saved(sketched.df.drop("tie", "sketch"), "rows")
    named = sketched.df.where("doc_id is not null and n_shingles > 0")
    # a node is a set; `low` is the smallest doc_id that has it, (low, tie) finds its text
    sets = Saved(named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("low")).withColumn("id", F.monotonically_increasing_id()), "sets")
    nodes = named.where("sketch is not null").join(sets.df, ["set_a", "set_b"]).where("doc_id = low").dropDuplicates(["set_a", "set_b"])
    nodes = Saved(nodes.select("id", "low", "tie", F.col("n_shingles").alias("n"), "sketch"), "nodes")
    sketched.drop()
    every = Saved(nodes.df.select("id", "sketch").mapInArrow(lean(_banded), "key long, id long"), "bands")
    shared = every.df.groupBy("key").count().where("count > 1").select("key")
    bands = Saved(every.df.join(shared, "key"), "shared")
    every.drop()
    met = Saved(nodes.df.join(_small(bands.df.select("id").distinct()), "id", "left_semi"), "met")
    nodes.drop()
    own = _texts(docs, met.df).mapInArrow(lean(_own_rows), "h long, id long")
    own = own.groupBy("h").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1").groupBy("id").agg(F.count("*").alias("u"))
    active = met.df.join(own, "id", "left").withColumn("u", F.coalesce("u", F.lit(0))).where(f"100 * (n - u) >= {percent} * n")
    active = Saved(active, "active")
    met.drop()
    texts = Saved(_texts(docs, active.df), "texts")
    if texts.df.count() > active.df.count():  # rows that occur more than once
        texts, more = Saved(texts.df.dropDuplicates(["id"]), "once"), texts
        more.drop()
    members = Saved(bands.df.join(active.df.select("id", "n", "u"), "id"), "members")
    bands.drop()

    share = F.struct((F.col("u") / F.col("n")).alias("share"), "id", "n", "u")
    pivots = members.df.groupBy("key").agg(F.min(share).alias("p"), F.count("*").alias("c")).where("c > 1").select("key", F.col("p.id").alias("a"), F.col("p.n").alias("n_a"), F.col("p.u").alias("u_a"))
    met = members.df.withColumnsRenamed({"n": "n_b", "u": "u_b"}).join(pivots, "key").where("a <> id").where(_possible(percent)).groupBy("id", "a").count()
    first = met.groupBy("id").agg(F.max(F.struct("count", F.negative("a").alias("a"))).alias("m")).select(F.negative("m.a").alias("x"), F.col("id").alias("y"))
    pairs = first.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    links = _links(pairs, active.df, texts.df, percent)
    edges = links.df.unionByName(_same_documents(rows.df, sets.df))
    open_links = Saved(_open_links(members.df, components(edges), active.df, texts.df, percent), "open-links")
    more = Saved(_confirmed(open_links.df, texts.df, percent), "more")
    labels = components(edges.unionByName(more.df))
    for x in (members, texts, active, open_links):
        x.drop()
    of_node = sets.df.join(labels, F.col("id") == F.col("node"), "left").select("set_a", "set_b", "low", F.coalesce("label", "id").alias("label"))
    least = of_node.groupBy("label").agg(F.min("low").alias("component"))
    of_set = Saved(of_node.join(least, "label").select("set_a", "set_b", "component"), "of-set")
    out = Saved(_with_components(rows.df, of_set.df), "near-duplicates")
    for x in (rows, sets, links, more, of_set):
        x.drop()
    return out.df.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, text of each node, from the rows of docs that have its smallest doc_id and its text's hash."""
    names = nodes.select(F.col("low").alias("doc_id"), "tie", "id")
    few = names.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(names) if few else names, ["doc_id", "tie"]).select("id", "text")


def _with_components(rows: DataFrame, of_set: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row. A row without words has its document's other texts' component."""
    some = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    full = rows.where(some).join(of_set, ["set_a", "set_b"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    empty = rows.where(~some).select("doc_id", "n_shingles")
    both = rows.where(some).join(empty.select("doc_id").distinct(), "doc_id", "left_semi").join(of_set, ["set_a", "set_b"]).groupBy("doc_id").agg(F.min("component").alias("component"))
    alone = empty.join(both, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return full.unionByName(alone)


def _same_documents(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of a doc_id that has several: each with the smallest."""
    held = rows.where("doc_id is not null and n_shingles > 0").select("doc_id", "set_a", "set_b").distinct()
    several = held.groupBy("doc_id").count().where("count > 1").select("doc_id")
    of = held.join(several, "doc_id").join(sets, ["set_a", "set_b"]).select("doc_id", "id")
    return of.join(of.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").where("a <> id").select("a", F.col("id").alias("b"))


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = list(shingles(words(*flat(part.column(1)), keyed=True), part.num_rows))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "shingles"])


def intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b, by chunks of shared members."""
    out = np.zeros((len(a), len(b)), np.float32)
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(flat_a, flat_b)
    places = []
    for every, sets in ((flat_a, a), (flat_b, b)):
        at = np.searchsorted(common, every)
        hit = at < len(common)
        hit[hit] = common[at[hit]] == every[hit]
        places.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit], at[hit]))
    for low in range(0, len(common), CHUNK):
        x, y = (np.zeros((len(sets), min(CHUNK, len(common) - low)), np.float32) for sets in (a, b))
        for m, (row, col) in zip((x, y), places, strict=True):
            own = (col >= low) & (col < low + CHUNK)
            m[row[own], col[own] - low] = 1
        out += x @ y.T
    return out


def _block_links(percent: int):
    """Rows of one (main, query block, target block): links (a, b), one for each query and foreign label."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        query = rows["query"].to_numpy()
        links = []
        if query.any() and not query.all():
            sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
            ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
            q, t = np.flatnonzero(query), np.flatnonzero(~query)
            sizes = np.array([len(x) for x in sets])
            for i in range(0, len(q), 1024):
                part = q[i : i + 1024]
                both = intersections([sets[k] for k in part], [sets[k] for k in t])
                union = sizes[part][:, None] + sizes[t][None, :] - both
                x, y = np.nonzero((100 * both >= percent * union) & (labels[part][:, None] != labels[t][None, :]))
                links.append(pd.DataFrame({"a": ids[part[x]], "b": ids[t[y]], "label": labels[t[y]]}).drop_duplicates(["a", "label"]))
        return pd.concat(links)[["a", "b"]] if links else pd.DataFrame({"a": [], "b": []}, dtype=np.int64)

    return run


def _open_links(members: DataFrame, labels: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links between components whose members share a band bucket."""
    marked = members.select("key", "id").join(labels, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    marked = Saved(marked, "marked")
    parts = marked.df.groupBy("key", "label").count().groupBy("key").agg(F.max(F.struct("count", "label")).alias("most"), F.count("*").alias("parts"))
    parts = parts.where("parts > 1").select("key", F.col("most.label").alias("main"))
    there = Saved(marked.df.join(parts, "key").select("main", "id", "label").distinct(), "open")
    marked.drop()
    rows = there.df.join(nodes.select("id", F.greatest("n", F.lit(LEAST_WEIGHT)).alias("n")), "id").withColumn("query", F.col("label") != F.col("main"))
    weight = lambda c: F.greatest(F.lit(1), F.ceil(F.sum(c) / BLOCK)).cast("int")
    blocks = rows.groupBy("main").agg(weight(F.when(F.col("query"), F.col("n")).otherwise(0)).alias("n_q"), weight("n").alias("n_t"))
    rows = rows.join(blocks, "main")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    queries = rows.where("query").withColumn("i", block("n_q")).withColumn("j", every("n_t")).select("main", "i", "j", "id", "label", "query")
    targets = rows.withColumn("j", block("n_t")).withColumn("i", every("n_q")).select("main", "i", "j", "id", "label", F.lit(False).alias("query"))
    sets = texts.join(there.df.select("id").distinct(), "id", "left_semi").mapInArrow(lean(_with_sets), "id long, shingles binary")
    both = queries.unionByName(targets).join(sets, "id")
    return both.groupBy("main", "i", "j").applyInPandas(_block_links(percent), "a long, b long")


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) END AS g FROM d),
r AS (SELECT doc_id, len(g) AS n, hash(list_sort(g)) AS h, g FROM s),
u AS (SELECT h, min(doc_id) AS id, any_value(n) AS n FROM r WHERE n > 0 GROUP BY h),
x AS (SELECT u.id, u.n, unnest(r.g) AS t FROM u JOIN r ON r.doc_id = u.id),
c AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.t = b.t AND a.id < b.id
      GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM c UNION ALL SELECT b, a FROM c),
reach(id, top) AS (SELECT id, id FROM u UNION SELECT e.b, reach.top FROM reach JOIN e ON e.a = reach.id),
l AS (SELECT id, min(top) AS top FROM reach GROUP BY id)
SELECT r.doc_id, r.n AS n_shingles, coalesce(l.top, r.doc_id) AS component_id, r.doc_id = coalesce(l.top, r.doc_id) AS kept
FROM r LEFT JOIN u ON u.h = r.h AND r.n > 0 LEFT JOIN l ON l.id = u.id
"""
