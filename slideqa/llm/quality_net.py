"""A quality classifier: word vectors by random indexing, pooled per document, judged by a small network.

- Tokens are runs of letters and digits, case kept, and single marks. Each has an index vector, ``NONZERO`` places of
  +1 or -1 among ``DIMS``, taken from its hash. A word's vector is the sum of the index vectors of the ``WINDOW``
  tokens on either side of it, over all documents, scaled to length one. Words share ``BUCKETS`` vectors by their
  hash, so the table has 4 MB for any corpus; no word is left out. A task sends a row of integers for each bucket
  that it met, Spark adds them up, and the table goes to the tasks of the next pass.
- A document is the mean of its tokens' vectors, their standard deviation, how alike neighbouring tokens' vectors are,
  and the logarithm of the tokens' number.
- The network has one hidden layer and one output, trained on the driver by Adam on the labelled documents of
  ``SAMPLE`` smallest hashes at most. A fifth of them is kept from training to choose the temperature that divides
  the outputs, by the likelihood of their labels.

Texts are read twice, whole; only 66 numbers a document are written in between. Labels are learned only from rows whose
crc32(doc_id) mod 4 is not 2; labels, languages, sources and ids are no inputs of a score.

Defined results: null and empty texts are documents without tokens, and get a score like others. Rows are scored one by
one: repeated rows get repeated scores. A row without doc_id is scored and not held out. Labels that are neither 0 nor 1
are not used; equal ones of one document count once, and of several texts of one doc_id the least vector is used. Without labels of both kinds the score is the share of good labels,
(good + 1) / (all + 2). An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slideqa.llm.tables import Saved, table
from slideqa.llm.text import flat, lean, mixed, slices, words

BUCKETS, DIMS, NONZERO, WINDOW = 1 << 15, 32, 2, 2
FEATURES = 2 * DIMS + 2
#: Labelled documents that the network is fitted to, at most: those of the smallest hashes.
SAMPLE = 40_000
HIDDEN, STEPS, BATCH, RATE, DECAY = 32, 3000, 256, 3e-3, 1e-4
GOOD_FROM = 0.7
#: Tokens whose vectors are held at a time.
CHUNK = 1 << 16

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_MARK = ~_LETTER
_MARK[[0x20, *range(0x00, 0x20), 0x7F]] = False
_MARKS = mixed(np.arange(1, 257, dtype=np.uint64))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token of all texts in order, and the n+1 bounds of texts among them."""
    w = words(data, offsets, _LETTER, lower=False)
    mark = np.flatnonzero(_MARK[data])
    starts = np.concatenate([w.start, mark])
    order = np.argsort(starts, kind="stable")
    return np.concatenate([w.hash, _MARKS[data[mark]]])[order], np.searchsorted(starts[order], offsets)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def _index(hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places and the signs of the index vectors."""
    bits = mixed(hashes)
    for k in range(NONZERO):
        own = bits >> np.uint64(16 * k)
        yield (own & np.uint64(DIMS - 1)).astype(np.int64), ((own >> np.uint64(15)) & np.uint64(1)).astype(np.int32) * 2 - 1


def add_contexts(sums: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> None:
    """Adds to each token's row of sums (BUCKETS x DIMS, flat) the index vectors of its neighbours in its text."""
    row, doc = _bucket(hashes) * DIMS, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for place, sign in _index(hashes):
        for step in range(1, WINDOW + 1):
            near = np.flatnonzero(doc[step:] == doc[:-step])
            far = near + step
            np.add.at(sums, row[near] + place[far], sign[far])
            np.add.at(sums, row[far] + place[near], sign[near])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros(BUCKETS * DIMS, np.int64)
    for batch in batches:
        for part in slices(batch, 0):
            data, offsets = flat(part.column(0))
            add_contexts(sums, *tokens(data, offsets))
    square = sums.reshape(BUCKETS, DIMS)
    met = np.flatnonzero(square.any(axis=1))
    for at in range(0, len(met), 4096):
        some = met[at : at + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(square[some, i]) for i in range(DIMS))], ["bucket", *(f"c{i}" for i in range(DIMS))])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """BUCKETS x DIMS numbers, rows of length one or zero: from all texts. Sums are of integers, so the order in which
    tasks come in doesn't matter."""
    names = [f"c{i}" for i in range(DIMS)]
    rows = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(lean(_contexts), "bucket int, " + ", ".join(f"{c} long" for c in names))
    got = rows.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out = np.zeros((BUCKETS, DIMS), np.float32)
    if got.num_rows:
        found = np.stack([got[c].to_numpy() for c in names], axis=1).astype(np.float64)
        out[got["bucket"].to_numpy()] = found / np.maximum(np.linalg.norm(found, axis=1), 1e-9)[:, None]
    return out


def pooled(vectors: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the token vectors of each text, the mean product of neighbours, and
    log(1 + tokens)."""
    n_docs, bucket = len(bounds) - 1, _bucket(hashes)
    sums, first_token = np.zeros((n_docs, 2 * DIMS + 1)), np.zeros(len(bucket) + 1, bool)
    first_token[bounds] = True
    for at in range(0, len(bucket), CHUNK):
        to = min(len(bucket), at + CHUNK)
        first, last = np.searchsorted(bounds, at, "right") - 1, np.searchsorted(bounds, to, "left")
        docs = np.arange(first, last)
        docs = docs[bounds[docs + 1] > bounds[docs]]  # reduceat takes no empty runs
        own = vectors[bucket[at:to]].astype(np.float64)
        alike = (own * vectors[bucket[np.maximum(np.arange(at, to) - 1, 0)]]).sum(axis=1) * ~first_token[at:to]
        sums[docs] += np.add.reduceat(np.concatenate([own, own * own, alike[:, None]], axis=1), np.maximum(bounds[docs], at) - at, axis=0)
    n = np.diff(bounds)[:, None]
    mean = sums / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(mean[:, DIMS : 2 * DIMS] - mean[:, :DIMS] ** 2, 0))
    return np.concatenate([mean[:, :DIMS], spread, mean[:, 2 * DIMS :], np.log1p(n)], axis=1)


def document_vectors(docs: DataFrame, vectors: np.ndarray, text_col: str = "text") -> DataFrame:
    """doc_id, features: a row per row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = flat(part.column(1))
                found = pooled(sent.value, *tokens(data, offsets))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * FEATURES), pa.array(found.ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "features"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, features array<float>")


class Network(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float

    def outputs(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.hidden + self.hidden_bias) @ self.out + self.out_bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.outputs(x) / self.temperature, -30, 30)))


def constant_network(score: float) -> Network:
    zero = np.zeros(FEATURES)
    return Network(zero, zero + 1, np.zeros((FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(score / (1 - score))), 1.0)


def log_loss(outputs: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, outputs) - y * outputs))


def best_temperature(outputs: np.ndarray, y: np.ndarray) -> float:
    """Of 0.1 to 10, the one under which the labels are likeliest: a grid, then a finer one around the best. Labels are
    drawn in by what their number leaves open, so rows that are told apart without a fault don't make it vanish."""
    y = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    grid = np.linspace(np.log(0.1), np.log(10), 41)
    for _ in range(3):
        best = grid[int(np.argmin([log_loss(outputs / np.exp(t), y) for t in grid]))]
        grid = np.clip(np.linspace(best - (grid[1] - grid[0]), best + (grid[1] - grid[0]), 21), np.log(0.1), np.log(10))
    return float(np.exp(best))


def trained(x: np.ndarray, y: np.ndarray, seed: int = 0) -> Network:
    """Fits the network to four fifths of the rows, its temperature to the rest. Needs both labels in either part."""
    r = np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4
    if min(len(set(y[held].tolist())), len(set(y[~held].tolist()))) < 2:
        return constant_network((y.sum() + 1) / (len(y) + 2))
    mean, scale = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-6
    z, t = (x[~held] - mean) / scale, y[~held].astype(float)
    params = [r.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        at = r.integers(0, len(t), BATCH)
        h = np.tanh(z[at] @ params[0] + params[1])
        slope = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30))) - t[at]) / BATCH
        back = slope[:, None] * params[2] * (1 - h * h)
        grads = [z[at].T @ back + DECAY * params[0], back.sum(axis=0), h.T @ slope + DECAY * params[2], slope.sum(keepdims=True)]
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    net = Network(mean, scale, params[0], params[1], params[2], float(params[3][0]), 1.0)
    return net._replace(temperature=best_temperature(net.outputs(x[held]), y[held]))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fitted(features: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """From the labelled rows (doc_id, quality) that are not held out, ``sample`` at most."""
    marks = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    some = marks.where(~held_out()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    # a row a label, however often its doc_id occurs
    got = features.join(some, "doc_id").groupBy("doc_id", "quality").agg(F.min("features").alias("features")).toArrow()
    if not got.num_rows:
        return constant_network(0.5)
    x = np.stack(got["features"].to_pylist()).astype(np.float64)
    y, ids = got["quality"].to_numpy(), got["doc_id"].to_numpy()
    order = np.lexsort((x[:, -1], y, mixed(ids.astype(np.uint64))))  # the same for any order of the rows
    return trained(x[order], y[order])


def scored(features: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted: a row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(-1, FEATURES).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.scores(x))], ["doc_id", "score"])

    rows = features.select("doc_id", "features").mapInArrow(lean(run), "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= GOOD_FROM, 1).otherwise(0).alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted: a row per row of docs (doc_id, text)."""
    features = Saved(document_vectors(docs, word_vectors(docs)), "document-vectors").df
    return scored(features, fitted(features, labels, sample))


def report(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """By held_out: documents, share predicted right, mean score and log loss of the labels: how well probabilities
    fit."""
    both = scores.join(labels.where("quality in (0, 1)").select("doc_id", "quality"), "doc_id")
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("score")))
    return both.groupBy("held_out").agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("accuracy"), F.avg(F.col("score")).alias("mean_score"), F.avg("quality").alias("good"), F.avg(-F.when(F.col("quality") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"))


def op12_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
