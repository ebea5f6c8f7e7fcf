"""Word and document vectors against plain ones; held-out accuracy and calibration of the network."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from slideqa.llm import quality_net as net
from slideqa.llm.tables import table
from slideqa.llm.text import flat
from tests.conftest import SMALL


def plain_tokens(text):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]", text.encode())


def hashes(parts):
    """The hash of each token, from texts of one token."""
    import pyarrow as pa

    return {p: net.tokens(*flat(pa.array([p], pa.binary()).cast(pa.string())))[0][0] for p in parts}


def plain_vectors(texts):
    known = hashes({t for x in texts for t in plain_tokens(x)})
    sums = np.zeros((net.BUCKETS, net.DIMS), np.int64)
    index = {}
    for t, h in known.items():
        v = np.zeros(net.DIMS, np.int64)
        for place, sign in net._index(np.array([h])):
            v[place[0]] += sign[0]
        index[t] = v
    for x in texts:
        row = plain_tokens(x)
        for i, t in enumerate(row):
            for j in range(max(0, i - net.WINDOW), min(len(row), i + net.WINDOW + 1)):
                if i != j:
                    sums[int(known[t]) % net.BUCKETS] += index[row[j]]
    return known, sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-9)[:, None]


def test_vectors(spark, edge_docs, edge_rows, monkeypatch):
    texts = [t or "" for _, t, *_ in edge_rows]
    known, want = plain_vectors(texts)
    got = net.word_vectors(edge_docs)
    assert np.allclose(got, want, atol=1e-6) and np.abs(got).any(axis=1).sum() > 200
    monkeypatch.setattr(net, "CHUNK", 37)
    rows = sorted((r.doc_id is None, r.doc_id or 0, tuple(np.round(r.features, 4))) for r in net.document_vectors(edge_docs, got).collect())
    plain = []
    for d, t, *_ in edge_rows:
        v = np.array([got[int(known[x]) % net.BUCKETS] for x in plain_tokens(t or "")], float).reshape(-1, net.DIMS)
        n = max(len(v), 1)
        alike = (v[1:] * v[:-1]).sum() / n
        plain.append((d is None, d or 0, np.concatenate([v.sum(axis=0) / n, np.sqrt(np.maximum((v * v).sum(axis=0) / n - (v.sum(axis=0) / n) ** 2, 0)), [alike, np.log1p(len(v))]])))
    plain.sort(key=lambda x: (*x[:2], tuple(np.round(x[2], 4))))
    assert [r[:2] for r in rows] == [p[:2] for p in plain]
    assert np.allclose([r[2] for r in rows], [p[2] for p in plain], atol=3e-4)


def test_scores(spark, edge_docs, edge_rows, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(3, 1), (5, None), (None, 1), (6, 7)], "doc_id long, quality int").selectExpr("*", "'z' as features", "1 as score")
    clash = edge_docs.selectExpr("*", "0 as features", "1 as score", "2 as quality", "3 as bucket", "4 as c0")
    got = net.quality_scores(clash, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, *_ in edge_rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    again = {(r.doc_id, round(r.score, 9)) for r in net.quality_scores(clash.repartition(2), labels.repartition(3)).collect()}
    assert again == {(r.doc_id, round(r.score, 9)) for r in got}
    assert {r.score for r in net.quality_scores(clash, labels.where("false")).collect()} == {0.5}
    good = labels.where("quality = 1")
    n = sum(1 for i in range(1, 30, 2) if zlib.crc32(str(i).encode()) % 4 != 2)
    assert np.allclose([r.score for r in net.quality_scores(clash, good).collect()], (n + 1) / (n + 2))
    assert net.quality_scores(no_docs, labels).count() == 0


def test_held_out_labels_are_not_learned(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    other = labels.withColumn("quality", F.when(net.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: round(r.score, 9) for r in net.quality_scores(docs, x).collect()} for x in (labels, other))
    assert a == b


def test_accuracy_and_calibration(spark):
    folder = SMALL.replace("0.001", "0.1")
    labels = table(spark, folder, "labels")
    r = {x.held_out: x for x in net.report(net.op12_quality_net(spark, folder), labels).collect()}[True]
    assert r.n > 900 and r.accuracy >= 0.985 and abs(r.mean_score - r.good) < 0.02 and r.log_loss < 0.06


def test_temperature():
    r = np.random.default_rng(1)
    logit = r.normal(0, 2, 4000)
    y = (r.random(4000) < 1 / (1 + np.exp(-logit))).astype(int)
    assert abs(net.best_temperature(3 * logit, y) - 3) < 0.3
    assert net.best_temperature(np.where(y, 50.0, -50.0), y) > 1  # no fault among 4,000 isn't certainty
