"""ROUGE-L over batches of pairs of any lengths, and tasks of even cost."""

import random

import pytest
from pyspark.sql import functions as F

from slideqa.functions import text_scores as ts
from slideqa.operators import scoring


def naive(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("cells", [1, 5000, ts.CELLS])
def test_batches_equal_the_table(monkeypatch, cells):
    monkeypatch.setattr(ts, "CELLS", cells)
    r = random.Random(1)
    side = lambda sizes: [[r.choice("abcdefgh"[: r.randint(1, 8)]) for _ in range(r.choice(sizes))] for _ in range(120)]
    a, b = side([0, 1, 3, 63, 64, 65, 128, 129, 200, 530, 600]), side([0, 1, 2, 63, 64, 65, 128, 190, 540])
    want = [naive(x, y) for x, y in zip(a, b, strict=True)]
    assert ts.lcs_lengths(a, b).tolist() == want == ts.lcs_lengths(b, a).tolist()
    assert [ts.lcs_length(x, y) for x, y in zip(a, b, strict=True)] == want
    assert ts.lcs_lengths([], []).tolist() == []


def test_scores_of_whole_columns(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(50)] + ["...", "It's", "a,b"]
    text = lambda: r.choice([None, "", " ", "...", " ".join(r.choices(words, k=r.choice([1, 5, 70, 700])))])
    rows = [(i, text(), text()) for i in range(200)]
    got = {x.question_id: tuple(x.s) for x in spark.createDataFrame(rows, "question_id int, p string, r string").repartition(3).select("question_id", ts.rouge_l(F.col("p"), F.col("r")).alias("s")).collect()}
    for i, p, q in rows:
        a, b = ts.rouge_tokens(p), ts.rouge_tokens(q)
        n = naive(a, b)
        assert got[i] == pytest.approx((n / len(a), n / len(b), 2 * n / (len(a) + len(b))) if n else (0, 0, 0))


def test_tasks_of_even_cost(spark):
    r = random.Random(3)
    rows = [(i, 20_000 if i % 100 == 0 else r.randint(1, 300)) for i in range(4000)]
    df = spark.createDataFrame(rows, "question_id long, n long").repartition(7)
    dealt = scoring.evenly_dealt(df, F.col("n"), 8)
    loads = [x.n for x in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("n").alias("n")).collect()]
    assert dealt.rdd.getNumPartitions() == 8 and sum(loads) == sum(n for _, n in rows) and max(loads) < 1.15 * sum(loads) / 8
    assert sorted(map(tuple, dealt.collect())) == sorted(rows)
    assert scoring.evenly_dealt(df.where("false"), F.col("n"), 3).count() == 0
    texts = df.select("question_id", F.repeat(F.lit("a b "), F.col("n").cast("int") % 50).alias("prediction"), F.lit("a b").alias("ground_truth"))
    plain, even = (sorted((x.question_id, x.rouge_l_fmeasure, x.meteor_score) for x in scoring.score_texts(texts, k).collect()) for k in (None, 5))
    assert plain == even
