"""Threshold sampling, ranks by ranges and the automaton look-up against windows, sorts and loops."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from slideqa.operators import cases, tasks, tokens


@pytest.fixture(scope="module")
def sequences(spark):
    """One slide has most tokens; others end in the middle of a pack, or hold the global token alone."""
    sizes = {"hot": 6000, "a": 21, "b": 26, "c": 2, "d": 1, "e": 11, "f": 12}
    rows = [(s, i, [float(i)]) for s, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "slide_id string, token_idx int, embedding array<float>").repartition(4)


def ids(df, *more):
    return sorted((r.slide_id, r.token_idx, *(r[c] for c in more)) for r in df.collect())


def placed(rows, seed, *parts):
    w = Window.partitionBy("slide_id")
    return rows.withColumn("n", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy(tokens.seeded(seed, "slide_id", *parts), *parts)))


@pytest.mark.parametrize("seed", [0, 7])
def test_choices_equal_a_full_order(sequences, seed):
    roles = tokens.with_roles(sequences)
    packs = placed(roles.where("pack_idx >= 0").select("slide_id", "pack_idx").distinct(), seed, "pack_idx")
    keep = packs.where((F.col("n") <= 1) | (F.col("r") <= tokens._kept(F.col("n"), 0.3, 90))).select("slide_id", "pack_idx")
    want = roles.where("pack_idx < 0").unionByName(roles.join(keep, ["slide_id", "pack_idx"], "left_semi").select(roles.columns))
    assert ids(tokens.drop_packs(sequences, 0.3, 90, seed)) == ids(want)

    hidden = packs.select("slide_id", "pack_idx", (F.col("r") > tokens._kept(F.col("n"), 0.75)).alias("masked"))
    want = roles.join(hidden, ["slide_id", "pack_idx"], "left").withColumn("masked", F.coalesce("masked", F.lit(False)))
    assert ids(tokens.mask_packs(sequences, seed=seed), "masked") == ids(want, "masked")

    patches = placed(roles.where("token_type = 'patch'").select("slide_id", "token_idx"), seed, "token_idx")
    hidden = {(r.slide_id, r.token_idx) for r in patches.where(F.col("r") > tokens._kept(F.col("n"), 0.75)).collect()}
    got = ids(tokens.mask_patches(sequences, seed=seed), "masked")
    assert len(got) == sequences.count() and {x[:2] for x in got if x[2]} == hidden and len(hidden) > 3000


def test_capped_pairs_equal_a_full_order(spark):
    counts = spark.createDataFrame([("hot", 9000), ("a", 2), ("b", 1), ("c", 40)], "slide_id string, n long")
    every = tokens.adjacent_pairs(counts)
    want = placed(every, 4, "a", "b").where("r <= 50")
    pairs = lambda df: sorted((r.slide_id, r.a, r.b) for r in df.collect())
    assert pairs(tokens.adjacent_pairs(counts, 50, 4)) == pairs(want)
    assert pairs(tokens.self_pairs(counts, 10**6, 4)) == pairs(tokens.self_pairs(counts))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_embeddings_pass_no_window(sequences):
    for df in (tokens.mask_patches(sequences), tokens.drop_packs(sequences, 0.5), tokens.mask_packs(sequences)):
        text = plan(df)
        assert "Window" in text and not any("embedding" in line for line in text.splitlines() if "Window" in line or re.search(r"\bSort \[", line) and "order" in line)


def test_thresholds_of_ties_and_all(spark):
    rows = spark.createDataFrame([("s", 5, i) for i in range(30)] + [("t", i, i) for i in range(4)] + [("u", 1, 1)], "slide_id string, h long, i int").select("slide_id", F.struct("h", "i").alias("order"))
    got = {r.slide_id: (r.n, r.cut and tuple(r.cut)) for r in tokens.thresholds(rows, lambda n: F.when(F.col("slide_id") == "u", 0).otherwise(F.least(n, F.lit(9)))).collect()}
    assert got == {"s": (30, (5, 8)), "t": (4, None)}


def test_ranks_by_ranges(spark):
    r = random.Random(3)
    value = lambda: "".join(r.choice("aéz🙂~") for _ in range(r.randint(0, 5)))
    rows = [(str(i), "t", value()) for i in range(3000)] + [(str(i), "t", "hot") for i in range(3000)] + [(str(i), "u", str(i % 2)) for i in range(50)]
    long = spark.createDataFrame(rows, "id string, task string, value string").repartition(5)
    places = {t: {v: i for i, v in enumerate(sorted({v for _, t2, v in rows if t2 == t}))} for t in "tu"}
    for sample, ranges in ((20_000, 1000), (40, 7), (1, 1)):
        got = tasks.label_ids(long, sample, ranges)
        assert sorted((x.id, x.task, x.value, x.label) for x in got.collect()) == sorted((i, t, v, places[t][v]) for i, t, v in rows)
    inventory = {x.task: (x.classes, x.n_classes, x.task_type, x.width) for x in tasks.class_inventory(long).collect()}
    assert inventory == {t: (list(p), len(p), "binary" if len(p) == 2 else "multi", 1 if len(p) == 2 else len(p)) for t, p in places.items()}
    assert not re.search(r"Window \[.*windowspecdefinition\(task#\d+, value", plan(got))
    assert tasks.label_ids(long.where("false")).count() == 0 and tasks.class_inventory(long.where("false")).count() == 0


def test_first_part(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abé_") for _ in range(r.randint(0, n)))
    names = [(i, word(9)) for i in range(300)] + [(300, None), (301, "")]
    parts = {word(4): r.randint(0, 30) for _ in range(60)} | {"bbbb": -1}
    parts.pop("", None)
    for more in ({}, {"": 12}):
        known = parts | more
        want = {(i, min(((o, p) for p, o in known.items() if p in n), default=(0, None))[1]) for i, n in names if n is not None and any(p in n for p in known)}
        a, b = spark.createDataFrame(names, "i int, name string"), spark.createDataFrame([*known.items(), (None, -9)], "part string, order int")
        for most in (10**6, 0):
            assert {(x.i, x.part) for x in cases.first_part(a, b, most).collect()} == want
    assert cases.first_part(a, b.where("false")).count() == 0
    assert "Generate" not in plan(cases.first_part(a, b))
