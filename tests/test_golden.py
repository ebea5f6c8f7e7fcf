"""Hand-worked cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slideqa.functions import choices, llm_text, options, text_scores
from slideqa.operators import cases, corpus, geometry, regions, scoring, tasks, tokens
from slideqa.sources import readers, writers


def one(spark, expression, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(expression.alias("out")).first().out


def test_options(spark):
    f = options.normalized_option(F.col("t"))
    assert [one(spark, f, t=t) for t in ("A: x", "B y", "C. z", "none")] == ["A. x", "B. y", "C. z", "none"]
    block = lambda o, d=None, c=None: one(spark, options.options_block(F.col("o").cast("string"), F.col("d").cast("string"), F.col("c").cast("string")), o=o, d=d, c=c)
    assert block('{"A":"x","B":"y"}') == "A. x\nB. y"
    assert block('["A","B"]', '{"A":"x"}') == "A. x"
    assert block("A. x, B: y") == "A. x\nB. y"
    assert block(None) == "" and block("[]") == ""
    assert block('[{"key":"A","label":"x"},{"key":"B","label":"y"}]') == "A. x\nB. y"
    assert block('["q"]', None, '{"Z":"1","A":"2"}') == "Z. 1\nA. 2"
    assert block('{"B":"y","A":"x"}', None, "{}") == "B. y\nA. x"


@pytest.mark.parametrize(("fields", "want"), [
    ({"answer_index": "[0,1,3]"}, ["A", "B", "D"]), ({"answer_index": "2"}, ["C"]), ({"answer_index": "0"}, ["A"]),
    ({"answer_index": "1", "answer": "A"}, ["B"]), ({"answer_key": "", "answer": "C"}, ["C"]), ({"answer_index": "[]", "answer": "C"}, []), ({}, None),
])
def test_answers(spark, fields, want):
    every = {f: F.lit(fields.get(f)).cast("string") for f in (*options.INDEX_FIELDS, *options.ANSWER_FIELDS)}
    assert one(spark, options.answer_letters(every), x=1) == want


def test_reject(spark):
    f = lambda q, l, k, b: one(spark, options.reject_reason(F.lit(q), l, F.lit(k), F.lit(b)), x=1)
    some, none = F.array(F.lit("A")), F.array().cast("array<string>")
    assert f("  ", some, "open", "") == "empty question"
    assert f("q", none, "open", "") == "empty answer"
    assert f("q", some, "single", "A. x") == "format=single and options length<10 (actual=4)"
    assert f("q", some, "open", "A. x") is None


@pytest.mark.parametrize(("text", "want"), [("Answer: C, F.", ["C", "F"]), ("ABC", []), ("B", ["B"]), ("A cat", ["A"])])
def test_letters(spark, text, want):
    assert one(spark, choices.option_letters(F.col("t")), t=text) == want


@pytest.mark.parametrize(("p", "r", "want"), [("A, C", "C, A", True), ("A", "A, C", False), ("A, B, C", "A, C", False), ("none", "none", True), ("A, A", "A", True), ("A, B", "AB", True)])
def test_exact_match(spark, p, r, want):
    assert one(spark, choices.choice_match(F.col("p"), F.col("r"))["exact_match"], p=p, r=r) is want


@pytest.mark.parametrize(("p", "r", "want"), [(["A"], ["A", "C"], 0.5), (["A", "B"], ["A", "C"], 0.0), ([], ["A"], 0.0), ([], [], 1.0)])
def test_graded(spark, p, r, want):
    a = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    assert one(spark, choices.graded_score(F.lit("multi"), a(p), a(r), F.lit(False)), x=1) == want


def naive_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_text_scores():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 20))] for _ in range(2))
        assert text_scores.lcs_length(a, b) == naive_lcs(a, b)
    assert text_scores.rouge_scores("the cat sat.", "the cat ran") == pytest.approx((2 / 3, 2 / 3, 2 / 3))
    assert text_scores.meteor_scores("a b c", "a b c")[0] == pytest.approx(53 / 54)
    assert text_scores.meteor_scores("", "a")[0::4] == (0.0, 1.0) and text_scores.meteor_scores("x", "y")[0::4] == (0.0, 0.0)
    assert text_scores.rouge_scores(None, "a") == (0.0, 0.0, 0.0)


def test_model_text(spark):
    assert one(spark, llm_text.claims(F.col("t")), t="- first claim\n2) second one\nabc") == ["first claim", "second one"]
    items = llm_text.judge_items(F.col("t"))
    assert one(spark, llm_text.mean_score(items), t="```python\n[{'score':1},{'score':'x'},{}]\n```") == 0.5
    assert one(spark, llm_text.mean_score(items), t="no list") == 0.0
    for text, want in (('{"a":1}', '{"a":1}'), ('```json\n{"a":1}\n```', '{"a":1}'), ('text {"a":1} end', '{"a":1}'), ("nope", None), ('{"a":1},{"b":2}', None), ("", None), ('{"a":1}] junk }', None), ("{'a':1}", None), ('[1,{"b":[2]}]', '[1,{"b":[2]}]'), ('"x"', '"x"'), ("12", "12"), ("1 2", None), ('{"a":1', None), ('{"a":01}', None)):
        got = one(spark, llm_text.parsed_json(F.col("t")), t=text)
        assert (got.json and got.json.strip()) == want and got.parse_error == (want is None)
    diagnosis = "HCC, IHC: CK19(+), Ki67. pT2N0"
    assert one(spark, llm_text.ihc_text(F.col("t")), t=diagnosis) == "CK19(+), Ki67" and one(spark, llm_text.ptnm_code(F.col("t")), t=diagnosis) == "pT2N0"
    got = one(spark, llm_text.captions(F.col("t")), t="x Caption A: one\nCaption C: three")
    assert (got.caption_a, got.caption_b, got.caption_c) == ("one", "", "three")


def test_task_types(spark):
    f = lambda k, o: one(spark, scoring.task_type(F.lit(k).cast("string"), F.lit(o)), x=1)
    assert [f("Multi", False), f("open", True), f(None, True), f(None, False)] == ["choice", "open_ended", "choice", "open_ended"]


def test_options_decide_without_format(spark):
    rows = spark.createDataFrame([(1, "A", "A", None, "A. x", None), (2, "B", "A", "", None, "[]"), (3, "one", "one", None, None, None)], "question_id long, prediction string, ground_truth string, format string, options string, choices string")
    choices, texts, summary = scoring.evaluate(rows)
    assert sorted(r.question_id for r in choices.collect()) == [1, 2] and [r.question_id for r in texts.collect()] == [3]
    assert {r.metric: r.value for r in summary.where("group_key = 'choice'").collect()} == {"correct": 1.0, "total": 2.0, "accuracy": 0.5}
    assert scoring.evaluate(rows.drop("options", "choices"))[0].count() == 0


def test_reports_are_ordered(spark):
    rows = spark.createDataFrame([(i, "single", f"{i % 3}.{i % 2}", ["WSI", None, "ROI"][i % 3], 1.0) for i in range(30)], "question_id long, format string, subcategory string, belong_level string, score double")
    keys = [(r.group_type, r.group_key, r.group_key2) for r in scoring.ordered_report(scoring.score_breakdown(rows)).collect()]
    assert keys == sorted(keys) and len(keys) > 10


def test_cases_and_geometry_by_part(spark):
    """The first in file order whose name is part of the slide's, with its whole row."""
    slides = spark.createDataFrame([("S10",), ("S1",), ("none",)], "slide_id string")
    known = spark.createDataFrame([(0, "S10.tif", "d0", 7), (1, "S1.svs", "d1", 8), (2, "S1", "d2", 9)], "position long, img string, diagnosis string, more long")
    got = {r.slide_id: (r.position, r.img, r.diagnosis, r.more) for r in cases.by_substring(slides, known).collect()}
    assert got == {"S10": (0, "S10.tif", "d0", 7), "S1": (1, "S1.svs", "d1", 8), "none": (None, None, "N/A", None)}
    assert cases.by_substring(slides, known.where("false")).count() == 3
    shapes = spark.createDataFrame([(5, "S1", "c0"), (3, "0", "c1"), (4, "S1", "c2")], "position long, slide_id string, cluster_id string")
    found = {(r.slide_id, r.cluster_id) for r in cases.geometry_with_fallback(slides, shapes).collect()}
    assert found == {("S1", "c0"), ("S1", "c2"), ("S10", "c1")}
    assert {(r.slide_id, r.cluster_id) for r in cases.geometry_with_fallback(slides, shapes.drop("position")).collect()} == found


def test_generated_ids_are_distinct(spark):
    images = spark.range(22_000).selectExpr("concat('image_', id) as image", "'WSI' as level")
    ids = tasks.expand_tasks(images).select("task_id")
    assert ids.count() == ids.distinct().count() == 440_000


def test_tiling(spark):
    slides = spark.createDataFrame([("s", 5000, 1000)], "slide_id string, width long, height long")
    g = geometry.tile_grid(slides).first()
    assert (g.packs_x, g.packs_y, g.patch_w, g.patch_h) == (3, 1, 555, 333)
    slides = spark.createDataFrame([("s", 3000, 3000)], "slide_id string, width long, height long")
    shape = spark.createDataFrame([("s", "c", 500.0, 2900.0, 300.0, 5)], "slide_id string, cluster_id string, center_x double, center_y double, radius double, count int")
    got = {r.type + (r.magnification or ""): (r.x0, r.y0, r.x1, r.y1) for r in geometry.boxes(slides, shape, 0).collect()}
    assert got == {"wsi": (0, 0, 3000, 3000), "cluster": (200, 2600, 800, 3000), "roi10x": (0, 1876, 2048, 3000), "roi20x": (0, 2388, 1024, 3000)}
    grid = spark.createDataFrame([("s", 3, 1, 100, 100)], "slide_id string, packs_x long, packs_y long, stride_x long, stride_y long")
    region = spark.createDataFrame([("s", "r", 100, 0, 200, 50), ("s", "out", 900, 0, 950, 50)], "slide_id string, region_id string, x0 long, y0 long, x1 long, y1 long")
    covered = geometry.covering_packs(region, grid)
    assert [r.pack_idx for r in covered.collect()] == [1]
    assert [r.region_id for r in geometry.uncovered_regions(region, covered).collect()] == ["out"]
    point = spark.createDataFrame([(10, 20, 1, 1, 0, 0, 100, 100, True, False)], "x int, y int, w int, h int, crop_x int, crop_y int, crop_w int, crop_h int, flip_v boolean, flip_h boolean")
    assert geometry.source_point(point).select("source_x", "source_y").first() == (10, 79)


def test_tokens(spark):
    rows = spark.createDataFrame([("s", i, [float(i)]) for i in range(21)], "slide_id string, token_idx int, embedding array<float>")
    kinds = [r.token_type for r in tokens.with_roles(rows).orderBy("token_idx").collect()]
    assert [i for i, k in enumerate(kinds) if k == "summary"] == [10, 20] and kinds.count("patch") == 18 and kinds[0] == "global"
    many = spark.createDataFrame([("s", i, [0.0]) for i in range(101)], "slide_id string, token_idx int, embedding array<float>")
    kept = tokens.drop_packs(many, 0.2, 5)
    assert kept.count() == 51 and kept.where("token_idx = 0").count() == 1
    assert kept.exceptAll(tokens.drop_packs(many.repartition(3), 0.2, 5)).isEmpty()
    pairs = tokens.adjacent_pairs(spark.createDataFrame([("s", 3), ("t", 1)], "slide_id string, n long"))
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    vectors = spark.createDataFrame([([0.0] * n,) for n in (512, 1024, 768)], "embedding array<float>")
    got = tokens.padded(vectors).collect()
    assert [len(r.embedding) if r.embedding else r.reject_reason for r in got] == [1024, 1024, "unexpected dimension: 768"]
    noisy = tokens.add_noise(rows, 0.1)
    assert noisy.exceptAll(tokens.add_noise(rows.repartition(5), 0.1)).isEmpty()
    wide = spark.createDataFrame([("s", i, [1.0] * 500) for i in range(20)], "slide_id string, token_idx int, embedding array<float>")
    drawn = np.array([r.embedding for r in tokens.add_noise(wide, 0.1).collect()]) - 1
    assert abs(drawn.mean()) < 0.01 and abs(drawn.std() - 0.1) < 0.01 and len({x.tobytes() for x in drawn}) == 20
    mixed = tokens.mixed_pairs(spark.createDataFrame([(f"s{i}", 4) for i in range(40)], "slide_id string, n long"), 2)
    assert {r.kind for r in mixed.collect()} == {"adjacent", "noise"} and mixed.count() == 80


def test_regions(spark):
    r = np.random.default_rng(3)
    xy = np.array([(512.0 * x, 512.0 * y) for y in range(6) for x in range(8)])
    label, size = regions.grow(xy, r.random((48, 4)))
    assert set(label) == {0, 1, 2} and size == 512
    rows = spark.createDataFrame([("s", i, float(x), float(y), [float(v) for v in r.random(4)]) for i, (x, y) in enumerate(xy)] + [("few", 0, 0.0, 0.0, [1.0])], "slide_id string, patch_idx int, x double, y double, feature array<float>")
    labels = regions.grow_regions(rows)
    assert labels.count() == 48
    circles = regions.circles(rows, labels).collect()
    assert sum(c["count"] for c in circles) == 48 and all(c.radius > 0 for c in circles)


def test_classes(spark):
    long = spark.createDataFrame([("1", "t", "b"), ("2", "t", "a"), ("3", "t", "b"), ("1", "u", "1"), ("2", "u", "2"), ("3", "u", "3")], "id string, task string, value string")
    got = {r.task: (r.task_type, r.width) for r in tasks.class_inventory(long).collect()}
    assert got == {"t": ("binary", 1), "u": ("multi", 3)}
    assert {r.value: r.label for r in tasks.label_ids(long).where("task = 't'").collect()} == {"a": 0, "b": 1}


def test_task_expansion(spark):
    images = spark.createDataFrame([("a", "WSI"), ("b", "Cluster"), ("c", "ROI")], "image string, level string")
    got = {r.level: r["count"] for r in tasks.expand_tasks(images).groupBy("level").count().collect()}
    assert got == {"WSI": 20, "Cluster": 20, "ROI": 25}
    assert tasks.expand_difficulties(images).count() == 21


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nbad\n[1]\n{"a": 2}\n')
    good, bad = readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2] and bad.count() == 2
    with pytest.raises(ValueError):
        readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int", "fail")
    for name, text in (("session_x_20240102_030405", '{"wsi_id": "x"}'), ("session_y", '[{"wsi_id": "y"}, {"wsi_id": "z"}, 3]')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "inference_results.json").write_text(text)
        (tmp_path / name / "vqa.jsonl").write_text('{"qa_id": "1", "question": "é?"}\n')
    got = readers.read_sessions(spark, str(tmp_path))
    assert got.count() == 3 and readers.read_question_lines(spark, str(tmp_path), False).count() == 2
    assert str(got.select(F.max(readers.session_time(F.col("session")))).first()[0]) == "2024-01-02 03:04:05"
    assert readers.file_listing(spark, str(tmp_path)).where("session = 'session_y'").count() == 2
    (tmp_path / "cases.json").write_text('{"img": "s.svs", "diagnosis": "d"}')
    assert readers.read_cases(spark, str(tmp_path / "cases.json")).first().img == "s.svs"
    (tmp_path / "m.tsv").write_text("filename\tx\na.svs\t1\n")
    assert readers.read_manifest(spark, str(tmp_path / "m.tsv")).first().filename == "a.svs"
    (tmp_path / "l.csv").write_text("id,t\n01,a\n")
    assert readers.read_labels(spark, str(tmp_path / "l.csv")).first().id == "01"
    rows = spark.createDataFrame([("é", None), ("b", "why")], "q string, reject_reason string")
    assert writers.write_split(rows, str(tmp_path / "both")) == {"total": 2, "success": 1, "filtered": 1, "success_rate": 50.0}
    assert spark.read.text(str(tmp_path / "both" / "kind=accepted")).first().value == '{"q":"é"}'
    assert spark.read.json(str(tmp_path / "both" / "kind=rejected")).first().reject_reason == "why"
    assert writers.write_split(rows.where("false"), str(tmp_path / "none"))["success_rate"] == 0 and writers.read_split(spark, str(tmp_path / "none"), "accepted").isEmpty()
    summary = spark.createDataFrame([("overall", "all", "n", 2.0)], "group_type string, group_key string, metric string, value double")
    writers.write_summary(summary, str(tmp_path / "sum"))
    assert spark.read.text(str(tmp_path / "sum")).first().value == '{"overall":{"all":{"n":2.0}}}'
    matrix = spark.createDataFrame([("s", [[1.0], [2.0]], [[0.0, 1.0], [2.0, 3.0]])], "slide_id string, features array<array<double>>, coords array<array<double>>")
    assert [(r.patch_idx, r.x, r.y) for r in readers.exploded_features(matrix).collect()] == [(0, 0.0, 1.0), (1, 2.0, 3.0)]


def test_resume_and_empty(spark):
    rows = spark.createDataFrame([(1, "A", "A", "single"), (2, "B", "A", "single")], "question_id long, prediction string, ground_truth string, format string")
    done = scoring.score_choices(rows.where("question_id = 1"))
    assert scoring.resumed(rows, done, scoring.score_choices).count() == 2
    assert scoring.choice_accuracy(scoring.score_choices(rows.where("false"))).first() == (0, 0, 0.0)
    assert scoring.text_means(scoring.score_texts(rows.where("false"))).first().meteor_score == 0.0
    assert corpus.conversion_stats(rows.where("false").withColumn("reject_reason", F.lit(""))).first().success_rate == 0.0
