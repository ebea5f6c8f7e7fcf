"""Nested documents written line by line, and feature documents in both layouts."""

import json

import pytest
from pyspark.sql import functions as F

from slideqa.sources import readers, writers


def plain(slides, clusters, regions):
    out = []
    for s, summary in sorted(slides):
        own = [{"cluster_id": c, "cluster_summary": t, "rois": [{"magnification": m, "text": x} for s3, c3, m, x in sorted(regions) if (s3, c3) == (s, c)]} for s2, c, t in sorted(clusters) if s2 == s]
        out.append({"slide_id": s, "summary": summary, "clusters": own})
    return out


def frames(spark, slides, clusters, regions):
    return spark.createDataFrame(slides, "slide_id string, summary string"), spark.createDataFrame(clusters, "slide_id string, cluster_id string, summary string"), spark.createDataFrame(regions, "slide_id string, cluster_id string, magnification int, text string").repartition(4)


def test_nested_documents(spark, tmp_path):
    slides = [("s", 'a "quoted" } summary'), ("t", "é"), ("u", "alone")]
    clusters = [("s", "c1", "x"), ("s", "c0", "y"), ("t", "c0", "]}"), ("nowhere", "c0", "z")]
    regions = [("s", "c1", 20, "b"), ("s", "c1", 10, "z"), ("s", "c1", 10, "z"), ("t", "c0", 10, "{"), ("t", "c9", 10, "no cluster")]
    for n in (1, 3):
        path = str(tmp_path / f"n{n}")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            writers.write_nested(*frames(spark, slides, clusters, regions), path)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        got = [d for f in sorted((tmp_path / f"n{n}").glob("part-*")) if f.stat().st_size for d in json.loads(f.read_text())]
        assert sorted(got, key=lambda d: d["slide_id"]) == plain(slides, [c for c in clusters if c[0] != "nowhere"], [r for r in regions if r[1] != "c9"])
        assert spark.read.json(path, multiLine=True).count() == 3
    writers.write_nested(*(f.where("false") for f in frames(spark, slides, clusters, regions)), str(tmp_path / "none"))
    assert not any(f.stat().st_size for f in (tmp_path / "none").glob("part-*"))


def test_a_slide_of_many_regions_stays_in_lines(spark, tmp_path):
    n = 200_000
    slides, clusters, _ = frames(spark, [("s", "x")], [("s", "c", "y")], [("s", "c", 1, "z")])
    regions = spark.range(n).select(F.lit("s").alias("slide_id"), F.lit("c").alias("cluster_id"), F.lit(10).alias("magnification"), F.format_string("region %07d", "id").alias("text"))
    writers.write_nested(slides, clusters, regions, str(tmp_path / "big"))
    (file,) = [f for f in (tmp_path / "big").glob("part-*") if f.stat().st_size]
    assert max(map(len, file.read_text().split("\n"))) < 100
    (doc,) = json.loads(file.read_text())
    assert [r["text"] for r in doc["clusters"][0]["rois"]] == [f"region {i:07d}" for i in range(n)]


CASES = {
    "[[1, 2], [3.5, 4]]": ([[1, 2], [3.5, 4]], None, None),
    '{"features": [[1], [2]], "coords": [[0, 1], [2, 3]], "more": 1}': ([[1], [2]], [[0, 1], [2, 3]], None),
    '{"summary_tokens": [[7]]}': ([[7]], None, None),
    " [1, 2, 3] ": ([[1, 2, 3]], None, None),
    '{"features": [5, 6]}': ([[5, 6]], None, None),
    '{"other": [[1]]}': (None, None, "no features"),
    "3": (None, None, "no features"),
    "[[1, 2], [3]]": (None, None, "rows of unlike lengths"),
    '[["a"]]': (None, None, "not numbers"),
    "[[1], null]": (None, None, "not numbers"),
    "[[1": (None, None, "not JSON"),
    "": (None, None, "not JSON"),
    '{"features": [[1], [2]], "coords": [[0, 1]]}': (None, None, "coords don't match"),
    '{"features": [[1]], "coords": [[0]]}': (None, None, "coords don't match"),
}


@pytest.mark.parametrize("text", list(CASES))
def test_feature_documents(spark, text):
    features, coords, why = CASES[text]
    r = readers.parsed_features(spark.createDataFrame([("s", text)], "slide_id string, value string")).first()
    assert r.reject_reason == why
    if why is None:
        assert r.features == features and r.coords == coords
