import json

from slideqa.streaming.scoring import score_new, score_stream


def test_each_line_is_scored_once(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()

    def put(name, rows):
        lines = [json.dumps({"question_id": i, "prediction": p, "ground_truth": "A, C", "info": {"format": "multi"}}) for i, p in rows]
        (tmp_path / "in" / name).write_text("\n".join([*lines, "", "bad"]) + "\n")

    put("1.jsonl", [("a", "A, C"), ("b", "A")])
    score_stream(spark, source, out, state).awaitTermination()
    put("2.jsonl", [("c", "B")])
    score_stream(spark, source, out, state).awaitTermination()
    got = {r.question_id: r.score for r in spark.read.parquet(out).collect()}
    assert got == {"a": 1.0, "b": 0.5, "c": 0.0} and spark.read.parquet(out).count() == 3


def test_each_question_is_scored_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()

    def put(name, rows):
        lines = [json.dumps({"question_id": i, "prediction": p, "ground_truth": "A, C", "info": {"format": "multi"}}) for i, p in rows]
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")

    def scores():
        return sorted((r.question_id or "", r.score) for r in spark.read.parquet(out).collect())

    put("1.jsonl", [("a", "A, C"), ("b", "A"), ("b", "A"), (None, "B")])
    score_new(spark, source, out, str(tmp_path / "s1")).awaitTermination()
    assert scores() == [("", 0.0), ("a", 1.0), ("b", 0.5)]
    put("2.jsonl", [("a", "B"), ("c", "B"), ("b", "A, C")])
    score_new(spark, source, out, str(tmp_path / "s1")).awaitTermination()
    assert scores() == [("", 0.0), ("a", 1.0), ("b", 0.5), ("c", 0.0)]
    score_new(spark, source, out, str(tmp_path / "s1")).awaitTermination()
    assert len(scores()) == 4
    # a checkpoint that was lost reads every file again; the batch with its number is written over, others hold
    put("3.jsonl", [("d", "A, C")])
    score_new(spark, source, out, str(tmp_path / "s2")).awaitTermination()
    assert [x for x in scores() if x[0]] == [("a", 1.0), ("b", 0.5), ("c", 0.0), ("d", 1.0)]
