"""What the physical plans of the main operators look like."""

import re

from slideqa.operators import geometry, scoring, tokens
from slideqa.plans import registry
from slideqa.plans import views as v
from tests.conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_products(spark):
    for name in ("patch_neighbours", "covering_packs", "bounding_boxes", "session_paths", "distant_partners", "assembled_sequences"):
        text = plan(registry.QUERIES[name](spark, SMALL))
        assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text, name


def test_substring_joins_are_joins_by_equality(spark):
    for name in ("cases_by_substring", "geometry_lookup"):
        assert not re.search("CartesianProduct|NestedLoop", plan(registry.QUERIES[name](spark, SMALL))), name


def test_counting_tokens_keeps_embeddings_out_of_windows(spark):
    assert "Window" not in plan(tokens.with_roles(spark.read.parquet(f"{SMALL}/embeddings.parquet").selectExpr("label as slide_id", "vec_id as token_idx", "embedding")))


def test_output_expressions_are_not_repeated(spark):
    assert len(plan(registry.QUERIES["attached_outputs"](spark, SMALL))) < 40_000


def test_expanded_tasks_are_not_broadcast(spark):
    text = plan(registry.QUERIES["attached_outputs"](spark, SMALL))
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_columns_are_pruned(spark):
    text = plan(scoring.judge_rows(v.view(spark, SMALL, v.CHOICE).selectExpr("question_id", "prediction", "ground_truth", "0D as precision", "0D as relevance")))
    assert not re.search(r"ReadSchema: .*o_totalprice", text)


def test_scoring_choices_needs_no_python_and_no_shuffle(spark):
    text = plan(scoring.score_choices(v.view(spark, SMALL, v.CHOICE)))
    assert not re.search("Python|Arrow|Exchange", text)


def test_same_rows_for_any_partitioning(spark):
    patches = v.view(spark, SMALL, v.PATCHES)
    one, many = (geometry.near_pairs(patches.repartition(n), 700.0).count() for n in (1, 8))
    assert one == many
