"""Every query gives the rows of its SQL; the others run and keep their promises elsewhere."""

import duckdb
import pytest

import __spark_entry__ as entry
from slideqa.plans import registry
from tests.compare import database, rows
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def db():
    return database(SMALL)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, SMALL).toPandas()
    if name in registry.ORACLE_SQL:
        want = db.execute(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


@pytest.mark.parametrize("of_each", [[21, 12], [21, 4, 1]])
def test_assembled_sequences_round_floats_and_keep_lone_tokens(spark, tmp_path, of_each):
    # 0.005 and 0.015 as floats lie below the half; 100 times as much as a float is the half itself
    vectors = [[0.005, 0.015, 0.3], [-0.005, -0.015, 0.025], [0.125, -0.125, 0.0049]]
    labels = [label for label, n in enumerate(of_each) for _ in range(n)]
    made = spark.createDataFrame([(i, vectors[i % 3], label) for i, label in enumerate(labels)], "vec_id long, embedding array<float>, label int")
    made.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = registry.QUERIES["assembled_sequences"](spark, str(tmp_path)).toPandas()
    want = c.execute(registry.ORACLE_SQL["assembled_sequences"]).df()
    assert len(want) == sum((n - 1) // 10 * 10 + 1 for n in of_each) and rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_breakdown_expands_sums_only(spark):
    plan = registry.QUERIES["score_breakdown"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1 and "CartesianProduct" not in plan
