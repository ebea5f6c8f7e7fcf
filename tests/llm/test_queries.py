"""The registered queries against their SQL; the others over their whole table."""

import pytest

from slideqa.llm import queries
from tests.compare import database, rows
from tests.conftest import SMALL

TABLE = {"op3_url_filter": "pages", "op7_warc": "pages", "op1_decontaminate": None, "op11_filter_audit": None, "op13_prefix_trie": None}


@pytest.fixture(scope="module")
def db():
    return database(SMALL)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, db, name):
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    table = TABLE.get(name, "documents")
    if table:
        assert len(got) == db.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
    if name in queries.ORACLE_SQL:
        want = db.execute(queries.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
