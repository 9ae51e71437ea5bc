import pytest

from oracle import assert_same
from tidegauge.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, sf_dir, name):
    assert_same(QUERIES[name], ORACLE_SQL[name], spark, sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_query_without_sql_covers_all_documents(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir)
    assert rows.select("doc_id").distinct().count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_there_is_one_query_an_operator():
    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, 11))
