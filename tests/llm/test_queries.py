"""The registered queries on the smallest tables: SQL where there is some, the contract's shape elsewhere."""

import re

import pytest

from cairn.llm import queries
from tests.oracle import same, views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_matches_sql(spark, name):
    same(queries.queries()[name](spark, SF), views(SF), queries.oracles()[name])


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 14))


def test_shapes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, columns, rows in (
        ("op1_language_id", ["page_id"], spark.read.parquet(f"{SF}/pages.parquet").count()),
        ("op2_quality", ["doc_id", "held_out", "score", "predicted"], docs),
        ("op6_pii", ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], docs),
        ("op9_order_minhash", ["doc_id", "class_id", "class_size"], docs),
    ):
        got = queries.queries()[name](spark, SF)
        assert got.columns[: len(columns)] == columns and got.count() == rows
    near = queries.queries()["op3_prefix_forest"](spark, SF)
    assert near.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert near.groupBy("query_id").count().where("count <> 20").count() == 0
