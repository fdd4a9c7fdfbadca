import re

import pytest

from driftkit.llm import queries as Q

from ..oracle import compare, connect

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in Q.queries()]
    assert numbers == list(range(1, 14))
    assert Q.oracle_sql().keys() <= Q.queries().keys()


@pytest.mark.parametrize("name", Q.oracle_sql())
def test_query_agrees_with_its_sql(spark, name):
    assert compare(name, spark, connect(SF), SF, Q.queries()[name], Q.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(Q.queries().keys() - Q.oracle_sql().keys()))
def test_query_runs_over_its_whole_table(spark, name):
    found = Q.queries()[name](spark, SF)
    read = {"op3_html_text": "pages", "op12_whitening": "embeddings"}.get(name, "documents")
    whole = spark.read.parquet(f"{SF}/{read}.parquet").count() * (8 if name == "op12_whitening" else 1)
    n = found.count()
    assert n == whole if name not in ("op1_token_shards", "op5_decontamination") else n > 0
