"""Every query that has SQL returns the same rows, names and types as the SQL."""

import re

import pytest

import __spark_entry__ as contract
import oracle

from workload.oracles import DECIMALS
from workload.oracles import ORACLES as SQL
from workload.queries import QUERIES

SCALE = "sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SCALE)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, f"{oracle.DATA}/{SCALE}")
    names, rows = oracle.spark_rows(df)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoop|EvalPython|InPandas", plan)
    want_names, want = oracle.duck_rows(con, SQL[name])
    assert names == want_names
    assert rows == want
    assert oracle.type_mismatches(df, oracle.duck_types(con, SQL[name])) == {}


@pytest.mark.parametrize("name", sorted(DECIMALS))
def test_contract_hands_over_doubles(spark, con, name):
    df = contract.queries()[name](spark, f"{oracle.DATA}/{SCALE}")
    sql = contract.oracle_sql()[name]
    assert oracle.spark_rows(df) == oracle.duck_rows(con, sql)
    assert oracle.type_mismatches(df, oracle.duck_types(con, sql)) == {}
    assert "decimal" not in {f.dataType.typeName() for f in df.schema}


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
    assert set(contract.queries()) - set(contract.LLM_QUERIES) == set(QUERIES)
    assert set(contract.oracle_sql()) - set(contract.LLM_ORACLES) == set(SQL)
    assert set(QUERIES) - set(SQL) == {"profile_sketched_percentiles", "profile_report"}


def test_entry_is_the_profile(spark):
    df = contract.entry(spark)
    assert len(df.columns) == 65
    assert df.count() == 150
