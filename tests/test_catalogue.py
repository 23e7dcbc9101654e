"""A few catalogue queries against DuckDB at the smallest scale; the driver runs all of them."""

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["pattern_two_hop", "pattern_wildcard_relation", "sparql_minus", "rule_transitive_once", "all_instances", "overwrite_merge", "type_check_violations"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", NAMES)
def test_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert order(got.select(*columns).collect()) == order(want.select(", ".join(columns)).fetchall())


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
