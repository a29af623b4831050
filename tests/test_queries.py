"""Every registered place query against its SQL."""

import duckdb
import pytest

from cairn.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    found = QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    wanted = duck.sql(ORACLE_SQL[name])
    assert sorted(wanted.columns) == columns
    got = sorted(repr([r[c] for c in columns]) for r in found.collect())
    at = [wanted.columns.index(c) for c in columns]
    assert got == sorted(repr([row[i] for i in at]) for row in wanted.fetchall())


def test_fuzzy_match_runs(spark, sf_dir):
    assert QUERIES["fuzzy_name_match"](spark, sf_dir).count() > 0


def test_entry_module(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() >= 0


def test_every_row_is_evidence(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert QUERIES["child_collect"](spark, sf_dir).agg({"n": "sum"}).first()[0] == rows
