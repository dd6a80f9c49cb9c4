"""The entry module, and every registered SQL against its query on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from groundwell import queries as core

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def plain(value):
    return round(value, 5) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(core.ORACLE))  # those of the training-data operators have tests of their own
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall()) == got


def test_entry(spark):
    assert entry.entry(spark).count() > 0
