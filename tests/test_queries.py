"""Every registered query against its checking SQL, on whole small tables."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry_file
from conftest import SMALL

QUERIES, ORACLE = entry_file.queries(), entry_file.oracle_sql()


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SMALL}/{file}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value % 1 == 0 else float(value)
    if isinstance(value, datetime.datetime):
        return str(value.replace(tzinfo=None))
    return value


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, engine, name):
    df = QUERIES[name](spark, SMALL)
    rows, columns = df.collect(), sorted(df.columns)
    result = engine.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    got = sorted(repr([plain(r[c]) for c in columns]) for r in rows)
    want = sorted(repr([plain(r[i]) for i in places]) for r in result.fetchall())
    assert got == want


def test_entry(spark):
    assert entry_file.entry(spark).count() > 0


def test_invariants(spark):
    from pagewarden.registry import audits
    evaluated = audits._audit(spark, SMALL).evaluated
    for site in evaluated.collect():
        fired = [f.rule_id for f in site.findings]
        assert fired.count("R01") == fired.count("R02")
        assert ("R05" in fired) == (site.privacy_policy_url is None)
        if "R12" in fired:
            assert not {"R06", "R07", "R08", "R09", "R10"} & set(fired)
