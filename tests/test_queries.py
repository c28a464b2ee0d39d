"""Registered queries against their SQL twins on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
GAPS = {"prf_19_histogram_gaps", "prf_03_nonfinite", "st_04_undefined", "st_17_p_value", "st_21_eligibility"}
PREFIXES = ("nrm_", "win_", "jn_", "set_", "ml_0", "evl_0", "evl_1", "ts_0", "lk_0", "ev_0", "reg_0", "evl_13_g")
SLOW = {"ml_04_exclusions", "ev_07_analyze", "lk_07_review", "evl_08_silhouette", "reg_01_model_score", "reg_03_input_schema", "nrm_12_roles"}
NAMES = sorted(n for n in entry.oracle_sql() if (n.startswith(PREFIXES) or n in GAPS) and n not in SLOW)


LARGER = "/root/testdata/sf0.01"


def connection(folder):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 8


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    compare(spark, con, name, FOLDER)


@pytest.mark.parametrize("name", sorted(GAPS))
def test_gaps_match_sql_on_more_rows(spark, name):
    compare(spark, connection(LARGER), name, LARGER)


def compare(spark, con, name, folder):
    got = entry.queries()[name](spark, folder)
    names = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr)
    found = con.execute(entry.oracle_sql()[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == names
    expected = sorted((tuple(r[order.index(c)] for c in names) for r in found.fetchall()), key=repr)
    assert rows == expected
