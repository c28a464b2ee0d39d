"""Comparison of a registered query with its SQL twin on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def twin(spark):
    def compare(name, folder=FOLDER, digits=9):
        con = duckdb.connect()
        for f in glob.glob(f"{folder}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        got = entry.queries()[name](spark, folder)
        names = sorted(got.columns)
        key = lambda r: repr(r)
        tidy = lambda v: round(v, digits) if isinstance(v, float) else v
        rows = sorted((tuple(tidy(r[c]) for c in names) for r in got.collect()), key=key)
        found = con.execute(entry.oracle_sql()[name])
        order = [d[0] for d in found.description]
        assert sorted(order) == names
        assert rows == sorted((tuple(tidy(r[order.index(c)]) for c in names) for r in found.fetchall()), key=key)
        return rows
    return compare
