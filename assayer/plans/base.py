"""Registration of queries with their SQL twins and access to the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_MD5 = "md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey))"


NUDGE = 0.0000137


def query(name: str, sql: str | None = None, digits: int = 6, nudge: float = 0.0):
    """Register a query; its doubles are rounded and its whole numbers widened for comparison.

    Means of money often end exactly on a rounding edge; ``nudge`` (added on both sides) moves
    them off it.
    """
    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return comparable(build(Tables(spark, folder)), digits, nudge)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


def comparable(df: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double") + F.lit(nudge) if nudge else c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


class Tables:
    """The parquet tables of a folder by attribute, timestamps as instants."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return df.select(*[F.col(f.name).cast("timestamp") if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name)
                           for f in df.schema.fields])

    def scratch(self, suffix: str) -> str:
        """A new path in the shared checkpoint folder; without that setting, in the warehouse, on a local master only."""
        base = self.spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = self.spark.sparkContext.master
            if not master.startswith("local") or "cluster" in master:
                raise ValueError("Set spark.checkpoint.dir to a folder that driver and executors share.")
            base = self.spark.conf.get("spark.sql.warehouse.dir")
        return f"{base.rstrip('/')}/{uuid.uuid4().hex}{suffix}"

    def labelled(self) -> DataFrame:
        """Documents with their labels: real gaps, since labels cover a part of them."""
        return self.documents.join(self.labels, "doc_id", "left").select("doc_id", "lang", "source", "n_chars", "quality", "toxic")


LABELLED = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def r(expression: str, alias: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {alias}"


def stamp(expression: str, alias: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S') AS {alias}"


def union_all(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def moved_sql(rows: str, salt: str) -> str:
    """(SQL twin of the keyed permutation) ``rows`` has ``place``, 0 to n - 1: adds ``target``, where each place goes."""
    from assayer.operators.explain import PRIME, ROUNDS, Permutation
    keys = Permutation(1, salt).keys
    cube = lambda v, k: f"(({v} + {k}) % {PRIME}) * (({v} + {k}) % {PRIME}) % {PRIME} * (({v} + {k}) % {PRIME}) % {PRIME}"

    def step(x: str) -> str:
        out = [f"{x} // c AS r0, {x} % c AS c0"]
        for k in range(ROUNDS):
            out.append(f"(r{k} + {cube(f'c{k}', keys[k])}) % h AS r{k + 1}, c{k} AS c{k + 1}" if k % 2 == 0 else f"r{k} AS r{k + 1}, (c{k} + {cube(f'r{k}', keys[k])}) % c AS c{k + 1}")
        return ", ".join([*out, f"r{ROUNDS} * c + c{ROUNDS} AS target"])

    return f"""(WITH RECURSIVE d AS (SELECT *, count(*) OVER () AS n FROM {rows}), g AS (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS h FROM d), e AS (SELECT *, CAST(ceil(n / h) AS BIGINT) AS c FROM g),
        w AS (SELECT place AS start, n, h, c, target FROM (SELECT place, n, h, c, {step('place')} FROM e) UNION ALL SELECT start, n, h, c, target FROM (SELECT start, n, h, c, {step('spot')} FROM (SELECT start, n, h, c, target AS spot FROM w WHERE target >= n)))
        SELECT d.*, w.target FROM d JOIN w ON w.start = d.place AND w.target < w.n)"""
