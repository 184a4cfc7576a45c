"""Named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a data folder as attributes: ``t.documents``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Derived tables that both engines build: name -> (Spark, DuckDB).
DERIVED = {
    "lines": (
        lambda t: t.documents.selectExpr("doc_id", "source", "lang", "posexplode(split(text, '\\n')) AS (pos, line)"),
        "(SELECT doc_id, source, lang, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)",
    ),
    "rects": (
        lambda t: t.lineitem.selectExpr("l_orderkey AS page", "l_linenumber * 1000000000L + l_partkey * 1000 + l_suppkey AS id", "l_partkey % 600 AS x", "l_suppkey * 7 % 800 AS y", "l_quantity * 4 AS w", "l_linenumber * 40.0D AS h", "l_returnflag AS kind", "l_discount AS score"),
        "(SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey AS id, l_partkey % 600 AS x, l_suppkey * 7 % 800 AS y, l_quantity * 4 AS w, CAST(l_linenumber * 40 AS DOUBLE) AS h, l_returnflag AS kind, l_discount AS score FROM lineitem)",
    ),
    "turns": (
        lambda t: t.conversations.selectExpr("conv_id", "turn", "role", "text", "row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth"),
        "(SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations)",
    ),
}


def same(name: str, sql: str, given: Callable[[Tables], dict[str, DataFrame]] = lambda t: {}):
    """Register one SQL text that both engines run; tables, base or derived, are named in braces. ``given``: tables that
    Spark reads in another form, with which the text gives the same rows."""

    def run(t: Tables) -> DataFrame:
        used = {n: getattr(t, n) for n in NAMES if "{" + n + "}" in sql}
        used |= {n: make(t) for n, (make, _) in DERIVED.items() if "{" + n + "}" in sql}
        return t.spark.sql(sql, **(used | given(t)))

    query(name, sql.format(**{n: n for n in NAMES}, **{n: duck for n, (_, duck) in DERIVED.items()}))(run)


def query(name: str, sql: str | None = None):
    """Register ``f(tables)`` under ``name``; ``sql`` gives the same rows in DuckDB."""

    def add(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add
