"""Where queries are registered, and small inline tables for both engines."""

from __future__ import annotations

import re
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Spark's type names and the other engine's.
_TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` says the same for the other engine."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if one task alone would read it, as it does a file of a single row group; else as it is."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if df.rdd.getNumPartitions() == 1 else df


#: Rows of a part that a table is dealt into by a key.
ROWS_A_PART = 100_000


def dealt(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``df`` by the keys that the next steps group and join by, in as many parts as its rows ask for: what a task holds doesn't grow with the table."""
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_PART)), *keys)


#: What stands for inline tables, by name, while a query of theirs is built over given tables.
_GIVEN: ContextVar[dict[str, Callable[[SparkSession], DataFrame]]] = ContextVar("given", default={})


class Inline:
    """A small table written once: a DataFrame here, a common table expression there."""

    def __init__(self, name: str, schema: str, rows: list[tuple]):
        self.name, self.schema, self.rows = name, schema, rows

    def df(self, spark: SparkSession) -> DataFrame:
        given = _GIVEN.get().get(self.name)
        return given(spark) if given else spark.createDataFrame(self.rows, self.schema)

    def _type(self, kind: str) -> str:
        if kind.startswith("array<"):
            return self._type(kind[6:-1]) + "[]"
        return _TYPES[kind]

    def _literal(self, value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).upper()
        if isinstance(value, (list, tuple)):
            return "[" + ", ".join(map(self._literal, value)) + "]"
        if isinstance(value, str):
            return "'" + value.replace("'", "''") + "'"
        return repr(value)

    @property
    def cte(self) -> str:
        """``name AS (...)``, to stand after WITH."""
        columns = [c.split(" ", 1) for c in self.schema.split(", ")]
        casts = ", ".join(f"CAST({c} AS {self._type(t)}) AS {c}" for c, t in columns)
        values = ", ".join("(" + ", ".join(map(self._literal, row)) + ")" for row in self.rows)
        return f"{self.name} AS (SELECT {casts} FROM (VALUES {values}) t({', '.join(c for c, _ in columns)}))"


class Derived:
    """A table made of given ones by SQL that both engines read; given tables stand in braces, ``{array}`` makes an array.

    ``keys`` are the columns by which the given tables are dealt before, if one task would else hold too much of them.
    """

    def __init__(self, sql: str, keys: tuple[str, ...] = ()):
        self.sql, self.keys = " ".join(sql.split()), keys
        self.tables = sorted(set(re.findall(r"{(\w+)}", self.sql)) - {"array"})

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        given = {t: table(spark, sf_dir, t) for t in self.tables}
        return spark.sql(self.sql.replace("{array}", "array"), **{t: dealt(df, self.keys) if self.keys else df for t, df in given.items()})

    def cte(self, name: str) -> str:
        return f"{name} AS ({self.sql.format(array='list_value', **{t: t for t in self.tables})})"


def on_tables(name: str, given: dict[Inline, Derived], suffix: str = "_on_tables") -> None:
    """Register the query ``name`` once more, with derived tables in place of its inline ones, in both engines."""
    sql = ORACLE_SQL[name]
    for inline, derived in given.items():
        assert inline.cte in sql, (name, inline.name)
        sql = sql.replace(inline.cte, derived.cte(inline.name))

    @query(name + suffix, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        token = _GIVEN.set({i.name: lambda s, d=d: d.df(s, sf_dir) for i, d in given.items()})
        try:
            return QUERIES[name](spark, sf_dir)
        finally:
            _GIVEN.reset(token)
