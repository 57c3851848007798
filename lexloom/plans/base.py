"""How plans are registered: a query function and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small rule or lexicon table; its size is that of the program text.

    It is made from Arrow, so the plan holds the rows themselves and the engine knows how few they
    are: joins with it are broadcast. A table from Python rows has no known size, and both sides of
    a join with it would be shuffled.
    """
    kind = StructType.fromDDL(schema)
    fields = to_arrow_schema(kind)
    columns = list(zip(*rows)) or [()] * len(fields)
    plain = lambda v: list(v.items()) if isinstance(v, dict) else v
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(map(plain, c), f.type) for c, f in zip(columns, fields)], schema=fields), kind)


def sql_values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else "[" + ", ".join(map(lit, v)) + "]" if isinstance(v, (list, tuple)) else str(v).upper() if isinstance(v, bool) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS t({names})"
