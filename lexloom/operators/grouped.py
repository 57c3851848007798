"""Programs over the ordered rows of one key, streamed: one sort, no frame per key.

Keys are bounded by construction (a paragraph, a sentence, a request), their number isn't;
a task holds one key's rows and one output batch.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

OUT_ROWS = 20_000
#: A table up to so many rows is broadcast.
BROADCAST_ROWS = 100_000
Columns = dict[str, list]


def small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def apart(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key stands once, and the others, or None where there are none.

    What holds of one row can be made of that row alone; only the others have to meet. One count of
    the key column decides.
    """
    again = rows.groupBy(F.col(key).alias("__again")).agg(F.count("*").alias("__n")).filter("__n > 1").select("__again")
    n = again.count()
    if not n:
        return rows, None
    same = rows[key].eqNullSafe(F.col("__again"))
    return rows.join(small(again, n), same, "left_anti"), rows.join(small(again, n), same, "left_semi")


def by_key(rows: DataFrame, keys: list[str], order: list[str], program: Callable[[Columns], Columns], schema: StructType | str) -> DataFrame:
    """Rows of ``program`` for each key: it gets and returns columns as lists, in the given order."""
    out_schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out_schema)
    names = arrow.names

    def run(batches):
        out: Columns = {n: [] for n in names}
        held: Columns | None = None
        last = None

        def close() -> None:
            for name, values in program(held).items():
                out[name].extend(values)

        def flush():
            arrays = [pa.array(out[n], arrow.field(n).type) for n in names]
            for n in names:
                out[n] = []
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            of = list(zip(*(columns[k] for k in keys)))
            start = 0
            for at in range(len(of) + 1):
                if at < len(of) and at > start and of[at] == of[start]:
                    continue
                if at > start:
                    if held is not None and of[start] == last:
                        for n, values in columns.items():
                            held[n] += values[start:at]
                    else:
                        if held is not None:
                            close()
                        held, last = {n: values[start:at] for n, values in columns.items()}, of[start]
                    start = at
                    if len(out[names[0]]) >= OUT_ROWS:
                        yield flush()
        if held is not None:
            close()
        yield flush()

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, out_schema)
