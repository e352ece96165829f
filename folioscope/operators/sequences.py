"""Longest increasing runs of long sequences, in one sorted pass."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def add(tails: list, value) -> None:
    """Put ``value`` on the leftmost pile whose top isn't smaller; the number of piles is the length of the longest increasing subsequence."""
    at = bisect_left(tails, value)
    if at == len(tails):
        tails.append(value)
    else:
        tails[at] = value


def longest_increasing(values: Column) -> Column:
    """Length of the longest strictly increasing subsequence of an array of numbers; nulls in it are passed over, a null array gives null."""

    @F.pandas_udf("int")
    def lengths(arrays: pd.Series) -> pd.Series:
        def of(array):
            if array is None:
                return None
            tails: list = []
            for v in array:
                if v is not None and v == v:
                    add(tails, v)
            return len(tails)

        return pd.Series([of(a) for a in arrays], dtype="Int32")

    return lengths(values.cast("array<double>"))


def longest_runs(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, n, longest: rows of each key, and its longest strictly increasing subsequence of ``value`` in ``order``.

    The rows of a key come to one task in order and are not gathered: what is kept of them are the
    tops of the piles, as many as the result.  Null values count in ``n`` alone; a null key is a
    key; equal places in the order are taken by value.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"{key} {kinds[key]}, n long, longest int"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tails, n, out, begun = None, [], 0, [], False

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
            out.clear()
            return made

        for given in batches:
            for k, v in zip(given.column(0).to_pylist(), given.column(1).to_pylist()):
                if not begun or k != now:
                    if begun:
                        out.append((now, n, len(tails)))
                    now, tails, n, begun = k, [], 0, True
                n += 1
                if v is not None and v == v:
                    add(tails, v)
            if len(out) >= 1000:
                yield batch()
        if begun:
            out.append((now, n, len(tails)))
        if out:
            yield batch()

    sorted_ = rows.select(key, F.col(value).alias("__value"), *[F.col(c).alias(f"__order{i}") for i, c in enumerate(order)])
    sorted_ = sorted_.repartition(key).sortWithinPartitions(key, *[f"__order{i}" for i in range(len(order))], "__value")
    return sorted_.select(key, "__value").mapInArrow(run, schema)
