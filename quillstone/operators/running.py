"""Things that go along an order: running sums in two levels, and folds that stream sorted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of `value` up to and with each row, per key in the order given.

    `bucket` is a coarse step of the order, as a day: sums of buckets are accumulated first, and rows only
    inside their bucket, so a key with a third of all rows is dealt out by bucket.
    """
    rows = df.withColumns({"_bucket": bucket, "_value": value})
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(sums, same).withColumn(name, F.col("_base") + F.sum("_value").over(inside))
    return out.select(*df.columns, name)


def streamed(df: DataFrame, key: str, order: list[str], schema: str, start: Callable[[], object], step: Callable[[object, tuple], tuple | None]) -> DataFrame:
    """A fold over each key's rows in order that yields as it goes.

    `step` takes the key's state (made by `start`) and a row, changes the state and returns an output row
    or None. Rows stream through sorted partitions, so memory does not grow with a key; a key is walked by
    one task, since each step needs the one before it.
    """
    columns = df.columns
    at = columns.index(key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False, name=None):
                if row[at] != last:
                    last, state = row[at], start()
                made = step(state, row)
                if made is not None:
                    out.append(made)
            yield pd.DataFrame(out, columns=names)

    names = [x.split()[0] for x in schema.split(",")]
    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
