"""Cosine similarity: expressions for row pairs, matrix products in Arrow batches for one query vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has length 0; null where the lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms))


def unit_rows(rows: list) -> np.ndarray:
    m = np.array(rows, np.float64)
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def cosine_to(query: list[float]):
    """A pandas UDF: similarity of a vector column to one query vector, a matrix product a batch."""
    q = np.array(query, np.float64)
    length = float(np.sqrt(q @ q))
    q = q / length if length else q

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(unit_rows(list(s)) @ q if len(s) else [], dtype="float64")

    return score
