"""Nearest neighbours above a threshold by pivots and the triangle inequality of angles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.vectors import unit_rows

#: Pivots, a sample by hash. Results don't depend on them. CELL: about so many points, or queries, that one task compares at a time.
PIVOTS, CELL = 64, 16384
#: Queries of a task that it compares at a time.
QUERIES = 256
_MARGIN = 1e-6


def pivots_of(points: DataFrame, vector: str = "vector", n: int = PIVOTS) -> np.ndarray:
    """Unit vectors of n points, those with the least hashes."""
    rows = points.where(F.size(vector) > 0).select(F.xxhash64(vector).alias("h"), F.col(vector).cast("array<double>").alias("v")).distinct().orderBy("h").limit(n).collect()
    return unit_rows([list(r["v"]) for r in rows]) if rows else np.zeros((0, 0))


def angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(m @ pivots.T, -1, 1))


def near_pairs(new: DataFrame, points: DataFrame, threshold: float, group: str = "domain", k: int | None = None) -> DataFrame:
    """kid, other, cosine >= threshold, within a group; with k only others than itself, and of a block of points the k
    nearest (equal ones by name), so the k nearest of all are among them. new and points: kid, group, vector (of one length; a vector
    of length 0 is near to nothing).

    A point belongs to the cell (nearest pivot, angle to it in steps of the threshold's angle t). Cells of a group, in order,
    are joined to blocks of about CELL points, and a large cell is cut into several; queries likewise. Two blocks meet, once, where two
    of their cells can hold a pair within t, by the angle of their pivots. So a vector travels as often as there are
    blocks it meets, at most the group's size by CELL, and tasks stay bounded when a group or a cell holds most
    points; a task's comparison is a matrix product."""
    pivots, t = pivots_of(points), float(np.arccos(np.clip(threshold, -1, 1))) + _MARGIN
    spark, kid = points.sparkSession, dict(new.dtypes)["kid"]
    out = f"kid {kid}, other {dict(points.dtypes)['kid']}, cosine double"
    if not len(pivots):
        return spark.createDataFrame([], out)
    cell = ["grp", "pivot", "step"]

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                m = unit_rows(list(f["vector"]))
                f, a = f[(m * m).sum(1) > 0], angles(m[(m * m).sum(1) > 0], pivots)
                yield f.assign(pivot=a.argmin(1).astype(np.int32), step=np.floor(a.min(1) / t).astype(np.int32))

    def placed(df: DataFrame) -> DataFrame:
        slim = df.where(F.size("vector") > 0).select("kid", F.col(group).alias("grp"), "vector")
        return slim.mapInPandas(cells, ", ".join(f"{c} {k}" for c, k in [*slim.dtypes, ("pivot", "int"), ("step", "int")]))

    def blocks(df: DataFrame) -> DataFrame:
        """grp, pivot, step, low, high: the blocks that a cell's rows are dealt to."""
        counted = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
        end = F.sum("n").over(Window.partitionBy("grp").orderBy("pivot", "step"))
        return counted.select(*cell, F.floor((end - F.col("n")) / CELL).cast("int").alias("low"), F.floor((end - 1) / CELL).cast("int").alias("high"))

    def dealt(df: DataFrame, places: DataFrame, name: str) -> DataFrame:
        block = F.col("low") + F.pmod(F.xxhash64("kid"), F.col("high") - F.col("low") + 1).cast("int")
        return df.join(places, cell).select("kid", "grp", "vector", block.alias(name))

    p, q = placed(points), placed(new)
    of_points, of_queries = blocks(p), blocks(q)
    between = angles(pivots, pivots)
    apart = spark.createDataFrame([(i, j, float(between[i, j])) for i in range(len(pivots)) for j in range(len(pivots))], "pivot int, o_pivot int, apart double")
    sides = of_queries.join(of_points.select("grp", *(F.col(c).alias(f"o_{c}") for c in ("pivot", "step", "low", "high"))), "grp").join(F.broadcast(apart), ["pivot", "o_pivot"])
    sides = sides.where(F.col("apart") <= (F.col("step") + F.col("o_step") + 3) * t + _MARGIN)  # who is in step s is nearer to its pivot than (s + 1) t
    meet = sides.select("grp", F.explode(F.sequence("low", "high")).alias("qblock"), "o_low", "o_high").distinct()
    meet = meet.select("grp", "qblock", F.explode(F.sequence("o_low", "o_high")).alias("block")).distinct()
    q = dealt(q, of_queries, "qblock").join(meet, ["grp", "qblock"])
    p = dealt(p, of_points, "block").join(meet, ["grp", "block"])

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("kid", kind="stable") if k else right
        b, names, asked = unit_rows(list(right["vector"])), right["kid"].to_numpy(), left["kid"].to_numpy()
        own = names.searchsorted(asked), names.searchsorted(asked, "right")
        parts = []
        for start in range(0, len(left), QUERIES):
            c = unit_rows(list(left["vector"].iloc[start : start + QUERIES])) @ b.T
            if k:
                for r in np.flatnonzero((own[0] < own[1])[start : start + QUERIES]):
                    c[r, own[0][start + r] : own[1][start + r]] = -2
            near = c >= threshold - _MARGIN
            many = np.flatnonzero(near.sum(1) > k) if k else np.zeros(0, int)
            near[many] = False
            found = [(*(at := np.nonzero(near)), c[at])]
            if len(many):
                rest = c[many]
                for _ in range(k):  # of equal ones the first, and names are in order
                    best = rest.argmax(1)
                    found.append((many, best, rest[np.arange(len(many)), best]))
                    rest[np.arange(len(many)), best] = -2
            row, col, cosine = (np.concatenate(x) for x in zip(*found, strict=True))
            parts.append(pd.DataFrame({"kid": asked[start + row], "other": names[col], "cosine": cosine}))
        return pd.concat(parts)

    def joined(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"kid": pd.Series([], dtype=object), "other": pd.Series([], dtype=object), "cosine": pd.Series([], dtype=float)})
        return compare(left, right)

    keys = ["grp", "qblock", "block"]
    pairs = q.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInPandas(joined, out)
    return pairs.where(F.col("cosine") >= threshold)


def duplicate_gate(new: DataFrame, points: DataFrame, threshold: float = 0.92, k: int = 8) -> DataFrame:
    """kid, other, score: of the k nearest entries of the domain, other than itself, those at the threshold; scores
    keep four decimals. As the nearest k at the threshold are the threshold's nearest k, pairs below it are never
    made."""
    pairs = near_pairs(new, points, threshold, k=k)
    rank = F.row_number().over(Window.partitionBy("kid").orderBy(F.desc("cosine"), "other"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("kid", "other", F.round("cosine", 4).alias("score"))
