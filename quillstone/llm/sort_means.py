"""Centroid clustering by Sort-means.

Each round orders, for every centroid, the other centroids by their distance from it. A vector first
meets the centroid it was assigned to, then the others in that order, and stops at the first one
that lies strictly beyond twice its current distance: by the triangle inequality neither that one nor any
later one is as near. All vectors of one previous centroid are scanned together: sorted by distance,
those still scanning are a prefix, so a step is one product of a matrix and a vector.

Vectors travel in blocks (a row holds up to BLOCK of them with their assignments), written anew each
round beside the round's sums; the blocks of the round before are deleted. Sums are exact decimals, one row
per (task, centroid, component), added up by Spark; the driver sees k times the dimension of them.
Arithmetic is exact: in doubles while no distance can pass 2^53, else in Python integers.

Defined results: vectors that are null, of another length, or with a null or non-finite component are left
out, and so are all rows of an empty table; a null vec_id is hashed as no digits; repeated rows repeat and each
can start a centroid (ties of the hash by components); with fewer than k vectors there are as many
centroids; a distance or sum beyond 64 bits is null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, slices

BLOCK = 4096
#: Components up to this size give distances below 2^53 in up to 512 dimensions.
_EXACT = 1 << 20
_LONG = (1 << 63) - 1
_LIMB = (1 << 60) - 1
_STATE = "kind string, ids array<long>, form string, numbers binary, assigned binary, distances array<long>, part array<struct<cluster:int,component:int,limb:int,total:decimal(30,0)>>"


def usable(vectors: DataFrame, dimension: int, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has `dimension` components, none null or non-finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.coalesce((F.size(vector) == dimension) & good, F.lit(False)))


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly."""
    n, d = float(x).as_integer_ratio()
    return scale * n // d


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) for a matrix of doubles, scale a power of two; Python integers where doubles don't reach."""
    if not values.size or np.abs(values).max() < _EXACT / scale - 1:
        return np.floor(values * scale)
    return np.array([[whole(x, scale) for x in row] for row in values], object)


def _stored(matrix: np.ndarray) -> tuple[str, bytes]:
    if matrix.dtype == object:
        return "text", ",".join(map(str, matrix.ravel())).encode()
    form = "<i2" if not matrix.size or np.abs(matrix).max() < 1 << 15 else "<i4"
    return form, matrix.astype(form).tobytes()


def _loaded(form: str, raw: bytes, dimension: int) -> np.ndarray:
    if form == "text":
        return np.array([int(x) for x in raw.decode().split(",")], object).reshape(-1, dimension)
    return np.frombuffer(raw, form).astype(np.float64).reshape(-1, dimension)


def _squares(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of m from c."""
    d = m - c
    return (d * d).sum(1) if d.dtype == object else np.einsum("ij,ij->i", d, d)


class Centroids:
    """A round's centroids, and for each of them the others from near to far."""

    def __init__(self, rows: list[list[int]]):
        exact = max((abs(x) for r in rows for x in r), default=0) < _EXACT
        self.rows = np.array(rows, np.float64 if exact else object).reshape(len(rows), -1)
        self.apart = np.array([_squares(self.rows, c) for c in self.rows])
        self.order = [sorted((k for k in range(len(rows)) if k != a), key=lambda k, a=a: (self.apart[a][k], k)) for a in range(len(rows))]

    def assign(self, m: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row (the smaller number of equals) and its squared distance."""
        rows = self.rows if m.dtype == self.rows.dtype else np.array([[int(x) for x in r] for r in self.rows], object)
        m = m if m.dtype == rows.dtype else np.array([[int(x) for x in r] for r in m], object)
        nearest, best = before.copy(), np.zeros(len(m), m.dtype)
        for a in np.unique(before).tolist():
            own = np.flatnonzero(before == a)
            start = _squares(m[own], rows[a])
            far_first = np.argsort(-start, kind="stable")
            own, start = own[far_first], start[far_first]
            x, low, at = m[own], start.copy(), np.full(len(own), a)
            reach = -4 * start  # ascends
            for k in self.order[a]:
                n = int(np.searchsorted(reach, -self.apart[a][k], "right"))  # rows with 4 * distance >= apart
                if not n:
                    break
                d = _squares(x[:n], rows[k])
                better = (d < low[:n]) | (d == low[:n]) & (k < at[:n])
                low[:n][better], at[:n][better] = d[better], k
            nearest[own], best[own] = at, low
        return nearest, best


def _sums(totals: dict[int, tuple[int, int, list[int]]]) -> list[dict]:
    """Component -1 is the count, -2 the inertia. A total goes in limbs of 60 bits, so that any size adds up."""
    out = []
    for cluster, (count, inertia, parts) in totals.items():
        for component, total in [(-1, count), (-2, inertia), *enumerate(parts)]:
            sign, rest, limb = -1 if total < 0 else 1, abs(total), 0
            while rest or not limb:
                out.append({"cluster": cluster, "component": component, "limb": limb, "total": Decimal(sign * (rest & _LIMB))})
                rest >>= 60
                limb += 1
    return out


def _pass(blocks: DataFrame, centroids: Centroids, dimension: int, final: bool) -> DataFrame:
    """Blocks with new assignments, and a task's sums. Blocks come without an assignment in the first round."""

    def run(batches):
        totals: dict[int, tuple[int, int, list[int]]] = {}
        schema = None
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            schema = batch.schema
            m = _loaded(row["form"], row["numbers"], dimension)
            before = np.frombuffer(row["assigned"], "<u2").astype(np.int64)
            nearest, best = centroids.assign(m, before)
            for k in np.unique(nearest).tolist():
                own = nearest == k
                count, inertia, parts = totals.get(k, (0, 0, [0] * dimension))
                parts = [p + int(s) for p, s in zip(parts, m[own].sum(0), strict=True)]
                totals[k] = (count + int(own.sum()), inertia + sum(map(int, best[own])), parts)
            row["assigned"] = nearest.astype("<u2").tobytes()
            if final:
                row["distances"] = [d if d <= _LONG else None for d in map(int, best)]
                row["numbers"] = b""
            yield pa.RecordBatch.from_pylist([row], schema)
        if totals:
            empty = dict.fromkeys(schema.names) | {"kind": "sums", "part": _sums(totals)}
            yield pa.RecordBatch.from_pylist([empty], schema)

    return blocks.select("kind", "ids", "form", "numbers", "assigned", "distances", "part").mapInArrow(run, _STATE)


def _blocks(vectors: DataFrame, key: str, vector: str, dimension: int, scale: int) -> DataFrame:
    def run(batches):
        for batch in slices(batches, BLOCK):
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            form, raw = _stored(quantised(flat.reshape(-1, dimension), scale))
            n = batch.num_rows
            columns = {
                "kind": pa.array(["blocks"]), "ids": pa.array([batch.column("id").to_pylist()], pa.list_(pa.int64())), "form": pa.array([form]), "numbers": pa.array([raw], pa.binary()),
                "assigned": pa.array([bytes(2 * n)], pa.binary()), "distances": pa.array([None], pa.list_(pa.int64())),
                "part": pa.array([None], pa.list_(pa.struct([("cluster", pa.int32()), ("component", pa.int32()), ("limb", pa.int32()), ("total", pa.decimal128(30, 0))]))),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    slim = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    return slim.mapInArrow(run, _STATE)


def first_centroids(vectors: DataFrame, k: int, salt: str, scale: int, key: str = "vec_id", vector: str = "embedding") -> list[list[int]]:
    """The k vectors with the smallest sha256 of `salt:key`, in that order. k rows come to the driver."""
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    rows = vectors.select(name.alias("h"), F.col(vector).cast("array<double>").alias("v")).orderBy("h", "v").limit(k).collect()
    return [[whole(x, scale) for x in r["v"]] for r in rows]


def sort_means(
    scratch: Scratch, vectors: DataFrame, *, k: int, dimension: int, rounds: int, scale: int, salt: str, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """A row per usable vector: its key, cluster, squared distance, its cluster's and the whole inertia, and the
    sha256 of its final centroid's components as decimal integers joined by commas."""
    vectors = usable(vectors.select(key, vector), dimension, vector)
    rows = first_centroids(vectors, k, salt, scale, key, vector)
    if not rows:
        return scratch.spark.createDataFrame([], f"`{key}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    state = scratch.cut(_blocks(vectors, key, vector, dimension, scale), "blocks", ["kind"])
    totals: dict[tuple[int, int], int] = {}
    for n in range(rounds + 1):
        done = scratch.cut(_pass(state.filter("kind = 'blocks'"), Centroids(rows), dimension, n == rounds), "round", ["kind"])
        sums = done.filter("kind = 'sums'").select(F.explode("part").alias("p")).groupBy("p.cluster", "p.component", "p.limb").agg(F.sum("p.total").alias("total"))
        totals = {}
        for r in sums.collect():  # some k times (dimension + 2)
            at = r["cluster"], r["component"]
            totals[at] = totals.get(at, 0) + (int(r["total"]) << 60 * r["limb"])
        scratch.drop(state)
        state = done
        if n < rounds:
            rows = [[totals[c, i] // totals[c, -1] for i in range(dimension)] if (c, -1) in totals else old for c, old in enumerate(rows)]
    inertia = sum(v for (_, i), v in totals.items() if i == -2)
    fits = lambda v: v if v <= _LONG else None
    named = [(c, fits(totals.get((c, -2), 0)), fits(inertia), hashlib.sha256(",".join(map(str, r)).encode()).hexdigest()) for c, r in enumerate(rows)]
    names = scratch.spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")

    def opened(batches):
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            assigned = np.frombuffer(row["assigned"], "<u2").astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), pa.array(assigned), pa.array(row["distances"], pa.int64())], names=["id", "cluster", "distance"]
            )

    out = state.filter("kind = 'blocks'").select("ids", "assigned", "distances").mapInArrow(opened, "id long, cluster int, distance long")
    return out.join(F.broadcast(names), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
