"""Checks over job graphs: cycles outside the allowed way back, inputs that no ancestor puts out.

All graphs of a table are checked at once. Rounds go on while something changes and are written below
spark.checkpoint.dir; what a round carries shrinks (peeling) or is new (facts), so no closure of pairs is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.sources.shared import scratch_folder


def _cut(df: DataFrame, folder: str, n: int) -> DataFrame:
    df.write.parquet(f"{folder}/{n}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{n}")


def allowed_back(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges from a critic gate with a bound on its rounds to where it sends work back: the only cycles allowed. nodes:
    g, node, kind, rounds, on_revise."""
    gates = nodes.where("kind = 'critic-gate' and coalesce(rounds, 0) <> 0 and on_revise is not null").select("g", F.col("node").alias("src"), F.col("on_revise").alias("dst"))
    return edges.join(gates, ["g", "src", "dst"], "left_semi")


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """g, node of strongly connected parts of more than a node (or with an edge to itself), and of what lies between
    two such parts: nodes without an edge into them, or out of them, are peeled off until none is left. A graph has
    a cycle exactly if something stays."""
    folder, n = scratch_folder(edges.sparkSession, "peel"), 0
    now = _cut(edges.select("g", "src", "dst").distinct(), folder, n)
    count = now.count()
    while count:
        heads, tails = now.select("g", F.col("dst").alias("src")).distinct(), now.select("g", F.col("src").alias("dst")).distinct()
        n += 1
        now = _cut(now.join(heads, ["g", "src"], "left_semi").join(tails, ["g", "dst"], "left_semi").select("g", "src", "dst"), folder, n)
        if (left := now.count()) == count:
            break
        count = left
    return now.select("g", F.col("src").alias("node")).union(now.select("g", "dst")).distinct()


def illegal_cycles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """g, code: graphs with a cycle that is no critic gate's way back (L1). Edges of unknown nodes don't count."""
    known = nodes.select("g", "node")
    inside = edges.join(known.withColumnRenamed("node", "src"), ["g", "src"], "left_semi").join(known.withColumnRenamed("node", "dst"), ["g", "dst"], "left_semi")
    rest = inside.join(allowed_back(inside, nodes), ["g", "src", "dst"], "left_anti")
    return cyclic_nodes(rest).select("g").distinct().withColumn("code", F.lit("L1"))


def effective_outputs(nodes: DataFrame) -> DataFrame:
    """g, node, token: outputs and verdicts; a critic gate also puts out a verdict."""
    none = F.array().cast("array<string>")
    gate = F.when(F.col("kind") == "critic-gate", F.array(F.lit("verdict"))).otherwise(none)
    return nodes.select("g", "node", F.explode(F.array_distinct(F.concat(F.coalesce("outputs", none), F.coalesce("verdicts", none), gate))).alias("token"))


def missing_inputs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """g, src, dst, missing: edges into a node that needs what none of its ancestors puts out (L4); the brief is always
    there. Facts (node, token) go along the edges, each once, and only tokens that some node needs."""
    folder, n = scratch_folder(edges.sparkSession, "facts"), 0
    need = nodes.select("g", F.col("node").alias("dst"), F.explode(F.array_distinct("inputs")).alias("token")).where("token <> 'brief'")
    wanted = need.select("g", "token").distinct()
    steps = edges.select("g", "src", "dst").distinct()
    made = effective_outputs(nodes).join(wanted, ["g", "token"], "left_semi").withColumnRenamed("node", "src")
    fresh = _cut(made.join(steps, ["g", "src"]).select("g", "dst", "token").distinct(), folder, n)
    held = fresh
    while fresh.count():
        n += 1
        onward = fresh.withColumnRenamed("dst", "src").join(steps, ["g", "src"]).select("g", "dst", "token").distinct()
        fresh = _cut(onward.join(held, ["g", "dst", "token"], "left_anti"), folder, n)
        held = held.unionByName(fresh)
    bare = need.join(held, ["g", "dst", "token"], "left_anti").groupBy("g", "dst").agg(F.array_join(F.array_sort(F.collect_set("token")), ",").alias("missing"))
    return steps.join(bare, ["g", "dst"]).select("g", "src", "dst", "missing")
