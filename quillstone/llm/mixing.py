"""Mixing sources to target weights by Sainte-Lague apportionment.

The words of a source are laid out shard by shard, documents in a seeded order, and cut into blocks
of equally many words. Blocks are seats: every (source, shard) cell gets an integer quota by the
highest quotients target / (2k + 1), never above `cap` passes over its blocks. A quota of so many
full passes plus a rest takes every block that often, and the rest as one run of neighbouring
blocks that starts at a seeded place, so that at most two documents of a cell are cut.

Everything is a Spark job over cells or documents. A shard holds about SHARD_WORDS words whatever
the size of its source, so a source with a third of all rows only has more shards. What the driver
sees are sums over sources and over a fixed number of trial thresholds.

Defined results: a null text has size 0 and is never taken; null sources form one source, ordered
last; repeated rows each count; an empty table gives an empty result. Reruns agree: order and
starting places come from hashes of doc_id, text and seed, not from the order of reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import WORD, Scratch, prefix_sums, words_column

BLOCK_WORDS = 8
SHARD_WORDS = 1 << 20
TRIALS = 64


def source_targets(scratch: Scratch, sizes: DataFrame, share: float, cap: float) -> DataFrame:
    """source, source_size, target: weights 5, 2, 1 by code point; targets stop at cap times the size
    and the excess goes to the others by weight until none is above."""
    per = scratch.cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    per = per.withColumn("last", F.col("source").isNull().cast("int")).withColumn("one", F.lit(1))
    per = prefix_sums(scratch, per, ["last", "source"], {"rank": "one"})
    weight = F.element_at(F.array(F.lit(5.0), F.lit(2.0), F.lit(1.0)), (F.col("rank") % 3 + 1).cast("int"))
    per = scratch.cut(per.select("source", "source_size", weight.alias("weight")), "weights")
    limit = cap * F.col("source_size")
    total = (per.agg(F.sum("source_size")).first()[0] or 0) * share
    level = -1.0
    while True:  # each pass caps at least one more source or ends
        capped = limit <= level * F.col("weight")
        s = per.agg(F.sum(F.when(capped, limit).otherwise(0.0)).alias("full"), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        new = (total - s["full"]) / s["open"] if s["open"] else None
        if new is None or new <= level:
            break
        level = new
    return per.select("source", "source_size", "weight", F.least(limit, F.lit(level) * F.col("weight")).cast("double").alias("target"))


def apportion(cells: DataFrame, seats: int, seed: int) -> DataFrame:
    """Sainte-Lague with caps. cells: source, shard, votes (double), most (long); adds quota.

    A seat threshold m gives a cell every seat whose quotient votes / (2k + 1) is at least m, that is
    floor((votes / m + 1) / 2). The m at which the seats of all cells come to `seats` is searched
    for by trying TRIALS values a pass. Ties are broken by a seeded factor of at most 1e-9.
    """
    tie = 1 + F.abs(F.xxhash64("source", "shard", F.lit(seed)) % 1000003) / 1e15
    cells = cells.withColumn("votes", F.col("votes") * tie)

    def given(m: Column) -> Column:
        return F.least(F.col("most"), F.floor((F.col("votes") / m + 1) / 2)).cast("long")

    top = cells.agg(F.max("votes"), F.sum("most")).first()
    if not top[0] or seats >= top[1]:
        return cells.withColumn("quota", F.col("most") if top[0] else F.lit(0).cast("long"))
    low, high = 0.0, top[0] * 2  # seats at low: all; at high: none
    for _ in range(12):
        step = (high - low) / TRIALS
        trials = [low + step * k for k in range(1, TRIALS)]
        tried = cells.select(F.posexplode(F.transform(F.array(*map(F.lit, trials)), given)).alias("k", "n"))
        sums = {r["k"]: r["n"] for r in tried.groupBy("k").agg(F.sum("n").alias("n")).collect()}
        below = [trials[k] for k in range(len(trials)) if sums[k] > seats]
        above = [trials[k] for k in range(len(trials)) if sums[k] <= seats]
        exact = [trials[k] for k in range(len(trials)) if sums[k] == seats]
        low, high = max(below, default=low), min(above, default=high)
        if exact or not low < (low + high) / 2 < high:
            break
    return cells.withColumn("quota", given(F.lit(exact[0] if exact else high)))


def mix(scratch: Scratch, docs: DataFrame, share: float = 1.5, cap: int = 2, seed: int = 17, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs (columns doc_id, text, source and others) with size, source_size, target, taken, passes,
    and the word ranges [from_1, to_1) and [from_2, to_2) taken besides the full passes."""
    mark = F.xxhash64("doc_id", F.xxhash64("text"), F.lit(seed))
    slim = docs.select("doc_id", "source", words_column(F.col("text")).alias("size"), mark.alias("mark"))
    sizes = scratch.cut(slim, "sizes")
    targets = scratch.cut(source_targets(scratch, sizes, share, cap), "targets")
    shards = F.ceil(F.col("source_size") / shard_words)
    known = sizes.alias("d").join(targets.alias("t"), F.expr("d.source <=> t.source")).select("d.*", "source_size", "target", (F.pmod(F.col("mark"), F.greatest(shards, F.lit(1)))).alias("shard"))
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("mark", F.lit(seed + 1)), "doc_id", "mark", "size")
    placed = known.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("size"))
    placed = scratch.cut(placed, "placed")
    cells = placed.groupBy("source", "shard").agg(F.sum("size").alias("cell_size"), F.first("source_size").alias("of"), F.first("target").alias("goal"))
    cells = cells.where("cell_size > 0").withColumn("blocks", F.ceil(F.col("cell_size") / block_words))
    cells = cells.withColumn("votes", F.col("goal") * F.col("cell_size") / F.col("of") / block_words).withColumn("most", F.col("blocks") * cap)
    cells = scratch.cut(cells, "cells")
    seats = round((targets.agg(F.sum("target")).first()[0] or 0) / block_words)
    quotas = apportion(cells, seats, seed)
    quotas = quotas.withColumn("passes", F.expr("quota div blocks")).withColumn("rest", F.col("quota") % F.col("blocks"))
    quotas = quotas.withColumn("first", F.pmod(F.xxhash64("source", "shard", F.lit(seed + 2)), F.col("blocks")))
    word = lambda block: F.least(block * block_words, F.col("cell_size"))
    quotas = quotas.select(
        F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "passes",
        word(F.col("first")).alias("run_1"), word(F.least(F.col("first") + F.col("rest"), F.col("blocks"))).alias("stop_1"),
        word(F.greatest(F.col("first") + F.col("rest") - F.col("blocks"), F.lit(0))).alias("stop_2"),
    )
    out = placed.join(quotas, F.expr("source <=> q_source and shard = q_shard"), "left")
    clip = lambda c: F.coalesce(F.greatest(F.lit(0), F.least(F.col("size"), F.col(c) - F.col("start"))), F.lit(0)).cast("long")
    out = out.withColumns({"from_1": F.lit(0).cast("long"), "to_1": clip("stop_2"), "from_2": clip("run_1"), "to_2": clip("stop_1"), "passes": F.coalesce(F.col("passes"), F.lit(0)).cast("long")})
    taken = F.col("passes") * F.col("size") + F.col("to_1") - F.col("from_1") + F.greatest(F.col("to_2") - F.col("from_2"), F.lit(0))
    return out.select("doc_id", "source", "mark", "size", "source_size", "target", taken.alias("taken"), "passes", "from_1", "to_1", "from_2", "to_2")


def apply_mix(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The mixed documents with their own columns: a row for each full pass, and one with the words of
    the rest. Rows that are equal in doc_id and text are told apart by nothing, so they share a plan."""
    seed = options.get("seed", 17)
    mark = F.xxhash64("doc_id", F.xxhash64("text"), F.lit(seed))
    plan = mix(scratch, docs, **options).where("taken > 0")
    same = Window.partitionBy("doc_id", "mark").orderBy("taken", "passes", "from_2", "to_2", "to_1")
    plan = plan.select(F.col("doc_id").alias("p_id"), F.col("mark").alias("p_mark"), "passes", "from_1", "to_1", "from_2", "to_2", F.row_number().over(same).alias("p_nth"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", mark.alias("mark"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy(F.lit(1)))
    both = packed.withColumn("nth", nth).join(plan, F.expr("doc_id <=> p_id and mark = p_mark and nth = p_nth"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = lambda a, b: F.slice(words, F.col(a) + 1, F.greatest(F.col(b) - F.col(a), F.lit(0)))
    part = F.array_join(F.concat(cut("from_2", "to_2"), cut("from_1", "to_1")), " ")
    whole = F.when((F.col("from_1") == 0) & (F.col("to_1") == F.size(words)) | (F.col("from_2") == 0) & (F.col("to_2") == F.size(words)), F.col("text")).otherwise(part)
    partial = (F.col("to_1") > F.col("from_1")) | (F.col("to_2") > F.col("from_2"))
    copies = F.concat(F.array_repeat(F.col("text"), F.col("passes").cast("int")), F.when(partial, F.array(whole)).otherwise(F.array().cast("array<string>")))
    out = both.select("row", F.explode(copies).alias("copy"))
    return out.select(*[(F.col("copy") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
