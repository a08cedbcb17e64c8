"""N-gram Jaccard join as a grouped prefix join.

A document is its set of distinct 5-word shingles (64-bit hashes). All documents order shingles
alike, rarest first, by a count sketch over the whole corpus (2 ** 20 counters, so its size never
grows). Two sets with a Jaccard similarity of at least 0.8 must share a shingle among the first
n - ceil(0.8 n) + 1 of either. So:

1. equal sets form a class, and only one document of a class goes on;
2. classes with the same prefix and size form a group; only one prefix per group is posted;
3. postings of shingles that a single group has are dropped, but for the first one of a group of
   several classes, which lists them all;
4. in each posting list the most central group (the one with the largest part of its prefix shared)
   is compared with all others, under the length and position filters, and each group's first
   member with its other members;
5. components are taken; lists that lie in one component are done. In the others, members of
   different components are compared: those outside the list's main component with all others;
6. every candidate pair is verified on the words of both whole texts.

A group of near copies thus costs a pair per member, not per pair of members, and no link between
different components is missed, because step 5 tries all pairs that could give one.

Defined results: documents without words have an empty set and link with nothing; fewer than five
words make one shingle; rows with the same doc_id count as one document, whose text is the greatest
of them; a null doc_id links with nothing; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, mix64, text_bytes
from quillstone.llm.components import components
from quillstone.llm.vocabularies import forget

WIDTH = 5
COUNTER_BITS = 20
SLICES = 1024
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CACHE_LIMIT = 500_000


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE_LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_hashes(text: bytes, known: WordHashes) -> np.ndarray:
    """One hash per 5-word window; of a shorter text one hash; of no words none."""
    words = text.lower().split()
    n = len(words)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    if n < WIDTH:
        acc, steps = h[:1].copy(), range(1, n)
        for k in steps:
            acc = acc * _BASE + h[k : k + 1]
        return mix64(acc + np.uint64(n))
    acc = h[: n - WIDTH + 1].copy()
    for k in range(1, WIDTH):
        acc = acc * _BASE + h[k : n - WIDTH + 1 + k]
    return mix64(acc)


def shingle_set(text: bytes) -> set[tuple[bytes, ...]]:
    """The exact set, for verification."""
    w = text.lower().split()
    return {tuple(w)} if 0 < len(w) < WIDTH else set(zip(*(w[k:] for k in range(WIDTH)), strict=False))


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def sketch(docs: DataFrame) -> np.ndarray:
    """How often shingles fall to each of 2 ** COUNTER_BITS counters, over all documents."""
    per = (1 << COUNTER_BITS) // SLICES

    def count(batches):
        forget()
        total, known = np.zeros(1 << COUNTER_BITS, np.int64), WordHashes()
        for batch in batches:
            found = [shingle_hashes(t, known) for t in text_bytes(batch)]
            if found:
                total += np.bincount((np.concatenate(found) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=len(total))
        rows = total.reshape(SLICES, per)
        used = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([rows[k].tobytes() for k in used], pa.binary())], names=["slice", "counts"])

    def merge(frames):
        held: dict[int, np.ndarray] = {}
        for f in frames:
            for k, x in zip(f["slice"], f["counts"], strict=True):
                a = np.frombuffer(x, np.int64)
                held[k] = held[k] + a if k in held else a
        yield pd.DataFrame({"slice": list(held), "counts": [a.tobytes() for a in held.values()]})

    schema = "slice int, counts binary"
    out = np.zeros((SLICES, per), np.int64)
    for r in docs.select("text").mapInArrow(count, schema).repartition("slice").mapInPandas(merge, schema).collect():  # SLICES rows of 8 KB
        out[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(out.ravel(), 2**32 - 1).astype(np.uint32)


def signatures(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, set_digest, prefix_digest, prefix (hashes, rarest first)."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        known, rank = WordHashes(), shared.value
        for batch in batches:
            sizes, sets, heads, prefixes = [], [], [], []
            for text in text_bytes(batch):
                u = np.unique(shingle_hashes(text, known))
                order = np.lexsort((u, rank[(u >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]))
                p = u[order[: prefix_length(len(u))]] if len(u) else u
                sizes.append(len(u))
                sets.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest())
                heads.append(hashlib.blake2b(p.tobytes(), digest_size=16).digest())
                prefixes.append(p.view(np.int64))
            ends = np.cumsum([0, *map(len, prefixes)])
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(sets, pa.binary()), pa.array(heads, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))],
                names=["doc_id", "n_shingles", "set_digest", "prefix_digest", "prefix"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles int, set_digest binary, prefix_digest binary, prefix array<long>")


def verify(scratch: Scratch, docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose whole texts link."""
    text = docs.select("doc_id", "text")
    with_b = pairs.join(text.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(text.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches):
        last, mine = None, set()
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), text_bytes(batch, "text_a"), text_bytes(batch, "text_b"), strict=True):
                if a != last:
                    last, mine = a, shingle_set(ta)
                other = shingle_set(tb)
                common = len(mine & other)
                keep.append(100 * common >= 80 * (len(mine) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    kind = dict(pairs.dtypes)["a"]
    return scratch.cut(both.select("a", "b", "text_a", "text_b").mapInArrow(run, f"u {kind}, v {kind}"), "links")


#: The filters on two postings (n, pos) and (n2, pos2) of one shingle: sizes near enough, and enough
#: shingles left from here on in both.
_CLOSE = "5 * least(n, n2) >= 4 * greatest(n, n2) and 9 * least(n - pos, n2 - pos2) >= 4 * (n + n2)"


def one_row_per_id(docs: DataFrame) -> DataFrame:
    """doc_id, text; rows that repeat an id become one row with the greatest text. Null ids go."""
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    again = docs.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return docs
    merged = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    return docs.join(again, "doc_id", "left_anti").unionByName(merged)


def link_documents(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every distinct non-null doc_id."""
    docs = one_row_per_id(docs)
    signed = scratch.cut(signatures(docs, sketch(docs)), "signed")
    full = signed.where("n_shingles > 0")
    # written first, so that the join of a digest with very many rows can be split
    classes = scratch.cut(full.groupBy("set_digest").agg(F.min("doc_id").alias("class_id")), "classes")
    members = scratch.cut(signed.select("doc_id", "n_shingles", "set_digest").join(classes, "set_digest", "left").drop("set_digest"), "members")
    heads = full.select("doc_id", "n_shingles", "prefix_digest").join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi")
    named = heads.groupBy("prefix_digest", "n_shingles").agg(F.min("doc_id").alias("gid"), F.count(F.lit(1)).alias("classes"))
    groups = scratch.cut(heads.join(named, ["prefix_digest", "n_shingles"]).select("gid", F.col("doc_id").alias("class_id"), "classes"), "groups")
    firsts = groups.where("gid = class_id").select(F.col("gid").alias("doc_id"), "classes")
    posted = full.join(firsts, "doc_id").select(F.col("doc_id").alias("gid"), F.col("n_shingles").alias("n"), "classes", F.posexplode("prefix").alias("pos", "token"))
    held = F.count(F.lit(1)).over(Window.partitionBy("token"))
    lists = scratch.cut(posted.withColumn("held", held).where("held > 1 or (classes > 1 and pos = 0)").drop("held", "classes"), "lists")

    central = lists.groupBy("gid").agg((F.count(F.lit(1)) / F.first(F.col("n") - F.floor((4 * F.col("n") + 4) / 5) + 1)).alias("part"))
    hubs = lists.join(central, "gid").groupBy("token").agg(F.max_by(F.struct("gid", "n", "pos"), F.struct("part", -F.col("gid"))).alias("h"))
    hubs = hubs.select("token", F.col("h.gid").alias("hub"), F.col("h.n").alias("n2"), F.col("h.pos").alias("pos2"))
    star = lists.join(hubs, "token").where("gid <> hub").where(_CLOSE).select(F.col("hub").alias("a"), F.col("gid").alias("b"))
    inside = groups.where("gid <> class_id").select(F.col("gid").alias("a"), F.col("class_id").alias("b"))
    first_pairs = scratch.cut(star.union(inside).distinct(), "pairs")
    links = verify(scratch, docs, first_pairs)

    comps = components(scratch, links)
    entries = lists.join(groups, "gid").join(comps.withColumnRenamed("node", "class_id"), "class_id", "left")
    entries = entries.select("token", "n", "pos", "class_id", F.coalesce("component", "class_id").alias("comp"))
    # counted by component first, so that no task holds a map of a list's components
    per = entries.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("token")
    open_lists = per.agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    entries = scratch.cut(entries.join(open_lists.select("token", "main"), "token"), "open")
    others = entries.where("comp <> main").select("token", F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("class_id").alias("other"), F.col("comp").alias("comp2"))
    cross = entries.join(others, "token").where("comp <> comp2 and (comp = main or class_id < other)").where(_CLOSE)
    pairs = cross.select(F.least("class_id", "other").alias("a"), F.greatest("class_id", "other").alias("b")).distinct()
    tried = first_pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = verify(scratch, docs, scratch.cut(pairs.join(tried, ["a", "b"], "left_anti"), "pairs"))

    comps = components(scratch, comps.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    out = members.join(comps.withColumnRenamed("node", "class_id"), "class_id", "left")
    return scratch.cut(out.select("doc_id", "n_shingles", F.coalesce("component", "class_id", "doc_id").alias("component_id")), "linked")


def join_documents(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, a row per row of docs."""
    linked = link_documents(scratch, docs)
    out = docs.select("doc_id").join(linked, "doc_id", "left")
    return out.select("doc_id", F.coalesce(F.col("n_shingles").cast("long"), F.lit(0)).alias("n_shingles"), "component_id")


def apply_join(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One document of each component stays: the one with the least doc_id (and null ids)."""
    linked = link_documents(scratch, docs)
    gone = linked.where("doc_id <> component_id").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
