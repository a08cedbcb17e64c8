"""The document pipeline: sections, chunks, sentence packing, keywords, paragraph clusters, point ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillstone.functions import text as tx

WINDOW_CHARS, STRIDE_CHARS = 480, 240


def h2_sections(entries: DataFrame) -> DataFrame:
    """kid, nth, header, body: text before the first "## " is dropped, and so are empty bodies."""
    parts = F.split("content", r"(?m)^##[\x20\t]+")
    rows = entries.where(F.col("content").rlike(r"(?m)^##[\x20\t]+")).select("kid", F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("nth", "part"))
    head, body = F.regexp_extract("part", r"^([^\n]*)", 1), tx.strip(F.regexp_replace("part", r"^[^\n]*\n?", ""))
    return rows.select("kid", "nth", tx.strip(head).alias("header"), body.alias("body")).where("body <> ''")


def chunk_windows(entries: DataFrame) -> DataFrame:
    """kid, nth, start, content: windows of 480 characters every 240; the window that reaches the end is the last."""
    n = F.length("content")
    last = F.greatest(F.lit(0), F.ceil((n - WINDOW_CHARS) / STRIDE_CHARS)).cast("int")
    rows = entries.where(n > 0).select("kid", "content", F.explode(F.sequence(F.lit(0), last)).alias("nth"))
    return rows.select("kid", "nth", (F.col("nth") * STRIDE_CHARS).alias("start"), F.substr("content", F.col("nth") * STRIDE_CHARS + 1, F.lit(WINDOW_CHARS)).alias("content"))


def pack_sentences(text: Column, max_tokens: int) -> Column:
    """Greedy packing: a sentence that would go over the limit opens the next part."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        joined = F.when(acc["open"] == "", s).otherwise(F.concat_ws(" ", acc["open"], s))
        full = (acc["open"] != "") & (tx.token_count(joined) > max_tokens)
        return F.struct(F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"), F.when(full, s).otherwise(joined).alias("open"))

    return F.aggregate(tx.sentences(text), start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


def keywords(documents: DataFrame, corpus: list[str], stop_words: list[str], features: int = 100, top: int = 5) -> DataFrame:
    """kid, rank, word, weight: smooth idf, unit length, over the corpus' most frequent words.

    `corpus` names the columns that tell corpora apart. Equal weights: the later in the alphabet first.
    """
    words = F.regexp_extract_all(F.lower("content"), F.lit(r"[a-zа-яё0-9]{2,}"), F.lit(0))
    rows = documents.select(*corpus, "kid", F.explode(words).alias("word"))
    if stop_words:
        rows = rows.where(~F.col("word").isin(*stop_words))
    # words are counted first, so that only the kept ones, `features` a corpus, are counted by document
    totals = rows.groupBy(*corpus, "word").agg(F.count(F.lit(1)).alias("total"))
    rank = F.row_number().over(Window.partitionBy(*corpus).orderBy(F.desc("total"), "word"))
    kept = totals.withColumn("f", rank).where(F.col("f") <= features).select(*corpus, "word")
    tf = rows.join(kept, [*corpus, "word"], "left_semi").groupBy(*corpus, "kid", "word").agg(F.count(F.lit(1)).alias("tf"))
    n = documents.groupBy(*corpus).agg(F.countDistinct("kid").alias("n_docs"))
    df = tf.groupBy(*corpus, "word").agg(F.count(F.lit(1)).alias("df")).join(n, corpus)
    rows = tf.join(df, [*corpus, "word"])
    weighted = rows.withColumn("w", F.col("tf") * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*corpus, "kid")))
    weighted = weighted.withColumn("weight", F.round(F.col("w") / norm, 6))
    best = F.row_number().over(Window.partitionBy(*corpus, "kid").orderBy(F.desc("weight"), F.desc("word")))
    return weighted.withColumn("rank", best).where(F.col("rank") <= top).select("kid", "rank", "word", "weight")


def point_id(namespace: str, name: Column) -> Column:
    """uuid5 of a name: SHA-1 with the version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("long").bitwiseAND(63).bitwiseOR(128)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def tree_checksum(rows: DataFrame, group: str, key: str, digest: str, cuts: tuple[int, ...]) -> DataFrame:
    """One checksum a group over its rows' digests, as a tree: digests of rows whose keys agree in so many
    characters are joined in order and hashed, level by level, so no node gathers a whole group."""
    level = rows.select(group, F.col(key).alias("key"), F.col(digest).alias("digest"))
    for n in (*cuts, 0):
        node = F.substring("key", 1, n)
        lines = F.transform(F.array_sort(F.collect_list(F.struct("key", "digest"))), lambda x: F.concat_ws(" ", x["key"], x["digest"]))
        level = level.withColumn("node", node).groupBy(group, "node").agg(F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("digest")).withColumnRenamed("node", "key")
    return level.select(group, F.col("digest").alias("checksum"))


def average_linkage(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Labels of agglomerative clustering by mean cosine distance: clusters nearer than the threshold merge.

    A chain of nearest neighbours grows until two are each other's nearest; those merge. Mean distance never falls by
    a merge elsewhere, so that gives the tree of always merging the nearest two, in quadratic time; and a cluster
    whose nearest neighbour is at the threshold or beyond is final."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    if threshold <= 0:
        return np.arange(len(vectors))
    # equal vectors merge first, at distance 0; who has no neighbour below the threshold stays alone
    width, seen = unit.shape[1] * unit.itemsize, {}
    raw = (unit + 0.0).tobytes()  # -0.0 is 0.0; np.unique by rows takes half a millisecond for a handful
    same = np.array([seen.setdefault(raw[k : k + width], len(seen)) for k in range(0, len(raw), width)])
    firsts = np.full(len(seen), len(same))
    np.minimum.at(firsts, same, np.arange(len(same)))
    unit, out, size = unit[firsts], firsts.copy(), np.bincount(same).astype(float)
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    near = np.flatnonzero(d.min(1) < threshold)
    if len(near):
        out[near] = firsts[near][_chained(d[np.ix_(near, near)], size[near], threshold)]
    least = {}
    return np.array([least.setdefault(name, k) for k, name in enumerate(out[same].tolist())])  # a cluster is called after its first member


def _chained(d: np.ndarray, size: np.ndarray, threshold: float) -> np.ndarray:
    n = len(d)
    label, alive = np.arange(n), np.ones(n, bool)
    members, chain, first = [[k] for k in range(n)], [], 0
    while True:
        while not chain and first < n:
            if alive[first]:
                chain.append(first)
            else:
                first += 1
        if not chain:
            return label
        a = chain[-1]
        b = int(d[a].argmin())
        if d[a, b] >= threshold:
            alive[a], d[:, a] = False, np.inf
            chain.pop()
            continue
        if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
            b = chain[-2]
            del chain[-2:]
            a, b = min(a, b), max(a, b)
            d[a] = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
            d[:, a] = d[a]
            d[~alive, a] = d[a, ~alive] = d[a, a] = np.inf
            d[b], d[:, b], alive[b] = np.inf, np.inf, False
            d[a, b] = d[b, a] = np.inf
            size[a] += size[b]
            members[a] += members[b]
            label[members[b]] = a
        else:
            chain.append(b)


def paragraph_clusters(paragraphs: DataFrame, threshold: float = 0.25, most: int = 2000, doc: str = "doc") -> DataFrame:
    """doc, nths, sections (arrays, in order of nth): a row a document, as `cluster_paragraphs` tells it. Sorted partitions stream
    through a step that holds a batch and one document, of which no more than `most` paragraphs."""
    slim = paragraphs.select(doc, F.col("nth").cast("long").alias("nth"), "vector").repartition(doc).sortWithinPartitions(doc, "nth")

    def clustered(vectors: np.ndarray) -> np.ndarray:
        if len(vectors) < 2:
            return np.zeros(len(vectors), np.int64)
        label = average_linkage(vectors, threshold)
        return np.concatenate([[0], np.cumsum(label[1:] != label[:-1])]).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, held, count = None, [], 0  # of the open document: its name, (nths, vectors) of its batches, its paragraphs so far

        def closed() -> tuple[np.ndarray, np.ndarray]:
            return np.concatenate([n for n, _ in held]), clustered(np.concatenate([v for _, v in held]))

        for batch in batches:
            if not len(batch):
                continue
            docs, nths, vectors = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            codes = docs.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(sizes)])
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
            out = []
            for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                if (sizes[at:end] != sizes[at]).any():
                    raise ValueError(f"vectors of unequal lengths in {docs[at].as_py()!r}")
                if count and (at or docs[0].as_py() != named):
                    out += [(named, *closed())] if count <= most else []
                    held, count = [], 0
                named, count = docs[at].as_py(), count + end - at
                held = [*held, (nths[at:end], flat[ends[at] : ends[end]].reshape(end - at, -1))] if count <= most else []
            yield told(out)
        if count and count <= most:
            yield told([(named, *closed())])

    def told(rows: list) -> pa.RecordBatch:
        arrays = [pa.array([r[k] for r in rows], t) for k, t in enumerate((kind, pa.list_(pa.int64()), pa.list_(pa.int64())))]
        return pa.RecordBatch.from_arrays(arrays, names=[doc, "nths", "sections"])

    kind = to_arrow_type(slim.schema[doc].dataType)
    return slim.mapInArrow(run, f"{doc} {dict(slim.dtypes)[doc]}, nths array<long>, sections array<long>")


def cluster_paragraphs(paragraphs: DataFrame, threshold: float = 0.25, most: int = 2000, doc: str = "doc") -> DataFrame:
    """doc, nth, section: paragraphs of a document clustered by vector; neighbours of one cluster form a
    section. Documents of more than `most` paragraphs are not clustered and have no rows: their structural
    sections go on. That bounds a document's matrix."""
    found = paragraph_clusters(paragraphs, threshold, most, doc)
    return found.select(doc, F.explode(F.arrays_zip("nths", "sections")).alias("x")).select(doc, F.col("x.nths").alias("nth"), F.col("x.sections").alias("section"))


def paragraphs(text: Column) -> Column:
    """Stripped paragraphs between empty lines, without blank ones."""
    return F.filter(F.transform(F.split(text, "\n\n"), tx.strip), lambda p: p != "")
