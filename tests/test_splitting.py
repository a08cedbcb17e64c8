"""The hybrid split against a plain version, and the clusters against always merging the nearest two."""

import re

import numpy as np
import pytest

from quillstone.operators import authoring as au
from quillstone.operators import documents as dc
from quillstone.plans import authoring as pa


def naive_labels(vectors, threshold):
    v = np.array(vectors, float)
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    d, groups = 1 - v @ v.T, [[k] for k in range(len(v))]
    while len(groups) > 1:
        best = min(((np.mean([d[x, y] for x in a for y in b]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j), key=lambda x: x[0])
        if best[0] >= threshold:
            break
        groups[best[1]] += groups.pop(best[2])
    out = {k: n for n, g in enumerate(groups) for k in g}
    return [out[k] for k in range(len(v))]


def same(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("seed", range(6))
def test_chain_of_neighbours_equals_merging_the_nearest(seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, 6))
    v = np.array([centres[k] + r.normal(size=6) * (0.2 + 0.15 * seed) for k in r.integers(0, 5, 40)])
    for threshold in (0.05, 0.25, 0.6, 2.1):
        assert same(dc.average_linkage(v, threshold).tolist(), naive_labels(v, threshold))
    assert dc.average_linkage(v[:1], 0.25).tolist() == [0]


def plain_hybrid(content, vectors, limit=512, most=2000):
    heads = list(re.finditer(r"^(#{1,3})\s+(.+)$", content, re.M))
    if not content.strip():
        return []
    if len(heads) < 2:
        chunks = [(heads[0][2].strip() if heads else "Untitled", content.strip())]
    else:
        ends = [*[h.start() for h in heads[1:]], len(content)]
        chunks = [(h[2].strip(), content[h.start() : e].strip()) for h, e in zip(heads, ends, strict=True)]
        before = content[: heads[0].start()].strip()
        if before:
            chunks[0] = (chunks[0][0], before + "\n\n" + chunks[0][1])
    if len(chunks) < 2 or any(len(b) // 4 > limit for _, b in chunks):
        pieces = [p.strip() for p in content.split("\n\n") if p.strip()]
        if 2 <= len(pieces) <= most and vectors is not None:
            labels, merged = naive_labels(vectors, 0.25), []
            for k, p in enumerate(pieces):
                if k and labels[k] == labels[k - 1]:
                    merged[-1] += "\n\n" + p
                else:
                    merged.append(p)
            chunks = [(b.split("\n")[0].strip()[:120], b) for b in merged]
    out = []
    for title, body in chunks:
        sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+", body.strip()) if s.strip()]
        if len(body) // 4 <= limit:
            out.append((title, body))
        elif len(sentences) <= 1:
            out.append((title, body[: limit * 4]))
        else:
            parts, tokens = [[]], 0
            for s in sentences:
                if parts[-1] and tokens + len(s) // 4 > limit:
                    parts, tokens = [*parts, []], 0
                parts[-1].append(s)
                tokens += len(s) // 4
            out += [(f"{title} (part {k})" if len(parts) > 1 else title, " ".join(p)) for k, p in enumerate(parts, 1)]
    return out


def test_hybrid_sections_equal_a_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    texts, vectors = pa.paragraph_texts(spark, sf), {}
    for r in pa.paragraph_vectors(spark, sf).orderBy("kid", "nth").collect():
        vectors.setdefault(r["kid"], []).append(list(r["vector"]))
    got = {}
    for r in au.hybrid_sections(texts, vectors=pa.paragraph_vectors(spark, sf)).orderBy("kid", "seq").collect():
        got.setdefault(r["kid"], []).append((r["title"], r["body"]))
    rows = texts.collect()
    few = [r for r in rows if len(vectors.get(r["kid"], [])) <= 60]
    assert len(few) > 100
    for r in few:
        assert got.get(r["kid"], []) == plain_hybrid(r["content"], vectors.get(r["kid"])), r["kid"]


def test_too_many_paragraphs_and_missing_vectors_keep_the_structure(spark):
    rows = [("a", "# A\n\none\n\ntwo"), ("b", "x\n\ny\n\nz"), ("c", "x\n\ny"), ("d", " \n")]
    texts = spark.createDataFrame(rows, "kid string, content string")
    v = spark.createDataFrame([("b", k, [1.0, 0.0]) for k in range(3)] + [("c", 0, [1.0, 0.0])] + [("a", k, [float(k), 1.0 - k]) for k in range(2)], "kid string, nth int, vector array<double>")
    got = {(r["kid"], r["seq"]): (r["title"], r["body"]) for r in au.hybrid_sections(texts, vectors=v, most=2).collect()}
    assert got == {("a", 1): ("A", "# A\n\none\n\ntwo"), ("b", 1): ("Untitled", "x\n\ny\n\nz"), ("c", 1): ("Untitled", "x\n\ny")}
    got = {(r["kid"], r["seq"]): (r["title"], r["body"]) for r in au.hybrid_sections(texts, vectors=v).collect()}
    assert got["b", 1] == ("x", "x\n\ny\n\nz")


def test_many_clusters_of_one_text_take_linear_time(spark):
    """2,000 paragraphs, each a section: what a lambda looks up must not be computed anew for every element."""
    import time

    from pyspark.sql import functions as F

    n = 2000
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("p"), i.cast("string"))).alias("pieces"), F.sequence(F.lit(1), F.lit(n)).alias("numbers"))
    begun = time.time()
    got = rows.persist().select(au.clustered_sections(F.col("pieces"), F.col("numbers")).alias("s")).first()["s"]
    assert [(x["title"], x["body"]) for x in got] == [(f"p{k}", f"p{k}") for k in range(1, n + 1)]
    assert time.time() - begun < 3


def test_documents_across_batches_are_clustered_whole(spark):
    """Batches of three rows end within documents; one of more than `most` paragraphs has no row, wherever its batches end."""
    r = np.random.default_rng(5)
    base = r.normal(size=(4, 3))
    rows = [(doc, k, [float(x) for x in base[r.integers(0, 4)] + r.normal(size=3) * 0.1]) for doc in range(30) for k in range(1 + doc % 9)]
    rows += [(99, k, [1.0, 0.0]) for k in range(9)] + [(98, k, [1.0, 0.0, -0.0, 0.0]) for k in range(10)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        frame = spark.createDataFrame(rows, "doc long, nth int, vector array<double>").repartition(3)
        got = {x["doc"]: (x["nths"], x["sections"]) for x in dc.paragraph_clusters(frame, most=9).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for doc in {x[0] for x in rows} - {98}:
        v = [x[2] for x in rows if x[0] == doc]
        labels = naive_labels(v, 0.25)
        want[doc] = (list(range(len(v))), np.cumsum([0, *(a != b for a, b in zip(labels, labels[1:], strict=False))]).tolist())
    assert got == want


def test_texts_are_split_once(spark):
    """The pattern of headings stands once in the plan, and nothing is written to be read again."""
    import os

    sf = "/root/testdata/sf0.001"
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    out = au.hybrid_sections(pa.paragraph_texts(spark, sf), vectors=pa.paragraph_vectors(spark, sf))
    assert not [x for x in set(os.listdir(folder)) - before if x.startswith("quillstone-sections")]
    for df in (out, au.structural_sections(pa.marked(spark, sf))):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("(?m)^(#{1,3}") == 1


def test_strip_at_a_line_separator(spark):
    from pyspark.sql import functions as F

    from quillstone.functions import text as tx

    rows = spark.createDataFrame([(k, x) for k, x in enumerate(["\t\x0b\f a \r\n", "a  ", "  a", " ", "\xa0a"])], "k int, x string")
    assert [r["s"] for r in rows.select("k", tx.strip(F.col("x")).alias("s")).orderBy("k").collect()] == ["a", "a  ", "  a", "", "\xa0a"]
