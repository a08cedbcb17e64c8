"""Nearest neighbours against all pairs, graphs by hand, pages that are long or blank."""

import numpy as np
import pytest

from quillstone.operators import graphs as gr
from quillstone.operators import neighbours as nb
from quillstone.operators import pages as pg


@pytest.mark.parametrize("seed,threshold,cell", [(1, 0.92, 4096), (2, 0.92, 7), (3, 0.5, 50), (4, -0.2, 4096), (5, 0.999, 3)])
def test_near_pairs_equal_all_pairs(spark, monkeypatch, seed, threshold, cell):
    monkeypatch.setattr(nb, "CELL", cell)
    r = np.random.default_rng(seed)
    centres = r.normal(size=(9, 5))
    v = [centres[k] + r.normal(size=5) * 0.3 for k in r.integers(0, 9, 150)] + [centres[0]] * 30
    rows = [(f"k{i}", "a" if i % 3 else "b", [float(x) for x in p]) for i, p in enumerate(v)]
    points = spark.createDataFrame([*rows, ("zero", "a", [0.0] * 5), ("none", "a", None)], "kid string, domain string, vector array<double>")
    new = points.where("kid in ('k1', 'k2', 'k3', 'k149', 'k160', 'zero', 'none')")
    unit = {k: (d, np.array(p) / np.linalg.norm(p)) for k, d, p in rows}
    want = {(q, k) for q in ("k1", "k2", "k3", "k149", "k160") for k in unit if unit[q][0] == unit[k][0] and float(unit[q][1] @ unit[k][1]) >= threshold + 1e-9}
    got = {(x["kid"], x["other"]): x["cosine"] for x in nb.near_pairs(new, points, threshold).collect()}
    assert want <= set(got) and all(c >= threshold for c in got.values())
    assert len(got) <= len(want) + 10  # ties with the threshold, a vector with itself at 0.999...
    top = nb.duplicate_gate(new, points, threshold).groupBy("kid").count().collect()
    assert all(x["count"] <= 8 for x in top)
    assert nb.near_pairs(new, points.limit(0), threshold).count() == 0


def test_cycles_by_hand(spark):
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1), (2, 1, 2), (2, 2, 1), (3, 1, 2), (3, 2, 3), (4, 5, 5), (5, 1, 2), (5, 2, 1), (6, 1, 9), (6, 9, 1)], "g long, src long, dst long")
    kinds = {(2, 2): ("critic-gate", 3, 1), (5, 2): ("critic-gate", 0, 1)}
    names = {(g, k) for g in range(1, 7) for k in (1, 2, 3, 5)}
    nodes = spark.createDataFrame([(g, k, *kinds.get((g, k), ("role", None, None))) for g, k in names], "g long, node long, kind string, rounds long, on_revise long")
    # 2 is a critic's allowed way back; in 5 its rounds have no bound; node 9 of 6 isn't there
    assert sorted(r["g"] for r in gr.illegal_cycles(edges, nodes).collect()) == [1, 4, 5]
    assert gr.cyclic_nodes(edges.limit(0)).count() == 0
    long = spark.range(60).selectExpr("0 AS g", "id AS src", "id + 1 AS dst")
    assert gr.cyclic_nodes(long).count() == 0
    assert gr.cyclic_nodes(long.union(spark.createDataFrame([(0, 60, 58)], "g long, src long, dst long"))).count() == 3


def test_inputs_come_from_any_ancestor(spark):
    edges = spark.createDataFrame([("m", "a", "b"), ("m", "b", "c"), ("m", "c", "d")], "g string, src string, dst string")
    rows = [("m", "a", "role", ["draft"], None, None), ("m", "b", "critic-gate", None, ["ok"], ["draft"]), ("m", "c", "role", ["text"], None, ["brief", "draft", "verdict"]), ("m", "d", "role", None, None, ["text", "table", "own", "chart"])]
    nodes = spark.createDataFrame(rows, "g string, node string, kind string, outputs array<string>, verdicts array<string>, inputs array<string>")
    assert [tuple(r) for r in gr.missing_inputs(edges, nodes).collect()] == [("m", "c", "d", "chart,own,table")]


def test_pages_long_blank_and_before_the_first(spark):
    text = "Sentence one is here. " * 300
    docs = spark.createDataFrame([("d", "  \n  " + text), ("e", "abc")], "doc string, content string")
    pages = spark.createDataFrame([("d", 1, 0, 5), ("d", 2, 5, 5 + len(text)), ("e", 1, 0, 3)], "doc string, page long, start long, stop long")
    none = spark.createDataFrame([], "doc string, nth long, title string")
    got = pg.imported_sections(docs, none, pages).orderBy("doc", "seq", "part").collect()
    assert [r["title"] for r in got if r["doc"] == "d"][:2] == ["Страница 1", "Страница 1 (часть 2)"]
    assert [(r["seq"], r["part"]) for r in got if r["doc"] == "d"] == [(1, k + 1) for k in range(len(got) - 1)]
    assert all(len(r["body"]) <= 2400 and r["page"] == 2 for r in got if r["doc"] == "d") and got[-1]["body"] == "abc"
    heads = spark.createDataFrame([("e", 1, "b"), ("e", 2, "zz"), ("e", 3, "c")], "doc string, nth long, title string")
    got = pg.imported_sections(docs.where("doc = 'e'"), heads, pages).orderBy("seq").collect()
    assert [(r["title"], r["body"], r["page"]) for r in got] == [("b", "a", 1)]
    got = pg.imported_sections(docs.where("doc = 'e'"), heads.where("nth < 3"), pages).orderBy("seq").collect()
    assert [(r["title"], r["body"]) for r in got] == [("b", "a"), ("Последний раздел", "c")]
    marks = spark.createDataFrame([("d", 3), ("d", 5), ("f", 1)], "doc string, start long")
    late = spark.createDataFrame([("d", 7, 4, 9)], "doc string, page long, start long, stop long")
    assert sorted((r["doc"], r["start"], r["page"]) for r in pg.page_of(marks, late).collect()) == [("d", 3, None), ("d", 5, 7), ("f", 1, None)]


def test_equal_vectors_make_k_pairs_a_slice(spark):
    """All points alike: what a query sends on is k rows a slice, not the group, and the gate's answer stays that of all pairs."""
    points = spark.createDataFrame([(f"k{i:03}", "a", [1.0, 0.5]) for i in range(300)], "kid string, domain string, vector array<double>")
    new = points.where("kid < 'k003'")
    few = nb.near_pairs(new, points, 0.9, k=8)
    assert few.count() == 3 * 8
    names = [f"k{i:03}" for i in range(300)]
    want = {(q, o) for q in names[:3] for o in [x for x in names if x != q][:8]}
    assert {(r["kid"], r["other"]) for r in nb.duplicate_gate(new, points, 0.9).collect()} == want


def test_every_section_of_an_import_asks_the_gate(spark, tmp_path):
    """Near copies whose numbers are no multiple of 50, in a book of ten: each is a warning, told by the query and by its SQL."""
    import os
    import shutil

    import duckdb
    from pyspark.sql import functions as F

    from quillstone.plans import bookkeeping as pb

    sf = f"{tmp_path}/sf"
    shutil.copytree("/root/testdata/sf0.001", sf, ignore=shutil.ignore_patterns("embeddings.parquet", "documents.parquet"))
    base = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    like = base.where("vec_id = 12").first()["embedding"]
    copies = F.when(F.col("vec_id").isin(12, 14, 17, 33), F.array(*map(F.lit, like)).cast("array<float>")).otherwise(F.col("embedding"))
    base.withColumn("embedding", copies).coalesce(1).write.parquet(f"{sf}/embeddings.parquet")
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("source", F.lit("one")).coalesce(1).write.parquet(f"{sf}/documents.parquet")
    got = {r["kid"]: tuple(r) for r in pb.QUERIES["import_report"](spark, sf).collect()}
    found = {k: r for k, r in got.items() if r[5]}
    assert {k: r[5] for k, r in found.items()} == {f"doc-{n:08}": 3 for n in (12, 14, 16, 32)} and all(r[2] and r[4] > 0 for r in found.values())
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}{'/*.parquet' if os.path.isdir(f'{sf}/{f}') else ''}'")
    assert {r[1]: r for r in con.execute(pb.ORACLE["import_report"]).fetchall()} == got


def test_a_vector_travels_once_a_block(spark, monkeypatch):
    """Scattered vectors: a query goes to the blocks of its group, not to every cell that its angle meets."""
    r = np.random.default_rng(6)
    points = spark.createDataFrame([(f"k{i}", "a", [float(x) for x in r.normal(size=64)]) for i in range(300)], "kid string, domain string, vector array<double>")
    seen = spark.sparkContext.accumulator(0)
    unit = nb.unit_rows

    def counted(rows):
        seen.add(len(rows))
        return unit(rows)

    monkeypatch.setattr(nb, "unit_rows", counted)
    monkeypatch.setattr(nb, "CELL", 100)
    assert nb.near_pairs(points, points, 0.92, k=8).count() == 0
    assert 300 * 4 <= seen.value <= 300 * (4 + 2 * 3 + 6)  # cells twice a side, then three blocks that three others meet
