"""Values worked out by hand from the rules."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import score as sc
from quillstone.functions import text as tx
from quillstone.functions.vectors import cosine
from quillstone.operators import documents as dc
from quillstone.operators import workspace as w
from quillstone.operators.maintenance import VersionedTable
from quillstone.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("days", "evergreen", "missing", "want"), [(365, False, 0, 0.47), (365, False, 1, 0.5233), (309, False, 1, 0.4512), (365, True, 0, 0.094), (None, False, 1, 0.0533)])
def test_staleness(spark, days, evergreen, missing, want):
    c = sc.staleness(F.lit(days).cast("int"), F.lit(evergreen), F.lit(missing), F.lit(3), F.lit(False), F.lit(0), F.lit(0))
    assert one(spark, c) == pytest.approx(want, abs=1e-4)


def test_text_functions(spark):
    assert one(spark, tx.slugify(F.lit("Щука и Ёж — 2"))) == "shchuka-i-yozh-2"
    assert one(spark, tx.normalize_tag(F.lit("Объект--Х"))) == "obekt-kh"
    assert one(spark, tx.deep_normalize(F.lit("GET /a/b/1 took 2m0s key=abcd12 at 2024-01-01T00:00:00Z x 17"))) == "GET <path> took <dur> key=<key> at <ts> x <n>"
    assert one(spark, tx.endpoint(F.lit('h "GET http://a.b/items/42/x?q=1 HTTP/1.1" 404'))) == "/items/<id>/x"
    assert one(spark, tx.marker(F.lit("[INFO] [AUTH] no"))) == "AUTH"
    assert one(spark, tx.mask_secrets(F.lit("password=hunter2 Bearer abc"))) == "password=<secret> Bearer <secret>"
    assert one(spark, tx.token_count(F.lit("a" * 481))) == 121
    assert one(spark, tx.derive_title(F.lit("x\n## Head\n"), F.lit("f"))) == "Head"
    assert one(spark, F.size(tx.sentences(F.lit("A b. C d! E")))) == 3


def test_money_and_trend(spark):
    assert one(spark, sc.cost_micro(F.lit(1000), F.lit(500), F.lit(24_000_000), F.lit(96_000_000))) == 72_000
    assert one(spark, sc.trend(F.lit(3), F.lit(0))) is None


def test_fold_and_percentile(spark):
    rows = spark.createDataFrame([(1, 1.0, 1, 10.0), (1, 2.0, 2, 20.0), (1, 3.0, 3, 30.0)], "k int, ts double, seq int, value double")
    assert w.ema(rows, "k").first()["ema"] == pytest.approx(18.1)
    assert w.p95(spark.range(1, 11).selectExpr("1 as k", "id as value"), "k").first()["p95"] == 10
    assert one(spark, w.weight(F.lit("interactive"), F.lit("high"))) == 400


@pytest.mark.parametrize(("length", "chunks"), [(480, 1), (481, 2), (720, 2), (721, 3)])
def test_chunks(spark, length, chunks):
    d = spark.createDataFrame([("a", "x" * length)], "kid string, content string")
    assert dc.chunk_windows(d).count() == chunks


def test_packing_and_ids(spark):
    assert one(spark, dc.pack_sentences(F.lit("Aaaa bbbb. Cccc dddd. Eeee."), 3)) == ["Aaaa bbbb.", "Cccc dddd.", "Eeee."]
    ns = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    assert one(spark, dc.point_id(ns, F.lit("zone:kid:0"))) == str(uuid.uuid5(uuid.UUID(ns), "zone:kid:0"))
    assert one(spark, cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert dc.average_linkage(np.array([[1, 0], [1, 0.01], [0, 1]]), 0.25).tolist() == [0, 0, 2]


def test_markdown_and_versions(spark, tmp_path):
    (tmp_path / "md/.trash").mkdir(parents=True)
    (tmp_path / "md/a.md").write_text("---\nknowledge_id: k1\ntags: [x, y]\nversion: 3\n---\nBody\n")
    (tmp_path / "md/b.md").write_text("no head")
    (tmp_path / "md/c.md").write_text("---\nopen")
    (tmp_path / "md/_skip.md").write_text("---\na: 1\n---\n")
    (tmp_path / "md/.trash/d.md").write_text("---\na: 1\n---\n")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.read_markdown(spark, str(tmp_path / "md")).collect()}
    assert set(rows) == {"a.md", "b.md", "c.md"}
    assert (rows["a.md"]["meta"]["tags"], rows["a.md"]["meta"]["version"], rows["a.md"]["body"], rows["a.md"]["error"]) == (["x", "y"], 3, "Body", None)
    assert (rows["b.md"]["error"], rows["c.md"]["error"]) == ("no_delimiter", "unclosed")
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    t.swap(t.build(spark.range(3)))
    t.swap(t.build(spark.range(5)))
    t.drop_others()
    assert t.read().count() == 5


def test_written_markdown_is_read_back(spark, tmp_path):
    rows = [("k1", "d", "s", None, "draft", 2, "Body\nof one"), ("k2", "d", None, "p", None, 1, "Two")]
    files.write_markdown(spark.createDataFrame(rows, "kid string, domain string, subject string, project string, status string, version int, content string"), f"file://{tmp_path}/out")
    for f in (tmp_path / "out").rglob("part-*.txt"):
        f.rename(f.with_suffix(".md"))
    got = {r["meta"]["knowledge_id"]: r for r in files.read_markdown(spark, f"file://{tmp_path}/out").collect()}
    assert {k: (r["body"], r["meta"]["subject"], r["meta"]["project"], r["meta"]["version"], r["error"]) for k, r in got.items()} == {"k1": ("Body\nof one", "s", None, 2, None), "k2": ("Two", None, "p", 1, None)}
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nno json\n{"a": 2}\n')
    assert sorted(r["a"] for r in files.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 2]


def test_ids_and_long_documents(spark):
    make = lambda *a: one(spark, tx.knowledge_id(*map(F.lit, a)))
    assert make("Engineering", "physical training", "Знания и опыт", "007") == "engineering-physical-training-znaniya-i-opyt-007"
    assert make("!", "", "", "001") == "domain-subject-section-001"
    long = make("d" * 60, "s" * 60, "t" * 60, "deadbeef")
    assert long == f"{'d' * 40}-{'s' * 40}-{'t' * 36}-deadbeef" and len(long) == 127
    v = spark.range(6).selectExpr("cast(1 as long) as doc", "id as nth", "array(1.0d, 0.0d) as vector").union(spark.range(3).selectExpr("cast(2 as long)", "id", "array(1.0d, 0.0d)"))
    got = dc.cluster_paragraphs(v, most=4).collect()
    assert sorted((r["doc"], r["nth"]) for r in got) == [(2, k) for k in range(3)]  # a long document keeps its structure


def test_paths_of_any_length(spark):
    edges = spark.range(40).selectExpr("cast(0 as int) as g", "id as src", "id + 1 as dst")
    assert w.reachable(spark, edges).count() == 40 * 41 // 2


def test_snapshots_an_hour_after_the_last(spark):
    from quillstone.operators import events as ev

    at = lambda m: f"2024-01-01 {int(m) // 60:02d}:{int(m) % 60:02d}:{int(m * 60) % 60:02d}"
    rows = [("cpu", at(m), k, m != 200) for k, m in enumerate((0, 61, 120.5, 121, 200, 201, 202))]
    d = spark.createDataFrame(rows, "metric string, ts string, seq long, breached boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    # the last snapshot of an earlier breach counts
    assert [(r["seq"], r["kind"]) for r in ev.edge_trigger(d).orderBy("seq").collect()] == [(0, "edge"), (1, "snapshot"), (3, "snapshot"), (5, "edge"), (6, "snapshot")]


def test_pairs_without_bounds(spark, monkeypatch):
    from quillstone.operators import quality as q

    r = np.random.default_rng(2)
    base = r.normal(size=(8, 4))
    rows = [("d", f"k{i:03d}", (base[i % 8] + 0.01 * r.normal(size=4)).tolist(), i, "published") for i in range(60)]
    d = spark.createDataFrame(rows, "domain string, kid string, vector array<double>, vec_id long, status string")
    u = np.array([x[2] for x in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {(f"k{a:03d}", f"k{b:03d}") for a in range(60) for b in range(a + 1, 60) if round(float(u[a] @ u[b]), 4) >= 0.92}
    monkeypatch.setattr(q, "PAIR_FIRST", 7)  # blocks of seven
    assert {(x["kid_a"], x["kid_b"]) for x in q.vector_pairs(d, None, None).collect()} == want
    assert q.vector_pairs(d, 14, 2).groupBy("kid_a").count().agg(F.max("count")).first()[0] <= 2
