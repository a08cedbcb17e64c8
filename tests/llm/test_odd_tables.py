"""Null ids, repeated rows, clashing names and long texts through every operator on documents; values of the pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillstone.llm import katz, line_dedup, mixing, ngram_join, piece_fst, quality_rules, separator_scan, stream_dedup
from quillstone.llm.common import Scratch
from quillstone.llm.vocabularies import vocabulary_bytes

MODEL = vocabulary_bytes(public_tokenizers.path("piece_bpe_32k.model"))
DISTINCT = " ".join(f"w{i}x{i * 7919 % 10007}" for i in range(12_000))
UNBROKEN = "".join(random.Random(1).choices("abcdefghijkl", k=60_000))
ROWS = [
    (None, "a null id and seven words", "s"), (None, None, None), (None, None, None), (4, "the same row twice", "s"), (4, "the same row twice", "s"), (4, "", "s"), (5, " \n\t", None),
    (9, DISTINCT, "t"), (10, DISTINCT + " end", "t"), (11, UNBROKEN, "t"), (12, "x" + UNBROKEN, "u"), (13, "漢字" * 20_000, "u"),
]


@pytest.fixture
def odd(spark):
    """Columns named like those that operators make for themselves."""
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, source string").repartition(3)
    return rows.selectExpr("*", "1 AS node", "'x' AS row", "2 AS at", "3 AS digest", "4 AS kind", "5 AS key", "6 AS h", "7 AS n", "8 AS size", "9 AS component", "10 AS uid", "11 AS ids", "12 AS taken")


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "odd")


def ids_of(rows):
    return Counter(r["doc_id"] for r in rows)


ALL = Counter(i for i, *_ in ROWS)


def test_pieces(odd):
    out = piece_fst.encode_documents(odd, MODEL).collect()
    assert ids_of(out) == ALL and all(r["decodes"] for r in out) and all(r["ids"] == 11 for r in out)


def test_mixing(odd, scratch):
    out = mixing.mix(scratch, odd).collect()
    assert ids_of(out) == ALL
    words = Counter((i, len((t or "").encode().split())) for i, t, _ in ROWS)
    assert Counter((r["doc_id"], r["size"]) for r in out) == words
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    assert mixing.mix(scratch, odd.limit(0)).count() == 0


def test_lines(odd, scratch):
    out = line_dedup.mark_lines(scratch, odd).select("row.doc_id", "row.text", "gone", "kept_text").collect()
    assert ids_of(out) == ALL
    kept = {r["doc_id"]: r["kept_text"] for r in out if r["doc_id"] in (9, 10, 11, 12)}
    assert kept == {9: DISTINCT, 10: "", 11: UNBROKEN, 12: ""}
    assert sorted(r["kept_text"] for r in out if r["doc_id"] == 4) == ["", "", "the same row twice"]


def test_separators(odd, scratch):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    path = scratch.path("flat")
    separator_scan.write_flat(odd, path, MODEL, file_bytes=9000)
    counted = separator_scan.count_tokens(scratch, f"{path}/kind=ids", block_ids=512)
    out = separator_scan.name_documents(scratch, path, counted).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in out) == Counter((i, len(library.encode(t or "")) + 1) for i, t, _ in ROWS)


def test_streamed_copies(spark, odd, tmp_path):
    path = f"file://{tmp_path}/documents.parquet"
    odd.write.parquet(path)
    out = stream_dedup.dedup(spark, path).collect()
    assert ids_of(out) == ALL
    sizes = Counter(t or "" for _, t, _ in ROWS)
    assert sum(r["kept"] for r in out) == len(sizes)
    assert sorted((r["doc_id"] or 0, r["group_size"]) for r in out) == sorted((i or 0, sizes[t or ""]) for i, t, _ in ROWS)
    empty = f"file://{tmp_path}/empty.parquet"
    odd.limit(0).write.parquet(empty)
    assert stream_dedup.dedup(spark, empty).count() == 0


def test_one_file_comes_in_several_batches(spark, scratch, tmp_path):
    """Copies are told over batches: the state is met again."""
    path = f"file://{tmp_path}/one.parquet"
    spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)], "doc_id long, text string").coalesce(1).write.parquet(path)
    rows = stream_dedup._located(spark.read.parquet(path), 256).select("at", "digest")
    light = scratch.cut(rows, "light", most=10)
    folder = scratch.path("state")
    state = stream_dedup.keep_state(stream_dedup.stream_of(light, 4), folder)
    assert sorted(r["n"] for r in state.collect()) == [5, 5, 6, 6, 6, 6, 6]
    assert spark.read.parquet(f"{folder}/changes").select("batch").distinct().count() == 4


def test_katz(odd, scratch):
    out = katz.score(scratch, odd).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in out) == Counter((i, len((t or "").encode().split()) + 1) for i, t, _ in ROWS)
    assert all(r["score"] < 0 and r["base_score"] < 0 for r in out)
    twice = {(r["doc_id"], r["score"]) for r in out if r["doc_id"] == 4 and r["n_tokens"] == 5}
    assert len(twice) == 1


def test_shingles(odd, scratch):
    out = ngram_join.join_documents(scratch, odd).collect()
    assert ids_of(out) == ALL
    by_id = {r["doc_id"]: r for r in out if r["doc_id"] in (9, 10, 11, 12, 13)}
    assert by_id[10]["component_id"] == 9 and by_id[9]["n_shingles"] == 11_996 and by_id[12]["component_id"] == 12


def test_rules(odd):
    out = quality_rules.judge(quality_rules.measure(odd)).select("row.doc_id", "n_words", "base_failed", "kept").collect()
    assert Counter((r["doc_id"], r["n_words"]) for r in out) == Counter((i, len((t or "").encode().split())) for i, t, _ in ROWS)
    assert all(r["base_failed"] and not r["kept"] for r in out if r["n_words"] < 50)


def grams(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def test_values_of_the_pipeline(spark, tmp_path):
    """Each stage's result against plain Python on the stage before."""
    import corpus_pipeline
    import sentencepiece

    r = random.Random(11)
    words = ["".join(r.choices("aeioulnrst", k=r.randint(2, 7))) for _ in range(700)]
    make = lambda n: "\n".join(" ".join(r.choices(words, k=12)) + "." for _ in range(n))
    texts = [make(8) for _ in range(60)]
    near = [" ".join(w if k != 40 else "changed" for k, w in enumerate(t.split(" "))) for t in texts[:6]]
    shared = "this passage of more than ten words stands in very many documents of this corpus."
    texts += [*texts[10:14], *near, *(shared + "\n" + make(8) for _ in range(8)), "too short", "no " * 400, "### $$$ %%% " * 60]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    steps = [{k: t for k, t, *_ in rows}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = Scratch(spark, "step").cut(stage(spark, docs, str(tmp_path)))
        steps.append({x["doc_id"]: x["text"] for x in docs.collect()})
    whole, good, lines, apart, mixed = steps
    assert set(good) == set(range(len(texts) - 3))  # the three bad ones go, all clean ones stay
    seen = Counter(re.sub(" +", " ", x.lower()).strip() for t in lines.values() for x in t.split("\n") if x.strip())
    assert max(seen.values()) == 1 and sum(shared in t for t in lines.values()) == 1
    links = [(a, b) for a in lines for b in lines if a < b and 100 * len(grams(lines[a]) & grams(lines[b])) >= 80 * len(grams(lines[a]) | grams(lines[b])) and grams(lines[a])]
    assert set(apart) == set(lines) - {b for _, b in links} and all(apart[k] == lines[k] for k in apart)
    assert set(mixed) <= set(apart)
    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    held = docs.collect()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    crc = lambda t: zlib.crc32(np.array(library.encode(t), "<u2").tobytes())
    assert Counter((x["doc_id"], x["ids_crc32"]) for x in out) == Counter((x["doc_id"], crc(x["text"])) for x in held)
    assert whole and F
