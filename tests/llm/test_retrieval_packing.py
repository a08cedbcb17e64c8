"""Packing: every id once and in place, full windows, scores by brute force, neighbours together."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillstone.llm import retrieval_packing
from quillstone.llm.common import Scratch
from quillstone.llm.vocabularies import vocabulary_bytes

PATH = public_tokenizers.path("word_bpe_49k.json")
WORDS = vocabulary_bytes(PATH)
LIBRARY = Tokenizer.from_file(PATH)


def encoded(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def packed(spark, rows, window=4096, partitions=3, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    df = df.selectExpr("*", "1 AS start", "'x' AS kind", "2 AS n", "'y' AS ids") if extra else df
    return retrieval_packing.pack(Scratch(spark, "test"), df, WORDS, window=window).collect()


def whole(rows, pieces, window):
    """Checks the contract; rows have distinct ids."""
    ids, by_doc, by_sequence = {i: encoded(t) for i, t in rows}, defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids[i])
            assert p["ids_crc32"] == crc(ids[i][at : at + p["length"]])
            at += p["length"]
        assert at == len(ids[i])
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == window or at < window and at & (at - 1) == 0
    return by_sequence


def topics(n, seed, long=40):
    r = random.Random(seed)
    words = [["".join(r.choices("abcdefgiklmnoprstu", k=r.randint(4, 7))) for _ in range(60)] for _ in range(8)]
    return [(i, " ".join(r.choices(words[i % 8], k=r.randint(5, long)))) for i in range(n)]


@pytest.mark.parametrize("window", [64, 256])
def test_every_id_lies_in_one_piece_and_windows_are_full(spark, window):
    rows = topics(300, 1) + [(1000, None), (1001, ""), (None, "a null id"), (1002, "x y. " * 3000), (1003, "é" * 500), (1004, "Zwei Häuser\n\nstehen <|endoftext|> da.")]
    whole(rows, packed(spark, rows, window, extra=True), window)


def test_reruns_agree_and_repeated_rows_stay(spark):
    rows = topics(90, 2) + [(5, "the same text again")] * 4
    a, b = (sorted(map(repr, packed(spark, rows, 128, p))) for p in (1, 3))
    assert len(a) and sum(p["length"] for p in packed(spark, rows, 128)) == sum(len(encoded(t)) for _, t in rows)
    assert a == sorted(map(repr, packed(spark, rows, 128, 1))) and len(b)


def test_empty_table(spark):
    assert packed(spark, []) == []


def test_a_hot_signature_spreads(spark):
    """A third of the rows are one text; they are dealt over several ranges and none is lost."""
    rows = [(i, "one text that many rows have") for i in range(400)] + [(i + 400, t) for i, t in topics(800, 3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pieces = packed(spark, rows, 256)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole(rows, pieces, 256)
    assert len({p["sequence_id"] >> 40 for p in pieces if p["doc_id"] < 400}) > 1


def test_neighbours_equal_brute_force_scores():
    docs = [encoded(t) for _, t in topics(150, 4)]
    held, mean = Counter(t for d in docs for t in set(d)), sum(map(len, docs)) / len(docs)
    top = max(held) + 1
    idf = np.array([math.log(1 + (len(docs) - held[t] + 0.5) / (held[t] + 0.5)) for t in range(top)], np.float32)
    index = retrieval_packing.Index([np.array(d, "<u2") for d in docs], idf, mean)

    def weight(t, d):
        f = d.count(t)
        return idf[t] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / mean)) if f else 0.0

    for k in range(0, 150, 7):
        terms = index.query(None, k)
        own = sorted(set(docs[k]), key=lambda t: -weight(t, docs[k]))
        assert min(weight(t, docs[k]) for t in terms.tolist()) >= weight(own[len(terms) - 1], docs[k]) - 1e-4
        assert set(index.query(np.array(docs[k], "<u2")).tolist()) == set(terms.tolist())
        index.unused[:] = True
        index.unused[k] = index.unused[3] = False
        scores = [sum(weight(t, d) for t in terms.tolist()) for d in docs]
        got = list(index.neighbours(terms))
        assert set(got) == {j for j, s in enumerate(scores) if s > 0 and j not in (k, 3)}
        assert all(scores[a] >= scores[b] - 1e-3 for a, b in zip(got, got[1:], strict=False))


def test_windows_hold_one_topic(spark):
    """Of two documents side by side, at least nine in ten share their topic of eight."""
    rows = topics(2000, 5)
    by_sequence = whole(rows, packed(spark, rows, 512), 512)
    same = [a["doc_id"] % 8 == b["doc_id"] % 8 for s in by_sequence.values() for x in [sorted(s, key=lambda p: p["offset"])] for a, b in zip(x, x[1:], strict=False)]
    assert len(same) > 1000 and sum(same) >= 0.9 * len(same)
