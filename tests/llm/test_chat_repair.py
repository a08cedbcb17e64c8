"""Conversation repair against a search over all edit strings, and the query against plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from quillstone.llm import chat_repair
from quillstone.llm.common import Scratch

ARCS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """rows: (role, text, fault). Least (cost, letters) over all edits, with the repaired lines (best-first search)."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, letters, i, q, lines = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, letters, list(lines)
        if (i, q) in done:
            continue
        done.add((i, q))
        for name in ("user", "assistant"):
            if (q, name[0]) in ARCS:
                heapq.heappush(heap, (cost + 5, letters + "I", i, ARCS[q, name[0]], (*lines, f"{name}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, letters + "D", i + 1, q, lines))
            if fault not in ("blank", "duplicate"):
                late = 5 * (fault == "truncated")
                if (q, role[:1]) in ARCS:
                    heapq.heappush(heap, (cost + late, letters + "K", i + 1, ARCS[q, role[:1]], (*lines, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if (q, name[0]) in ARCS:
                        heapq.heappush(heap, (cost + 1 + late, letters + "R", i + 1, ARCS[q, name[0]], (*lines, f"{name}:{text}")))
    raise AssertionError


def brute(rows):
    """rows: (conv_id, turn, role, text), turns distinct within a conversation or rows equal."""
    groups, space = {}, lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kept = groups.setdefault(conv, [])
        kind, role, text = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20, space(role), space(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, kept in groups.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        faults, seen = [], set()
        for _, role, text in kept:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, letters, lines = cheapest([(r, t, f) for (_, r, t), f in zip(kept, faults, strict=True)])
        turns = [t for t, *_ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(map(repr, out))


def run(spark, rows, partitions=3, extra=False):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(partitions)
    df = df.selectExpr("*", "'x' AS row", "1 AS letters", "false AS gone") if extra else df
    out = chat_repair.digests(chat_repair.repair(Scratch(spark, "test"), chat_repair.damaged(df)))
    return sorted(repr(tuple(r)) for r in out.collect())


def conversations(seed, n, longest=14):
    r = random.Random(seed)
    texts = ["", " \t", "yes.", "no!", "why?", "so ", "I see", "well.\n", "ok. ", "a "]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "sys", "", "unknown"]
    rows = []
    for conv in range(n):
        for turn in range(r.randint(1, longest)):
            if r.random() < 0.9:
                text = r.choice(texts) if r.random() < 0.5 else f"{r.choice(texts)} {r.randrange(99)}{r.choice(['.', '?', ''])}"
                role = ("user", "assistant")[turn % 2] if r.random() < 0.6 else r.choice(roles)
                rows.append((conv, turn * r.choice([1, 1, 2]) if r.random() < 0.02 else turn, role, text))
    return list({(c, t): (c, t, role, text) for c, t, role, text in rows}.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_search_over_all_edits(spark, seed):
    rows = conversations(seed, 300)
    assert run(spark, rows, extra=True) == brute(rows)


def test_a_conversation_over_many_ranges(spark):
    """One conversation holds most rows and is cut into several blocks."""
    rows = [(7, t, role, text) for _, (_, _, role, text), t in zip(range(3000), conversations(5, 700) * 2, range(3000), strict=False)] + conversations(6, 5)
    rows = [(7 if c == 7 else c + 10, t, role, text) for c, t, role, text in rows]
    assert run(spark, rows) == brute(rows)


def test_nulls_copies_and_empty_tables(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (None, 2, "assistant", None), (3, None, "user", "x."), (3, None, "user", "x."), (3, 5, "assistant", "y."), (4, None, None, "z")]
    rows += [(8, t, "user", "same.") for t in range(30)] + [(9, t, ("user", "assistant")[t % 2], "word " * 20_000 + f"{t}.") for t in range(6)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_rows_all_dropped_keep_their_conversation(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(conv, 0, "user", "a.")]) == [repr((conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))]


def test_edits_keep_texts_and_lines(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "hello."), (1, 1, "assistant", "good day.")], "conv_id long, turn long, role string, text string")
    out = chat_repair.repair(Scratch(spark, "test"), rows.selectExpr("*", "false AS gone", "0 AS copy")).orderBy("row").collect()
    assert [(r["letters"], r["lines"], r["text"]) for r in out] == [("Ru", ["user:hello."], "hello."), ("K", ["assistant:good day."], "good day.")]
    assert out[0]["counts"] == [0, 0, 0, 0, 1, 1] and out[1]["counts"] is None
