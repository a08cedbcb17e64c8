"""Writes in batches against replays one row after the other, and entries as files."""

import random

import pytest

from quillstone.operators import writing as wr
from quillstone.sources import walk

REQUEST = "n long, kid string, content string, domain string, subject string, zone string, strict boolean, documents array<string>, source string, evergreen boolean, cross_subjects array<string>"
STORE = "kid string, content_type string, domain string, subject string, zone string, content string, version long"
SOURCE = "source_id string, sha256 string, canonical string, derived array<string>, error string, license string, public_allowed boolean"
INGEST = "n long, sha256 string, canonical string, derived array<string>, error string, license string, public_allowed boolean"


def replay_writes(rows, store, dups):
    kinds, out = {s[0]: s[1] for s in store}, {}
    taken = set(kinds)
    for n, kid, content, domain, subject, zone, strict, documents, source, evergreen, crossed in rows:
        bad = next((k for k, v in (("content", content), ("domain", domain), ("subject", subject)) if not v), None) or (None if zone in (None, "public", "private") else "zone")
        missing = [k for k, v in (("source", source), ("evergreen", evergreen), ("cross_subjects", crossed)) if not v]
        issues = ["taken"] * bool(kid and kid in taken)
        if strict:
            issues += [f"missing:{m}" for m in missing] + ["duplicates"] * (n in dups)
        faults = [x for x in ("empty" if not d else f"not_found:{d}" if d not in kinds else f"not_source:{d}" if kinds[d] != "source" else None for d in documents or []) if x]
        if bad:
            out[n] = ("invalid", bad)
        elif issues:
            out[n] = ("blocked", ",".join(issues))
        elif faults:
            out[n] = ("refused", ",".join(faults))
        else:
            name = kid or f"{domain}-{subject}-h{content[4:]}"
            taken.add(name)
            out[n] = ("written", "")
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_writes_equal_a_replay(spark, seed):
    r = random.Random(seed)
    store = [("s1", "source", "l", "b", "private", "x", 1), ("book1", None, "d", "s", "public", "y", 3), ("d-s-h1", "book", "d", "s", "public", "z", 1)]
    rows = [
        (n, r.choice([None, "", "book1", "a1", "a2", "d-s-h2"]), r.choice(["## h1", "## h2", "## h3", "## h4", None]), r.choice(["d"] * 6 + [None]), r.choice(["s"] * 6 + [""]), r.choice([None, "public", "private", "private", "other"]), r.choice([True, False, None]),
         r.choice([None, [], ["s1"], ["s1", "s1"], ["gone", "book1", None, ""]]), r.choice(["x", "x", "x", ""]), r.choice([True, True, True, False, None]), r.choice([["a"], ["a"], ["a"], []]))
        for n in range(150)
    ]
    dups = {n for n in range(150) if r.random() < 0.2}
    frames = spark.createDataFrame(rows, REQUEST), spark.createDataFrame(store, STORE), spark.createDataFrame([(n, x) for n in dups for x in range(2)], "n long, other long")
    out = wr.entry_writes(*frames)
    got = {x["n"]: x for x in out.collect()}
    want = replay_writes(rows, store, dups)
    assert {n: (x["outcome"], x["reasons"]) for n, x in got.items()} == want
    assert all(x["duplicates"] == (2 if n in dups and x["outcome"] != "invalid" else 0) for n, x in got.items())
    after = {x["kid"]: x["content"] for x in wr.stored(frames[1], frames[0], out).collect()}
    last = {x["id"]: rows[n][2] for n, x in sorted(got.items()) if x["outcome"] == "written"}
    assert after == {s[0]: s[5] for s in store} | last
    assert wr.entry_writes(frames[0].limit(0), frames[1], frames[2].limit(0)).count() == 0


def replay_ingests(sources, rows):
    state = {s[0]: dict(zip(("sha", "canonical", "derived", "error", "license", "allowed"), s[1:], strict=True)) for s in sources}
    for s in state.values():
        s["derived"] = list(s["derived"] or [])
    out = {}
    for n, sha, canonical, derived, error, license, allowed in rows:
        if sha is None or len(sha) != 64:
            out[n] = "invalid"
            continue
        s = state.get("src-" + sha[:16])
        if s is None:
            state["src-" + sha[:16]] = {"sha": sha, "canonical": canonical, "derived": list(dict.fromkeys(derived or [])), "error": None if canonical else error, "license": license, "allowed": allowed if allowed is not None else license == "own"}
            out[n] = "created"
        elif s["sha"] != sha:
            out[n] = "collision"
        else:
            changed = False
            if not s["canonical"] and canonical:
                s["canonical"], changed = canonical, True
            for d in derived or []:
                if d not in s["derived"]:
                    s["derived"].append(d)
                    changed = True
            if s["canonical"]:
                changed |= s["error"] is not None
                s["error"] = None
            elif error:
                s["error"], changed = error, True
            out[n] = "attached" if changed else "reused"
    return out, {k: (s["sha"], s["canonical"], tuple(s["derived"]), s["error"], s["license"], s["allowed"]) for k, s in state.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ingests_equal_a_replay(spark, seed):
    r = random.Random(seed)
    sha = lambda k, tail="0": f"{k:016x}" + tail * 48
    sources = [("src-" + sha(k)[:16], sha(k), r.choice([None, "c0"]), r.choice([None, ["d1", "d2"]]), r.choice([None, "e0"]), "arr", r.choice([True, False])) for k in range(4)]
    rows = []
    for n in range(200):
        canonical = r.choice([None, None, None, None, "c1", "c2"])
        rows.append((n, r.choice([None, "x", sha(r.randint(0, 12), r.choice("0001"))]) if n % 10 == 0 else sha(r.randint(0, 12), r.choice("00001")), canonical, r.choice([None, [], ["d3", "d1", "d3"], ["d4"]]), None if canonical else r.choice([None, None, "e1", "e2"]), r.choice([None, "own"]), r.choice([None, True, False])))
    after, told = wr.registered(spark.createDataFrame(sources, SOURCE), spark.createDataFrame(rows, INGEST))
    want, state = replay_ingests(sources, rows)
    assert {x["n"]: x["outcome"] for x in told.collect()} == want
    assert {x["source_id"]: (x["sha256"], x["canonical"], tuple(x["derived"] or ()), x["error"], x["license"], x["public_allowed"]) for x in after.collect()} == state


def test_ingests_are_shuffled_once_and_stream(spark):
    """Nothing is written to be read again, rows travel once, batches of three end within a source, and the store's sources stay, with odd ids too."""
    import os

    r = random.Random(9)
    sha = lambda k, tail="0": f"{k:016x}" + tail * 48
    sources = [("src-" + sha(k)[:16], sha(k), None, ["d1"], "e0", "arr", True) for k in (0, 1, 77)] + [("odd", "x", None, None, "e", None, None), (None, None, None, ["d"], None, None, False)]
    rows = [(n, sha(r.randint(0, 5), r.choice("00001")), r.choice([None, None, None, "c1"]), r.choice([None, ["d1", "d2"], [f"d{n}"]]), r.choice([None, "e1"]), "own", None) for n in range(120)] + [(n, "no hash", None, None, None, None, None) for n in range(120, 130)]
    r.shuffle(rows)
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        after, told = wr.registered(spark.createDataFrame(sources, SOURCE), spark.createDataFrame(rows, INGEST))
        assert told._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        want, state = replay_ingests([s for s in sources if s[1] and len(s[1]) == 64], sorted(rows))
        assert {x["n"]: x["outcome"] for x in told.collect()} == want
        got = {x["source_id"]: (x["sha256"], x["canonical"], tuple(x["derived"] or ()), x["error"], x["license"], x["public_allowed"]) for x in after.collect()}
        assert got == state | {s[0]: (s[1], s[2], tuple(s[3] or ()), *s[4:]) for s in sources[3:]}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert not [x for x in set(os.listdir(folder)) - before if x.startswith("quillstone-ingests")]


def test_licences(spark):
    store = spark.createDataFrame([("a", "source", "arr", None, 1), ("b", None, None, None, 4)], "kid string, content_type string, license string, public_allowed boolean, version long")
    asked = [(1, "a", "cc-by", None), (2, "a", None, False), (3, "b", "own", None), (4, "c", "own", None), (5, "", "own", None), (6, "a", None, None), (7, None, "own", True)]
    after, told = wr.relicensed(store, spark.createDataFrame(asked, "n long, source_id string, license string, public_allowed boolean"))
    assert {x["n"]: x["outcome"] for x in told.collect()} == {1: "ok", 2: "ok", 3: "not_source", 4: "not_found", 5: "missing", 6: "nothing", 7: "missing"}
    assert {tuple(x) for x in after.collect()} == {("a", "source", "cc-by", False, 3), ("b", None, None, None, 4)}


def test_walk_finds_what_spark_hides(spark, tmp_path):
    places = ["a.md", "_b.md", "d/c.md", "_d/e.md", ".f/g.md", "d/.trash/h.md", ".trash/i/j.md", "d/k.txt", *[f"m/{k}/x{k}.md" for k in range(300)]]
    rows = spark.createDataFrame([(p, f"---\nknowledge_id: id-{i}\ndomain: d\nsubject: s\n---\nbody {i}\r\n") for i, p in enumerate(places)], "path string, text string")
    assert walk.write_texts(rows, f"file://{tmp_path}/all")[0] == len(places)
    found = {x["path"] for x in walk.walked(spark, f"file://{tmp_path}/all").collect()}
    assert found == {p for p in places if ".trash" not in p and p.endswith(".md")} - {"_b.md"}
    every = walk.walked(spark, f"{tmp_path}/all", skip_underscore=False)
    assert {x["path"] for x in every.collect()} == found | {"_b.md"}
    assert {x["body"] for x in walk.stored_entries(every).where("path = 'a.md'").collect()} == {"body 0"}
    assert walk.walked(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        walk.walked(spark, "s3a://bucket/x")


def test_rules_of_reading(spark):
    good = "knowledge_id: abc\ndomain: d\nsubject: s"
    texts = {"good": f"---\n{good}\n---\nB\n", "no end of line": f"---\n{good}\n---", "inline": f"---{good}---B", "broken": "---\na: [\n---\n", "short id": f"---\n{good.replace('abc', 'ab')}\n---\n", "null": None, "empty": "", "no subject": "---\nknowledge_id: abc\ndomain: d\n---\n"}
    rows = spark.createDataFrame(list(texts.items()), "path string, text string")
    assert {(x["path"], x["body"]) for x in walk.stored_entries(rows).collect()} == {("good", "B")}
    assert {(x["path"], x["body"]) for x in walk.scanned_entries(rows).collect()} == {("good", "\nB\n"), ("no end of line", ""), ("inline", "B")}
    faults = {x["path"]: x["fault"] for x in walk.strict_faults(rows).collect()}
    assert faults == {"good": None, "no end of line": None, "inline": "unclosed", "broken": "yaml", "short id": None, "null": "empty", "empty": "empty", "no subject": None}


def test_entries_as_texts(spark):
    made = walk.entry_texts(spark.createDataFrame([("k-1", "d", "s", None, ["x", "y: z"], 2, None), ("k-2", "d", "s", "p", None, None, "---\nBody")], "kid string, domain string, subject string, project string, tags array<string>, version long, content string"))
    assert {x["path"] for x in made.collect()} == {"d/s/k-1.md", "d/s/p/k-2.md"}
    got = {x["meta"]["knowledge_id"]: (x["meta"]["tags"], x["meta"]["version"], x["meta"]["project"], x["body"]) for x in walk.stored_entries(made).collect()}
    assert got == {"k-1": (["x", "y: z"], 2, None, ""), "k-2": (None, None, "p", "---\nBody")}
