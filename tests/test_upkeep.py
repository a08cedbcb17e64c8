"""The guard with its list against a replay, and what is old, queued or not ready."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from quillstone.operators import serving as sv
from quillstone.operators import upkeep as uk

EVENT = "sig string, ts timestamp, seq long, source string, marker string, hint string, status int, actor string"


def replay(rows, listed, today):
    state, out = {}, {}
    for sig, ts, seq, source, marker, hint, status, actor in sorted(rows, key=lambda r: (r[1], r[2])):
        hard = hint == "traceback" or source in ("host", "health", "docker_events") or marker == "GUARD"
        if sig in listed and not hard and (not listed[sig] or listed[sig] >= today):
            out[seq] = ("listed", 0)
        elif hard or (actor and status is not None and 400 <= status < 500):
            out[seq] = ("immune", 0)
        else:
            s = state.setdefault(sig, {"minute": None, "n": 0, "held": 0})
            if s["minute"] != ts.replace(second=0):
                s["minute"], s["n"] = ts.replace(second=0), 0
            if s["n"] >= 5:
                s["held"] += 1
                out[seq] = ("capped", 0)
            else:
                s["n"] += 1
                out[seq] = ("passed", s["held"])
                s["held"] = 0
    return out


def test_guard_equals_a_replay(spark):
    r, start = random.Random(5), dt.datetime(2024, 1, 1)
    rows = [
        (r.choice("abcd"), start + dt.timedelta(seconds=r.randint(0, 600)), seq, r.choice(["svc", "svc", "svc", "svc", "host", None]), r.choice([None, None, None, None, "GUARD"]), r.choice([None, None, None, None, "traceback"]),
         r.choice([None, 404, 500]), r.choice([None, "", "u1"]))
        for seq in range(600)
    ]
    listed = {"b": "2024-01-01", "c": "2023-12-31", "d": ""}
    frames = spark.createDataFrame(rows, EVENT), spark.createDataFrame(list(listed.items()), "sig string, until string")
    got = {x["seq"]: (x["verdict"], x["carried"]) for x in uk.guarded(*frames, "2024-01-01").collect()}
    assert got == replay(rows, listed, "2024-01-01")
    assert {v for v, _ in got.values()} == {"listed", "immune", "passed", "capped"}
    assert uk.guarded(frames[0].limit(0), frames[1], "2024-01-01").count() == 0
    asked = spark.createDataFrame([("health|x", None), ("svc|health", None)], "sig string, until string")
    assert {x["sig"]: x["refused"] for x in uk.list_additions(asked).collect()} == {"health|x": True, "svc|health": False}


def test_old_days_are_dates_only(spark):
    names = ["2024-01-01", "2024-01-02", "2024-1-1", "2024-02-30", "notes", None, "2024-01-01.bak"]
    days = spark.createDataFrame([(n,) for n in names], "name string")
    now = F.lit("2024-04-01").cast("date")  # ninety days before: 2024-01-02
    assert {x["name"] for x in uk.old_days(days, now).collect()} == {"2024-01-01", "2024-1-1"}


def test_promotion(spark):
    e = spark.createDataFrame([("a", "d/Review-x/a.md"), ("b", None), ("c", "d/c.md")], "kid string, path string")
    i = spark.createDataFrame([("c", "sensitive", "open"), ("c", "sensitive", "open"), ("b", "sensitive", "resolved")], "kid string, type string, status string")
    got = {x["kid"]: (x["ready"], x["warnings"]) for x in uk.promotion_checklist(e, i, F.lit("public")).collect()}
    assert got == {"a": (False, ["file path contains 'review-': d/Review-x/a.md"]), "b": (True, []), "c": (False, ["2 open sensitive issue(s)"])}
    assert all(x["ready"] for x in uk.promotion_checklist(e, i, F.lit("private")).collect())


def test_queue_of_jobs(spark):
    calls = [("local", "c1", "", 3, False, "low", "batch"), ("local", "c2", "j", None, True, "high", "batch"), ("local", "c3", "j", 2, False, "med", "interactive"), ("x", "c4", "k", None, False, "low", "batch")]
    calls = spark.createDataFrame(calls, "shelf string, call string, job string, position long, starved boolean, prio string, class string")
    times = spark.createDataFrame([("local", 2.0, 5.0)], "shelf string, ema_s double, p95_s double")
    got = {x["job"]: tuple(x)[2:] for x in uk.queue_jobs(calls, times, spark.createDataFrame([("j", "low"), ("k", "?")], "job string, prio string")).collect()}
    assert got["c1"] == (3, 2, False, "low", "batch", 1, 4.0, 15.0, None, "account")
    assert got["j"] == (2, 1, True, "med", "interactive", 2, 2.0, 10.0, "low", "job")
    assert got["k"] == (None, None, False, "low", "batch", 1, None, None, "?", "account")
    shelves = uk.queue_shelves(calls, spark.createDataFrame([("x", 9)], "shelf string, depth long")).collect()
    assert {tuple(x) for x in shelves} == {("local", 3, "waiting", 3), ("ext", 0, "waiting", 0), ("x", 9, "posq", 1)}


def test_budget(spark):
    counters = spark.createDataFrame([(None, 100), (1, 60), (2, 40)], "user long, micro long")
    journal = spark.createDataFrame([("2024-01", 1, 30), ("2024-01", 3, 5), ("2024-01", None, 1), ("2023-12", 1, 999)], "month string, user long, micro long")
    rows = lambda most: {x["user"]: (x["before"], x["after"], x["refused"]) for x in uk.corrected_budget(counters, journal, "2024-01", most).collect()}
    want = {None: (100, 36, False), 1: (60, 30, False), 2: (40, 40, False), 3: (0, 5, False)}
    assert rows(None) == rows(64) == want
    assert rows(63) == {None: (100, 100, True), 1: (60, 60, True), 2: (40, 40, True), 3: (0, 0, True)}
    assert {tuple(x) for x in uk.corrected_budget(counters.limit(0), journal.limit(0), "2024-01", 0).collect()} == {(None, 0, 0, False)}


def test_cascades(spark):
    entries = [("book", None, "public", None), ("a", "book", "public", "draft"), ("b", "book", "private", None), ("a1", "a", "public", None), ("x", "gone", "public", "archived")]
    entries = spark.createDataFrame(entries, "kid string, parent string, zone string, status string")
    acts = [(1, "book", "deprecate", False), (2, "a", "restore", False), (3, "a", "deprecate", True), (4, "nobody", "deprecate", True), (5, "x", "ignore", True), (6, None, "restore", None)]
    acts = spark.createDataFrame(acts, "n long, kid string, action string, cascade boolean")
    got = {x["kid"]: (x["status"], x["reached"]) for x in uk.cascaded(entries, acts).collect()}
    assert got == {"book": ("deprecated", 1), "a": ("deprecated", 3), "b": (None, 0), "a1": ("deprecated", 1), "x": ("archived", 0)}
    assert {x["reached"] for x in uk.cascaded(entries, acts.limit(0)).collect()} == {0}


def test_views_of_entries(spark):
    entries = [
        ("k1", "public", 1, None, "collection", ["s1", "s1"], None), ("k2", "public", 2, "k1", None, None, "s2"), ("k3", "public", 1, "k1", None, ["s1", None, "s9"], "s2"), ("k4", "private", 1, "k1", None, None, None),
    ]
    entries = spark.createDataFrame(entries, "kid string, zone string, version long, parent string, content_type string, source_refs array<string>, source_id string")
    person = "array<struct<literal:string,family:string,given:string>>"
    s = spark.createDataFrame([("s1", "One"), ("s2", None)], "source_id string, title string").selectExpr(
        "*", f"cast(array(named_struct('literal', 'Org', 'family', null, 'given', null)) as {person}) as authors", "'2020' as year", "cast(null as string) as publisher", "cast(null as string) as url", "'public' as zone", "cast(null as string) as status",
        "true as public_allowed", "'own' as license", "'pdf' as format", "true as present", "false as promised", "true as `exists`", "true as has_original", "'normalize' as policy", "cast(null as string) as error", "true as blob_shown",
    )
    asked = spark.createDataFrame([("k1",), ("k2",), ("k3",), ("k4",), ("no",)], "kid string")
    got = {x["kid"]: tuple(x)[1:] for x in sv.entry_views(asked, entries, s, ("public",)).collect()}
    text = got["k1"][3]
    assert text and got["k1"] == (True, 1, 2, text, None, None)
    assert got["k2"] == (True, 2, 0, None, None, None)
    assert got["k3"][:5] == (True, 1, 0, None, None)
    assert json.loads(got["k3"][5]) == [{"source_id": "s1", "citation": text}, {"source_id": "s9"}]
    assert got["k4"] == got["no"] == (False, None, None, None, None, None)
