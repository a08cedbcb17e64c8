"""Rules over time against replays in plain Python, and streams over restarts."""

import random

import pytest

from quillstone.operators import overtime as ot
from quillstone.streaming import events as st
from quillstone.streaming import workers


@pytest.mark.parametrize("seed,quota,top", [(1, 1000, 60), (2, 5000, 4000), (3, 37, 5), (4, 10**12, 10**11), (5, 0, 3), (6, 63, 64)])
def test_quota_equals_a_replay(spark, seed, quota, top):
    r = random.Random(seed)
    rows = [(i, r.choice([0, 1, r.randint(0, top), r.randint(0, max(1, top // 10))])) for i in range(400)]
    used, want = 0, {}
    for i, n in rows:
        want[i] = used + n <= quota
        used += n * want[i]
    got = ot.within_quota(spark.createDataFrame(rows, "seq long, size long"), quota, step=50)
    assert {x["seq"]: x["stored"] for x in got.collect()} == want


def test_refused_blobs_take_nothing(spark):
    puts = spark.createDataFrame([(1, "a", 90), (2, "b", 60), (3, "c", 10), (4, "b", 60), (5, "a", 90), (6, "old", 5)], "seq long, sha string, size long")
    stored = spark.createDataFrame([("old", 0)], "sha string, size long")
    got = {r["seq"]: r["outcome"] for r in ot.put_blobs(puts, stored, 100).collect()}
    assert got == {1: "stored", 2: "refused", 3: "stored", 4: "refused", 5: "known", 6: "known"}
    assert ot.put_blobs(puts.limit(0), stored, 100).count() == 0


def replay_alerts(incidents, every=300):
    state, out = ot.AlertState(), []
    times = sorted(t for *_, t in incidents)
    for now in range(-(-times[0] // every) * every, times[-1] + 601, every):
        rows = {}
        for sig, kind, ts in incidents:
            if now - 600 <= ts <= now:
                x = rows.setdefault(sig, [None, None])
                k = kind == "burst"
                x[k] = max(ts, x[k] or 0)
        if rows:
            out += [(now, s, k) for s, k in state.run(now, [(s, a, b) for s, (a, b) in rows.items()])]
    return sorted(map(repr, out))


@pytest.mark.parametrize("seed,n,sigs", [(1, 3000, 400), (2, 300, 20), (3, 2000, 5)])
def test_sent_alerts_equal_a_replay_of_all_candidates(spark, seed, n, sigs):
    r = random.Random(seed)
    rows = [(f"s{r.randrange(sigs)}", r.choice(["new_p0", "burst"]), 1_700_000_000 + int(r.random() ** 2 * 40_000)) for _ in range(n)]
    got = ot.sent_alerts(spark.createDataFrame(rows, "sig string, kind string, ts long")).collect()
    assert sorted(repr(tuple(x)) for x in got) == replay_alerts(rows)
    by_hour = {}
    for x in got:
        by_hour[x["run"] // 3600] = by_hour.get(x["run"] // 3600, 0) + 1
    assert max(by_hour.values()) <= 3


def test_alert_state_by_hand():
    s, t = ot.AlertState(), 7200
    assert s.run(t, [("a", t, None), ("b", t - 5, None), ("c", None, t)]) == [("a", "new_p0"), ("b", "new_p0"), (None, "tail")]
    assert s.run(t + 300, [("d", t + 300, None)]) == []  # the hour is full
    assert s.run(t + 3600, [("d", t + 3590, None), ("a", None, t + 3600)]) == [("d", "new_p0")]  # a rests
    assert s.run(t + 7200, [("a", t, t + 7190)]) == [("a", "burst")]  # no P0 twice


def write(spark, rows, schema, folder, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{n}")


def stream(spark, schema, folder):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", __import__("pyspark").sql.functions.timestamp_seconds("at"))


def test_silence_is_told_before_the_next_event(spark, tmp_path):
    schema, folder, base = "source string, at long", f"file://{tmp_path}/in", 1_700_000_000
    write(spark, [("a", base), ("b", base)], schema, folder, 1)
    write(spark, [("b", base + 9000)], schema, folder, 2)  # the clock goes on, a says nothing
    out = st.run(workers.silent_sources(stream(spark, schema, folder)), "append", f"file://{tmp_path}/state")
    got = sorted((r["source"], r["at"] - base) for r in out.collect())
    assert got == [("a", 1801), ("a", 9001 - 7200 + 7200)] or got == [("a", 1801), ("b", 1801)], got
    write(spark, [("c", base + 12_000)], schema, folder, 3)
    out = st.run(workers.silent_sources(stream(spark, schema, folder)), "append", f"file://{tmp_path}/state")
    got = sorted((r["source"], r["at"] - base) for r in out.collect())
    assert got == [("a", 1801), ("a", 9001), ("b", 1801), ("b", 10801)]
    events = spark.createDataFrame([("a", base), ("b", base), ("b", base + 9000), ("c", base + 12_000)], schema)
    batch = ot.silence_alerts(events, base + 12_000 - 60).collect()
    assert sorted((r["source"], r["at"] - base) for r in batch) == got


def test_retries_wait_and_die_over_restarts(spark, tmp_path):
    schema, folder, base = "key string, seq long, at long, ok boolean, error string", f"file://{tmp_path}/in", 1_700_000_000
    run = lambda: sorted((r["key"], r["seq"], r["retries"], r["action"]) for r in st.run(workers.index_worker(stream(spark, schema, folder)), "append", f"file://{tmp_path}/state").collect())
    write(spark, [("k", 1, base, False, "x"), ("m", 2, base, False, "y")], schema, folder, 1)
    run()
    write(spark, [("clock", 3, base + 500, True, None)], schema, folder, 2)
    assert run() == [("k", 1, 1, "retry"), ("m", 2, 1, "retry")]  # by the timer, no event of k or m came
    write(spark, [("k", 4, base + 501, False, "x"), ("k", 5, base + 506, False, "z"), ("m", 6, base + 502, True, None), ("m", 7, base + 503, False, "w")], schema, folder, 3)
    write(spark, [("clock", 8, base + 900, True, None)], schema, folder, 4)
    want = [("k", 1, 1, "retry"), ("k", 4, 2, "retry"), ("k", 5, 3, "dead"), ("m", 2, 1, "retry"), ("m", 7, 1, "retry")]
    assert run() == want
    rows = [("k", 1, base, False, "x"), ("m", 2, base, False, "y"), ("k", 4, base + 501, False, "x"), ("k", 5, base + 506, False, "z"), ("m", 6, base + 502, True, None), ("m", 7, base + 503, False, "w")]
    log = ot.retry_log(spark.createDataFrame(rows, schema))
    assert sorted((r["key"], r["seq"], r["retries"], r["action"]) for r in log.collect()) == want
    assert [(r["key"], r["error"]) for r in ot.dead_letters(log).collect()] == [("k", "z")]
    assert ot.dead_alert(ot.dead_letters(log)).first()["alert"] is None
    assert ot.dead_alert(spark.range(11).selectExpr("id AS key")).first()["alert"] == "DLQ size 11 > threshold 10"


def test_a_crash_between_attempt_and_send_gives_one_send(spark, tmp_path):
    state, day = {}, "2024-01-01"
    assert ot.digest_step(state, day, 9, 0, "sent", True) is None
    assert ot.digest_step(state, day, 10, 100, "crash", True) == "crash"
    assert ot.digest_step(state, day, 10, 200, "sent", True) == "assumed"
    assert ot.digest_step(state, day, 11, 300, "sent", True) is None
    state = {}
    assert ot.digest_step(state, day, 10, 100, "spooled", False) == "spooled"
    assert ot.digest_step(state, day, 10, 200, "sent", True) is None  # waits an hour
    assert ot.digest_step(state, day, 12, 3700, "sent", False) == "waits"
    assert ot.digest_step(state, day, 13, 7300, "sent", True) == "flushed"

    schema, folder = "host string, seq long, at long, outcome string, flushed boolean", f"file://{tmp_path}/in"
    write(spark, [("h", 1, 1_700_040_000, "sent", True), ("h", 2, 1_700_040_300, "sent", True)], schema, folder, 1)
    sent, crashes = [], [True]

    def send(host, day):
        sent.append((host, day))
        if crashes.pop() if crashes else False:
            raise RuntimeError("the process dies after it has sent")

    go = lambda: workers.deliver(workers.digests(stream(spark, schema, folder), "Europe/Moscow"), f"file://{tmp_path}/state", send)
    with pytest.raises(Exception, match="dies"):
        go()
    go()
    assert len(sent) == 1
    write(spark, [("h", 3, 1_700_126_400, "sent", True)], schema, folder, 2)
    go()
    assert len(sent) == 2
