"""Queries of the rules over time, with their SQL; those without are tested against a replay in plain Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import overtime as ot
from quillstone.sources import tables as t
from quillstone.streaming import events as st
from quillstone.streaming import workers

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""WITH RECURSIVE p AS (SELECT event_id AS seq, 'b' || (event_id * 7 % 997) AS sha, event_id * 7 % 997 % 50 + 1 AS size FROM events),
    st AS (SELECT DISTINCT 'b' || (s_suppkey % 100) AS sha, s_suppkey % 100 % 50 + 1 AS size FROM supplier),
    f AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY first) AS i
        FROM (SELECT sha, min(seq) AS first, any_value(size) AS size FROM p WHERE sha NOT IN (SELECT sha FROM st) GROUP BY sha)),
    walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST((SELECT sum(size) FROM st) AS BIGINT) AS used, true AS ok
        UNION ALL SELECT f.i, CAST(CASE WHEN used + size <= 12000 THEN used + size ELSE used END AS BIGINT), used + size <= 12000 FROM walk JOIN f ON f.i = walk.i + 1)
    SELECT seq, p.sha, CASE WHEN first IS NULL THEN 'known' WHEN NOT ok THEN 'refused' WHEN seq = first THEN 'stored' ELSE 'known' END AS outcome
    FROM p LEFT JOIN f USING (sha) LEFT JOIN walk USING (i)""")
def blob_put(spark, sf_dir) -> DataFrame:
    n = F.col("event_id")
    key = n * 7 % 997
    puts = t.table(spark, sf_dir, "events").select(n.alias("seq"), F.concat(F.lit("b"), key.cast("string")).alias("sha"), (key % 50 + 1).alias("size"))
    s = F.col("s_suppkey") % 100
    stored = t.table(spark, sf_dir, "supplier").select(F.concat(F.lit("b"), s.cast("string")).alias("sha"), (s % 50 + 1).alias("size")).distinct()
    return ot.put_blobs(puts, stored, 12_000)


ATTEMPTS = """a AS (SELECT 'u' || user_id AS key, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS at_s, event_id % 4 = 0 AS ok, event_type AS error FROM events),
    g AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS run FROM a),
    n AS (SELECT *, (row_number() OVER (PARTITION BY key, run ORDER BY seq) - 1) % 3 + 1 AS retries FROM g WHERE NOT ok),
    log AS (SELECT key, seq, retries, CASE WHEN retries < 3 THEN 'retry' ELSE 'dead' END AS action, CASE retries WHEN 1 THEN at_s + 1 WHEN 2 THEN at_s + 4 END AS due, error FROM n)"""


def attempts(spark, sf_dir) -> DataFrame:
    n = F.col("event_id")
    return t.table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), n.alias("seq"), F.unix_timestamp("ts").alias("at"), (n % 4 == 0).alias("ok"), F.col("event_type").alias("error")
    )


@query(f"WITH {ATTEMPTS} SELECT key, seq, retries, action, due FROM log")
def retry_log(spark, sf_dir) -> DataFrame:
    return ot.retry_log(attempts(spark, sf_dir)).drop("error")


@query(f"WITH {ATTEMPTS}, d AS (SELECT key, max(seq) AS seq, arg_max(error, seq) AS error FROM log WHERE action = 'dead' GROUP BY key) SELECT key, seq, error, CAST(key[2:] AS BIGINT) % 3 <> 0 AS replayed FROM d")
def dead_letters(spark, sf_dir) -> DataFrame:
    """Every dead key, and whether a replay indexes it again: entries of users whose number 3 divides are gone."""
    dead = ot.dead_letters(ot.retry_log(attempts(spark, sf_dir)))
    entries = t.table(spark, sf_dir, "events").where("user_id % 3 <> 0").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"))
    return dead.select("key", "seq", "error").join(ot.replayed(dead, entries), "key")


@query(f"WITH {ATTEMPTS}, d AS (SELECT count(DISTINCT key) AS n FROM log WHERE action = 'dead') SELECT n AS size, CASE WHEN n > 10 THEN 'DLQ size ' || n || ' > threshold 10' END AS alert FROM d")
def dead_letter_alert(spark, sf_dir) -> DataFrame:
    return ot.dead_alert(ot.dead_letters(ot.retry_log(attempts(spark, sf_dir))))


@query(f"WITH {ATTEMPTS} SELECT key, seq, retries, action, due FROM log WHERE action = 'dead' OR due <= (SELECT max(at_s) - 60 FROM a)")
def stream_retries(spark, sf_dir) -> DataFrame:
    """The log as a stream. Waits that end in its last minute may still be pending."""
    n = F.col("event_id")
    rows = st.read_events(spark, sf_dir).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), n.alias("seq"), "ts", (n % 4 == 0).alias("ok"), F.col("event_type").alias("error")
    )
    out = st.run(workers.index_worker(rows), "append").drop("batch", "error")
    end = t.table(spark, sf_dir, "events").agg((F.max(F.unix_timestamp("ts")) - 60).alias("end"))
    return out.join(F.broadcast(end)).where("action = 'dead' or due <= end").drop("end")  # one row


SILENT = """e AS (SELECT 'src' || user_id % 40 AS source, CAST(floor(epoch(ts)) AS BIGINT) AS at_s FROM events WHERE event_id % 5 = 0),
    z AS (SELECT max(CAST(floor(epoch(ts)) AS BIGINT)) AS until FROM events),
    g AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY last) AS i
        FROM (SELECT source, at_s AS last, coalesce(lead(at_s) OVER (PARTITION BY source ORDER BY at_s), until) AS next FROM e, z) WHERE next - last > 1800),
    w AS (SELECT source, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS last, CAST(-1 AS BIGINT) AS first, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS rest FROM (SELECT DISTINCT source FROM g)
        UNION ALL SELECT source, x.i, x.last, first, n, CASE WHEN n > 0 THEN first + n * 7200 ELSE rest END
        FROM (SELECT g.source, g.i, g.last, greatest(g.last + 1801, w.rest) AS first, w.rest, greatest(0, CAST(floor((g.next - greatest(g.last + 1801, w.rest)) / 7200) AS BIGINT) + 1) AS n FROM w JOIN g ON g.source = w.source AND g.i = w.i + 1) x)"""


@query(f"WITH RECURSIVE {SILENT} SELECT source, last, first + k * 7200 AS \"at\" FROM (SELECT *, unnest(range(0, n)) AS k FROM w WHERE i > 0)")
def silence_alerts(spark, sf_dir) -> DataFrame:
    e = t.table(spark, sf_dir, "events")
    until = e.agg(F.max(F.unix_timestamp("ts"))).first()[0]
    source = F.concat(F.lit("src"), (F.col("user_id") % 40).cast("string"))
    return ot.silence_alerts(e.where("event_id % 5 = 0").select(source.alias("source"), F.unix_timestamp("ts").alias("at")), int(until or 0))


@query(f"WITH RECURSIVE {SILENT} SELECT source, last, first + k * 7200 AS \"at\" FROM (SELECT *, unnest(range(0, n)) AS k FROM w WHERE i > 0), z WHERE first + k * 7200 <= until - 60")
def stream_silence_alerts(spark, sf_dir) -> DataFrame:
    source = F.concat(F.lit("src"), (F.col("user_id") % 40).cast("string"))
    rows = st.read_events(spark, sf_dir).select(F.when(F.col("event_id") % 5 == 0, source).otherwise("clock").alias("source"), "ts")
    end = t.table(spark, sf_dir, "events").agg((F.max(F.unix_timestamp("ts")) - 60).alias("end"))
    out = st.run(workers.silent_sources(rows), "append").drop("batch").where("source <> 'clock'")
    return out.join(F.broadcast(end)).where("at <= end").drop("end")  # one row


def incidents(spark, sf_dir) -> DataFrame:
    n = F.col("event_id")
    kind = F.when(n % 3 == 0, "new_p0").otherwise("burst")
    return t.table(spark, sf_dir, "events").select(F.concat(F.lit("s"), (F.col("user_id") % 50).cast("string")).alias("sig"), kind.alias("kind"), F.unix_timestamp("ts").alias("ts"))


@query(None)
def sent_alerts(spark, sf_dir) -> DataFrame:
    return ot.sent_alerts(incidents(spark, sf_dir))


def ticks(rows: DataFrame) -> DataFrame:
    n = F.col("event_id")
    outcome = F.when(n % 7 == 0, "crash").when(n % 3 == 0, "spooled").otherwise("sent")
    return rows.select(F.concat(F.lit("h"), (F.col("user_id") % 9).cast("string")).alias("host"), n.alias("seq"), F.col("ts").cast("timestamp").alias("ts"), outcome.alias("outcome"), (n % 2 == 0).alias("flushed"))


_TICKS = """k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY host ORDER BY now, seq) AS i FROM (
        SELECT 'h' || user_id % 9 AS host, event_id AS seq, strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d') AS day, CAST(floor(epoch(ts)) AS BIGINT) AS now,
            CASE WHEN event_id % 7 = 0 THEN 'crash' WHEN event_id % 3 = 0 THEN 'spooled' ELSE 'sent' END AS outcome, event_id % 2 = 0 AS flushed FROM events WHERE hour(ts + INTERVAL 3 HOUR) >= 10)),
    w AS (SELECT host, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS seq, '' AS day, '' AS last, '' AS attempt, '' AS spooled, CAST(0 AS BIGINT) AS rest, '' AS action FROM (SELECT DISTINCT host FROM k)
        UNION ALL SELECT host, i, seq, day, CASE WHEN act IN ('sent', 'flushed', 'assumed') THEN day ELSE last END, CASE WHEN act <> '' THEN day ELSE attempt END,
            CASE WHEN act = 'spooled' THEN day WHEN act IN ('crash', 'sent') THEN '' ELSE spooled END,
            CASE WHEN act IN ('spooled', 'waits') THEN now + 3600 WHEN act IN ('sent', 'flushed', 'assumed') THEN 0 ELSE rest END, act
        FROM (SELECT k.*, w.last, w.attempt, w.spooled, w.rest, CASE WHEN w.last = k.day OR w.rest > k.now THEN '' WHEN w.attempt <> k.day THEN k.outcome
            WHEN w.spooled = k.day THEN CASE WHEN k.flushed THEN 'flushed' ELSE 'waits' END ELSE 'assumed' END AS act FROM w JOIN k ON k.host = w.host AND k.i = w.i + 1))"""


@query(f"WITH RECURSIVE {_TICKS} SELECT host, seq, day, action FROM w WHERE action <> ''")
def digest_actions(spark, sf_dir) -> DataFrame:
    return ot.digest_actions(ticks(t.table(spark, sf_dir, "events")), "Europe/Moscow")


@query(f"WITH RECURSIVE {_TICKS} SELECT host, seq, day, action FROM w WHERE action <> ''")
def stream_digests(spark, sf_dir) -> DataFrame:
    return st.run(workers.digests(ticks(st.read_events(spark, sf_dir)), "Europe/Moscow"), "append").drop("batch")
