"""Queries that run a stream over the events table to its end, with the batch SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.plans.sql import EVENTS
from quillstone.sources import tail
from quillstone.sources.shared import scratch_folder
from quillstone.sources.tables import table
from quillstone.streaming import events as st

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


@query("SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY ALL")
def stream_daily(spark, sf_dir) -> DataFrame:
    out = st.run(st.daily(st.read_events(spark, sf_dir)), "update")
    return out.groupBy("event_type", "day").agg(F.max_by("n", "batch").alias("n"))


@query("SELECT event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, count(*) AS n FROM events WHERE date_trunc('hour', ts) < (SELECT date_trunc('hour', max(ts) - INTERVAL 1 HOUR) FROM events) GROUP BY ALL")
def stream_hourly(spark, sf_dir) -> DataFrame:
    """Only hours that the watermark has closed."""
    out = st.run(st.hourly_windows(st.read_events(spark, sf_dir)), "append")
    return out.select("event_type", F.unix_timestamp("start").alias("start"), "n")


@query("SELECT event_id, event_type FROM events")
def stream_dedup(spark, sf_dir) -> DataFrame:
    events = st.read_events(spark, sf_dir)
    twice = events.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    return st.run(st.deduplicated(twice).select("event_id", "event_type"), "append").drop("batch")


@query("""WITH e AS (SELECT event_id AS seq, event_type AS sig, event_id % 13 = 0 AS immune, date_trunc('hour', ts) AS m FROM events),
    a AS (SELECT *, immune OR row_number() OVER (PARTITION BY sig, immune, m ORDER BY seq) <= 5 AS allowed FROM e),
    h AS (SELECT *, sum(CASE WHEN allowed THEN 0 ELSE 1 END) OVER (PARTITION BY sig, immune ORDER BY m, seq ROWS UNBOUNDED PRECEDING) AS held FROM a)
    SELECT seq, sig, allowed, CAST(CASE WHEN allowed AND NOT immune THEN held - coalesce(last_value(CASE WHEN allowed THEN held END IGNORE NULLS)
        OVER (PARTITION BY sig, immune ORDER BY m, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE 0 END AS BIGINT) AS carried FROM h""")
def stream_guard(spark, sf_dir) -> DataFrame:
    """Per event type, with an hour for a minute so that the cap bites."""
    hour = F.expr("unix_timestamp(ts) div 3600")
    rows = st.read_events(spark, sf_dir).select(F.col("event_type").alias("sig"), F.col("event_id").alias("seq"), hour.alias("minute"), (F.col("event_id") % 13 == 0).alias("immune"))
    return st.run(st.guard(rows), "append").drop("batch")


@query("""WITH l AS (SELECT 'svc' || user_id % 5 AS source, CAST(floor(epoch(ts)) AS BIGINT) AS after, event_id FROM events), g AS (SELECT source, lag(after) OVER (PARTITION BY source ORDER BY after, event_id) AS before, after FROM l)
    SELECT source, before, after FROM g WHERE after - before > 1800""")
def stream_silences(spark, sf_dir) -> DataFrame:
    source = F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string"))
    rows = st.read_events(spark, sf_dir).select(source.alias("source"), F.unix_timestamp("ts").alias("at"))
    return st.run(st.silences(rows), "append").drop("batch")


@query(f"""WITH RECURSIVE {EVENTS}, c AS (SELECT event_type AS sig, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) // 3600 AS cycle, count(*) AS k FROM error_events GROUP BY ALL),
    m AS (SELECT sig, cycle, k * CASE WHEN cycle % 97 = 0 THEN 61 ELSE 1 END AS n FROM c), a AS (SELECT *, avg(n) OVER (PARTITION BY sig ORDER BY cycle ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS mean FROM m),
    h AS MATERIALIZED (SELECT sig, cycle, n, n >= 50 OR coalesce(mean >= 1 AND n >= 10 * mean, false) AS hit, row_number() OVER (PARTITION BY sig ORDER BY cycle) AS i, count(*) OVER (PARTITION BY sig) AS total FROM a),
    s AS (SELECT sig, cycle, n, i, total, CASE WHEN hit THEN 'fired' ELSE 'armed' END AS state, CASE WHEN hit THEN 0 ELSE -1 END AS since FROM h WHERE i = 1
      UNION ALL SELECT h.sig, h.cycle, h.n, h.i, h.total, CASE WHEN s.state IN ('fired', 'held') THEN CASE WHEN hit THEN 'held' ELSE 're-armed' END WHEN hit AND (since < 0 OR since >= 24) THEN 'fired' WHEN hit THEN 'held' ELSE s.state END,
        CASE WHEN s.state NOT IN ('fired', 'held') AND hit AND (since < 0 OR since >= 24) THEN 0 WHEN since < 0 THEN -1 ELSE since + 1 END FROM s JOIN h ON h.sig = s.sig AND h.i = s.i + 1)
    SELECT sig, cycle, n, state FROM s WHERE i < total""")
def stream_bursts(spark, sf_dir) -> DataFrame:
    """All cycles but the last of each type, which is still open; every 97th hour is a storm."""
    cycle = F.expr("unix_timestamp(ts) div 3600")
    rows = st.read_events(spark, sf_dir).select(F.col("event_type").alias("sig"), cycle.alias("cycle"))
    storm = F.explode(F.array_repeat(F.lit(0), F.when(F.col("cycle") % 97 == 0, 61).otherwise(1)))
    return st.run(st.bursts(rows.withColumn("again", storm).drop("again")), "append").drop("batch")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def stream_raw_sink(spark, sf_dir) -> DataFrame:
    out = st.raw_sink(st.read_events(spark, sf_dir), scratch_folder(spark, "raw"))
    return out.groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT event_id || ' ' || event_type AS line FROM events")
def tailed_lines(spark, sf_dir) -> DataFrame:
    """Log files written from the events in two rounds, each followed by a run that goes on at the last offsets."""
    folder = scratch_folder(spark, "logs")
    spark.dataSource.register(tail.TailedLines)
    lines = table(spark, sf_dir, "events").select("event_id", F.concat(F.col("event_id").cast("string"), F.lit(" "), "event_type").alias("line"))
    for k in range(2):
        lines.where(F.col("event_id") % 2 == k).select("line").write.text(f"{folder}/logs/{k}")
        stream = spark.readStream.format("tailed_lines").option("pattern", f"{folder.removeprefix('file://')}/logs/*/part-*").load()
        out = st.run(stream, "append", f"{folder}/state")
    return out.select("line")
