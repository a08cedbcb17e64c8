"""Queries over error events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import score as sc
from quillstone.functions import text as tx
from quillstone.operators import events as ev
from quillstone.plans.sql import EVENTS
from quillstone.sources import tables as t

QUERIES, ORACLE = {}, {}
TODAY = "2024-01-30"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def now(text: str = "2024-01-30 12:00:00"):
    return F.lit(text).cast("timestamp")


def today():
    return F.lit(TODAY).cast("date")


E = f"WITH {EVENTS}"


@query(f"""{E} SELECT sig, count(*) AS count_total, CAST(epoch(date_trunc('second', min(ts))) AS BIGINT) AS first_seen, CAST(epoch(date_trunc('second', max(ts))) AS BIGINT) AS last_seen,
    count(DISTINCT actor) AS n_actors, count(DISTINCT source) AS n_sources, arg_max(message, (ts, seq)) AS last_example FROM error_events GROUP BY sig""")
def signature_counts(spark, sf_dir) -> DataFrame:
    out = ev.signature_counts(t.error_events(spark, sf_dir))
    return out.withColumns({"first_seen": F.unix_timestamp("first_seen"), "last_seen": F.unix_timestamp("last_seen")})


@query(f"""{E}, r AS (SELECT sig, actor, row_number() OVER (PARTITION BY sig ORDER BY actor) AS rn FROM (SELECT DISTINCT sig, actor FROM error_events WHERE actor IS NOT NULL))
    SELECT sig, string_agg(actor, ',' ORDER BY actor) AS actors FROM r WHERE rn <= 50 GROUP BY sig""")
def signature_actors(spark, sf_dir) -> DataFrame:
    return ev.first_values(t.error_events(spark, sf_dir), "actor", 50)


@query(f"""{E} SELECT source || '|' || coalesce(marker, '-') || '|' || n AS signature, count(*) AS events FROM (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(message,
    '(^|[^\\w./-])/(?:[\\w.-]+/)*[\\w.-]+', '\\1<path>', 'g'), '\\b(?:\\d+(?:\\.\\d+)?\\s?(?:ns|us|ms|s|m|h))+\\b', '<dur>', 'g'), '\\b\\d+\\b', '<n>', 'g'), '\\s+', ' ', 'g')) AS n FROM error_events) GROUP BY 1""")
def deep_signatures(spark, sf_dir) -> DataFrame:
    e = t.error_events(spark, sf_dir)
    return e.groupBy(tx.signature(F.col("source"), F.col("marker"), F.lit(None).cast("string"), F.col("message")).alias("signature")).agg(F.count(F.lit(1)).alias("events"))


@query(f"{E} SELECT sig, CAST(day AS VARCHAR) AS day, count(*) AS n FROM error_events GROUP BY ALL")
def signature_daily(spark, sf_dir) -> DataFrame:
    return ev.daily(t.error_events(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


WEEKS = f"""w AS (SELECT sig, count(*) FILTER (date_diff('day', day, DATE '{TODAY}') <= 7) AS count_7d,
    count(*) FILTER (date_diff('day', day, DATE '{TODAY}') > 7 AND date_diff('day', day, DATE '{TODAY}') <= 14) AS count_prev_7d FROM error_events GROUP BY sig)"""


def weeks(spark, sf_dir) -> DataFrame:
    return ev.week_counts(ev.daily(t.error_events(spark, sf_dir)), today())


@query(f"{E}, {WEEKS} SELECT *, CASE WHEN count_prev_7d = 0 THEN NULL WHEN count_7d > count_prev_7d THEN 'up' WHEN count_7d < count_prev_7d THEN 'down' ELSE 'flat' END AS trend FROM w")
def week_trend(spark, sf_dir) -> DataFrame:
    return weeks(spark, sf_dir).withColumn("trend", sc.trend(F.col("count_7d"), F.col("count_prev_7d")))


def _hist(key: str, keep: int, other: str) -> str:
    return f"""{E}, c AS (SELECT sig, {key} AS key, count(*) AS n FROM error_events GROUP BY ALL),
    r AS (SELECT sig, n, CASE WHEN row_number() OVER (PARTITION BY sig ORDER BY n DESC, key) <= {keep} THEN key ELSE '{other}' END AS key FROM c) SELECT sig, key, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY ALL"""


@query(_hist("CASE WHEN exit_code = 11 THEN '__unknown__' ELSE CAST(exit_code AS VARCHAR) END", 8, "__other__"))
def exit_hist(spark, sf_dir) -> DataFrame:
    return ev.histogram(t.error_events(spark, sf_dir), F.when(F.col("exit_code") == 11, "__unknown__").otherwise(F.col("exit_code").cast("string")), 8, "__other__")


@query(_hist("'/items/' || CAST(k AS VARCHAR)", 20, "__others__"))
def endpoint_hist(spark, sf_dir) -> DataFrame:
    return ev.histogram(t.error_events(spark, sf_dir), F.concat(F.lit("/items/"), F.col("k").cast("string")), 20, "__others__")


P0 = "('" + "', '".join(ev.P0_HINTS) + "')"
LADDER = f"""{WEEKS}, f AS (SELECT sig, bool_or(coalesce(hint IN {P0}, false) AND NOT expected) AS p0, bool_or(hint = 'slow') AS slow, bool_or(hint = 'burst_routine') AS calm, bool_or(hint IN ('burst', 'watchdog_silent')) AS loud, bool_and(expected) AS routine, count(DISTINCT actor) AS actors,
    bool_and(coalesce(status IN (401, 403, 404, 429) AND actor IS NULL, false) OR coalesce(marker = 'HEALTH', false) OR contains(message, '[AUTH]')) AS baseline
    FROM (SELECT * REPLACE (CASE WHEN seq % 40 = 0 AND k % 10 IN (1, 3, 5, 7) THEN ['slow', 'burst_routine', 'burst', 'watchdog_silent'][k % 10 // 2 + 1] ELSE hint END AS hint) FROM error_events WHERE day >= DATE '2024-01-29') GROUP BY sig),
    ladder AS (SELECT sig, CASE WHEN p0 THEN 'P0' WHEN slow THEN 'P1' WHEN calm THEN 'P2' WHEN loud THEN 'P1' WHEN routine THEN 'P3' WHEN actors >= 2 OR coalesce(count_prev_7d > 0 AND count_7d > count_prev_7d, false) THEN 'P1' WHEN baseline THEN 'P3' ELSE 'P2' END AS priority,
    CASE WHEN p0 THEN 'T' WHEN slow THEN 'U' WHEN calm OR loud OR routine THEN 'T' WHEN actors >= 2 OR coalesce(count_prev_7d > 0 AND count_7d > count_prev_7d, false) THEN CASE WHEN actors > 0 THEN 'U' ELSE 'T' END WHEN baseline THEN 'T' WHEN actors > 0 THEN 'U' ELSE 'T' END AS class FROM f LEFT JOIN w USING (sig))"""


def ladder(spark, sf_dir) -> DataFrame:
    """Every 40th event of some signatures is slow, of a burst, or of a silent watchdog."""
    k = F.col("k") % 10
    planted = F.when(k == 1, "slow").when(k == 3, "burst_routine").when(k == 5, "burst").when(k == 7, "watchdog_silent").otherwise(F.col("hint"))
    e = t.error_events(spark, sf_dir).where("day >= date'2024-01-29'").withColumn("hint", F.when(F.col("seq") % 40 == 0, planted).otherwise(F.col("hint")))
    return ev.priority_ladder(e, weeks(spark, sf_dir))


@query(f"{E}, {LADDER} SELECT * FROM ladder")
def priority_ladder(spark, sf_dir) -> DataFrame:
    return ladder(spark, sf_dir)


GUARD = """g0 AS (SELECT sig2 AS sig, ts, seq, immune, immune OR row_number() OVER (PARTITION BY sig2, immune, date_trunc('minute', mts) ORDER BY ts, seq) <= 5 AS allowed
    FROM (SELECT *, event_type AS sig2, coalesce(hint = 'oom', false) AS immune, date_trunc('hour', ts) AS mts FROM error_events)),
    g1 AS (SELECT *, sum(CASE WHEN allowed THEN 0 ELSE 1 END) OVER (PARTITION BY sig, immune ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS held FROM g0),
    g AS (SELECT seq, sig, allowed, CAST(CASE WHEN allowed AND NOT immune THEN held - coalesce(last_value(CASE WHEN allowed THEN held END IGNORE NULLS) OVER (PARTITION BY sig, immune ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE 0 END AS BIGINT) AS carried FROM g1)"""


def guarded(spark, sf_dir) -> DataFrame:
    """By event type, with times cut to the hour so that the cap of a minute bites."""
    e = t.error_events(spark, sf_dir).select("seq", F.col("event_type").alias("sig"), F.date_trunc("hour", "ts").alias("ts"), F.coalesce(F.col("hint") == "oom", F.lit(False)).alias("immune"))
    return ev.guard(e)


GUARD = GUARD.replace("SELECT sig2 AS sig, ts, seq", "SELECT sig2 AS sig, mts AS ts, seq").replace("ORDER BY ts, seq) <= 5", "ORDER BY mts, seq) <= 5")


@query(f"{E}, {GUARD} SELECT seq, sig FROM g WHERE allowed")
def minute_cap(spark, sf_dir) -> DataFrame:
    return guarded(spark, sf_dir).where("allowed").select("seq", "sig")


@query(f"{E}, {GUARD} SELECT seq, sig, carried FROM g WHERE carried > 0")
def suppression_carry(spark, sf_dir) -> DataFrame:
    return guarded(spark, sf_dir).where("carried > 0").select("seq", "sig", "carried")


CYCLES = """c AS (SELECT sig, cycle, n + CASE WHEN cycle // 3600 % 97 = 0 THEN 60 ELSE 0 END AS n
    FROM (SELECT event_type AS sig, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS cycle, count(*) AS n FROM error_events GROUP BY ALL))"""
MEANS = f"{CYCLES}, m AS (SELECT *, avg(n) OVER (PARTITION BY sig ORDER BY cycle ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS mean FROM c)"


def cycles(spark, sf_dir) -> DataFrame:
    hour = F.unix_timestamp(F.date_trunc("hour", "ts"))
    c = t.error_events(spark, sf_dir).groupBy(F.col("event_type").alias("sig"), hour.alias("cycle")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("n", F.col("n") + F.when(F.expr("cycle div 3600 % 97 = 0"), 60).otherwise(0))


@query(f"{E}, {MEANS} SELECT sig, cycle, n, round(mean, 6) AS mean_before, n >= 50 OR coalesce(mean >= 1 AND n >= 10 * mean, false) AS hit FROM m")
def burst_mean(spark, sf_dir) -> DataFrame:
    return ev.burst_means(cycles(spark, sf_dir)).withColumn("mean_before", F.round("mean_before", 6))


@query(f"""WITH RECURSIVE {EVENTS}, {MEANS}, h AS MATERIALIZED (SELECT sig, cycle, n, n >= 50 OR coalesce(mean >= 1 AND n >= 10 * mean, false) AS hit, row_number() OVER (PARTITION BY sig ORDER BY cycle) AS i FROM m),
    s AS (SELECT sig, cycle, n, i, CASE WHEN hit THEN 'fired' ELSE 'armed' END AS state, CASE WHEN hit THEN 0 ELSE -1 END AS since FROM h WHERE i = 1
      UNION ALL SELECT h.sig, h.cycle, h.n, h.i, CASE WHEN s.state IN ('fired', 'held') THEN CASE WHEN hit THEN 'held' ELSE 're-armed' END WHEN hit AND (since < 0 OR since >= 24) THEN 'fired' WHEN hit THEN 'held' ELSE s.state END,
        CASE WHEN s.state NOT IN ('fired', 'held') AND hit AND (since < 0 OR since >= 24) THEN 0 WHEN since < 0 THEN -1 ELSE since + 1 END FROM s JOIN h ON h.sig = s.sig AND h.i = s.i + 1)
    SELECT sig, cycle, n, state FROM s""")
def burst_fsm(spark, sf_dir) -> DataFrame:
    return ev.burst_states(cycles(spark, sf_dir))


@query(f"""{E}, b AS (SELECT *, 'tool' || CAST(k * 10 + seq % 10 AS VARCHAR) AS tool FROM error_events WHERE ts > TIMESTAMP '2024-01-29 12:00:00' AND ts <= TIMESTAMP '2024-01-30 12:00:00'),
    s AS (SELECT * FROM b WHERE event_type = 'click') SELECT seq, tool FROM s WHERE epoch(TIMESTAMP '2024-01-30 12:00:00') - floor(epoch(ts)) BETWEEN 1800 AND 7200 AND tool NOT IN (SELECT tool FROM b WHERE event_type = 'purchase')""")
def hang_antijoin(spark, sf_dir) -> DataFrame:
    b = t.error_events(spark, sf_dir).where((F.col("ts") > now("2024-01-29 12:00:00")) & (F.col("ts") <= now())).withColumn("tool", F.concat(F.lit("tool"), (F.col("k") * 10 + F.col("seq") % 10).cast("string")))
    return ev.hangs(b.where("event_type = 'click'"), b.where("event_type = 'purchase'"), now()).select("seq", "tool")


@query(f"""{E} SELECT seq FROM error_events e WHERE hint = 'oom' AND EXISTS (SELECT 1 FROM error_events d WHERE d.seq % 211 = 0 AND abs(floor(epoch(d.ts)) - floor(epoch(e.ts))) <= 900)""")
def expected_restart(spark, sf_dir) -> DataFrame:
    e = t.error_events(spark, sf_dir)
    return ev.near_deploys(e.where("hint = 'oom'"), e.where("seq % 211 = 0")).select("seq")


AGG = """agg AS (SELECT sig, count(*) AS count_total, min(ts) AS first_seen, max(CASE WHEN k % 10 < 3 AND day > DATE '2024-01-20' THEN NULL ELSE ts END) AS last_seen, count(*) % 5 = 0 AS burst,
    'P' || CAST(count(*) % 4 AS VARCHAR) AS priority FROM error_events GROUP BY sig)"""


def aggregates(spark, sf_dir) -> DataFrame:
    e = t.error_events(spark, sf_dir)
    seen = F.when(~((F.col("k") % 10 < 3) & (F.col("day") > F.lit("2024-01-20").cast("date"))), F.col("ts"))
    n = F.count(F.lit(1))
    return e.groupBy("sig").agg(n.alias("count_total"), F.min("ts").alias("first_seen"), F.max(seen).alias("last_seen"), (n % 5 == 0).alias("burst"), F.concat(F.lit("P"), (n % 4).cast("string")).alias("priority"))


@query(f"{E}, {AGG} SELECT sig, CASE WHEN date_diff('day', CAST(last_seen AS DATE), DATE '{TODAY}') >= 7 THEN 'resolved' ELSE 'active' END AS status, CASE WHEN date_diff('day', CAST(last_seen AS DATE), DATE '{TODAY}') >= 7 THEN CAST(floor(epoch(last_seen)) AS BIGINT) END AS fixed_at FROM agg")
def resolve_status(spark, sf_dir) -> DataFrame:
    return ev.resolve(aggregates(spark, sf_dir), today()).select("sig", "status", F.unix_timestamp("fixed_at").alias("fixed_at"))


@query(f"""{E}, {AGG}, d AS (SELECT sig, priority AS pb, burst, count_total % 3 = 0 AS routine, date_diff('day', CAST(CASE WHEN burst THEN last_seen END AS DATE), DATE '{TODAY}') < 7 AS fresh FROM agg)
    SELECT sig, CASE WHEN coalesce(fresh, false) THEN CASE WHEN pb = 'P0' THEN 'P0' WHEN routine THEN 'P2' ELSE 'P1' END ELSE pb END AS priority FROM d""")
def burst_decay(spark, sf_dir) -> DataFrame:
    a = aggregates(spark, sf_dir).withColumns({"priority_base": F.col("priority"), "burst_routine": F.col("count_total") % 3 == 0, "burst_ts": F.when(F.col("burst"), F.col("last_seen"))})
    return ev.burst_decay(a, today()).select("sig", "priority")


STATE = """st AS (SELECT sig, count_total % 7 = 0 AS investigating, CASE WHEN count_total % 2 = 0 THEN 'resolved' ELSE 'known' END AS state, CASE WHEN count_total % 6 = 0 THEN first_seen END AS p0_alerted_at FROM agg WHERE count_total % 11 <> 0)"""


def state(spark, sf_dir) -> DataFrame:
    a = aggregates(spark, sf_dir).where("count_total % 11 <> 0")
    return a.select("sig", (F.col("count_total") % 7 == 0).alias("investigating"), F.when(F.col("count_total") % 2 == 0, "resolved").otherwise("known").alias("state"), F.when(F.col("count_total") % 6 == 0, F.col("first_seen")).alias("p0_alerted_at"))


@query(f"""{E}, {AGG}, {STATE} SELECT sig, CASE WHEN priority = 'P0' AND p0_alerted_at IS NULL AND floor(epoch(TIMESTAMP '2024-01-01 00:20:00')) - floor(epoch(first_seen)) <= 600 THEN 'new_p0' ELSE 'burst' END AS kind
    FROM agg LEFT JOIN st USING (sig) WHERE NOT coalesce(investigating, false) AND NOT (sig LIKE 'view%')
      AND ((priority = 'P0' AND p0_alerted_at IS NULL AND floor(epoch(TIMESTAMP '2024-01-01 00:20:00')) - floor(epoch(first_seen)) <= 600) OR (burst AND priority IN ('P0', 'P1')))""")
def alert_candidates(spark, sf_dir) -> DataFrame:
    at = now("2024-01-01 00:20:00")
    a = aggregates(spark, sf_dir).withColumn("burst_ts", F.when(F.col("burst"), F.col("last_seen")))
    s = state(spark, sf_dir).withColumns({"cooldown_until": F.lit(None).cast("timestamp"), "burst_alerted_at": F.lit(None).cast("timestamp")})
    until = F.when(F.col("sig").startswith("view"), F.lit(None).cast("string")).when(F.col("sig").startswith("error"), "no date").otherwise("2023-12-31")
    return ev.alert_candidates(a, s, a.select("sig", until.alias("until")), at).select("sig", "kind")


@query(f"""{E}, {AGG}, {STATE}, r AS (SELECT *, date_diff('day', CAST(last_seen AS DATE), DATE '{TODAY}') AS age, CASE WHEN date_diff('day', CAST(last_seen AS DATE), DATE '{TODAY}') >= 7 THEN 'resolved' ELSE 'active' END AS status,
      CASE WHEN count_total % 4 = 1 THEN first_seen END AS fixed_at FROM agg LEFT JOIN st USING (sig))
    SELECT sig, CASE WHEN status = 'resolved' AND NOT coalesce(fixed_at IS NOT NULL AND last_seen > fixed_at AND age < 7, false) AND age >= 7 THEN 'resolved'
      WHEN coalesce(fixed_at IS NOT NULL AND last_seen > fixed_at AND age < 7, false) OR coalesce(p0_alerted_at IS NOT NULL AND status = 'active' AND state = 'resolved', false) THEN 'regressed'
      WHEN date_diff('day', CAST(first_seen AS DATE), DATE '{TODAY}') < 7 THEN 'new' ELSE 'known' END AS week_status FROM r""")
def weekly_classes(spark, sf_dir) -> DataFrame:
    a = ev.resolve(aggregates(spark, sf_dir), today()).drop("fixed_at").join(state(spark, sf_dir), "sig", "left")
    a = a.withColumns({"fixed_at": F.when(F.col("count_total") % 4 == 1, F.col("first_seen")), "state_fixed_at": F.col("p0_alerted_at"), "manual": F.lit(False), "reported_week": F.lit(None).cast("string")})
    return ev.weekly_status(a, today()).select("sig", "week_status")


@query(f"{E}, v AS (SELECT event_type, k, row_number() OVER (PARTITION BY event_type ORDER BY k) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM error_events) SELECT event_type, k AS median FROM v WHERE rn = n // 2 + 1")
def upper_median_ttf(spark, sf_dir) -> DataFrame:
    return ev.upper_median(t.error_events(spark, sf_dir).select("event_type", "k"), ["event_type"], "k")


@query(f"{E}, {LADDER} SELECT source, round(avg(CASE WHEN priority = 'P3' THEN 1.0 ELSE 0.0 END), 4) AS noise, count(*) AS events FROM error_events LEFT JOIN ladder USING (sig) GROUP BY source")
def noise_ratio(spark, sf_dir) -> DataFrame:
    return ev.noise_ratio(t.error_events(spark, sf_dir), ladder(spark, sf_dir))


HOSTS = "hosts AS (SELECT source, sig, count(*) AS n, 'P' || CAST(count(*) % 4 AS VARCHAR) AS priority FROM error_events GROUP BY ALL)"


@query(f"""{E}, {HOSTS}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY priority, n DESC, sig) AS rank FROM hosts)
    SELECT source, count(*) FILTER (priority = 'P0') AS p0, count(*) FILTER (priority = 'P1') AS p1, count(*) FILTER (priority = 'P2') AS p2, string_agg(sig, ',' ORDER BY rank) FILTER (rank <= 3) AS top,
      CASE WHEN count(*) FILTER (priority = 'P0') > 0 THEN 'red' WHEN count(*) FILTER (priority = 'P1') > 0 THEN 'yellow' ELSE 'green' END AS colour FROM r GROUP BY source""")
def host_digest(spark, sf_dir) -> DataFrame:
    n = F.count(F.lit(1))
    return ev.host_digest(t.error_events(spark, sf_dir).groupBy("source", "sig").agg(n.alias("n"), F.concat(F.lit("P"), (n % 4).cast("string")).alias("priority")))


@query(f"{E} SELECT source, count(*) AS events, count(DISTINCT sig) AS signatures FROM error_events GROUP BY source")
def source_rollup(spark, sf_dir) -> DataFrame:
    return t.error_events(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("sig").alias("signatures"))


@query(f"{E}, r AS (SELECT sig, seq, row_number() OVER (PARTITION BY sig ORDER BY ts DESC, seq DESC) AS rank FROM error_events) SELECT * FROM r WHERE rank <= 3")
def examples_topn(spark, sf_dir) -> DataFrame:
    return ev.examples(t.error_events(spark, sf_dir)).select("sig", "seq", F.col("rank").cast("long").alias("rank"))


@query(f"""{E}, {AGG}, {STATE}, p AS (SELECT sig, date_diff('day', CAST(last_seen AS DATE), DATE '2024-04-30') AS age, coalesce(investigating, false) AS held, state FROM agg FULL JOIN st USING (sig)),
    q AS (SELECT sig, coalesce(age > 90 AND NOT held, false) AS drop_aggregate, coalesce(state IN ('new', 'known', 'resolved') AND NOT held AND age > 45, false) AS drop_state FROM p) SELECT * FROM q WHERE drop_aggregate OR drop_state""")
def prune_plan(spark, sf_dir) -> DataFrame:
    a = aggregates(spark, sf_dir).withColumn("status", F.lit("resolved"))
    return ev.prune_plan(a, state(spark, sf_dir), F.lit("2024-04-30").cast("date"))


@query(f"""{E}, {AGG}, u AS (SELECT sig, count_total, first_seen, burst, priority FROM agg UNION ALL SELECT replace(sig, 'view', 'click'), count_total, first_seen, burst, priority FROM agg)
    SELECT sig, CAST(sum(count_total) AS BIGINT) AS count_total, CAST(floor(epoch(min(first_seen))) AS BIGINT) AS first_seen, bool_or(burst) AS burst, min(priority) AS priority FROM u GROUP BY sig""")
def merged_aggregates(spark, sf_dir) -> DataFrame:
    a = aggregates(spark, sf_dir).withColumn("status", F.lit("active"))
    out = ev.merge_aggregates(a, a.withColumn("sig", F.replace("sig", F.lit("view"), F.lit("click"))))
    return out.select("sig", "count_total", F.unix_timestamp("first_seen").alias("first_seen"), "burst", "priority")


_SINCE = "b.t0 - coalesce(walk.snapshot, walk.edge) >= 3600"


@query(f"""WITH RECURSIVE {E[5:] if E.startswith('WITH ') else E}, s AS (SELECT source AS metric, ts, seq, k >= 40 AS breached FROM error_events),
    e AS (SELECT *, breached AND NOT coalesce(lag(breached) OVER (PARTITION BY metric ORDER BY ts, seq), false) AS is_edge FROM s),
    b AS MATERIALIZED (SELECT metric, seq, is_edge, epoch(ts) AS t0, row_number() OVER (PARTITION BY metric ORDER BY ts, seq) AS rn FROM e WHERE breached),
    walk AS (SELECT metric, seq, rn, t0 AS edge, CAST(NULL AS DOUBLE) AS snapshot, 'edge' AS kind FROM b WHERE rn = 1
            UNION ALL
            SELECT b.metric, b.seq, b.rn, CASE WHEN b.is_edge THEN b.t0 ELSE walk.edge END, CASE WHEN NOT b.is_edge AND {_SINCE} THEN b.t0 ELSE walk.snapshot END,
                CASE WHEN b.is_edge THEN 'edge' WHEN {_SINCE} THEN 'snapshot' END
            FROM walk JOIN b ON b.metric = walk.metric AND b.rn = walk.rn + 1)
    SELECT metric, seq, kind FROM walk WHERE kind IS NOT NULL""")
def edge_trigger(spark, sf_dir) -> DataFrame:
    s = t.error_events(spark, sf_dir).select(F.col("source").alias("metric"), "ts", "seq", (F.col("k") >= 40).alias("breached"))
    return ev.edge_trigger(s).select("metric", "seq", "kind")


@query(f"{E}, l AS (SELECT source, seq, floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY source ORDER BY ts, seq))) AS seconds FROM error_events) SELECT source, count(*) AS gaps, CAST(max(seconds) AS BIGINT) AS longest FROM l WHERE seconds > 1800 GROUP BY source")
def silence_gaps(spark, sf_dir) -> DataFrame:
    return ev.silence_gaps(t.error_events(spark, sf_dir)).groupBy("source").agg(F.count(F.lit(1)).alias("gaps"), F.max("seconds").alias("longest"))


@query(f"""{E}, {AGG} SELECT sig, priority, count_total FROM agg WHERE contains(lower(sig), 'error') AND last_seen >= TIMESTAMP '2024-01-25 00:00:00' ORDER BY priority, last_seen DESC, sig LIMIT 5""")
def errors_query(spark, sf_dir) -> DataFrame:
    a = aggregates(spark, sf_dir).withColumn("sources", F.array().cast("array<string>"))
    return ev.query_aggregates(a, text="ERROR", since=now("2024-01-25 00:00:00"), limit=5).select("sig", "priority", "count_total")
