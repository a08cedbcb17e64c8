"""Queries of fragments and of the weekly report, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import lifecycle as lc
from quillstone.operators import reports as rp
from quillstone.plans import events as pe
from quillstone.plans.lifecycle import _RULES, _WHYS
from quillstone.plans.sql import ENTRIES
from quillstone.sources import tables as t

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


_SLUG = "regexp_replace(trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')[1:40], '-+$', '')"


@query(f"""WITH {ENTRIES}, r AS (SELECT event_id AS n, CASE WHEN event_id % 29 = 0 THEN '' ELSE 'doc-' || lpad(CAST(CASE WHEN event_id % 6 = 0 THEN event_id % 300 ELSE event_id % 30 * 10 END AS VARCHAR), 8, '0') END AS collection,
        CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 19 = 0 THEN '## ' ELSE 'Part ' || event_type || ' ' || event_id END AS title, CASE WHEN event_id % 23 = 0 THEN '' ELSE 'text ' || event_id END AS content,
        CASE event_id % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'private' WHEN 2 THEN CASE WHEN event_id % 31 = 0 THEN 'both' END END AS wanted FROM events),
    last AS (SELECT parent AS collection, max(coalesce(seq, 0)) AS last FROM entries WHERE parent IS NOT NULL GROUP BY 1),
    j AS (SELECT r.*, e.kid, domain, subject, zone AS bz, content_type, status, coalesce(last, 0) AS last, CASE WHEN r.collection = '' THEN 'no collection' WHEN title = '' THEN 'no title' WHEN r.content = '' THEN 'no content' WHEN title = '## ' THEN 'no title'
        WHEN e.kid IS NULL THEN 'not found' WHEN coalesce(content_type, '') <> 'collection' THEN 'no book' WHEN coalesce(status, '') = 'deprecated' THEN 'deprecated' WHEN wanted = 'both' THEN 'no zone' END AS error
        FROM r LEFT JOIN entries e ON e.kid = r.collection LEFT JOIN last l ON l.collection = r.collection),
    k AS (SELECT *, CASE WHEN error IS NULL THEN last + row_number() OVER (PARTITION BY collection, error IS NULL ORDER BY n) END AS seq FROM j)
    SELECT n, error, CASE WHEN error IS NULL THEN {_SLUG.format('domain')} || '-' || {_SLUG.format('subject')} || '-' || {_SLUG.format('title')} || '-' || lpad(CAST(seq AS VARCHAR), 3, '0') END AS kid, seq,
        CASE WHEN error IS NULL THEN '# ' || title || chr(10) || chr(10) || content END AS body, CASE WHEN error IS NULL THEN CASE WHEN wanted IS NULL OR bz = 'private' AND wanted = 'public' THEN bz ELSE wanted END END AS zone,
        CASE WHEN error IS NULL THEN coalesce(wanted = 'public' AND bz = 'private', false) END AS forced, CASE WHEN error IS NULL THEN coalesce(wanted = 'private' AND bz = 'public', false) END AS partial FROM k""")
def fragments_added(spark, sf_dir) -> DataFrame:
    n = F.col("event_id")
    book = F.when(n % 29 == 0, "").otherwise(t.doc_name(F.when(n % 6 == 0, n % 300).otherwise(n % 30 * 10)))
    title = F.when(n % 17 == 0, "").when(n % 19 == 0, "## ").otherwise(F.concat(F.lit("Part "), "event_type", F.lit(" "), n.cast("string")))
    zone = F.when(n % 4 == 0, "public").when(n % 4 == 1, "private").when((n % 4 == 2) & (n % 31 == 0), "both")
    content = F.when(n % 23 == 0, "").otherwise(F.concat(F.lit("text "), n.cast("string")))
    requests = t.table(spark, sf_dir, "events").select(n.alias("n"), book.alias("collection"), title.alias("title"), content.alias("content"), zone.alias("zone"))
    return rp.added_fragments(requests, t.entries(spark, sf_dir)).select("n", "error", "kid", "seq", "body", "zone", "forced", "partial")


@query(f"""WITH {ENTRIES}, r AS (SELECT 'doc-' || lpad(CAST(doc_id + CASE WHEN doc_id % 37 = 0 THEN 10000000 ELSE 0 END AS VARCHAR), 8, '0') AS kid, CASE WHEN doc_id % 3 = 0 THEN 'New ' || doc_id WHEN doc_id % 41 = 0 THEN ' # ' END AS title,
        CASE WHEN doc_id % 4 < 2 THEN 'body ' || doc_id END AS content, CASE WHEN doc_id % 7 = 0 THEN 99 WHEN doc_id % 7 = 1 THEN doc_id % 5 + 1 END AS version FROM documents),
    e AS (SELECT kid, parent, CASE WHEN n % 2 = 0 THEN '# Head' || chr(10) || chr(10) || 'old ' || n ELSE 'old ' || n END AS old, n % 2 = 0 AS headed, version AS held, n FROM entries),
    j AS (SELECT r.*, old, headed, held, n, CASE WHEN e.kid IS NULL THEN 'not found' WHEN parent IS NULL THEN 'no section' WHEN title = ' # ' THEN 'no title' WHEN r.version IS NOT NULL AND r.version <> held THEN 'conflict' END AS error FROM r LEFT JOIN e USING (kid))
    SELECT kid, error, CASE WHEN error IS NULL THEN CASE WHEN title IS NOT NULL THEN '# ' || title || chr(10) || chr(10) || coalesce(content, 'old ' || n) WHEN content IS NOT NULL THEN CASE WHEN headed THEN '# Head' || chr(10) || chr(10) ELSE '' END || content ELSE old END END AS content,
        CASE WHEN error IS NULL THEN held + 1 END AS version FROM j""")
def fragments_updated(spark, sf_dir) -> DataFrame:
    n = F.col("doc_id")
    name = lambda p: F.concat(F.lit(p), n.cast("string"))
    requests = t.table(spark, sf_dir, "documents").select(
        t.doc_name(n + F.when(n % 37 == 0, 10_000_000).otherwise(0)).alias("kid"), F.when(n % 3 == 0, name("New ")).when(n % 41 == 0, " # ").alias("title"), F.when(n % 4 < 2, name("body ")).alias("content"),
        F.when(n % 7 == 0, 99).when(n % 7 == 1, n % 5 + 1).alias("version"),
    )
    old = F.concat(F.when(F.col("n") % 2 == 0, "# Head\n\n").otherwise(""), F.lit("old "), F.col("n").cast("string"))
    return rp.updated_fragments(requests, t.entries(spark, sf_dir).withColumn("content", old))


@query(f"WITH {ENTRIES}, r AS (SELECT 'doc-' || lpad(CAST(event_id % 400 AS VARCHAR), 8, '0') AS kid FROM events GROUP BY 1) SELECT r.kid, CASE WHEN e.kid IS NULL THEN 'not found' WHEN parent IS NULL THEN 'no section' END AS error FROM r LEFT JOIN entries e ON e.kid = r.kid")
def fragments_deleted(spark, sf_dir) -> DataFrame:
    requests = t.table(spark, sf_dir, "events").select(t.doc_name(F.col("event_id") % 400).alias("kid")).distinct()
    return rp.deleted_fragments(requests, t.entries(spark, sf_dir))


_KIND = "CASE count_total % 5 WHEN 0 THEN '|404|' WHEN 1 THEN '|oom' ELSE '|' END"
REPORT = f"""{pe.AGG}, act AS (SELECT sig AS s0, count(DISTINCT actor) AS actors, max(message) AS example FROM error_events GROUP BY sig),
    rep AS (SELECT sig || {_KIND} AS sig, priority, CASE WHEN count_total % 2 = 0 THEN 'resolved' ELSE 'active' END AS status, first_seen, last_seen, count_total AS count_7d, actors, example,
        CASE WHEN count_total % 3 = 0 THEN last_seen END AS burst_ts, CASE WHEN count_total % 2 = 0 THEN CASE WHEN count_total % 4 = 0 THEN first_seen ELSE last_seen END END AS fixed_at,
        CASE WHEN count_total % 7 = 0 THEN 'regressed' ELSE 'known' END AS week_status, count_total % 10 = 0 AS non_routine, count_total % 6 = 1 AS reported FROM agg JOIN act ON s0 = sig)"""


def report_rows(spark, sf_dir) -> DataFrame:
    n = F.col("count_total")
    more = t.error_events(spark, sf_dir).groupBy("sig").agg(F.countDistinct("actor").alias("actors"), F.max("message").alias("example"))
    a = pe.aggregates(spark, sf_dir).join(more, "sig")
    return a.select(
        F.concat("sig", F.when(n % 5 == 0, "|404|").when(n % 5 == 1, "|oom").otherwise("|")).alias("sig"), "priority", F.when(n % 2 == 0, "resolved").otherwise("active").alias("status"), "first_seen", "last_seen", n.alias("count_7d"),
        "actors", "example", F.when(n % 3 == 0, F.col("last_seen")).alias("burst_ts"), F.when(n % 2 == 0, F.when(n % 4 == 0, F.col("first_seen")).otherwise(F.col("last_seen"))).alias("fixed_at"),
        F.when(n % 7 == 0, "regressed").otherwise("known").alias("week_status"), (n % 10 == 0).alias("non_routine"), (n % 6 == 1).alias("reported"),
    )


def _part(name: str, where: str, order: str, limit: int, note: str = "CAST(NULL AS VARCHAR)") -> str:
    return f"SELECT '{name}' AS section, row_number() OVER (ORDER BY {order}, sig) AS rank, sig, count_7d, {note} AS note FROM rep WHERE {where} QUALIFY rank <= {limit}"


_NOW = "2024-02-01"
_WHY, _RULE = f"CASE WHEN NOT non_routine THEN CASE {_WHYS} END END", f"CASE {_RULES} ELSE '{lc.OTHER_RULE}' END"
_REPORT = " UNION ALL ".join([
    _part("p0", "priority = 'P0' AND status <> 'resolved'", "count_7d DESC", 10), _part("p1_p2", "priority IN ('P1', 'P2') AND status <> 'resolved'", "actors DESC, count_7d DESC", 10), _part("p3", "priority = 'P3'", "count_7d DESC", 5),
    _part("bursts", f"floor(epoch(burst_ts)) >= epoch(TIMESTAMP '{_NOW}') - 604800", "burst_ts DESC", 10), _part("rules", "priority IN ('P0', 'P1') AND status = 'resolved' AND fixed_at IS NOT NULL", "fixed_at DESC", 10, _RULE),
    _part("relapses", "week_status = 'regressed'", "count_7d DESC", 10), _part("quiet", f"priority IN ('P0', 'P1') AND status <> 'resolved' AND {_WHY} IS NOT NULL", "count_7d DESC", 10, _WHY),
])


@query(f"{pe.E}, {REPORT} {_REPORT}")
def weekly_report(spark, sf_dir) -> DataFrame:
    return rp.weekly_report(report_rows(spark, sf_dir), F.to_timestamp(F.lit(_NOW)))


@query(f"""{pe.E}, {REPORT}, f AS (SELECT (floor(epoch(fixed_at)) - floor(epoch(first_seen))) / 3600 AS h, row_number() OVER (ORDER BY (floor(epoch(fixed_at)) - floor(epoch(first_seen))) / 3600) AS rn, count(*) OVER () AS n FROM rep WHERE status = 'resolved' AND fixed_at IS NOT NULL)
    SELECT count(*) FILTER (priority IN ('P0', 'P1') AND status <> 'resolved') AS active, count(*) FILTER (priority IN ('P0', 'P1') AND date_diff('day', CAST(last_seen AS DATE), DATE '{_NOW}') <= 30) AS recent,
        count(*) FILTER (priority IN ('P0', 'P1') AND status = 'resolved' AND fixed_at IS NOT NULL) AS rule_candidates, count(*) FILTER (status = 'resolved' AND last_seen > fixed_at) AS relapses, count(*) FILTER (status = 'resolved' AND fixed_at IS NOT NULL) AS fixed,
        (SELECT round(h, 1) FROM f WHERE rn = n // 2 + 1) AS median_hours, count(*) FILTER (priority IN ('P0', 'P1') AND status <> 'resolved' AND NOT reported) AS found_first,
        coalesce((SELECT string_agg(sig, '; ' ORDER BY sig) FROM (SELECT sig FROM rep WHERE status = 'resolved' AND last_seen > fixed_at ORDER BY sig LIMIT 3)), '') AS relapsed,
        CASE WHEN bool_or(reported) AND recent > 0 THEN round(found_first / recent, 2) END AS share FROM rep""")
def cycle_metrics(spark, sf_dir) -> DataFrame:
    return rp.cycle_metrics(report_rows(spark, sf_dir), F.lit(_NOW).cast("date"))
