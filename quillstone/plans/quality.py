"""Queries of the quality engine, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.operators import quality as q
from quillstone.plans.sql import ENTRIES, POINTS
from quillstone.sources import tables as t

QUERIES, ORACLE = {}, {}
NOW_DAY = 731  # 2026-01-01 in days from 2024-01-01


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


WARS = "wars AS (SELECT doc AS n, count(*) AS commits FROM (SELECT event_id % 60 AS doc, ts FROM events) WHERE ts > TIMESTAMP '2024-01-29 00:00:00' AND ts <= TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1 HAVING count(*) >= 3)"
SCORED = f"""{ENTRIES}, {WARS}, scored AS (SELECT entries.*, round(least(1.0, greatest(0.0,
    0.47 * least(1.0, greatest(0.0, coalesce(CASE WHEN explicit THEN ({NOW_DAY} - updated_day) / (CASE WHEN evergreen THEN 1825 ELSE 365 END) END, 0.0)))
    + 0.16 * (CASE WHEN source_url IS NULL THEN 1 ELSE 0 END) / 3.0 + 0.10 * (CASE WHEN wars.n IS NOT NULL THEN 1.0 ELSE 0.0 END))), 4) AS score FROM entries LEFT JOIN wars ON wars.n = entries.n)"""


def commits(spark, sf_dir) -> DataFrame:
    return t.table(spark, sf_dir, "events").select(t.doc_name(F.col("event_id") % 60).alias("kid"), "ts")


def wars(spark, sf_dir) -> DataFrame:
    return q.edit_wars(commits(spark, sf_dir), F.lit("2024-01-30 00:00:00").cast("timestamp"))


def scores(spark, sf_dir) -> DataFrame:
    return q.scored(t.entries(spark, sf_dir), NOW_DAY, wars(spark, sf_dir))


@query(f"WITH {SCORED} SELECT kid, score FROM scored")
def staleness(spark, sf_dir) -> DataFrame:
    return scores(spark, sf_dir).select("kid", "score")


@query(f"WITH {SCORED} SELECT kid, score FROM scored WHERE score >= 0.45 ORDER BY score DESC, kid LIMIT 20")
def review_queue(spark, sf_dir) -> DataFrame:
    return q.review_queue(scores(spark, sf_dir))


@query(f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY score DESC, kid) AS rn FROM scored WHERE parent IS NOT NULL)
    SELECT parent, count(*) AS sections, count(*) FILTER (score >= 0.45) AS stale, max(score) AS max_score, string_agg(kid, ',' ORDER BY rn) FILTER (score >= 0.45 AND rn <= 5) AS worst,
           round(count(*) FILTER (score >= 0.45) / count(*), 3) AS fraction FROM r GROUP BY parent HAVING count(*) FILTER (score >= 0.45) > 0""")
def stale_books(spark, sf_dir) -> DataFrame:
    return q.stale_books(scores(spark, sf_dir))


@query(f"WITH {WARS} SELECT 'doc-' || lpad(CAST(n AS VARCHAR), 8, '0') AS kid, commits FROM wars")
def edit_war(spark, sf_dir) -> DataFrame:
    return wars(spark, sf_dir)


BODY = r"regexp_replace(regexp_replace(content, '^\s+|\s+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"


@query(f"WITH {ENTRIES} SELECT kid, sha256({BODY}) AS body_hash, length({BODY}) AS body_length FROM entries")
def body_hash(spark, sf_dir) -> DataFrame:
    e = t.entries(spark, sf_dir)
    return e.select("kid", tx.body_hash(F.col("content")).alias("body_hash"), F.length(tx.normalized_body(F.col("content"))).cast("long").alias("body_length"))


_HASHED = f"h AS (SELECT *, sha256({BODY}) AS hash FROM entries WHERE status IS NULL OR status <> 'deprecated')"


@query(f"""WITH {ENTRIES}, {_HASHED}, f AS (SELECT domain, subject, hash, min(kid) AS kid_a, count(*) AS copies FROM h GROUP BY ALL HAVING count(*) > 1)
    SELECT kid_a, kid AS kid_b, copies FROM h JOIN f USING (domain, subject, hash) WHERE kid <> kid_a""")
def exact_hash_pairs(spark, sf_dir) -> DataFrame:
    return q.hash_pairs(t.entries(spark, sf_dir))


_ELIGIBLE = "el AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY kid) AS rn FROM entries WHERE coalesce(status, '') <> 'deprecated') WHERE rn <= 500)"
_TAGS = f"""{ENTRIES}, {_ELIGIBLE}, p AS (SELECT a.domain, a.kid AS kid_a, b.kid AS kid_b, CAST(len(list_intersect(a.tags, b.tags)) AS BIGINT) AS common, a.tags AS ta, b.tags AS tb
    FROM el a JOIN el b ON a.domain = b.domain AND a.subject = b.subject AND a.rn < b.rn),
    pairs AS (SELECT domain, kid_a, kid_b, common FROM (SELECT *, row_number() OVER (PARTITION BY kid_a ORDER BY kid_b) AS nth FROM p WHERE common / least(len(ta), len(tb)) >= 0.5) WHERE nth <= 10)"""


@query(f"WITH {_TAGS} SELECT * FROM pairs")
def tag_dup_pairs(spark, sf_dir) -> DataFrame:
    return q.tag_pairs(t.entries(spark, sf_dir))


@query(f"WITH {_TAGS} SELECT kid, count(*) AS pairs FROM (SELECT kid_a AS kid FROM pairs UNION ALL SELECT kid_b FROM pairs) GROUP BY kid")
def dup_map(spark, sf_dir) -> DataFrame:
    return q.dup_map(q.tag_pairs(t.entries(spark, sf_dir)))


_VECTORS = f"""{POINTS}, first AS (SELECT domain, kid, any_value(status) AS status, arg_min(vector, vec_id) AS vector FROM (SELECT domain, kid, status, vec_id, vector FROM points
    UNION ALL SELECT domain, kid || '-copy', status, vec_id, vector FROM points WHERE vec_id % 40 = 0) GROUP BY domain, kid),
    el AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY kid) AS rn FROM first WHERE coalesce(status, '') <> 'deprecated'),
    c AS (SELECT a.domain, a.kid AS kid_a, b.kid AS kid_b, round(list_cosine_similarity(a.vector, b.vector), 4) AS cosine FROM el a JOIN el b ON a.domain = b.domain AND a.rn < b.rn WHERE a.rn <= 500 AND b.rn <= 500),
    pairs AS (SELECT domain, kid_a, kid_b, cosine FROM (SELECT *, row_number() OVER (PARTITION BY kid_a ORDER BY kid_b) AS nth FROM c WHERE cosine >= 0.92) WHERE nth <= 10)"""


@query(f"WITH {_VECTORS} SELECT * FROM pairs")
def vector_dup_pairs(spark, sf_dir) -> DataFrame:
    """With planted copies, which the random vectors lack."""
    p = t.points(spark, sf_dir)
    return q.vector_pairs(p.unionByName(p.where("vec_id % 40 = 0").withColumn("kid", F.concat("kid", F.lit("-copy")))))


_SIDES = f"""f AS (SELECT kid, subject, sha256({BODY}) AS hash, length({BODY}) AS length, parent IS NULL AS alone FROM entries),
    made AS (SELECT *, CASE WHEN kb % 4 = 0 THEN NULL ELSE 0.90 + (ka * 7 + kb) % 11 / 100.0 END AS cosine FROM (
        SELECT a.kid AS kid_a, b.kid AS kid_b, a.n AS ka, b.n AS kb FROM entries a JOIN entries b ON b.n > a.n AND b.n <= a.n + 20 AND b.n % 10 = a.n % 10)),
    ranked AS (SELECT kid_a, kid_b, cosine, CASE
        WHEN a.hash = b.hash AND a.alone AND b.alone AND a.subject = b.subject THEN 'green' WHEN cosine IS NULL OR cosine < 0.92 THEN 'red' WHEN a.hash = b.hash THEN 'yellow'
        WHEN cosine >= 0.97 AND a.alone AND b.alone AND abs(a.length - b.length) / greatest(a.length, b.length) <= 0.10 THEN 'green' ELSE 'yellow' END AS flow,
        CASE WHEN a.length > b.length THEN kid_a WHEN b.length > a.length THEN kid_b WHEN a.alone AND NOT b.alone THEN kid_a ELSE kid_b END AS keep
        FROM made JOIN f a ON a.kid = kid_a JOIN f b ON b.kid = kid_b)"""


def made_pairs(spark, sf_dir) -> DataFrame:
    """Pairs of every entry with the two ten and twenty further on, with an invented cosine."""
    e = t.entries(spark, sf_dir).select("n", "kid")
    steps = e.select(F.col("n").alias("ka"), F.col("kid").alias("kid_a"), F.explode(F.array(F.col("n") + 10, F.col("n") + 20)).alias("kb"))
    both = steps.join(e.select(F.col("n").alias("kb"), F.col("kid").alias("kid_b")), "kb")
    return both.select("kid_a", "kid_b", F.when(F.col("kb") % 4 != 0, 0.90 + (F.col("ka") * 7 + F.col("kb")) % 11 / 100.0).alias("cosine"))


@query(f"WITH {ENTRIES}, {_SIDES} SELECT kid_a, kid_b, flow FROM ranked")
def dup_rank(spark, sf_dir) -> DataFrame:
    return q.ranked_pairs(made_pairs(spark, sf_dir), t.entries(spark, sf_dir)).select("kid_a", "kid_b", "flow")


@query(f"WITH {ENTRIES}, {_SIDES} SELECT kid_a, kid_b, keep FROM ranked")
def canonical_pick(spark, sf_dir) -> DataFrame:
    return q.ranked_pairs(made_pairs(spark, sf_dir), t.entries(spark, sf_dir)).select("kid_a", "kid_b", "keep")


@query(f"WITH {ENTRIES}, {_SIDES} SELECT flow, count(*) AS pairs FROM ranked GROUP BY flow")
def duplicate_review(spark, sf_dir) -> DataFrame:
    return q.ranked_pairs(made_pairs(spark, sf_dir), t.entries(spark, sf_dir)).groupBy("flow").agg(F.count(F.lit(1)).alias("pairs"))


@query("""WITH p AS (SELECT event_type AS kid_a, event_id AS b FROM events), c AS (SELECT *, row_number() OVER (PARTITION BY kid_a ORDER BY b) AS nth FROM p) SELECT kid_a, b AS kid_b FROM c WHERE nth <= 10""")
def pair_cap(spark, sf_dir) -> DataFrame:
    return q.cap_pairs(t.table(spark, sf_dir, "events").select(F.col("event_type").alias("kid_a"), F.col("event_id").alias("kid_b")))


@query(f"""WITH {ENTRIES}, s AS (SELECT kid, 'review-' || subject || '/' || kid AS path, regexp_extract_all(content, '(?i)the|und|les') AS found, n FROM entries)
    SELECT kid, n % 40 = 0 AS path_flag, array_to_string(list_sort(list_distinct(found))[1:10], ',') AS matched FROM s WHERE len(found) >= 2 OR n % 40 = 0""")
def sensitive(spark, sf_dir) -> DataFrame:
    e = t.entries(spark, sf_dir).withColumn("path", F.when(F.col("n") % 40 == 0, "Partners/x").otherwise("notes/x"))
    return q.sensitive(e, "path", "(?i)the|und|les")


@query(f"""WITH {ENTRIES} SELECT kid, 'warn' AS severity, field FROM (
    SELECT kid, unnest([CASE WHEN project IS NULL THEN 'project' END, CASE WHEN source_url IS NULL THEN 'source_url' END, CASE WHEN content_type IS NULL THEN 'content_type' END]) AS field FROM entries) WHERE field IS NOT NULL
    UNION ALL SELECT kid, 'critical', 'content' FROM entries WHERE coalesce(content, '') = '' UNION ALL SELECT kid, 'critical', 'kid' FROM entries WHERE n % 25 = 0""")
def frontmatter_gate(spark, sf_dir) -> DataFrame:
    e = t.entries(spark, sf_dir)
    return q.gate_issues(e.withColumn("tags", F.array_join("tags", ",")), e.where("n % 25 = 0"))


_ISSUES = """issues AS (SELECT 'iss_' || sha256('missing_field|' || kid || '|source')[1:16] AS issue_id, kid, 'missing_field' AS type,
    CASE WHEN n % 4 = 0 THEN 'resolved' ELSE 'open' END AS status, 'source v1' AS detail FROM entries WHERE n % 3 = 0)"""


def issues(spark, sf_dir) -> DataFrame:
    e = t.entries(spark, sf_dir).where("n % 3 = 0")
    return e.select(q.issue_id(F.lit("missing_field"), F.col("kid"), F.lit("source")).alias("issue_id"), "kid", F.lit("missing_field").alias("type"), F.when(F.col("n") % 4 == 0, "resolved").otherwise("open").alias("status"), F.lit("source v1").alias("detail"))


@query(f"""WITH {ENTRIES}, {_ISSUES}, found AS (SELECT 'iss_' || sha256('missing_field|' || kid || '|source')[1:16] AS issue_id, CASE WHEN n % 6 = 0 THEN 'source v2' ELSE 'source v1' END AS detail FROM entries WHERE n % 2 = 0)
    SELECT issue_id, coalesce(s.status, 'open') AS status, coalesce(f.detail, s.detail) AS detail, CASE WHEN s.status IS NULL THEN 'created' WHEN f.detail IS NULL THEN 'kept' WHEN f.detail <> s.detail THEN 'refreshed' ELSE 'skipped' END AS action
    FROM issues s FULL JOIN found f USING (issue_id)""")
def issue_upsert(spark, sf_dir) -> DataFrame:
    e = t.entries(spark, sf_dir).where("n % 2 = 0")
    found = e.select(q.issue_id(F.lit("missing_field"), F.col("kid"), F.lit("source")).alias("issue_id"), F.when(F.col("n") % 6 == 0, "source v2").otherwise("source v1").alias("detail"))
    return q.upsert_issues(issues(spark, sf_dir), found)


@query(f"WITH {SCORED}, {_ISSUES} SELECT issue_id, kid, score FROM issues JOIN scored USING (kid) WHERE issues.status = 'open' AND score < 0.45")
def auto_clear(spark, sf_dir) -> DataFrame:
    return q.auto_clear(issues(spark, sf_dir), scores(spark, sf_dir)).select("issue_id", "kid", "score")


@query(f"WITH {ENTRIES}, {_ISSUES} SELECT status, count(*) AS issues FROM issues GROUP BY status")
def issue_counts(spark, sf_dir) -> DataFrame:
    return issues(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("issues"))


@query(f"WITH {ENTRIES}, {_ISSUES} SELECT kid, count(*) AS n, min(issue_id) AS issue_id FROM issues WHERE status = 'open' GROUP BY kid")
def open_issues(spark, sf_dir) -> DataFrame:
    return issues(spark, sf_dir).where("status = 'open'").groupBy("kid").agg(F.count(F.lit(1)).alias("n"), F.min("issue_id").alias("issue_id"))


_AUDIT = """audit AS (SELECT ts, 'doc-' || lpad(CAST(event_id % 300 AS VARCHAR), 8, '0') AS kid, CASE WHEN event_id % 2000 = 7 THEN 'scan_completed' WHEN event_id % 10 = 1 THEN 'auto_deprecated' WHEN event_id % 10 = 2 THEN 'restored' WHEN event_id % 10 = 3 THEN 'dup_rejected' ELSE 'updated' END AS action FROM events)"""


def audit(spark, sf_dir) -> DataFrame:
    n = F.col("event_id")
    action = F.when(n % 2000 == 7, "scan_completed").when(n % 10 == 1, "auto_deprecated").when(n % 10 == 2, "restored").when(n % 10 == 3, "dup_rejected").otherwise("updated")
    return t.table(spark, sf_dir, "events").select("ts", t.doc_name(n % 300).alias("kid"), action.alias("action"))


@query(f"""WITH {_AUDIT}, s AS (SELECT ts FROM audit WHERE action = 'scan_completed' ORDER BY ts DESC LIMIT 3), f AS (SELECT CASE WHEN count(*) = 3 THEN min(ts) END AS since FROM s),
    c AS (SELECT count(*) FILTER (action = 'dup_rejected') AS rejections, count(*) FILTER (action = 'auto_deprecated') AS automatic FROM audit, f WHERE since IS NULL OR ts >= since)
    SELECT rejections, automatic, round(rejections / nullif(rejections + automatic, 0), 4) AS rate, rejections = 0 AS fp_free FROM c""")
def fp_rate(spark, sf_dir) -> DataFrame:
    return q.false_positive_rate(audit(spark, sf_dir))


@query(f"""WITH {_AUDIT}, l AS (SELECT kid, max(ts) FILTER (action = 'restored') AS r, max(ts) FILTER (action = 'auto_deprecated') AS d FROM audit GROUP BY kid)
    SELECT kid FROM l WHERE r IS NOT NULL AND (d IS NULL OR r > d) AND (SELECT count(*) FROM audit WHERE action = 'scan_completed' AND ts > l.r) < 3""")
def cooldown_shield(spark, sf_dir) -> DataFrame:
    return q.shielded(audit(spark, sf_dir)).select("kid")


@query(f"WITH {_AUDIT} SELECT action, count(*) AS n FROM audit GROUP BY action")
def audit_counts(spark, sf_dir) -> DataFrame:
    return audit(spark, sf_dir).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


_INDEX = "idx AS (SELECT CASE WHEN n % 23 = 0 THEN 'gone-' || kid ELSE kid END AS kid, true AS indexed, CASE WHEN n % 19 = 0 THEN NULL WHEN n % 7 = 0 THEN updated_day - 1 ELSE updated_day END AS updated_day FROM entries WHERE n % 29 <> 0)"


def index(spark, sf_dir) -> DataFrame:
    e = t.entries(spark, sf_dir).where("n % 29 <> 0")
    return e.select(F.when(F.col("n") % 23 == 0, F.concat(F.lit("gone-"), "kid")).otherwise(F.col("kid")).alias("kid"), F.lit(True).alias("indexed"), F.when(F.col("n") % 19 == 0, None).when(F.col("n") % 7 == 0, F.col("updated_day") - 1).otherwise(F.col("updated_day")).alias("updated_day"))


@query(f"""WITH {ENTRIES}, {_INDEX} SELECT kid, CASE WHEN indexed IS NULL THEN 'missing' WHEN explicit IS NULL THEN 'orphan'
    WHEN (CASE WHEN i.updated_day IS NULL THEN explicit WHEN NOT explicit THEN false ELSE s.updated_day > i.updated_day END) THEN 'drifted' ELSE 'ok' END AS state
    FROM entries s FULL JOIN idx i USING (kid)""")
def reconcile(spark, sf_dir) -> DataFrame:
    return q.reconcile(t.entries(spark, sf_dir), index(spark, sf_dir))


@query(f"WITH {ENTRIES} SELECT kid, parent FROM entries WHERE parent IS NOT NULL AND n % 10 < 8 AND NOT (parent IN (SELECT kid FROM entries WHERE n % 70 <> 0))")
def orphan_children(spark, sf_dir) -> DataFrame:
    e = t.entries(spark, sf_dir)
    return q.orphan_children(e.where("n % 70 <> 0").where("n % 10 < 8 or n % 10 = 0")).where("parent is not null")


@query(f"""WITH {ENTRIES}, c AS (SELECT parent, kid || CASE WHEN n % 3 = 0 THEN '-lost' ELSE '' END AS child FROM entries WHERE parent IS NOT NULL),
    g AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY child) AS nth FROM c WHERE child NOT IN (SELECT kid FROM entries)) SELECT parent, child FROM g WHERE nth <= 5""")
def incomplete_collections(spark, sf_dir) -> DataFrame:
    e = t.entries(spark, sf_dir)
    listed = e.where("parent is not null").select("parent", F.concat("kid", F.when(F.col("n") % 3 == 0, "-lost").otherwise("")).alias("child"))
    return q.incomplete_collections(listed, e)


@query(f"WITH {ENTRIES}, {_ISSUES} SELECT e.kid, count(i.issue_id) AS open, count(i.issue_id) > 0 AS warn FROM entries e LEFT JOIN issues i ON i.kid = e.kid AND i.status = 'open' WHERE zone = 'private' GROUP BY e.kid")
def promotion_readiness(spark, sf_dir) -> DataFrame:
    return q.promotion_readiness(t.entries(spark, sf_dir), issues(spark, sf_dir).withColumn("type", F.lit("sensitive")))


@query(f"WITH {ENTRIES} SELECT kid, kid || ' ' || subject || ' ' || array_to_string(tags, ' ') AS text FROM entries")
def scan_text(spark, sf_dir) -> DataFrame:
    return q.group_similarity_text(t.entries(spark, sf_dir))


@query(f"""WITH {_AUDIT}, p AS (SELECT *, row_number() OVER (ORDER BY ts DESC, kid, action) AS rn, count(*) OVER () AS total FROM audit WHERE action <> 'updated')
    SELECT kid, action, total FROM p WHERE rn <= 50""")
def audit_page(spark, sf_dir) -> DataFrame:
    """The newest page of the audit log with the number of all rows."""
    rows = audit(spark, sf_dir).where("action <> 'updated'")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(F.desc("ts"), "kid", "action").limit(50).join(F.broadcast(total)).select("kid", "action", "total")


@query(f"WITH {ENTRIES}, x AS (SELECT kid, row_number() OVER (PARTITION BY domain ORDER BY version DESC, kid) AS rn FROM entries WHERE {NOW_DAY} - updated_day > 365) SELECT kid FROM x WHERE rn <= 4")
def keep_newest(spark, sf_dir) -> DataFrame:
    """The newest four per domain of what is older than a year."""
    old = t.entries(spark, sf_dir).where(F.lit(NOW_DAY) - F.col("updated_day") > 365)
    return old.withColumn("rn", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("version"), "kid"))).where("rn <= 4").select("kid")


