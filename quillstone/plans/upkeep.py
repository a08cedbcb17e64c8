"""Queries of upkeep, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.vectors import cosine_to
from quillstone.operators import upkeep as uk
from quillstone.plans import events as pe
from quillstone.plans import quality as pq
from quillstone.plans import workspace as pw
from quillstone.plans.sql import ENTRIES, EVENTS, POINTS, TITLE
from quillstone.sources import tables as t

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


_GUARDED = f"""{EVENTS}, ge AS (SELECT seq, date_trunc('hour', ts) AS ts, event_type || '|' || (k % 6) AS sig, CASE WHEN seq % 19 = 0 THEN 'health' ELSE source END AS source, CASE WHEN seq % 43 = 0 THEN 'GUARD' ELSE marker END AS marker,
        CASE WHEN seq % 29 = 0 THEN 'traceback' ELSE hint END AS hint, status, actor FROM error_events),
    li AS (SELECT DISTINCT event_type || '|' || (k % 6) AS sig FROM error_events WHERE k % 6 IN (1, 2, 5)),
    gl AS (SELECT ge.*, li.sig IS NOT NULL AND (ge.sig LIKE '%1' OR ge.sig LIKE '%5') AS on_list, coalesce(hint = 'traceback', false) OR source = 'health' OR coalesce(marker = 'GUARD', false) AS li_immune FROM ge LEFT JOIN li USING (sig)),
    gi AS (SELECT *, on_list AND NOT li_immune AS listed, li_immune OR coalesce(status BETWEEN 400 AND 499, false) AND actor IS NOT NULL AS immune FROM gl),
    gc AS (SELECT *, row_number() OVER (PARTITION BY sig, ts ORDER BY seq) AS nth FROM gi WHERE NOT listed AND NOT immune),
    gm AS (SELECT sig, ts, lag(greatest(n - 5, 0)) OVER (PARTITION BY sig ORDER BY ts) AS held FROM (SELECT sig, ts, count(*) AS n FROM gc GROUP BY ALL))"""


@query(f"""WITH {_GUARDED} SELECT seq, sig, CASE WHEN listed THEN 'listed' ELSE 'immune' END AS verdict, 0 AS carried FROM gi WHERE listed OR immune
    UNION ALL SELECT seq, sig, CASE WHEN nth <= 5 THEN 'passed' ELSE 'capped' END, CASE WHEN nth = 1 THEN coalesce(held, 0) ELSE 0 END FROM gc JOIN gm USING (sig, ts)""")
def guarded_events(spark, sf_dir) -> DataFrame:
    """The storm guard with a suppression list: one entry for good, one in force, one run out."""
    n, e = F.col("seq"), t.error_events(spark, sf_dir)
    sig = F.concat("event_type", F.lit("|"), (F.col("k") % 6).cast("string"))
    rows = e.select(
        "seq", F.date_trunc("hour", "ts").alias("ts"), sig.alias("sig"), F.when(n % 19 == 0, "health").otherwise(F.col("source")).alias("source"), F.when(n % 43 == 0, "GUARD").otherwise(F.col("marker")).alias("marker"),
        F.when(n % 29 == 0, "traceback").otherwise(F.col("hint")).alias("hint"), "status", "actor",
    )
    end = F.when(F.col("sig").endswith("1"), "").when(F.col("sig").endswith("2"), "2024-01-31").otherwise("2024-02-01")
    listed = rows.select("sig").distinct().where("sig like '%1' or sig like '%2' or sig like '%5'").withColumn("until", end)
    return uk.guarded(rows, listed, "2024-02-01").select("seq", "sig", "verdict", "carried")


@query(f"""WITH {EVENTS}, {pe.AGG}, {pe.STATE}, d AS (SELECT DISTINCT CASE WHEN seq % 50 = 0 THEN 'day-' || day ELSE CAST(day AS VARCHAR) END AS name FROM error_events),
    p AS (SELECT sig, date_diff('day', CAST(last_seen AS DATE), DATE '2024-04-15') AS age, coalesce(investigating, false) AS held, state FROM agg FULL JOIN st USING (sig)), b AS (SELECT DISTINCT 'backup-' || day AS name FROM error_events)
    SELECT 'day' AS kind, name FROM d WHERE name NOT LIKE 'day%' AND name < '2024-01-16' UNION ALL SELECT 'aggregate', sig FROM p WHERE age > 90 AND NOT held
    UNION ALL SELECT 'state', sig FROM p WHERE state IN ('new', 'known', 'resolved') AND NOT held AND age > 45 UNION ALL SELECT 'backup', name FROM (SELECT name, row_number() OVER (ORDER BY name DESC) AS rn FROM b) WHERE rn > 4""")
def prune_slices(spark, sf_dir) -> DataFrame:
    e, day = t.error_events(spark, sf_dir), F.col("day").cast("string")
    days = e.select(F.when(F.col("seq") % 50 == 0, F.concat(F.lit("day-"), day)).otherwise(day).alias("name")).distinct()
    a = pe.aggregates(spark, sf_dir).withColumn("status", F.lit("resolved"))
    return uk.prune_slices(days, a, pe.state(spark, sf_dir), e.select(F.concat(F.lit("backup-"), day).alias("name")).distinct(), F.lit("2024-04-15").cast("date"))


@query(f"""WITH {ENTRIES}, {pq._ISSUES}, o AS (SELECT kid, count(*) AS open FROM issues WHERE status = 'open' GROUP BY kid),
    p AS (SELECT n, kid, zone, domain || '/' || CASE n % 6 WHEN 0 THEN 'Partners/' WHEN 1 THEN 'REVIEW-' WHEN 2 THEN '.trash/_private/' ELSE '' END || kid || '.md' AS path FROM entries)
    SELECT kid, zone <> 'public' OR open IS NULL AND n % 6 > 2 AS ready, CASE WHEN zone = 'public' THEN array_to_string(list_filter([CASE WHEN open > 0 THEN open || ' open sensitive issue(s)' END, CASE WHEN n % 6 = 0 THEN 'file path contains ''partners/'': ' || path END,
        CASE WHEN n % 6 = 2 THEN 'file path contains ''_private/'': ' || path END, CASE WHEN n % 6 = 1 THEN 'file path contains ''review-'': ' || path END, CASE WHEN n % 6 = 2 THEN 'file path contains ''.trash'': ' || path END], lambda v: v IS NOT NULL), '; ') ELSE '' END AS warnings
    FROM p LEFT JOIN o USING (kid)""")
def promotion_checklist(spark, sf_dir) -> DataFrame:
    n = F.col("n")
    part = F.when(n % 6 == 0, "Partners/").when(n % 6 == 1, "REVIEW-").when(n % 6 == 2, ".trash/_private/").otherwise("")
    e = t.entries(spark, sf_dir).withColumn("path", F.concat("domain", F.lit("/"), part, "kid", F.lit(".md")))
    out = uk.promotion_checklist(e, pq.issues(spark, sf_dir).withColumn("type", F.lit("sensitive")), F.col("zone"))
    return out.withColumn("warnings", F.array_join("warnings", "; "))


_QUEUE = f"{pw._RANK}, q AS (SELECT *, CASE WHEN seq % 5 = 0 THEN '' ELSE job END AS j, CASE WHEN seq % 7 <> 0 THEN position END AS pos FROM r)"


def waiting(spark, sf_dir) -> DataFrame:
    n = F.col("seq")
    return pw.ranked(spark, sf_dir).withColumns({"job": F.when(n % 5 == 0, "").otherwise(F.col("job")), "position": F.when(n % 7 != 0, F.col("position")).cast("long")})


@query(f"""WITH {_QUEUE}, g AS (SELECT shelf, coalesce(nullif(j, ''), call) AS job, min(pos) AS position, bool_or(starved) AS starved, arg_min(prio, (pos IS NULL, pos, call)) AS prio, arg_min(class, (pos IS NULL, pos, call)) AS class, count(*) AS calls FROM q GROUP BY 1, 2)
    SELECT shelf, job, position, position - 1 AS ahead, starved, prio, class, calls, CAST(CASE WHEN shelf <> 'shelf2' THEN (position - 1) * 1.5 END AS DOUBLE) AS lower, CAST(CASE WHEN shelf <> 'shelf2' THEN position * 4.0 END AS DOUBLE) AS upper,
        CASE WHEN job LIKE 'j%1' THEN 'high' WHEN job LIKE 'j%2' THEN 'urgent' END AS override, CASE WHEN job LIKE 'j%1' THEN 'job' ELSE 'account' END AS prio_source FROM g""")
def queue_jobs(spark, sf_dir) -> DataFrame:
    times = spark.createDataFrame([("shelf0", 1.5, 4.0), ("shelf1", 1.5, 4.0)], "shelf string, ema_s double, p95_s double")
    calls = waiting(spark, sf_dir)
    jobs = calls.select("job").distinct()
    wanted = jobs.select("job", F.when(F.col("job").endswith("1"), "high").when(F.col("job").endswith("2"), "urgent").alias("prio")).where("prio is not null")
    return uk.queue_jobs(calls, times, wanted)


@query(f"""WITH {_QUEUE}, c AS (SELECT shelf, count(*) AS waiting FROM q GROUP BY shelf) SELECT shelf, CASE WHEN shelf = 'shelf1' THEN 77 WHEN shelf = 'gpu' THEN 0 ELSE coalesce(waiting, 0) END AS depth,
    CASE WHEN shelf IN ('shelf1', 'gpu') THEN 'posq' ELSE 'waiting' END AS depth_source, coalesce(waiting, 0) AS waiting FROM (SELECT shelf FROM c UNION SELECT unnest(['local', 'ext', 'gpu', 'shelf1'])) LEFT JOIN c USING (shelf)""")
def queue_shelves(spark, sf_dir) -> DataFrame:
    return uk.queue_shelves(waiting(spark, sf_dir), spark.createDataFrame([("shelf1", 77), ("gpu", 0)], "shelf string, depth long"))


@query(f"""WITH {POINTS}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)
    SELECT kid, CASE WHEN vec_id % 3 = 0 THEN 'c' || vec_id ELSE CAST(vec_id AS VARCHAR) END AS chunk_id, round(list_cosine_similarity(vector, v), 4) AS score, CASE WHEN vec_id % 4 = 1 THEN 'Part ' || vec_id ELSE {TITLE} END AS title,
        CASE vec_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '{{"source_id":"s' || vec_id || '"}}' ELSE '{{"source_id":"s' || vec_id || '","locator_kind":"page","locator_start":' || vec_id % 9 || ',"locator_end":' || (vec_id % 9 + 1) || '}}' END AS locator FROM points, q""")
def found_points(spark, sf_dir) -> DataFrame:
    """All chunks, scored against the first vector."""
    n, p = F.col("vec_id"), t.points(spark, sf_dir)
    first = t.table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]
    with_ = lambda c: F.when(n % 5 > 1, c)
    rows = p.select(
        "kid", "content", n.alias("id"), F.when(n % 3 == 0, F.concat(F.lit("c"), n.cast("string"))).alias("chunk_id"), cosine_to(list(first))("vector").alias("score"),
        F.when(n % 4 == 1, F.concat(F.lit("Part "), n.cast("string"))).when(n % 4 == 2, "").alias("section_header"), F.when(n % 5 > 0, F.concat(F.lit("s"), n.cast("string"))).alias("source_id"),
        with_(F.lit("page")).alias("locator_kind"), with_(n % 9).alias("locator_start"), with_(n % 9 + 1).alias("locator_end"),
    )
    return uk.found_points(rows)


@query(f"""WITH {pw.SPEND}, j AS (SELECT user, CAST(sum({pw._COST}) AS BIGINT) AS s FROM spend WHERE month = '1995-03' GROUP BY user), m AS (SELECT c_custkey AS user, c_custkey * 1000 AS b FROM customer WHERE c_custkey % 3 <> 0)
    SELECT user, coalesce(b, 0) AS before, coalesce(s, b) AS after, false AS refused FROM j FULL JOIN m USING (user) UNION ALL SELECT NULL, 5000, coalesce((SELECT CAST(sum(s) AS BIGINT) FROM j), 0), false""")
def corrected_budget(spark, sf_dir) -> DataFrame:
    c = t.table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("long").alias("user"), (F.col("c_custkey") * 1000).cast("long").alias("micro"))
    return uk.corrected_budget(c.union(spark.createDataFrame([(None, 5000)], "user long, micro long")), pw.spend(spark, sf_dir), "1995-03", 5000)


@query(f"""WITH {ENTRIES}, a AS (SELECT event_id AS n, 'doc-' || lpad(CAST(event_id % 1300 AS VARCHAR), 8, '0') AS kid, CASE WHEN event_id % 3 = 0 THEN 'published' ELSE 'deprecated' END AS target, event_id % 2 = 0 AS cascade FROM events WHERE event_id % 5 <> 0),
    h AS (SELECT a.*, e.zone, e.parent FROM a JOIN entries e USING (kid)), r AS (SELECT n, kid, target FROM h UNION ALL SELECT h.n, c.kid, h.target FROM h JOIN entries c ON c.parent = h.kid AND c.zone = h.zone WHERE h.cascade OR h.parent IS NULL),
    l AS (SELECT kid, arg_max(target, n) AS target, count(*) AS reached FROM r GROUP BY kid) SELECT kid, coalesce(target, status) AS status, coalesce(reached, 0) AS reached FROM entries LEFT JOIN l USING (kid)""")
def cascaded_statuses(spark, sf_dir) -> DataFrame:
    """Deprecations, restorations, and every fifth time something else."""
    n = F.col("event_id")
    action = F.when(n % 5 == 0, "resolve").when(n % 3 == 0, "restore").otherwise("deprecate")
    acts = t.table(spark, sf_dir, "events").select(n.alias("n"), t.doc_name(n % 1300).alias("kid"), action.alias("action"), (n % 2 == 0).alias("cascade"))
    return uk.cascaded(t.entries(spark, sf_dir), acts)
