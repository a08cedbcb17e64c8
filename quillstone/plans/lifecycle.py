"""Queries of issues, zones, blobs, log classes and bookkeeping, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import score as sc
from quillstone.functions import text as tx
from quillstone.functions import time as tm
from quillstone.operators import lifecycle as lc
from quillstone.operators.events import alert_budget as alert_rows
from quillstone.operators.events import examples as newest_events
from quillstone.operators.events import resolve
from quillstone.plans import events as pe
from quillstone.plans import provenance as pr
from quillstone.plans import quality as pq
from quillstone.plans.sql import ENTRIES
from quillstone.plans.events import E
from quillstone.sources import tables as t

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def events(spark, sf_dir) -> DataFrame:
    return t.table(spark, sf_dir, "events")


ISSUES = """iss AS (SELECT 'i' || n AS issue_id, kid, n AS seq, CASE n % 2 WHEN 0 THEN 'duplicate' ELSE 'missing_field' END AS type,
        CASE n % 5 WHEN 0 THEN 'resolved' WHEN 1 THEN 'ignored' ELSE 'open' END AS status FROM entries),
    acts AS (SELECT CASE WHEN n % 3 = 0 THEN 'i' || n END AS issue_id, kid, CASE n % 18 // 3 WHEN 0 THEN 'merge' WHEN 1 THEN 'deprecate' WHEN 2 THEN 'restore' WHEN 3 THEN 'resolve' ELSE 'ignore' END AS action,
        CASE WHEN n % 2 = 1 THEN 'Not a duplicate at all' END AS reason FROM entries WHERE n % 3 < 2)"""


def issues(spark, sf_dir) -> DataFrame:
    n = F.col("n")
    return t.entries(spark, sf_dir).select(
        F.concat(F.lit("i"), n.cast("string")).alias("issue_id"), "kid", n.alias("seq"), F.when(n % 2 == 0, "duplicate").otherwise("missing_field").alias("type"),
        F.when(n % 5 == 0, "resolved").when(n % 5 == 1, "ignored").otherwise("open").alias("status"),
    )


def actions(spark, sf_dir) -> DataFrame:
    n = F.col("n")
    k = F.floor(n % 18 / 3)
    action = F.when(k == 0, "merge").when(k == 1, "deprecate").when(k == 2, "restore").when(k == 3, "resolve").otherwise("ignore")
    rows = t.entries(spark, sf_dir).where("n % 3 < 2")
    return rows.select(F.when(n % 3 == 0, F.concat(F.lit("i"), n.cast("string"))).alias("issue_id"), "kid", action.alias("action"), F.when(n % 2 == 1, "Not a duplicate at all").alias("reason"))


@query(f"""WITH {ENTRIES}, {ISSUES}, d AS (SELECT iss.*, CASE WHEN a.action IS NULL THEN status WHEN a.action = 'ignore' THEN 'ignored' ELSE 'resolved' END AS st
        FROM iss LEFT JOIN acts a ON a.issue_id = iss.issue_id),
    k AS (SELECT kid, bool_or(action IN ('merge', 'deprecate')) AS c, bool_or(action = 'restore') AS r FROM acts GROUP BY kid)
    SELECT issue_id, kid, type, status AS before, CASE WHEN type = 'duplicate' AND coalesce(c, false) AND st = 'open' THEN 'resolved'
        WHEN type = 'duplicate' AND coalesce(r, false) AND st = 'resolved' THEN 'open' ELSE st END AS status FROM d LEFT JOIN k USING (kid)""")
def resolve_issues(spark, sf_dir) -> DataFrame:
    return lc.apply_actions(issues(spark, sf_dir), actions(spark, sf_dir))


@query(f"""WITH {ENTRIES}, {ISSUES}, a AS (SELECT kid, CASE WHEN action = 'resolve' AND lower(reason) LIKE '%not a duplicate%' THEN 'fp_rejection' WHEN action = 'merge' THEN 'merge'
    WHEN action = 'deprecate' THEN 'deprecated' WHEN action = 'restore' THEN 'restored' END AS action FROM acts) SELECT * FROM a WHERE action IS NOT NULL""")
def issue_audit(spark, sf_dir) -> DataFrame:
    return lc.action_audit(actions(spark, sf_dir))


@query(f"""WITH {ENTRIES}, {ISSUES} SELECT issue_id, type = 'duplicate' AND status = 'open' AND seq % 7 < 3 AS changed,
    CASE WHEN type = 'duplicate' AND status = 'open' AND seq % 7 < 3 THEN 'ignored' ELSE status END AS status FROM iss""")
def bulk_resolve(spark, sf_dir) -> DataFrame:
    wanted = (F.col("type") == "duplicate") & (F.col("seq") % 7 < 3)
    return lc.bulk_resolve(issues(spark, sf_dir), wanted, "ignored").select("issue_id", "changed", "status")


@query(f"WITH {ENTRIES}, {ISSUES} SELECT issue_id, seq FROM iss WHERE status = 'open' ORDER BY seq DESC LIMIT 20")
def newest_issues(spark, sf_dir) -> DataFrame:
    return lc.newest(issues(spark, sf_dir).where("status = 'open'"), 20).select("issue_id", "seq")


@query("""WITH s AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'done' ELSE 'running' END AS status, CASE WHEN event_id % 11 = 0 THEN NULL ELSE date_trunc('second', ts) END AS t0 FROM events),
    a AS (SELECT *, greatest(0, CAST(epoch(TIMESTAMP '2024-01-15 00:00:00') - epoch(t0) AS BIGINT)) AS age FROM s)
    SELECT id, CASE WHEN t0 IS NULL THEN 0 ELSE age END AS age, status = 'running' AND t0 IS NOT NULL AND age > 600 AS stalled FROM a""")
def stalled_scans(spark, sf_dir) -> DataFrame:
    N = F.col("event_id")  # noqa: N806
    raw = F.when(N % 11 == 0, "no time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    s = events(spark, sf_dir).select(N.alias("id"), F.when(N % 3 == 0, "done").otherwise("running").alias("status"), raw.alias("updated_at"))
    return lc.stalled(s, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("id", F.coalesce("age", F.lit(0)).alias("age"), "stalled")


_ZONE = ["public", "private", "both", "auto", "", "moon"]


@query(f"""WITH r AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'write' WHEN 1 THEN 'system' ELSE 'read' END AS level, event_id % 3 AS sc,
        {_ZONE}[event_id % 7 + 1] AS zone FROM events)
    SELECT id, CASE WHEN level <> 'read' THEN CASE WHEN zone IN ('public', 'private') THEN zone WHEN zone IS NULL OR zone IN ('both', 'auto', '') THEN 'both' ELSE 'unknown' END
        WHEN zone IN ('public', 'private') THEN CASE WHEN sc = 2 OR (sc = 0 AND zone = 'public') OR (sc = 1 AND zone = 'private') THEN zone ELSE 'denied' END
        WHEN zone IS NULL OR zone IN ('both', 'auto', '') THEN ['public', 'private', 'both'][sc + 1] ELSE 'unknown' END AS zone FROM r""")
def zone_requests(spark, sf_dir) -> DataFrame:
    N = F.col("event_id")  # noqa: N806
    level = F.when(N % 4 == 0, "write").when(N % 4 == 1, "system").otherwise("read")
    scope = F.when(N % 3 == 0, F.array(F.lit("public"))).when(N % 3 == 1, F.array(F.lit("private"))).otherwise(F.array(F.lit("public"), F.lit("private")))
    zone = F.get(F.array(*map(F.lit, _ZONE)), (N % 7).cast("int"))
    return events(spark, sf_dir).select(N.alias("id"), lc.resolved_zone(level, scope, zone).alias("zone"))


@query("""SELECT event_id AS id, event_type AS tool, coalesce(m.tool IS NOT NULL, false) AS allowed FROM events e LEFT JOIN
    (VALUES (0, 'view'), (0, 'click'), (1, 'view'), (1, 'click'), (1, 'purchase')) m(level, tool) ON m.level = e.event_id % 3 AND m.tool = e.event_type""")
def tool_permissions(spark, sf_dir) -> DataFrame:
    N = F.col("event_id")  # noqa: N806
    matrix = spark.createDataFrame([(0, "view"), (0, "click"), (1, "view"), (1, "click"), (1, "purchase")], "level long, tool string")
    return lc.permitted(events(spark, sf_dir).select(N.alias("id"), (N % 3).alias("level"), F.col("event_type").alias("tool")), matrix).select("id", "tool", "allowed")


@query("SELECT event_id AS id FROM events WHERE event_id % 5 <> 0 AND event_id % 4 IN (1, 2)")
def egress_guard(spark, sf_dir) -> DataFrame:
    N = F.col("event_id")  # noqa: N806
    zone, shelf = F.when(N % 5 == 0, "public").otherwise("private"), F.when(N % 4 == 1, "ext").when(N % 4 == 2, "cloud").otherwise("local")
    return lc.egress(events(spark, sf_dir).select(N.alias("id"), zone.alias("zone"), shelf.alias("shelf"))).select("id")


@query("""WITH x AS (SELECT p_partkey AS n, 's' || p_partkey AS source_id, CASE WHEN p_partkey % 3 = 0 THEN 'c1' END AS c, CASE WHEN p_partkey % 4 <> 0 THEN ['d1', 'd2'] END AS d,
        CASE WHEN p_partkey % 5 = 0 THEN 'c2' END AS c2, CASE WHEN p_partkey % 7 < 3 THEN ['d2', 'd3'] END AS d2 FROM part)
    SELECT source_id, coalesce(c, c2) AS canonical, array_to_string(coalesce(d, []) || list_filter(coalesce(d2, []), lambda v: NOT list_contains(coalesce(d, []), v)), ',') AS derived,
        coalesce((c IS NULL AND c2 IS NOT NULL) OR len(list_filter(coalesce(d2, []), lambda v: NOT list_contains(coalesce(d, []), v))) > 0, false) AS attached FROM x""")
def blob_merge(spark, sf_dir) -> DataFrame:
    n, two = F.col("p_partkey"), lambda a, b: F.array(F.lit(a), F.lit(b))
    base = t.table(spark, sf_dir, "part").select(n, F.concat(F.lit("s"), n.cast("string")).alias("source_id"))
    old = base.select("source_id", F.when(n % 3 == 0, "c1").alias("canonical"), F.when(n % 4 != 0, two("d1", "d2")).alias("derived"))
    new = base.select("source_id", F.when(n % 5 == 0, "c2").alias("canonical"), F.when(n % 7 < 3, two("d2", "d3")).alias("derived"))
    return lc.merged_blobs(old, new).select("source_id", "canonical", F.array_join("derived", ",").alias("derived"), "attached")


@query(f"""WITH {ENTRIES}, g AS (SELECT 's' || p_partkey AS source_id FROM part WHERE p_partkey % 5 = 0), e AS (SELECT kid, 's' || (n % 400) AS source_id FROM entries),
    r AS (SELECT 's' || ps AS source_id, 'b' || (ps // 3) AS sha FROM (SELECT p_partkey AS ps FROM part))
    SELECT 'source' AS kind, source_id AS id FROM g UNION ALL SELECT 'entry', kid FROM e WHERE source_id IN (SELECT source_id FROM g)
    UNION ALL SELECT 'blob', sha FROM (SELECT DISTINCT sha FROM r WHERE source_id IN (SELECT source_id FROM g)) WHERE sha NOT IN (SELECT sha FROM r WHERE source_id NOT IN (SELECT source_id FROM g))""")
def teardown_plan(spark, sf_dir) -> DataFrame:
    n = F.col("p_partkey")
    part = t.table(spark, sf_dir, "part").select(n, F.concat(F.lit("s"), n.cast("string")).alias("source_id"))
    e = t.entries(spark, sf_dir).select("kid", F.concat(F.lit("s"), (F.col("n") % 400).cast("string")).alias("source_id"))
    return lc.teardown(part.where(n % 5 == 0), e, part.select("source_id", F.concat(F.lit("b"), F.expr("p_partkey div 3").cast("string")).alias("sha")))


@query("""SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'normal' END AS prio, CASE WHEN event_id % 5 < 2 THEN 'job' ELSE 'account' END AS source FROM events""")
def job_priority(spark, sf_dir) -> DataFrame:
    N = F.col("event_id")  # noqa: N806
    job = F.when(N % 5 == 0, "high").when(N % 5 == 1, "low").when(N % 5 == 2, "urgent!")
    j = events(spark, sf_dir).select(N.alias("id"), F.lit("normal").alias("account_prio"), job.alias("job_prio"))
    return lc.job_priorities(j, ("high", "normal", "low")).select("id", "prio", "source")


@query("SELECT event_type AS model, count(*) AS calls, CAST(sum(user_id) AS BIGINT) AS tokens, max(value) AS slowest_s, arg_max(event_id, (value, event_id)) AS slowest FROM events GROUP BY event_type")
def journal_summary(spark, sf_dir) -> DataFrame:
    rows = events(spark, sf_dir).groupBy(F.col("event_type").alias("model"))
    return rows.agg(F.count(F.lit(1)).alias("calls"), F.sum("user_id").alias("tokens"), F.max("value").alias("slowest_s"), F.max_by("event_id", F.struct("value", "event_id")).alias("slowest"))


@query(f"""WITH {ENTRIES} SELECT 'zone_' || zone AS name, count(*) AS n FROM entries GROUP BY zone UNION ALL SELECT 'kind_' || coalesce(content_type, 'other'), count(*) FROM entries GROUP BY 1
    UNION ALL SELECT 'all', count(*) FROM entries""")
def collection_sizes(spark, sf_dir) -> DataFrame:
    e = t.entries(spark, sf_dir)
    names = F.array(F.concat(F.lit("zone_"), "zone"), F.concat(F.lit("kind_"), F.coalesce("content_type", F.lit("other"))), F.lit("all"))
    return e.select(F.explode(names).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT user_id AS key, event_id AS seq, event_id % 4 = 0 AS ok FROM events), g AS (SELECT key, max(seq) FILTER (ok) AS good FROM a GROUP BY key),
    n AS (SELECT key, (count(*) - 1) % 3 + 1 AS attempts FROM a JOIN g USING (key) WHERE NOT ok AND (good IS NULL OR seq > good) GROUP BY key)
    SELECT key, attempts, attempts >= 3 AS dead, CASE WHEN attempts < 3 THEN CAST(pow(4, attempts - 1) AS BIGINT) END AS wait FROM n""")
def retry_state(spark, sf_dir) -> DataFrame:
    N = F.col("event_id")  # noqa: N806
    return lc.retries(events(spark, sf_dir).select(F.col("user_id").alias("key"), N.alias("seq"), (N % 4 == 0).alias("ok")))


@query("SELECT user_id AS key, array_to_string(list_sort(list_distinct(list('z' || event_id % 4) || ['own'])), ',') AS scopes FROM events GROUP BY user_id")
def scope_union(spark, sf_dir) -> DataFrame:
    N = F.col("event_id")  # noqa: N806
    grants = events(spark, sf_dir).groupBy(F.col("user_id").alias("key")).agg(F.collect_set(F.concat(F.lit("z"), (N % 4).cast("string"))).alias("g"))
    return grants.select("key", F.array_join(F.array_sort(F.array_union("g", F.array(F.lit("own")))), ",").alias("scopes"))


@query(f"WITH {ENTRIES} SELECT kid, zone FROM entries WHERE n % 9 = 0")
def zone_collisions(spark, sf_dir) -> DataFrame:
    """Wanted ids that either zone has."""
    e = t.entries(spark, sf_dir)
    wanted = e.where("n % 9 = 0").select("kid").union(e.where("n % 9 = 0").select(F.concat("kid", F.lit("-new"))))
    both = e.where("zone = 'public'").select("kid", "zone").union(e.where("zone = 'private'").select("kid", "zone"))
    return both.join(wanted, "kid", "left_semi")


@query("""SELECT sha256(event_type || '/' || user_id)[1:16] AS id, max(day) AS day, max(day) + 30 AS expires FROM (SELECT *, event_id % 60 AS day FROM events) GROUP BY event_type, user_id HAVING max(day) + 30 > 80""")
def artifacts(spark, sf_dir) -> DataFrame:
    N = F.col("event_id")  # noqa: N806
    rows = events(spark, sf_dir).select(F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")).alias("content"), (N % 60).alias("day"))
    return lc.artifacts(rows, 80).select("id", "day", "expires")


@query(f"""WITH {ENTRIES} SELECT kid, CASE WHEN n % 3 = 0 AND n % 4 = 0 THEN NULL ELSE seq END AS seq, n % 3 = 0 AND n % 4 <> 0 AND seq IS NOT NULL AS filled FROM entries""")
def sequence_backfill(spark, sf_dir) -> DataFrame:
    e = t.entries(spark, sf_dir)
    store = e.where("n % 4 <> 0 and seq is not null").select("kid", "seq")
    return lc.backfilled(e.select("kid", F.when(F.col("n") % 3 != 0, F.col("seq")).alias("seq")), store.union(store))


@query(f"""WITH {ENTRIES}, {pq._INDEX}, st AS (SELECT kid, CASE WHEN indexed IS NULL THEN 'missing' WHEN explicit IS NULL THEN 'orphan'
        WHEN (CASE WHEN i.updated_day IS NULL THEN explicit WHEN NOT explicit THEN false ELSE s.updated_day > i.updated_day END) THEN 'drifted' ELSE 'ok' END AS state
        FROM entries s FULL JOIN idx i USING (kid))
    SELECT kid, CASE WHEN (SELECT count(*) FROM st WHERE state IN ('missing', 'drifted')) > 50 THEN 'full' ELSE 'incremental' END AS mode FROM st
    WHERE state <> 'orphan' AND ((SELECT count(*) FROM st WHERE state IN ('missing', 'drifted')) > 50 OR state IN ('missing', 'drifted'))""")
def index_plan(spark, sf_dir) -> DataFrame:
    return lc.index_plan(pq.QUERIES["reconcile"](spark, sf_dir))


@query("""WITH r AS (SELECT event_id % 500 AS kid, CASE WHEN event_id % 7 = 0 THEN 'bad ' || event_id % 3 ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS u, CASE WHEN event_id % 7 <> 0 THEN date_trunc('second', ts) END AS t0 FROM events)
    SELECT kid, coalesce(arg_max(u, t0) FILTER (t0 IS NOT NULL), max(u)) AS updated_at FROM r GROUP BY kid""")
def latest_updates(spark, sf_dir) -> DataFrame:
    N = F.col("event_id")  # noqa: N806
    raw = F.when(N % 7 == 0, F.concat(F.lit("bad "), (N % 3).cast("string"))).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return lc.latest_updates(events(spark, sf_dir).select((N % 500).alias("kid"), raw.alias("updated_at")))


@query("""WITH s AS (SELECT event_id % 700 AS chunk, CASE WHEN event_id % 3 = 0 THEN 'page' ELSE 'section' END AS kind, event_id AS char_start, user_id AS start, user_id + event_id % 5 AS stop FROM events),
    k AS (SELECT chunk, arg_min(kind, char_start) AS kind FROM s GROUP BY chunk) SELECT chunk, kind, min(start) AS start, max(stop) AS stop FROM s JOIN k USING (chunk, kind) GROUP BY ALL""")
def locator_payloads(spark, sf_dir) -> DataFrame:
    N = F.col("event_id")  # noqa: N806
    u = F.col("user_id")
    s = events(spark, sf_dir).select((N % 700).alias("chunk"), F.when(N % 3 == 0, "page").otherwise("section").alias("kind"), N.alias("char_start"), u.alias("start"), (u + N % 5).alias("stop"))
    return lc.locator_payload(s)


# a line kind with its level, marker, status, text and what becomes of it: expected, hint
_LINES = [
    ("ERROR", None, None, "boom", False, None), (None, "REQ", 500, "GET /x", False, None), (None, "MCP", None, "[MCP] tool=a error", False, None),
    ("WARNING", None, None, "mcp_knowledge.pipeline Очередь переполнена — blocking put", True, None), (None, None, 429, "GET /y", True, None), (None, None, 429, "GET /errors", False, None),
    ("WARNING", None, None, "mcp_knowledge.rate_limit Rate limit exceeded key=anonymous", True, None), ("WARNING", None, None, "mcp_knowledge.rate_limit Rate limit exceeded key=ab12", False, None),
    ("INFO", "MCP", None, "[MCP] tool=a ok in 12.5 ms", True, None), ("INFO", "MCP", None, "[MCP] tool=a ok in 61000 ms", False, "slow"), (None, "MCP", None, "[MCP] tool=a start", True, None),
    (None, "MCP", None, "[MCP] what", False, None), (None, "REQ", 200, "GET /z", True, None), (None, "REQ", 404, "GET /z", False, None), (None, "ERRORS_QUERY", None, "errors_query n=3", True, None),
    (None, "ERRORS_QUERY", None, "errors_query failed", False, None), (None, "GIN", 302, "GET", True, None), (None, "GIN", 404, "GET", False, None), (None, None, None, "plain", False, None),
]
_EXPECTED = "[" + ", ".join(str(x[4]).lower() for x in _LINES) + "]"


@query(f"SELECT event_id AS id, {_EXPECTED}[event_id % {len(_LINES)} + 1] AS expected, CASE WHEN event_id % {len(_LINES)} = 9 THEN 'slow' END AS hint FROM events")
def routine_classes(spark, sf_dir) -> DataFrame:
    """Every rule of the ladder, by a table of planted lines."""
    N = F.col("event_id")  # noqa: N806
    kinds = spark.createDataFrame([(k, *x[:4]) for k, x in enumerate(_LINES)], "kind long, level string, marker string, status int, rest string")
    rows = events(spark, sf_dir).select(N.alias("id"), (N % len(_LINES)).alias("kind")).join(F.broadcast(kinds), "kind")
    c = lc.routine_class(F.col("rest"), F.col("level"), F.col("marker"), F.col("status"))
    return rows.select("id", c["expected"].alias("expected"), c["hint"].alias("hint"))


@query("""SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'ERROR' WHEN 3 THEN 'INFO' WHEN 4 THEN CASE WHEN event_id % 4 = 0 THEN 'ERROR' ELSE 'WARNING' END END AS level,
    CASE event_id % 6 WHEN 0 THEN 'oom' WHEN 1 THEN 'restart' WHEN 2 THEN 'restart' WHEN 4 THEN CASE WHEN event_id % 4 = 0 THEN 'health_degraded' END END AS hint FROM events WHERE event_id % 6 <> 5""")
def lifecycle_events(spark, sf_dir) -> DataFrame:
    N = F.col("event_id")  # noqa: N806
    k = N % 6
    action = F.when(k == 0, "oom").when(k == 1, "restart").when(k.isin(2, 3), "die").when(k == 4, "health_status").otherwise("pull")
    e = lc.lifecycle_event(action, F.when(k == 2, F.when(N % 4 == 0, 137)).otherwise(0), F.when(N % 4 == 0, "unhealthy").otherwise("healthy"))
    return events(spark, sf_dir).select(N.alias("id"), e.alias("e")).where("e is not null").select("id", "e.level", "e.hint")


@query("""SELECT event_id AS id, 'top' AS kind, 'm' || i AS message, CASE i WHEN 0 THEN event_id % 5 ELSE 0 END AS persons, CASE WHEN i = 0 AND event_id % 5 >= 3 THEN 'P1' END AS hint
    FROM events, range(0, 2) r(i) WHERE event_id % 4 <> 0""")
def pulled_rows(spark, sf_dir) -> DataFrame:
    N = F.col("event_id")  # noqa: N806
    line = F.when(N % 4 == 0, "{not json").otherwise(F.concat(F.lit('{"kind":"top","rows":[{"message":"m0","persons":'), (N % 5).cast("string"), F.lit('},{"message":"m1"},{"other":1}]}')))
    return lc.pulled_rows(events(spark, sf_dir).select(N.alias("id"), line.alias("line")))


_WHYS = " ".join(f"WHEN contains(sig, '{k}') THEN '{v}'" for k, v in lc.SUPPRESS_HINTS.items())
_RULES = " ".join(f"WHEN contains(sig, '{k}') OR contains(lower(example), '{k.replace('_', ' ')}') THEN '{v}'" for k, v in lc.RULE_HINTS.items())


@query(f"""WITH x AS (SELECT event_id AS id, 'api|' || CASE event_id % 7 WHEN 0 THEN '404|x' WHEN 1 THEN 'LIFECYCLE|docker event: die' WHEN 2 THEN 'degraded:http_401' WHEN 3 THEN 'cron_nonzero' WHEN 4 THEN '400|5xx' ELSE event_type END AS sig,
        event_id % 3 = 0 AS odd, CASE event_id % 5 WHEN 0 THEN 'Disk Critical on a' WHEN 1 THEN 'a hang' WHEN 2 THEN 'health degraded' WHEN 3 THEN '' END AS example FROM events)
    SELECT id, CASE WHEN NOT odd THEN CASE {_WHYS} END END AS why, CASE {_RULES} ELSE '{lc.OTHER_RULE}' END AS rule FROM (SELECT id, sig, odd, coalesce(example, '') AS example FROM x)""")
def signature_hints(spark, sf_dir) -> DataFrame:
    n = F.col("event_id")
    kind = F.when(n % 7 == 0, "404|x").when(n % 7 == 1, "LIFECYCLE|docker event: die").when(n % 7 == 2, "degraded:http_401").when(n % 7 == 3, "cron_nonzero").when(n % 7 == 4, "400|5xx").otherwise(F.col("event_type"))
    sig = F.concat(F.lit("api|"), kind)
    example = F.when(n % 5 == 0, "Disk Critical on a").when(n % 5 == 1, "a hang").when(n % 5 == 2, "health degraded").when(n % 5 == 3, "")
    return events(spark, sf_dir).select(n.alias("id"), lc.suppress_hint(sig, n % 3 == 0).alias("why"), lc.rule_hint(sig, example).alias("rule"))


@query("""WITH RECURSIVE l AS MATERIALIZED (SELECT event_id // 200 AS source, event_id AS seq, row_number() OVER (PARTITION BY event_id // 200 ORDER BY event_id) AS i, CASE WHEN event_id % 11 IN (3, 4) THEN 'Traceback (most recent call last):'
        WHEN event_id % 11 IN (5, 6, 9) THEN '  at ' || event_id WHEN event_id % 11 = 7 THEN 'ValueError: ' || event_id ELSE 'fine' END AS line FROM events),
    w AS (SELECT source, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS start, false AS more, CAST(NULL AS BIGINT) AS block FROM (SELECT DISTINCT source FROM l)
        UNION ALL SELECT source, i, block, block IS NOT NULL AND (NOT old OR indented), block FROM (
            SELECT l.source, l.i, w.more AS old, l.line[1] = ' ' AS indented, CASE WHEN w.more THEN w.block WHEN starts_with(l.line, 'Traceback (') THEN l.seq END AS block FROM w JOIN l ON l.source = w.source AND l.i = w.i + 1))
    SELECT source, block AS start, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS message FROM w JOIN l USING (source, i) WHERE block IS NOT NULL GROUP BY ALL""")
def error_blocks(spark, sf_dir) -> DataFrame:
    """Heads, one of them closing another's block, indented lines inside and outside of blocks, and errors."""
    n = F.col("event_id")
    k, at = n % 11, F.concat(F.lit("  at "), n.cast("string"))
    line = F.when(k.isin(3, 4), "Traceback (most recent call last):").when(k.isin(5, 6, 9), at).when(k == 7, F.concat(F.lit("ValueError: "), n.cast("string"))).otherwise("fine")
    return lc.error_blocks(events(spark, sf_dir).select(F.expr("event_id div 200").alias("source"), n.alias("seq"), line.alias("line")))


@query(f"{E}, {pe.WEEKS}, {pe.AGG} SELECT sig, priority, count_7d FROM agg JOIN w USING (sig) ORDER BY priority, count_7d DESC, sig LIMIT 100")
def priority_view(spark, sf_dir) -> DataFrame:
    a = pe.aggregates(spark, sf_dir).join(pe.weeks(spark, sf_dir).select("sig", "count_7d"), "sig")
    return lc.priority_view(a).select("sig", "priority", "count_7d")


@query(f"{E}, {pe.GUARD}, d AS (SELECT sig, CAST(t.ts AS DATE) AS day, count(*) AS n FROM g JOIN error_events t USING (seq) WHERE NOT allowed GROUP BY ALL) SELECT sig, CAST(sum(n) AS BIGINT) AS suppressed FROM d WHERE day >= DATE '2024-01-23' GROUP BY sig".replace("SELECT sig, CAST(t.ts", "SELECT g.sig, CAST(t.ts"))
def suppressed_7d(spark, sf_dir) -> DataFrame:
    daily = pe.guarded(spark, sf_dir).where("not allowed").groupBy("sig", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return daily.where("day >= date'2024-01-23'").groupBy("sig").agg(F.sum("n").alias("suppressed"))


@query(f"""{E}, {pe.AGG}, r AS (SELECT *, date_diff('day', CAST(last_seen AS DATE), DATE '2024-02-05') AS age, CASE WHEN date_diff('day', CAST(last_seen AS DATE), DATE '2024-02-05') >= 7 THEN 'resolved' ELSE 'active' END AS status FROM agg),
    x AS (SELECT *, CASE WHEN status = 'resolved' OR count_total % 2 = 0 THEN CASE WHEN count_total % 3 = 0 THEN first_seen ELSE last_seen END END AS fixed_at FROM r),
    f AS (SELECT (floor(epoch(fixed_at)) - floor(epoch(first_seen))) / 3600 AS h, row_number() OVER (ORDER BY (floor(epoch(fixed_at)) - floor(epoch(first_seen))) / 3600) AS rn, count(*) OVER () AS n FROM x WHERE count_total % 2 = 0 AND fixed_at IS NOT NULL)
    SELECT count(*) FILTER (priority IN ('P0', 'P1') AND count_total % 2 = 1) AS active, count(*) FILTER (priority IN ('P0', 'P1') AND age <= 30) AS recent,
        count(*) FILTER (priority IN ('P0', 'P1') AND count_total % 2 = 0 AND fixed_at IS NOT NULL) AS rule_candidates, count(*) FILTER (count_total % 2 = 0 AND last_seen > fixed_at) AS relapses,
        count(*) FILTER (count_total % 2 = 0 AND fixed_at IS NOT NULL) AS fixed, (SELECT round(h, 1) FROM f WHERE rn = n // 2 + 1) AS median_hours FROM x""")
def weekly_metrics(spark, sf_dir) -> DataFrame:
    n, now = F.col("count_total"), F.lit("2024-02-05").cast("date")
    a = resolve(pe.aggregates(spark, sf_dir), now)
    done = (F.col("status") == "resolved") | (n % 2 == 0)
    a = a.withColumns({"fixed_at": F.when(done, F.when(n % 3 == 0, F.col("first_seen")).otherwise(F.col("last_seen"))), "status": F.when(n % 2 == 0, "resolved").otherwise("active")})
    return lc.weekly_metrics(a, now)


@query(f"""WITH c AS (SELECT sig, kind, last_seen FROM ({pe.ORACLE['alert_candidates']}) a JOIN ({E}, {pe.AGG} SELECT sig, last_seen FROM agg) l USING (sig)),
    r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN kind = 'new_p0' THEN 0 ELSE 1 END, last_seen DESC, sig) AS rank FROM c)
    SELECT kind, sig, 1 AS n, true AS sent FROM r WHERE rank <= 2 UNION ALL SELECT 'tail', NULL, count(*), true FROM r WHERE rank > 2 HAVING count(*) > 0""")
def alert_budget(spark, sf_dir) -> DataFrame:
    last = pe.aggregates(spark, sf_dir).select("sig", "last_seen")
    return alert_rows(pe.QUERIES["alert_candidates"](spark, sf_dir).join(last, "sig"))


@query("""SELECT event_id AS id, CAST(floor((event_id % 100 + user_id + 3) / 4) AS BIGINT) AS tokens, sha256('ask ' || event_type || chr(10) || 'end') AS prompt,
    CASE event_id % 4 WHEN 0 THEN CAST(floor(epoch(ts)) AS BIGINT) WHEN 1 THEN CAST(floor(epoch(ts)) AS BIGINT) - 10800 WHEN 2 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS at_s FROM events""")
def calls_and_times(spark, sf_dir) -> DataFrame:
    """Token estimates, prompt hashes that ignore white space at line ends, and times as they are written."""
    n = F.col("event_id")
    prompt = F.concat(F.lit("ask "), F.col("event_type"), F.when(n % 2 == 0, F.lit("  \t")).otherwise(F.lit("")), F.lit("\nend"))
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    written = F.when(n % 4 == 0, F.concat(plain, F.lit(".123456789Z"))).when(n % 4 == 1, F.concat(plain, F.lit("+03:00"))).when(n % 4 == 2, plain).otherwise(F.concat(F.lit("on "), plain))
    at = F.unix_timestamp(tm.parse_instant(written))
    return t.table(spark, sf_dir, "events").select(n.alias("id"), sc.usage_tokens(n % 100, F.col("user_id")).alias("tokens"), tx.prompt_hash(prompt).alias("prompt"), at.alias("at_s"))


@query(f"""{E}, {pe.AGG}, x AS (SELECT *, CASE WHEN count_total % 2 = 0 THEN 'resolved' ELSE 'active' END AS status FROM agg),
    e AS (SELECT sig, seq, row_number() OVER (PARTITION BY sig ORDER BY ts DESC, seq DESC) AS rank FROM error_events)
    SELECT x.sig, status, count(e.seq) AS examples, max(e.seq) AS newest FROM x JOIN e ON e.sig = x.sig AND rank <= 3 WHERE status = 'active' AND contains(lower(x.sig), 'e') GROUP BY ALL""")
def errors_with_examples(spark, sf_dir) -> DataFrame:
    """Active signatures that match, each with its three newest events."""
    a = pe.aggregates(spark, sf_dir).withColumn("status", F.when(F.col("count_total") % 2 == 0, "resolved").otherwise("active"))
    found = lc.filtered(a, status="active", text="E")
    e = newest_events(t.error_events(spark, sf_dir)).select("sig", "seq")
    return found.join(e, "sig").groupBy("sig", "status").agg(F.count("seq").alias("examples"), F.max("seq").alias("newest"))


@query(f"""{E}, {pe.AGG} SELECT sig, count_total FROM agg WHERE sig = 'error|3'""")
def exact_signature(spark, sf_dir) -> DataFrame:
    return lc.filtered(pe.aggregates(spark, sf_dir), sig="error|3").select("sig", "count_total")


@query(f"""WITH {pr.REFS}, {pr.BLOBS}, d AS (SELECT CASE WHEN actual_sha256 IS NULL THEN 'missing' WHEN actual_sha256 <> refs.sha256 THEN 'mismatch' END AS defect, ref_kind = 'canonical' AS lost
        FROM refs LEFT JOIN blobs ON blobs.sha256 = refs.sha256) SELECT coalesce(defect, 'ok') AS defect, count(*) AS n, count(*) FILTER (lost AND defect IS NOT NULL) AS canonical_lost FROM d GROUP BY 1""")
def integrity_counts(spark, sf_dir) -> DataFrame:
    all_ = pr.refs(spark, sf_dir)
    bad = pr.QUERIES["integrity"](spark, sf_dir).groupBy("defect").agg(F.count(F.lit(1)).alias("n"), F.count_if("canonical_lost").alias("canonical_lost"))
    rest = all_.agg(F.count(F.lit(1)).alias("all")).join(F.broadcast(bad.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bad"))))
    return bad.unionByName(rest.select(F.lit("ok").alias("defect"), (F.col("all") - F.col("bad")).alias("n"), F.lit(0).cast("long").alias("canonical_lost")).where("n > 0"))
