"""Queries of imports, sessions, progress, offsets and drift, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import bookkeeping as bk
from quillstone.operators import authoring as au
from quillstone.plans import authoring as pa
from quillstone.operators import neighbours as nb
from quillstone.plans import events as pe
from quillstone.plans import quality as pq
from quillstone.plans.events import E
from quillstone.plans.sql import ENTRIES, POINTS
from quillstone.sources import tables as t

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


_PARTS = pa.ORACLE["hybrid_sections"].replace("SELECT kid, row_number() OVER (PARTITION BY kid ORDER BY nth, part) AS seq, title, length(body) AS chars, sha256(body) AS digest FROM parts", "")
_D, _S = "coalesce(nullif({}, ''), 'domain')", "coalesce(nullif({}, ''), 'subject')"
_ROOT = "{d} || '-' || {s} || '-' || {t}[1:greatest(0, least(length({t}), 124 - length({d}) - length({s}) - {n}))] || '-' || {x}"
_SLUG = pa._SLUG


@query(f"""{_PARTS}, q AS (SELECT kid AS book, row_number() OVER (PARTITION BY kid ORDER BY nth, part) AS seq, {_SLUG.format('title')} AS t FROM parts),
    e AS (SELECT kid AS book, {_D.format(_SLUG.format('domain'))} AS d, {_S.format(_SLUG.format('subject'))} AS s FROM marked),
    x AS (SELECT book, seq, d, s, t, CASE WHEN seq < 1000 THEN lpad(CAST(seq AS VARCHAR), 3, '0') ELSE CAST(seq AS VARCHAR)[1:3] END AS suffix FROM q JOIN e USING (book)),
    r AS (SELECT book, d, s, {_SLUG.format("'Book ' || book")} AS t FROM e)
    SELECT book, seq, {_ROOT.format(d='d', s='s', t='t', n='length(suffix)', x='suffix')} AS kid FROM x
    UNION ALL SELECT book, 0, {_ROOT.format(d='d', s='s', t='t', n='10', x="'collection'")} FROM r""")
def import_book(spark, sf_dir) -> DataFrame:
    texts = pa.marked(spark, sf_dir).withColumn("title", F.concat(F.lit("Book "), "kid"))
    old = texts.select(F.col("kid").alias("book"), F.lit(1).cast("long").alias("seq"), F.lit("old").alias("kid"))
    return bk.imported_book(texts, old)


_ISSUES = pq.ORACLE["frontmatter_gate"].removeprefix(f"WITH {ENTRIES} ")


@query(f"""WITH {POINTS}, gate AS ({_ISSUES}), f AS (SELECT kid, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity <> 'critical') AS w FROM gate GROUP BY kid),
    s AS (SELECT q.kid, p.kid AS other, list_cosine_similarity(q.vector, p.vector) AS cs FROM points q JOIN points p USING (domain) WHERE q.kid <> p.kid),
    r AS (SELECT *, row_number() OVER (PARTITION BY kid ORDER BY cs DESC, other) AS rank FROM s), d AS (SELECT kid, count(*) AS d FROM r WHERE rank <= 8 AND cs >= 0.92 GROUP BY kid),
    b AS (SELECT *, count(*) OVER (PARTITION BY book) <= 500 AS checked FROM (SELECT coalesce(parent, kid) AS book, kid FROM entries))
    SELECT book, kid, checked, CASE WHEN checked THEN coalesce(c, 0) END AS issues, CASE WHEN checked THEN coalesce(w, 0) + CASE WHEN d > 0 THEN 1 ELSE 0 END END AS warnings,
        CASE WHEN checked THEN coalesce(d, 0) END AS duplicates FROM b LEFT JOIN f USING (kid) LEFT JOIN d USING (kid)""")
def import_report(spark, sf_dir) -> DataFrame:
    """Every entry asks the gate, by each of its vectors; books of up to 500 sections are checked, as in the reference."""
    p = t.points(spark, sf_dir).select("kid", "domain", "vector")
    near = nb.duplicate_gate(p, p)
    sections = t.entries(spark, sf_dir).select(F.coalesce("parent", "kid").alias("book"), "kid")
    return bk.import_report(sections, pq.QUERIES["frontmatter_gate"](spark, sf_dir), near)


@query("SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id ORDER BY conv_id DESC LIMIT 20")
def session_list(spark, sf_dir) -> DataFrame:
    return bk.sessions(t.table(spark, sf_dir, "conversations"), 20)


@query("SELECT conv_id, turn FROM conversations WHERE conv_id % 3 <> 0")
def session_purge(spark, sf_dir) -> DataFrame:
    c = t.table(spark, sf_dir, "conversations")
    return bk.purged(c, c.where("conv_id % 3 = 0")).select("conv_id", "turn")


@query("""WITH p AS (SELECT user_id AS job, event_id AS seq, event_type AS phase, event_id % 4 AS n, 20 AS total, 'l' || event_id AS line FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY seq DESC) AS rank FROM p)
    SELECT job, CAST(sum(n) AS BIGINT) AS done, max(total) AS total, arg_max(phase, seq) AS phase, CAST(floor(least(100, 100 * sum(n) / max(total))) AS BIGINT) AS percent,
        string_agg(line, '|' ORDER BY seq) FILTER (rank <= 5) AS log FROM r GROUP BY job""")
def import_progress(spark, sf_dir) -> DataFrame:
    n = F.col("event_id")
    e = t.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job"), n.alias("seq"), F.col("event_type").alias("phase"), (n % 4).alias("n"), F.lit(20).alias("total"), F.concat(F.lit("l"), n.cast("string")).alias("line")
    )
    return bk.progress(e)


@query("""WITH l AS (SELECT 'svc' || user_id % 5 AS source, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events),
    o AS (SELECT source, max(s) FILTER (seq % 2 = 0) - 86400 * 3 AS last FROM l WHERE source <> 'svc3' GROUP BY source)
    SELECT seq, last IS NULL OR s > last AS fresh FROM l LEFT JOIN o USING (source) WHERE (last IS NULL OR s > last - 7200) AND seq % 5 <> 0""")
def source_offsets(spark, sf_dir) -> DataFrame:
    """An overlap of two hours, so that it holds lines."""
    n = F.col("event_id")
    lines = t.table(spark, sf_dir, "events").select(F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string")).alias("source"), n.alias("seq"), "ts")
    last = lines.where("source <> 'svc3' and seq % 2 = 0").groupBy("source").agg((F.max(F.unix_timestamp("ts")) - 86400 * 3).alias("s"))
    offsets = last.select("source", F.timestamp_seconds("s").alias("last_ts"))
    return bk.new_lines(lines, offsets, lines.where("seq % 5 = 0"), 7200).select("seq", "fresh")


@query("""WITH l AS (SELECT event_id AS seq, ts, ts + INTERVAL 3 HOUR AS at_local FROM events) SELECT strftime(at_local, '%Y-%m-%d') AS day, arg_min(seq, (ts, seq)) AS seq FROM l WHERE hour(at_local) >= 10 GROUP BY 1""")
def digest_days(spark, sf_dir) -> DataFrame:
    ticks = t.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    return bk.once_a_day(ticks, "Europe/Moscow")


@query("""WITH p AS (SELECT p_partkey AS n, p_partkey AS cell, 'c' || p_partkey % 9 AS model_class, 'm' || p_partkey % 5 AS model, CASE WHEN p_partkey % 6 <> 0 THEN 'd1' END AS digest,
        CASE WHEN p_partkey % 7 = 0 THEN 'g0' ELSE 'g1' END AS golden, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE 'p1' END AS prices, CASE WHEN p_partkey % 10 = 0 THEN 'draft' ELSE 'active' END AS status FROM part),
    j AS (SELECT *, n % 4 <> 0 AS seen, CASE WHEN n % 11 = 0 THEN 'mx' ELSE model END AS fm, 'd1' AS fd, CASE WHEN n % 9 < 7 THEN CASE WHEN n % 9 = 3 THEN 'retired' ELSE 'active' END END AS cs FROM p),
    k AS (SELECT *, CASE WHEN seen AND fm <> model THEN 'model_mismatch' WHEN seen AND fd IS DISTINCT FROM digest THEN 'digest_mismatch' END AS moved,
        list_filter([CASE WHEN golden <> 'g1' THEN 'evidence_stale' END, CASE WHEN prices IS DISTINCT FROM 'p1' THEN 'price_stale' END], lambda x: x IS NOT NULL) AS marks, cs IS NOT NULL AND cs <> status AS blocked FROM j)
    SELECT cell, CASE WHEN moved IS NOT NULL THEN 't1' WHEN list_contains(marks, 'evidence_stale') THEN 't2' WHEN len(marks) > 0 THEN 't3' ELSE 'ok' END AS status,
        coalesce(array_to_string(marks, ','), '') AS marks, coalesce(moved, CASE WHEN blocked THEN 'status_divergence' END) AS reason, blocked FROM k""")
def profile_drift(spark, sf_dir) -> DataFrame:
    n, name = F.col("p_partkey"), lambda p, c: F.concat(F.lit(p), c.cast("string"))
    part = t.table(spark, sf_dir, "part")
    profiles = part.select(
        n.alias("cell"), name("c", n % 9).alias("model_class"), name("m", n % 5).alias("model"), F.when(n % 6 != 0, "d1").alias("digest"), F.when(n % 7 == 0, "g0").otherwise("g1").alias("golden"),
        F.when(n % 8 != 0, "p1").alias("prices"), F.when(n % 10 == 0, "draft").otherwise("active").alias("status"),
    )
    facts = part.where(n % 4 != 0).select(n.alias("cell"), F.when(n % 11 == 0, "mx").otherwise(name("m", n % 5)).alias("model"), F.lit("d1").alias("digest"))
    c = n % 9
    registry = part.where(c < 7).select(name("c", c).alias("model_class"), F.when(c == 3, "retired").otherwise("active").alias("status")).distinct()
    return bk.drift(profiles, facts, registry, "g1", "p1")


@query(f"""{E}, {pe.AGG}, {pe.STATE} SELECT sig, CASE WHEN sig LIKE 'click%' THEN 'resolved' ELSE 'active' END AS status, CASE WHEN sig LIKE 'click%' THEN 'resolved' ELSE state END AS state,
    CASE WHEN sig LIKE 'click%' THEN DATE '2024-01-30' END AS fixed_at FROM agg LEFT JOIN st USING (sig)""")
def resolve_signatures(spark, sf_dir) -> DataFrame:
    a = pe.aggregates(spark, sf_dir).withColumn("status", F.lit("active"))
    return bk.resolved_signatures(a, pe.state(spark, sf_dir), a.where("sig like 'click%'"), F.lit("2024-01-30").cast("date"))


@query(f"""WITH {ENTRIES}, w AS (SELECT CASE WHEN n % 3 = 0 THEN kid ELSE 'new-' || kid END AS kid, n, source_url, project FROM entries WHERE n % 2 = 0)
    SELECT kid, CASE WHEN n % 3 = 0 THEN 'blocked' WHEN n % 10 = 4 THEN 'review' ELSE 'written' END AS outcome,
        CAST(source_url IS NULL AS BIGINT) + CAST(project IS NULL AS BIGINT) AS warnings FROM w""")
def entry_writes(spark, sf_dir) -> DataFrame:
    e = t.entries(spark, sf_dir)
    new = e.where("n % 2 = 0").withColumn("kid", F.when(F.col("n") % 3 == 0, F.col("kid")).otherwise(F.concat(F.lit("new-"), "kid")))
    return bk.written(new, e, new.where("n % 10 = 4"), ["source_url", "project"])


@query(f"""WITH {ENTRIES}, r AS (SELECT domain, kid, row_number() OVER (PARTITION BY domain ORDER BY kid) AS rank FROM entries)
    SELECT domain, count(*) AS files, CASE WHEN sum(length(kid) + 4) > 1000 THEN least(count(*), 10) ELSE count(*) END AS listed, sum(length(kid) + 4) > 1000 AS truncated,
        string_agg(kid, ',' ORDER BY kid) FILTER (rank <= 10) AS first FROM r GROUP BY domain""")
def index_files(spark, sf_dir) -> DataFrame:
    return bk.index_files(t.entries(spark, sf_dir), 1000)


@query(f"{E}, {pe.AGG}, {pe.STATE}, p AS (SELECT sig FROM agg LEFT JOIN st USING (sig) WHERE date_diff('day', CAST(last_seen AS DATE), DATE '2024-04-30') > 90 AND NOT coalesce(investigating, false)) SELECT sig, count_total FROM agg JOIN p USING (sig)")
def backup_slice(spark, sf_dir) -> DataFrame:
    """The aggregates that a pruning would drop, as they go to the backup first."""
    doomed = pe.QUERIES["prune_plan"](spark, sf_dir).where("drop_aggregate")
    return pe.aggregates(spark, sf_dir).join(doomed.select("sig"), "sig", "left_semi").select("sig", "count_total")


@query(f"WITH {ENTRIES} SELECT zone, count(*) AS n FROM entries GROUP BY zone")
def collection_split(spark, sf_dir) -> DataFrame:
    """One collection rewritten as one partition a zone, read back."""
    from quillstone.sources.shared import scratch_folder

    path = scratch_folder(spark, "split")
    t.entries(spark, sf_dir).select("kid", "zone").write.partitionBy("zone").parquet(path)
    return spark.read.schema("kid string, zone string").parquet(path).groupBy("zone").agg(F.count(F.lit(1)).alias("n"))
