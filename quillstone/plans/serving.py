"""Queries of what is handed out, and of texts as they are read, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.operators import overtime as ot
from quillstone.operators import serving as sv
from quillstone.plans import overtime as po
from quillstone.plans import provenance as pr
from quillstone.plans.events import E
from quillstone.plans.sql import ENTRIES
from quillstone.sources import files
from quillstone.sources import tables as t
from quillstone.sources.shared import scratch_folder

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


@query(f"""WITH {ENTRIES}, x AS (SELECT *, CASE WHEN n % 4 = 0 THEN ['k' || n % 30] ELSE [] END AS crossed FROM entries),
    c AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags || crossed) AS tag FROM x) GROUP BY tag)
    SELECT 'section' AS kind, domain AS name, count(*) AS n FROM x GROUP BY domain UNION ALL (SELECT 'tag', tag, n FROM c ORDER BY n DESC, tag LIMIT 20)
    UNION ALL SELECT 'tag', '...and ' || (count(*) - 20) || ' more', 0 FROM c HAVING count(*) > 20 UNION ALL SELECT 'total', 'entries', count(*) FROM x
    UNION ALL SELECT 'total', 'complete', CAST(round(count(*) FILTER (coalesce(project, '') <> '' AND source_url IS NOT NULL AND coalesce(content, '') <> '') / count(*) * 1000) AS BIGINT) FROM x""")
def root_index(spark, sf_dir) -> DataFrame:
    n = F.col("n")
    e = t.entries(spark, sf_dir).withColumn("cross_subjects", F.when(n % 4 == 0, F.array(F.concat(F.lit("k"), (n % 30).cast("string")))))
    return sv.root_index(e, ["project", "source_url", "content", "tags"])


@query(f"""WITH {pr.SOURCES}, {pr.REFS}, {pr.BLOBS}, ok AS (SELECT DISTINCT sha256 FROM refs WHERE source_id IN (SELECT source_id FROM sources WHERE zone = 'public' AND {pr._SHOWN})),
    q AS (SELECT event_id AS n, CASE WHEN event_id % 50 = 0 THEN 'nothing' ELSE sha256('p' || (event_id % 300)) END AS sha, event_id % 4 AS r, event_id % 60 AS a FROM events),
    j AS (SELECT q.*, size, b.n AS bn, CASE WHEN sha = 'nothing' THEN 400 WHEN ok.sha256 IS NULL OR size IS NULL THEN 404 WHEN r = 0 THEN 200 WHEN r = 1 AND a = 0 OR r > 1 AND a >= size THEN 416 ELSE 206 END AS status
        FROM q LEFT JOIN ok ON ok.sha256 = sha LEFT JOIN blobs b ON b.sha256 = sha)
    SELECT n, status, CASE WHEN status < 300 THEN CASE WHEN bn % 2 = 0 THEN 'application/pdf' ELSE 'application/octet-stream' END END AS mime,
        CASE WHEN status < 300 THEN CASE WHEN bn % 3 = 0 THEN 'file ' || bn ELSE sha || CASE WHEN bn % 2 = 0 THEN '.pdf' ELSE '.bin' END END END AS name,
        CASE WHEN status = 200 THEN 0 WHEN status = 206 THEN CASE r WHEN 1 THEN greatest(0, size - a) ELSE a END END AS start,
        CASE WHEN status = 200 THEN size WHEN status = 206 THEN CASE r WHEN 1 THEN least(size, a) WHEN 2 THEN size - a ELSE least(a + 5, size - 1) - a + 1 END END AS length FROM j""")
def served_ranges(spark, sf_dir) -> DataFrame:
    n = F.col("event_id")
    a, b = (n % 60).cast("string"), (n % 60 + 5).cast("string")
    header = F.when(n % 4 == 1, F.concat(F.lit("bytes=-"), a)).when(n % 4 == 2, F.concat(F.lit("bytes="), a, F.lit("-"))).when(n % 4 == 3, F.concat(F.lit("bytes="), a, F.lit("-"), b))
    asked = F.when(n % 50 == 0, "nothing").otherwise(pr.sha(F.concat(F.lit("p"), (n % 300).cast("string"))))
    requests = t.table(spark, sf_dir, "events").select(n.alias("n"), asked.alias("sha256"), header.alias("header"))
    k = F.col("n")
    blobs = pr.blobs(spark, sf_dir).withColumns({"mime": F.when(k % 2 == 0, "application/pdf").otherwise("text/html"), "filename": F.when(k % 3 == 0, F.concat(F.lit("file/ "), k.cast("string")))})
    return sv.served(requests, blobs, pr.refs(spark, sf_dir), pr.sources(spark, sf_dir), ("public",))


@query(f"""{E}, a AS (SELECT 'old' || seq AS sig, source, CASE WHEN seq % 5 = 0 THEN '' ELSE 'took ' || seq || ' of ' || event_type END AS example, event_type, seq FROM error_events)
    SELECT sig, count(*) AS count_total, CAST(min(seq) AS BIGINT) AS first_seen, min('P' || seq % 4) AS priority FROM (
        SELECT CASE WHEN example = '' THEN sig ELSE source || '|-|took <n> of ' || event_type END AS sig, seq FROM a) GROUP BY sig""")
def migrated_keys(spark, sf_dir) -> DataFrame:
    """An aggregate an event, whose old key tells too much."""
    n, none = F.col("seq"), F.lit(None).cast("string")
    text = F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("took "), n.cast("string"), F.lit(" of "), "event_type"))
    a = t.error_events(spark, sf_dir).select(
        F.concat(F.lit("old"), n.cast("string")).alias("sig"), F.lit(1).cast("long").alias("count_total"), n.alias("first_seen"), n.alias("last_seen"), F.lit(False).alias("burst"), F.concat(F.lit("P"), (n % 4).cast("string")).alias("priority"),
        F.lit("active").alias("status"), F.col("source").alias("example_source"), none.alias("example_marker"), none.alias("example_code"), text.alias("example"),
    )
    return sv.migrated(a).select("sig", "count_total", "first_seen", "priority")


@query(f"WITH {ENTRIES}, {po.ATTEMPTS} SELECT 'points_' || zone AS name, count(*) AS n FROM entries GROUP BY zone UNION ALL SELECT 'queue', count(*) FROM log WHERE action = 'retry' UNION ALL SELECT 'dead_letters', count(DISTINCT key) FROM log WHERE action = 'dead'")
def store_stats(spark, sf_dir) -> DataFrame:
    log = ot.retry_log(po.attempts(spark, sf_dir))
    return sv.store_stats(t.entries(spark, sf_dir), log.where("action = 'retry'"), ot.dead_letters(log))


@query("""SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 <> 0 AND event_id % 3 = 0 AND event_id % 5 < 3 THEN CASE WHEN event_id % 2 = 0 THEN 'a,crit,plan' ELSE 'crit,plan' END ELSE 'a,plan' END AS shown FROM events
    WHERE event_id % 2 = 0 OR event_id % 11 = 0 OR NOT (event_id % 7 <> 0 AND event_id % 3 = 0 AND event_id % 5 < 3) UNION ALL
    SELECT event_id, 'crit,plan' FROM events WHERE event_id % 2 = 1 AND event_id % 11 <> 0 AND event_id % 7 <> 0 AND event_id % 3 = 0 AND event_id % 5 < 3""")
def delta_views(spark, sf_dir) -> DataFrame:
    """A node with inputs a and plan, and a critique of its plan by a gate, by a person, or by a gate that saw everything."""
    n = F.col("event_id")
    words = lambda *w: F.array(*map(F.lit, w))
    changed = F.when(n % 7 != 0, F.when(n % 2 == 0, words("a", "plan", "crit", "gone")).otherwise(words("plan", "crit")))
    writer = F.when(n % 3 == 0, words("critic-gate")).when(n % 3 == 1, words("human-gate")).otherwise(words("critic-gate", "critic-gate"))
    scope = F.when(n % 5 < 3, words("plan")).when(n % 5 == 3, words("plan", "brief")).otherwise(F.array().cast("array<string>"))
    critique = F.array(F.struct(F.lit("crit").alias("section"), writer.alias("writers"), scope.alias("inputs")), F.struct(F.lit("old").alias("section"), words("human-gate").alias("writers"), scope.alias("inputs")))
    sections = F.when(n % 11 == 0, words("a")).otherwise(words("a", "plan", "crit", "old"))
    return t.table(spark, sf_dir, "events").select(n.alias("id"), F.array_join(sv.delta_view(changed, sections, words("a", "plan"), critique), ",").alias("shown"))


@query(f"""WITH {ENTRIES} SELECT kid, CASE WHEN n % 7 IN (0, 1, 5) THEN kid END AS meta_kid, CASE WHEN n % 7 IN (0, 1, 5) THEN domain END AS domain, CASE WHEN n % 7 = 1 THEN 2 END AS tags,
    CASE n % 7 WHEN 2 THEN 'empty' WHEN 3 THEN 'no_delimiter' WHEN 4 THEN 'unclosed' WHEN 6 THEN 'not_a_mapping' END AS error, CASE WHEN n % 7 IN (0, 1, 5, 6) THEN 'body ' || n ELSE '' END AS body FROM entries""")
def parsed_entries(spark, sf_dir) -> DataFrame:
    """Texts with front matter of every kind, good and bad."""
    n = F.col("n")
    head, body = F.concat(F.lit("---\nknowledge_id: "), "kid", F.lit("\ndomain: "), "domain"), F.concat(F.lit("\n---\nbody "), n.cast("string"), F.lit("\n"))
    text = (
        F.when(n % 7 == 1, F.concat(head, F.lit("\ntags: [x, 'y z']"), body)).when(n % 7 == 2, " \n").when(n % 7 == 3, F.concat(F.lit("# "), "kid")).when(n % 7 == 4, head)
        .when(n % 7 == 6, F.concat(F.lit("---\n- a list\n- of two"), body)).otherwise(F.concat(head, body))
    )
    rows = files.parsed_markdown(t.entries(spark, sf_dir).select("kid", text.alias("text")))
    return rows.select("kid", F.col("meta.knowledge_id").alias("meta_kid"), F.col("meta.domain").alias("domain"), F.when(F.col("meta.tags").isNotNull(), F.size("meta.tags")).alias("tags"), "error", "body")


@query("SELECT event_id AS id, event_type AS type FROM events WHERE event_id % 6 <> 0")
def issue_lines(spark, sf_dir) -> DataFrame:
    """Issues written as JSON lines, every sixth of them broken, and read again."""
    n, path = F.col("event_id"), scratch_folder(spark, "issues")
    whole = F.to_json(F.struct(n.alias("id"), F.col("event_type").alias("type")))
    t.table(spark, sf_dir, "events").select(F.when(n % 6 == 0, F.substring(whole, 1, 5)).otherwise(whole).alias("value")).write.text(path)
    return files.read_json_lines(spark, path, "id long, type string")


@query("""SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'teg-' || event_id WHEN 1 THEN event_type || event_id WHEN 2 THEN 'a-b' ELSE '' END AS tag FROM events""")
def normalised_tags(spark, sf_dir) -> DataFrame:
    n = F.col("event_id")
    word = F.when(n % 4 == 0, F.concat(F.lit("Тег--"), n.cast("string"))).when(n % 4 == 1, F.concat(F.upper("event_type"), F.lit("_ "), n.cast("string"))).when(n % 4 == 2, "-A - B-").otherwise("…")
    return t.table(spark, sf_dir, "events").select(n.alias("id"), tx.normalize_tag(word).alias("tag"))


_ASKED = "k AS (SELECT CASE WHEN n % 17 = 0 THEN 'gone-' || n ELSE kid END AS kid, n FROM entries)"
_CITED = f"""c AS (SELECT source_id, 'Org' || n || '. ' || name || CASE WHEN n % 3 = 0 THEN '. — https://e.org' ELSE '' END || CASE WHEN n % 2 = 0 THEN '. — 2020' ELSE '' END AS text,
    CASE WHEN n % 10 <> 0 THEN {pr._WHY} END AS why FROM sources WHERE {pr._SHOWN} AND zone = 'private' AND n % 6 <> 0 AND n % 13 <> 0)"""


@query(f"""WITH {ENTRIES}, {pr.SOURCES}, {_ASKED}, {_CITED}, e AS (SELECT k.kid, e.n, e.version, content_type, 's' || (e.n % 140) AS a, 's' || (e.n % 9) AS b FROM k LEFT JOIN entries e ON e.kid = k.kid AND zone = 'private'),
    ch AS (SELECT parent AS kid, count(*) AS children FROM entries WHERE zone = 'private' GROUP BY parent),
    j AS (SELECT e.*, '{{"source_id":"' || a || '"' || coalesce(',"citation":"' || x.text || '"', '') || coalesce(',"citation_reason":"' || x.why || '"', '') || '}}' AS ja, '{{"source_id":"' || b || '"' || coalesce(',"citation":"' || y.text || '"', '') || coalesce(',"citation_reason":"' || y.why || '"', '') || '}}' AS jb,
        x.text, x.why FROM e LEFT JOIN c x ON x.source_id = a LEFT JOIN c y ON y.source_id = b)
    SELECT kid, n IS NOT NULL AS found, version, CASE WHEN n IS NOT NULL THEN CASE WHEN content_type = 'collection' THEN coalesce(children, 0) ELSE 0 END END AS children,
        CASE WHEN n % 4 IN (0, 1) OR n % 4 = 2 AND a = b THEN text END AS citation, CASE WHEN n % 4 IN (0, 1) OR n % 4 = 2 AND a = b THEN why END AS citation_reason, CASE WHEN n % 4 = 2 AND a <> b THEN '[' || ja || ',' || jb || ',' || ja || ']' END AS citations FROM j LEFT JOIN ch USING (kid)""")
def entry_views(spark, sf_dir) -> DataFrame:
    """Every entry asked for in the private zone: with one source, one that is named twice, two, or none."""
    n, e = F.col("n"), t.entries(spark, sf_dir)
    a, b = F.concat(F.lit("s"), (n % 140).cast("string")), F.concat(F.lit("s"), (n % 9).cast("string"))
    e = e.withColumns({"source_refs": F.when(n % 4 == 1, F.array(a, a)).when(n % 4 == 2, F.array(a, b, a)).when(n % 4 == 3, F.array(F.lit(""))), "source_id": F.when(n % 4 == 0, a)})
    asked = e.select(F.when(n % 17 == 0, F.concat(F.lit("gone-"), n.cast("string"))).otherwise(F.col("kid")).alias("kid"))
    e = e.select("kid", "zone", "version", "parent", "content_type", "source_refs", "source_id")
    return sv.entry_views(asked, e, pr.described(spark, sf_dir), ("private",))
