"""Queries of table maintenance and of log sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.operators import maintenance as m
from quillstone.plans import quality as qp
from quillstone.plans.sql import ENTRIES
from quillstone.sources import files
from quillstone.sources import tables as t
from quillstone.sources.shared import scratch_folder

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_NEW = "new AS (SELECT kid, 'changed' AS status, version + 1 AS version FROM entries WHERE n % 4 = 0 UNION ALL SELECT 'new-' || kid, 'published', 1 FROM entries WHERE n % 50 = 0)"


@query(f"WITH {ENTRIES}, {_NEW} SELECT kid, status, version FROM entries WHERE kid NOT IN (SELECT kid FROM new) UNION ALL SELECT * FROM new")
def point_upsert(spark, sf_dir) -> DataFrame:
    e = t.entries(spark, sf_dir)
    new = e.where("n % 4 = 0").select("kid", F.lit("changed").alias("status"), (F.col("version") + 1).alias("version"))
    fresh = e.where("n % 50 = 0").select(F.concat(F.lit("new-"), "kid").alias("kid"), F.lit("published").alias("status"), F.lit(1).cast("long").alias("version"))
    return m.upsert(e.select("kid", "status", "version"), new.union(fresh), "kid")


@query(f"WITH {ENTRIES} SELECT kid, domain FROM entries WHERE n % 6 <> 1")
def delete_by_id(spark, sf_dir) -> DataFrame:
    e = t.entries(spark, sf_dir)
    return m.delete_where(e.select("kid", "domain"), e.where("n % 6 = 1"), "kid")


@query(f"WITH {ENTRIES} SELECT kid, CASE WHEN domain = 'src1' THEN 'deprecated' ELSE status END AS status, CASE WHEN domain = 'src1' THEN NULL ELSE project END AS project FROM entries")
def set_payload(spark, sf_dir) -> DataFrame:
    return m.set_columns(t.entries(spark, sf_dir), F.col("domain") == "src1", {"status": F.lit("deprecated"), "project": None}).select("kid", "status", "project")


@query(f"""WITH {ENTRIES}, u AS (SELECT CASE WHEN n % 17 = 0 THEN 'x-' ELSE '' END || kid AS kid, CASE WHEN n % 3 = 0 THEN NULL WHEN n % 3 = 1 THEN version ELSE version + 1 END AS expected FROM entries WHERE n % 2 = 0)
    SELECT u.kid, CASE WHEN version IS NULL THEN 'not_found' WHEN expected IS NULL OR expected = version THEN 'updated' ELSE 'conflict' END AS outcome, CASE WHEN expected IS NULL OR expected = version THEN version + 1 ELSE version END AS version FROM u LEFT JOIN entries e ON e.kid = u.kid""")
def version_update(spark, sf_dir) -> DataFrame:
    e = t.entries(spark, sf_dir)
    n = F.col("n")
    u = e.where("n % 2 = 0").select(F.concat(F.when(n % 17 == 0, "x-").otherwise(""), "kid").alias("kid"), F.when(n % 3 == 1, F.col("version")).when(n % 3 == 2, F.col("version") + 1).alias("expected"))
    return m.update_versions(e, u)


@query(f"WITH {ENTRIES}, r AS (SELECT kid FROM entries WHERE n % 30 = 0 OR n % 44 = 0) SELECT kid FROM entries WHERE kid IN (SELECT kid FROM r) OR parent IN (SELECT kid FROM r)")
def delete_cascade(spark, sf_dir) -> DataFrame:
    e = t.entries(spark, sf_dir)
    return m.delete_cascade(e, e.where("n % 30 = 0 or n % 44 = 0"))[1]


@query(f"""WITH {ENTRIES}, w AS (SELECT CASE WHEN n % 9 = 0 THEN 'x-' ELSE '' END || kid AS kid FROM entries WHERE n % 3 = 0) SELECT w.kid, CASE WHEN e.kid IS NULL THEN 'failed' WHEN coalesce(status, 'published') = 'deprecated' THEN 'already' ELSE 'changed' END AS outcome FROM w LEFT JOIN entries e ON e.kid = w.kid""")
def status_many(spark, sf_dir) -> DataFrame:
    e = t.entries(spark, sf_dir)
    w = e.where("n % 3 = 0").select(F.concat(F.when(F.col("n") % 9 == 0, "x-").otherwise(""), "kid").alias("kid"))
    return m.set_status(e, w, "deprecated")


@query(f"WITH {ENTRIES} SELECT kid, CASE WHEN kid = 'doc-00000040' OR parent = 'doc-00000040' THEN 'private' ELSE zone END AS zone FROM entries")
def set_zone(spark, sf_dir) -> DataFrame:
    return m.set_zone(t.entries(spark, sf_dir), "doc-00000040", "private").select("kid", "zone")


@query(f"WITH {ENTRIES} SELECT kid, CASE WHEN kid = 'doc-00000050' OR parent = 'doc-00000050' THEN 'archived' ELSE status END AS status FROM entries")
def lifecycle_transition(spark, sf_dir) -> DataFrame:
    return m.transition(t.entries(spark, sf_dir), "doc-00000050", "archived").select("kid", "status")


@query(f"WITH {ENTRIES}, {qp._SIDES}, {qp._AUDIT}, d AS (SELECT DISTINCT CASE WHEN keep = kid_a THEN kid_b ELSE kid_a END AS kid FROM ranked WHERE flow = 'green') SELECT kid FROM d WHERE kid NOT IN (SELECT DISTINCT kid FROM audit WHERE action = 'restored') ORDER BY kid LIMIT 100")
def deprecation_plan(spark, sf_dir) -> DataFrame:
    from quillstone.operators import quality as q

    pairs = q.ranked_pairs(qp.made_pairs(spark, sf_dir), t.entries(spark, sf_dir))
    return m.deprecation_plan(pairs, qp.audit(spark, sf_dir).where("action = 'restored'").distinct(), True)


@query(f"WITH {ENTRIES} SELECT zone, count(*) AS entries, CAST(sum(version + 1) AS BIGINT) AS versions FROM entries GROUP BY zone")
def blue_green(spark, sf_dir) -> DataFrame:
    """Two versions built below the shared folder, verified, swapped; the old one is deleted."""
    table = m.VersionedTable(spark, scratch_folder(spark, "versions"))
    e = t.entries(spark, sf_dir).select("kid", "zone", "version")
    table.swap(table.build(e, ["zone"]))
    new = table.build(table.read().withColumn("version", F.col("version") + 1), ["zone"])
    if table.verify(new, e.count()):
        table.swap(new)
        table.drop_others()
    return table.read().groupBy("zone").agg(F.count(F.lit(1)).alias("entries"), F.sum("version").alias("versions"))


@query("SELECT event_id AS id, 'backup-' || CAST(event_id % 20 AS VARCHAR) AS job, CAST(event_id % 3 AS INTEGER) AS exit, CAST(event_id % 50 AS VARCHAR) || 's' AS dur FROM events WHERE event_id % 5 <> 0")
def cron_lines(spark, sf_dir) -> DataFrame:
    n = F.col("event_id")
    line = F.when(n % 5 == 0, "INFO: nothing").otherwise(F.concat(F.lit("x [CRON] job=backup-"), (n % 20).cast("string"), F.lit(" exit="), (n % 3).cast("string"), F.lit(" dur="), (n % 50).cast("string"), F.lit("s ts=2024-01-01T00:00:00Z")))
    rows = t.table(spark, sf_dir, "events").select(n.alias("id"), files.cron_line(line).alias("c")).where("c is not null")
    return rows.select("id", "c.job", "c.exit", "c.dur")


@query("""WITH l AS (SELECT event_id AS id, event_id % 4 AS r, 200 + event_id % 5 * 100 AS s FROM events) SELECT id, CASE WHEN r = 0 THEN '/items/<id>/x' END AS endpoint, CASE WHEN r < 2 THEN CAST(s AS INTEGER) END AS status,
    CASE r WHEN 1 THEN 'GIN' WHEN 2 THEN 'SLOW' END AS marker FROM l WHERE r = 0 AND s >= 400 OR r IN (1, 2) OR r = 3 AND id % 8 = 7""")
def log_capture(spark, sf_dir) -> DataFrame:
    n = F.col("event_id")
    s = (200 + n % 5 * 100).cast("string")
    line = F.when(n % 4 == 0, F.concat(F.lit('1.2.3.4 "GET /items/'), n.cast("string"), F.lit('/x?q=1 HTTP/1.1" '), s)).when(n % 4 == 1, F.concat(F.lit("[GIN] | "), s, F.lit(" | 3ms"))).when(n % 4 == 2, F.lit("[INFO] [SLOW] waiting")).when(n % 8 == 7, F.lit("WARNING: disk")).otherwise(F.lit("INFO: fine"))
    rows = t.table(spark, sf_dir, "events").select(n.alias("id"), line.alias("line")).where(files.captured(F.col("line")))
    return rows.select("id", tx.endpoint(F.col("line")).alias("endpoint"), files.access_status(F.col("line")).alias("status"), tx.marker(F.col("line")).alias("marker"))
