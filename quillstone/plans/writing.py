"""Queries of writes in batches, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import writing as wr
from quillstone.plans.provenance import sha
from quillstone.plans.sql import ENTRIES
from quillstone.sources import tables as t

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def store(spark, sf_dir) -> DataFrame:
    """Entries and sources (the suppliers) as one store."""
    e = t.entries(spark, sf_dir).select("kid", "content_type", "domain", "subject", "zone", "content", "version")
    s = t.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("kid"), F.lit("source").alias("content_type"), F.lit("library").alias("domain"), F.lit("bibliography").alias("subject"),
        F.lit("private").alias("zone"), F.col("s_name").alias("content"), F.lit(1).cast("long").alias("version"),
    )
    return e.unionByName(s)


def requests(spark, sf_dir) -> DataFrame:
    """A write an entry: of its own id, of an id that four ask for, or of none; with faults of every kind."""
    n = F.col("n")
    e = t.entries(spark, sf_dir)
    link = F.concat(F.lit("s"), (n % 40).cast("string"))
    return e.select(
        "n", F.when(n % 3 == 0, F.col("kid")).when(n % 3 == 1, F.concat(F.lit("new-"), F.expr("n div 12").cast("string"))).alias("kid"), F.when(n % 29 != 0, F.concat(F.lit("## Part "), n.cast("string"), F.lit("\n"), "content")).alias("content"),
        "domain", F.when(n % 31 == 0, "").otherwise(F.col("subject")).alias("subject"), F.when(n % 37 == 0, "secret").when(n % 5 != 1, F.col("zone")).alias("zone"), (n % 2 == 0).alias("strict"),
        F.when(n % 7 == 0, F.array(link, F.col("kid"), F.lit(""))).when(n % 7 < 4, F.array(link)).alias("documents"),
        F.when(n % 4 != 3, F.lit("x")).alias("source"), (n % 8 != 6).alias("evergreen"), F.when(n % 16 == 4, F.array().cast("array<string>")).otherwise(F.array("domain")).alias("cross_subjects"),
    )


def duplicates(spark, sf_dir) -> DataFrame:
    return t.table(spark, sf_dir, "embeddings").where("label = 3").select(F.expr("vec_id div 2").alias("n"), "vec_id")


_STORE = "store AS (SELECT kid, content_type, domain, subject, zone, content, version FROM entries UNION ALL SELECT 's' || s_suppkey, 'source', 'library', 'bibliography', 'private', s_name, 1 FROM supplier)"
_REQUESTS = """req AS (SELECT n, CASE WHEN n % 3 = 0 THEN kid WHEN n % 3 = 1 THEN 'new-' || (n // 12) END AS kid, kid AS old, CASE WHEN n % 29 <> 0 THEN '## Part ' || n || chr(10) || content END AS content, domain,
    CASE WHEN n % 31 = 0 THEN '' ELSE subject END AS subject, CASE WHEN n % 37 = 0 THEN 'secret' WHEN n % 5 <> 1 THEN zone END AS zone, n % 2 = 0 AS strict FROM entries),
    dups AS (SELECT vec_id // 2 AS n, count(*) AS found FROM embeddings WHERE label = 3 GROUP BY 1),
    faults AS (SELECT n, CASE WHEN s_suppkey IS NULL THEN 'not_found:s' || (n % 40) ELSE '' END || CASE WHEN n % 7 = 0 THEN CASE WHEN s_suppkey IS NULL THEN ',' ELSE '' END || 'not_source:' || old || ',empty' ELSE '' END AS faults
        FROM req LEFT JOIN supplier ON s_suppkey = n % 40 WHERE n % 7 < 4),
    r1 AS (SELECT req.*, coalesce(found, 0) AS found, coalesce(faults, '') AS faults, CASE WHEN content IS NULL THEN 'content' WHEN subject = '' THEN 'subject' WHEN zone = 'secret' THEN 'zone' END AS invalid,
        list_filter([CASE WHEN n % 4 = 3 THEN 'missing:source' END, CASE WHEN n % 8 = 6 THEN 'missing:evergreen' END, CASE WHEN n % 16 = 4 THEN 'missing:cross_subjects' END], lambda v: v IS NOT NULL) AS missing,
        coalesce(kid, left(regexp_replace(lower(domain), '[^a-z0-9]+', '-', 'g'), 40) || '-' || left(regexp_replace(lower(subject), '[^a-z0-9]+', '-', 'g'), 40) || '-part-' || n) AS id
        FROM req LEFT JOIN dups USING (n) LEFT JOIN faults USING (n)),
    r2 AS (SELECT *, CASE WHEN strict THEN missing || CASE WHEN found > 0 THEN ['duplicates'] ELSE [] END ELSE [] END AS issues FROM r1),
    r3 AS (SELECT r2.*, f.first, kid IS NOT NULL AND (kid IN (SELECT kid FROM store) OR coalesce(n > f.first, false)) AS taken
        FROM r2 LEFT JOIN (SELECT id, min(n) AS first FROM r2 WHERE invalid IS NULL AND len(issues) = 0 AND faults = '' GROUP BY id) f USING (id)),
    w AS (SELECT *, CASE WHEN invalid IS NOT NULL THEN 'invalid' WHEN taken OR len(issues) > 0 THEN 'blocked' WHEN faults <> '' THEN 'refused' ELSE 'written' END AS outcome FROM r3)"""


@query(f"""WITH {ENTRIES}, {_STORE}, {_REQUESTS} SELECT n, CASE WHEN outcome = 'written' THEN id END AS id, outcome,
    CASE outcome WHEN 'invalid' THEN invalid WHEN 'blocked' THEN array_to_string(CASE WHEN taken THEN ['taken'] ELSE [] END || issues, ',') ELSE faults END AS reasons,
    CASE WHEN invalid IS NULL AND NOT strict THEN len(missing) ELSE 0 END AS warnings, CASE WHEN invalid IS NULL THEN found ELSE 0 END AS duplicates,
    CASE WHEN outcome = 'written' AND n % 7 BETWEEN 1 AND 3 THEN 1 ELSE 0 END AS linked FROM w""")
def gated_writes(spark, sf_dir) -> DataFrame:
    return wr.entry_writes(requests(spark, sf_dir), store(spark, sf_dir), duplicates(spark, sf_dir))


@query(f"""WITH {ENTRIES}, {_STORE}, {_REQUESTS}, new AS (SELECT id AS kid, CAST(NULL AS VARCHAR) AS content_type, domain, subject, coalesce(zone, 'private') AS zone, content, 1 AS version FROM w WHERE outcome = 'written'
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1)
    SELECT kid, content_type, zone, md5(content) AS body, version FROM new UNION ALL SELECT kid, content_type, zone, md5(content), version FROM store WHERE kid NOT IN (SELECT kid FROM new)""")
def entry_store(spark, sf_dir) -> DataFrame:
    s, r = store(spark, sf_dir), requests(spark, sf_dir)
    out = wr.stored(s, r, wr.entry_writes(r, s, duplicates(spark, sf_dir)))
    return out.select("kid", "content_type", "zone", F.md5("content").alias("body"), "version")


def known_sources(spark, sf_dir) -> DataFrame:
    n = F.col("p_partkey")
    own = sha(F.concat(F.lit("p"), n.cast("string")))
    return t.table(spark, sf_dir, "part").where("p_size % 3 = 0").select(
        wr.source_id(own).alias("source_id"), own.alias("sha256"), F.when(n % 4 == 0, "c0").alias("canonical"), F.when(n % 5 < 2, F.array(F.lit("d1"), F.lit("d9"))).alias("derived"),
        F.when(n % 6 < 3, "timeout").alias("error"), F.lit("own").alias("license"), (n % 2 == 0).alias("public_allowed"),
    )


def ingests(spark, sf_dir) -> DataFrame:
    """Original documents as order lines bring them (lines of one number are one), some with a hash that has another's
    beginning, some with none."""
    n, p = F.col("number"), F.col("l_partkey").cast("string")
    own = sha(F.concat(F.lit("p"), p))
    text = F.when(n % 41 == 0, "no hash").when(n % 13 == 0, F.concat(F.substring(own, 1, 16), F.substring(sha(F.lit("q")), 17, 48))).otherwise(own)
    word = lambda m: F.concat(F.lit("d"), (F.col("l_suppkey") % m).cast("string"))
    lines = t.table(spark, sf_dir, "lineitem").groupBy(F.expr("l_orderkey * 10 + l_linenumber").alias("number")).agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    return lines.select(
        n.alias("n"), text.alias("sha256"), F.when(n % 9 == 0, F.concat(F.lit("c"), (n % 4).cast("string"))).alias("canonical"), F.when(n % 3 == 0, F.array(word(3), word(4))).alias("derived"),
        F.when((n % 9 != 0) & (n % 5 == 0), F.concat(F.lit("e"), (n % 7).cast("string"))).alias("error"), F.when(n % 2 == 0, "cc-by").alias("license"), F.when(n % 7 == 0, n % 3 == 0).alias("public_allowed"),
    )


_INGESTS = """old AS (SELECT 'src-' || left(sha256('p' || p_partkey), 16) AS source_id, sha256('p' || p_partkey) AS sha256, CASE WHEN p_partkey % 4 = 0 THEN 'c0' END AS canonical, CASE WHEN p_partkey % 5 < 2 THEN ['d1', 'd9'] ELSE [] END AS derived,
        CASE WHEN p_partkey % 6 < 3 THEN 'timeout' END AS error, 'own' AS license, p_partkey % 2 = 0 AS public_allowed FROM part WHERE p_size % 3 = 0),
    l AS (SELECT l_orderkey * 10 + l_linenumber AS n, sha256('p' || min(l_partkey)) AS own, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1),
    i AS (SELECT n, CASE WHEN n % 41 = 0 THEN 'no hash' WHEN n % 13 = 0 THEN left(own, 16) || sha256('q')[17:] ELSE own END AS sha256, CASE WHEN n % 9 = 0 THEN 'c' || (n % 4) END AS canonical,
        CASE WHEN n % 3 = 0 THEN ['d' || (l_suppkey % 3), 'd' || (l_suppkey % 4)] ELSE [] END AS derived, CASE WHEN n % 9 <> 0 AND n % 5 = 0 THEN 'e' || (n % 7) END AS error, CASE WHEN n % 2 = 0 THEN 'cc-by' END AS license,
        CASE WHEN n % 7 = 0 THEN n % 3 = 0 END AS public_allowed, CASE WHEN n % 41 <> 0 THEN 'src-' || left(own, 16) END AS source_id FROM l),
    j AS (SELECT i.*, old.sha256 AS osha, old.canonical AS ocanonical, coalesce(old.derived, []) AS oderived, old.error AS oerror,
        coalesce(old.sha256, first_value(i.sha256) OVER (PARTITION BY i.source_id ORDER BY n)) AS own FROM i LEFT JOIN old USING (source_id) WHERE i.source_id IS NOT NULL),
    g AS (SELECT *, row_number() OVER s AS nth, count(canonical) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM j WHERE sha256 = own WINDOW s AS (PARTITION BY source_id ORDER BY n)),
    d AS (SELECT source_id, sha, min(n * 10 + pos) AS seen FROM (SELECT source_id, n, oderived, unnest(derived) AS sha, generate_subscripts(derived, 1) AS pos FROM g) WHERE NOT list_contains(oderived, sha) GROUP BY source_id, sha)"""


@query(f"""WITH {_INGESTS}, h AS (SELECT n, source_id, CASE WHEN osha IS NULL AND nth = 1 THEN 'created' WHEN ocanonical IS NULL AND before = 0 AND (canonical IS NOT NULL OR error IS NOT NULL) OR ocanonical IS NOT NULL AND oerror IS NOT NULL AND nth = 1
        OR (source_id, n) IN (SELECT (source_id, seen // 10) FROM d) THEN 'attached' ELSE 'reused' END AS outcome FROM g)
    SELECT n, source_id, outcome FROM h UNION ALL SELECT n, source_id, 'collision' FROM j WHERE sha256 <> own UNION ALL SELECT n, NULL, 'invalid' FROM i WHERE source_id IS NULL""")
def ingest_outcomes(spark, sf_dir) -> DataFrame:
    return wr.registered(known_sources(spark, sf_dir), ingests(spark, sf_dir))[1]


@query(f"""WITH {_INGESTS}, a AS (SELECT source_id, any_value(own) AS sha256, coalesce(any_value(ocanonical), arg_min(canonical, n)) AS canonical, any_value(oderived) AS oderived, coalesce(arg_max(error, n), any_value(oerror)) AS err,
        bool_or(osha IS NOT NULL) AS known, arg_min(coalesce(license, ''), n) AS license, arg_min(CASE WHEN public_allowed IS NULL THEN license IS NOT NULL ELSE public_allowed END, n) AS allowed FROM g GROUP BY source_id),
    e AS (SELECT source_id, list(sha ORDER BY seen) AS added FROM d GROUP BY source_id),
    s AS (SELECT a.source_id, a.sha256, a.canonical, array_to_string(oderived || coalesce(added, []), ',') AS derived, CASE WHEN a.canonical IS NULL THEN err END AS error,
        CASE WHEN known THEN old.license ELSE nullif(a.license, '') END AS license, CASE WHEN known THEN old.public_allowed ELSE allowed END AS public_allowed FROM a LEFT JOIN e USING (source_id) LEFT JOIN old USING (source_id))
    SELECT * FROM s UNION ALL SELECT source_id, sha256, canonical, array_to_string(derived, ','), error, license, public_allowed FROM old WHERE source_id NOT IN (SELECT source_id FROM s)""")
def ingested_sources(spark, sf_dir) -> DataFrame:
    out = wr.registered(known_sources(spark, sf_dir), ingests(spark, sf_dir))[0]
    return out.withColumn("derived", F.array_join(F.coalesce("derived", F.array().cast("array<string>")), ","))


_CHANGES = """k AS (SELECT p_partkey AS n, 'k' || p_partkey AS kid, CASE WHEN p_partkey % 6 <> 0 THEN 'source' WHEN p_partkey % 12 = 0 THEN 'book' END AS content_type, 'arr' AS license, false AS public_allowed, 1 AS version FROM part),
    c AS (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 23 <> 0 THEN 'k' || (o_custkey * 3) END AS kid, CASE WHEN o_orderkey % 3 = 0 THEN 'cc-by' WHEN o_orderkey % 3 = 1 THEN 'arr' END AS license, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 2 = 0 END AS allowed FROM orders),
    d AS (SELECT c.n, c.kid, c.license, coalesce(allowed, CASE WHEN c.license IS NOT NULL THEN c.license = 'cc-by' END) AS allowed, CASE WHEN c.kid IS NULL THEN 'missing' WHEN k.kid IS NULL THEN 'not_found' WHEN coalesce(content_type, '') <> 'source' THEN 'not_source'
        WHEN c.license IS NULL AND allowed IS NULL THEN 'nothing' ELSE 'ok' END AS outcome FROM c LEFT JOIN k USING (kid))"""


def changed(spark, sf_dir):
    p, o = F.col("p_partkey"), F.col("o_orderkey")
    k = t.table(spark, sf_dir, "part").select(F.concat(F.lit("k"), p.cast("string")).alias("kid"), F.when(p % 6 != 0, "source").when(p % 12 == 0, "book").alias("content_type"), F.lit("arr").alias("license"), F.lit(False).alias("public_allowed"), F.lit(1).cast("long").alias("version"))
    c = t.table(spark, sf_dir, "orders").select(o.alias("n"), F.when(o % 23 != 0, F.concat(F.lit("k"), (F.col("o_custkey") * 3).cast("string"))).alias("source_id"), F.when(o % 3 == 0, "cc-by").when(o % 3 == 1, "arr").alias("license"), F.when(o % 5 == 0, o % 2 == 0).alias("public_allowed"))
    return wr.relicensed(k, c)


@query(f"WITH {_CHANGES} SELECT n, outcome FROM d")
def licence_changes(spark, sf_dir) -> DataFrame:
    return changed(spark, sf_dir)[1]


@query(f"""WITH {_CHANGES}, l AS (SELECT kid, arg_max(license, n) AS license, arg_max(allowed, n) AS allowed, count(*) AS times FROM d WHERE outcome = 'ok' GROUP BY kid)
    SELECT k.kid, content_type, coalesce(l.license, k.license) AS license, coalesce(allowed, public_allowed) AS public_allowed, version + coalesce(times, 0) AS version FROM k LEFT JOIN l USING (kid)""")
def relicensed_sources(spark, sf_dir) -> DataFrame:
    return changed(spark, sf_dir)[0]
