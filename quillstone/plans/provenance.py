"""Queries over sources, blobs and references, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import provenance as pv
from quillstone.plans.sql import ENTRIES
from quillstone.sources import tables as t

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def sha(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


SOURCES = """sources AS (SELECT 's' || s_suppkey AS source_id, CASE WHEN s_suppkey % 2 = 0 THEN 'public' ELSE 'private' END AS zone, CASE WHEN s_suppkey % 9 = 0 THEN 'deprecated' END AS status,
    CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 5 <> 0 END AS public_allowed, ['own', 'licensed', 'cc-by', 'arr'][CAST(s_suppkey % 4 + 1 AS INTEGER)] AS license, ['pdf', 'docx', 'png'][CAST(s_suppkey % 3 + 1 AS INTEGER)] AS format, s_suppkey AS n, s_name AS name FROM supplier)"""
REFS = """refs AS (SELECT CASE WHEN l_partkey % 37 = 0 THEN 'x' ELSE 's' END || l_suppkey AS source_id, sha256('p' || l_partkey) AS sha256, ['original', 'canonical', 'derived'][l_linenumber % 3 + 1] AS ref_kind, l_orderkey AS o, l_linenumber AS ln FROM lineitem WHERE l_partkey % 3 <> 0)"""
BLOBS = """blobs AS (SELECT sha256('p' || p_partkey) AS sha256, CASE WHEN p_partkey % 23 = 0 THEN sha256('changed') ELSE sha256('p' || p_partkey) END AS actual_sha256, p_size AS size, CASE WHEN p_partkey % 13 <> 0 THEN p_partkey % 60 END AS age, p_partkey AS n FROM part WHERE p_partkey % 17 <> 0)"""


def sources(spark, sf_dir) -> DataFrame:
    n = F.col("s_suppkey")
    pick = lambda values, m: F.element_at(F.array(*map(F.lit, values)), (n % m + 1).cast("int"))
    return t.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), n.cast("string")).alias("source_id"), F.when(n % 2 == 0, "public").otherwise("private").alias("zone"), F.when(n % 9 == 0, "deprecated").alias("status"), F.when(n % 4 != 0, n % 5 != 0).alias("public_allowed"),
        pick(("own", "licensed", "cc-by", "arr"), 4).alias("license"), pick(("pdf", "docx", "png"), 3).alias("format"), n.alias("n"), F.col("s_name").alias("name"),
    )


def refs(spark, sf_dir) -> DataFrame:
    l = t.table(spark, sf_dir, "lineitem").where("l_partkey % 3 <> 0")  # noqa: E741
    kind = F.element_at(F.array(*map(F.lit, ("original", "canonical", "derived"))), F.col("l_linenumber") % 3 + 1)
    source = F.concat(F.when(F.col("l_partkey") % 37 == 0, "x").otherwise("s"), F.col("l_suppkey").cast("string"))
    return l.select(source.alias("source_id"), sha(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("sha256"), kind.alias("ref_kind"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ln"))


def blobs(spark, sf_dir) -> DataFrame:
    n = F.col("p_partkey")
    own = sha(F.concat(F.lit("p"), n.cast("string")))
    return t.table(spark, sf_dir, "part").where(n % 17 != 0).select(own.alias("sha256"), F.when(n % 23 == 0, sha(F.lit("changed"))).otherwise(own).alias("actual_sha256"), F.col("p_size").alias("size"), F.when(n % 13 != 0, n % 60).alias("age"), n.alias("n"))


SPANS = """spans AS (SELECT user_id AS doc, event_id AS id, k * 40 AS s, k * 40 + 1 + CAST(event_id % 70 AS BIGINT) AS e FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
    chunks AS (SELECT o_custkey AS doc, o_orderkey AS chunk, o_orderkey % 50 * 100 AS cs, o_orderkey % 50 * 100 + 120 AS ce FROM orders)"""


def spans(spark, sf_dir) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return t.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("id"), (k * 40).alias("s"), (k * 40 + 1 + F.col("event_id") % 70).alias("e"))


def chunks(spark, sf_dir) -> DataFrame:
    start = F.col("o_orderkey") % 50 * 100
    return t.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("chunk"), start.alias("cs"), (start + 120).alias("ce"))


@query(f"WITH {SPANS} SELECT id, chunk FROM spans JOIN chunks USING (doc) WHERE s < ce AND cs < e")
def locator_overlap(spark, sf_dir) -> DataFrame:
    return pv.overlaps(spans(spark, sf_dir), chunks(spark, sf_dir), 200).select("id", "chunk")


@query(f"WITH {SPANS} SELECT id, chunk, greatest(s, cs) - cs AS start, least(e, ce) - cs AS end FROM spans JOIN chunks USING (doc) WHERE s < ce AND cs < e")
def locator_clip(spark, sf_dir) -> DataFrame:
    return pv.clip(pv.overlaps(spans(spark, sf_dir), chunks(spark, sf_dir), 200)).select("id", "chunk", "start", "end")


@query(f"WITH {SPANS} SELECT 'd' || doc AS source_id, id % 2 AS kind, min(s) AS start, max(e) AS end FROM spans GROUP BY ALL")
def covering_range(spark, sf_dir) -> DataFrame:
    s = spans(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc").cast("string")).alias("source_id"), (F.col("id") % 2).alias("kind"), F.col("s").alias("start"), F.col("e").alias("end"))
    return pv.covering(s)


@query("""WITH seg AS (SELECT conv_id AS doc, turn AS nth, length(text) AS length FROM conversations), o AS (SELECT *, coalesce(sum(length + 2) OVER (PARTITION BY doc ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM seg)
    SELECT doc, nth, CAST(b AS BIGINT) AS start, CAST(b + length AS BIGINT) AS end FROM o""")
def page_spans(spark, sf_dir) -> DataFrame:
    seg = t.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("nth"), F.length("text").cast("long").alias("length"))
    return pv.page_spans(seg).select("doc", "nth", "start", "end")


@query(f"WITH {REFS}, {BLOBS} SELECT n, sha256 FROM blobs WHERE sha256 NOT IN (SELECT sha256 FROM refs)")
def orphan_blobs(spark, sf_dir) -> DataFrame:
    return pv.orphans(blobs(spark, sf_dir), refs(spark, sf_dir), grace_days=0).select("n", "sha256")


@query(f"WITH {REFS}, {BLOBS} SELECT n, age FROM blobs WHERE (age IS NULL OR age >= 30) AND sha256 NOT IN (SELECT sha256 FROM refs)")
def gc_sweep(spark, sf_dir) -> DataFrame:
    return pv.orphans(blobs(spark, sf_dir), refs(spark, sf_dir)).select("n", "age")


@query(f"WITH {REFS}, {SOURCES} SELECT source_id, count(*) AS refs FROM refs WHERE source_id NOT IN (SELECT source_id FROM sources) GROUP BY 1")
def dangling_refs(spark, sf_dir) -> DataFrame:
    return pv.dangling(refs(spark, sf_dir), sources(spark, sf_dir)).groupBy("source_id").agg(F.count(F.lit(1)).alias("refs"))


@query(f"""WITH {REFS}, {BLOBS}, d AS (SELECT o, ln, CASE WHEN actual_sha256 IS NULL THEN 'missing' WHEN actual_sha256 <> refs.sha256 THEN 'mismatch' END AS defect, ref_kind = 'canonical' AS canonical_lost FROM refs LEFT JOIN blobs ON blobs.sha256 = refs.sha256)
    SELECT * FROM d WHERE defect IS NOT NULL""")
def integrity(spark, sf_dir) -> DataFrame:
    return pv.integrity(refs(spark, sf_dir), blobs(spark, sf_dir)).select("o", "ln", "defect", "canonical_lost")


_SHOWN = "coalesce(status, '') <> 'deprecated' AND (zone <> 'public' OR coalesce(public_allowed, true) AND (license IN ('own', 'licensed') OR license LIKE 'cc-%'))"


@query(f"WITH {SOURCES} SELECT source_id, {_SHOWN} AS shown_all, zone = 'public' AND {_SHOWN} AS shown_public FROM sources")
def availability(spark, sf_dir) -> DataFrame:
    return sources(spark, sf_dir).select("source_id", pv.available(("public", "private")).alias("shown_all"), pv.available(("public",)).alias("shown_public"))


@query(f"WITH {REFS}, {SOURCES} SELECT DISTINCT sha256 FROM refs WHERE source_id IN (SELECT source_id FROM sources WHERE zone = 'public' AND {_SHOWN})")
def blob_availability(spark, sf_dir) -> DataFrame:
    return pv.blob_available(refs(spark, sf_dir), sources(spark, sf_dir), ("public",))


@query(f"WITH {SOURCES} SELECT source_id, CASE WHEN NOT ({_SHOWN}) OR n % 6 = 0 THEN 'none' WHEN n % 4 = 1 THEN 'b' ELSE 'a' END AS level FROM sources")
def citation_level(spark, sf_dir) -> DataFrame:
    return sources(spark, sf_dir).select("source_id", pv.citation_level(pv.available(("public", "private")), F.col("n") % 6 != 0, F.col("n") % 4 == 1).alias("level"))


@query("""WITH b AS (SELECT c_custkey AS n, CASE WHEN c_custkey % 7 <> 0 THEN 'Title ' || c_custkey END AS title, CASE WHEN c_custkey % 5 = 4 THEN 'Org' || c_custkey || ' [и др.]' WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 5 = 1 THEN 'Org' || c_custkey
        WHEN c_custkey % 5 = 2 THEN 'Org' || c_custkey || ', Ivanov A. B.' ELSE 'Org' || c_custkey || ', Ivanov A. B., Solo' END AS who, CASE WHEN c_custkey % 3 <> 0 THEN 'Press' END AS publisher FROM customer)
    SELECT n, CASE WHEN title IS NOT NULL AND who <> '' THEN who || '. ' || title || '. — ' || coalesce(publisher, 'https://e.org/' || n) || CASE WHEN n % 2 = 0 THEN '. — ' || CAST(2000 + n % 20 AS VARCHAR) ELSE '' END END AS citation FROM b""")
def gost(spark, sf_dir) -> DataFrame:
    n = F.col("c_custkey")
    who = lambda literal, family, given: F.struct(F.lit(literal).alias("literal") if not isinstance(literal, F.Column) else literal.alias("literal"), F.lit(family).cast("string").alias("family"), F.lit(given).cast("string").alias("given"))
    everyone = F.array(who(F.concat(F.lit("Org"), n.cast("string")), None, None), who("", "Ivanov", "Anna Bela"), who("", "Solo", None), who("Last", None, None))
    authors = F.slice(everyone, F.lit(1), (n % 5).cast("int"))
    text = pv.citation(F.when(n % 7 != 0, F.concat(F.lit("Title "), n.cast("string"))), authors, F.when(n % 2 == 0, (2000 + n % 20).cast("string")), F.when(n % 3 != 0, "Press"), F.concat(F.lit("https://e.org/"), n.cast("string")))
    return t.table(spark, sf_dir, "customer").select(n.alias("n"), text.alias("citation"))


@query(f"""WITH {SOURCES} SELECT source_id, CASE WHEN n % 5 = 0 THEN NULL WHEN n % 5 = 1 AND n % 2 = 0 THEN 'blob_missing' WHEN n % 7 = 0 THEN 'url_no_blobs' WHEN format = 'png' THEN 'outside_pdf_axis' WHEN n % 11 = 0 THEN 'policy_pdf_only'
    WHEN n % 4 = 2 THEN 'timeout' WHEN n % 4 = 3 THEN 'conversion_failed' WHEN format = 'docx' THEN 'queued' ELSE 'blob_missing' END AS reason FROM sources""")
def citation_reason(spark, sf_dir) -> DataFrame:
    n = F.col("n")
    s = sources(spark, sf_dir).withColumns({"present": n % 5 == 0, "promised": n % 5 == 1, "exists": n % 2 != 0, "has_original": n % 7 != 0, "policy": F.when(n % 11 == 0, "pdf_only").otherwise("normalize"), "error": F.when(n % 4 == 2, "timeout").when(n % 4 == 3, "odd")})
    return s.select("source_id", pv.reason().alias("reason"))


_WHY = """CASE WHEN n % 5 = 0 THEN NULL WHEN n % 5 = 1 AND n % 2 = 0 THEN 'blob_missing' WHEN n % 7 = 0 THEN 'url_no_blobs' WHEN format = 'png' THEN 'outside_pdf_axis' WHEN n % 11 = 0 THEN 'policy_pdf_only'
    WHEN n % 4 = 2 THEN 'timeout' WHEN n % 4 = 3 THEN 'conversion_failed' WHEN format = 'docx' THEN 'queued' ELSE 'blob_missing' END"""


def described(spark, sf_dir) -> DataFrame:
    """Sources with what citations need."""
    n, kind = F.col("n"), "array<struct<literal:string,family:string,given:string>>"
    someone = F.array(F.struct(F.concat(F.lit("Org"), n.cast("string")).alias("literal"), F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("given")))
    return sources(spark, sf_dir).withColumns({
        "title": F.when(n % 6 != 0, F.col("name")), "authors": F.when(n % 13 != 0, someone).otherwise(F.array().cast(kind)), "year": F.when(n % 2 == 0, "2020"), "publisher": F.lit(None).cast("string"),
        "url": F.when(n % 3 == 0, "https://e.org"), "blob_shown": n % 10 == 0, "present": n % 5 == 0, "promised": n % 5 == 1, "exists": n % 2 != 0, "has_original": n % 7 != 0,
        "policy": F.when(n % 11 == 0, "pdf_only").otherwise("normalize"), "error": F.when(n % 4 == 2, "timeout").when(n % 4 == 3, "odd"),
    })


@query(f"""WITH {ENTRIES}, {SOURCES}, c AS (SELECT source_id, n % 10 = 0 AS blob, 'Org' || n || '. ' || name || CASE WHEN n % 3 = 0 THEN '. — https://e.org' ELSE '' END || CASE WHEN n % 2 = 0 THEN '. — 2020' ELSE '' END AS text,
        {_WHY} AS why FROM sources WHERE {_SHOWN} AND n % 6 <> 0 AND n % 13 <> 0)
    SELECT kid, CASE WHEN text IS NOT NULL THEN CASE WHEN blob THEN 'b' ELSE 'a' END END AS level, text AS citation, CASE WHEN NOT blob THEN why END AS reason
    FROM (SELECT kid, 's' || (n % 140) AS source_id FROM entries) LEFT JOIN c USING (source_id)""")
def cited_entries(spark, sf_dir) -> DataFrame:
    rows = t.entries(spark, sf_dir).select("kid", F.concat(F.lit("s"), (F.col("n") % 140).cast("string")).alias("source_id"))
    return pv.cited(rows, described(spark, sf_dir), ("public", "private")).select("kid", "level", "citation", "reason")


@query(f"""WITH {SOURCES}, {REFS}, ok AS (SELECT source_id, {_WHY} AS reason FROM sources WHERE zone = 'public' AND {_SHOWN}),
    b AS (SELECT DISTINCT source_id, ref_kind, sha256 FROM refs WHERE sha256 IN (SELECT sha256 FROM refs WHERE source_id IN (SELECT source_id FROM ok)))
    SELECT source_id, reason, sha256(string_agg(ref_kind || sha256, ',' ORDER BY ref_kind, sha256)) AS blobs FROM ok LEFT JOIN b USING (source_id) GROUP BY ALL""")
def source_views(spark, sf_dir) -> DataFrame:
    v = pv.source_views(described(spark, sf_dir), refs(spark, sf_dir), ("public",))
    text = F.array_join(F.transform("blobs", lambda x: F.concat(x["ref_kind"], x["sha256"])), ",")
    return v.select("source_id", "reason", F.when(F.col("blobs").isNotNull(), sha(text)).alias("blobs"))


@query("""WITH o AS (SELECT sha256('p' || p_partkey) AS sha256, p_brand AS role, p_size AS size, p_type AS mime FROM part WHERE p_partkey % 5 <> 0), n AS (SELECT sha256('p' || p_partkey) AS sha256, p_brand AS role, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_size END AS size, p_type AS mime FROM part WHERE p_partkey % 7 <> 0)
    SELECT sha256, CASE WHEN o.role IS NULL THEN 'added' WHEN n.role IS NULL THEN 'removed' ELSE 'updated' END AS state FROM o FULL JOIN n USING (sha256) WHERE o.role IS NULL OR n.role IS NULL OR o.size IS DISTINCT FROM n.size""")
def registry_diff(spark, sf_dir) -> DataFrame:
    p = t.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rows = lambda d, size: d.select(sha(F.concat(F.lit("p"), k.cast("string"))).alias("sha256"), F.col("p_brand").alias("role"), size.alias("size"), F.col("p_type").alias("mime"), F.col("p_name").alias("filename"), F.lit(None).cast("string").alias("derived_from"), F.col("p_type").alias("tool"), F.col("p_brand").alias("params_hash"), F.lit(True).alias("known"))
    return pv.registry_diff(rows(p.where("p_partkey % 5 <> 0"), F.col("p_size")), rows(p.where("p_partkey % 7 <> 0"), F.when(k % 8 != 0, F.col("p_size"))))


@query(f"""WITH {REFS}, u AS (SELECT o AS kid, source_id, CASE WHEN ln % 2 = 0 THEN ref_kind END AS kind, ln AS nth, CASE WHEN ln % 3 = 0 THEN 1 ELSE 0 END AS f FROM refs),
    r AS (SELECT kid, source_id, kind, nth, row_number() OVER (PARTITION BY kid, source_id, kind ORDER BY f, nth) AS rn FROM u) SELECT kid, source_id, kind, nth FROM r WHERE rn = 1""")
def source_refs_merge(spark, sf_dir) -> DataFrame:
    r = refs(spark, sf_dir).select(F.col("o").alias("kid"), "source_id", F.when(F.col("ln") % 2 == 0, F.col("ref_kind")).alias("kind"), F.col("ln").alias("nth"))
    return pv.merge_refs(r.where("nth % 3 <> 0"), r.where("nth % 3 = 0")).select("kid", "source_id", "kind", "nth")


@query(f"WITH {BLOBS} SELECT count(*) AS blobs, CAST(sum(size) AS BIGINT) AS used, round(100.0 * sum(size) / 200000, 2) AS percent, count(*) FILTER (age IS NULL) AS unknown_age FROM blobs")
def documents_stats(spark, sf_dir) -> DataFrame:
    return blobs(spark, sf_dir).agg(F.count(F.lit(1)).alias("blobs"), F.sum("size").alias("used"), F.round(100 * F.sum("size") / 200000, 2).alias("percent"), F.count_if(F.col("age").isNull()).alias("unknown_age"))


@query(f"WITH {REFS} SELECT source_id, count(DISTINCT sha256) AS blobs, min(sha256) AS first_sha FROM refs GROUP BY source_id")
def source_blobs(spark, sf_dir) -> DataFrame:
    return refs(spark, sf_dir).groupBy("source_id").agg(F.countDistinct("sha256").alias("blobs"), F.min("sha256").alias("first_sha"))
