"""Queries over entries and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.operators import retrieval as r
from quillstone.plans.sql import ENTRIES, POINTS, RANK, SERVED, STATUS, TITLE
from quillstone.sources import tables as t

QUERIES, ORACLE = {}, {}


def query(sql: str):
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return list(t.table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


def _search(where: str, order: str, limit: int) -> str:
    return f"""WITH {POINTS}, scored AS (
        SELECT kid, zone, content, round(list_cosine_similarity(vector, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 4) AS score
        FROM points WHERE regexp_matches(coalesce(content, ''), '[A-Za-zА-Яа-я0-9]') AND {where}),
        best AS (SELECT kid, zone, max(score) AS score, min({TITLE}) AS title FROM scored GROUP BY ALL)
        SELECT kid, zone, score, title FROM best ORDER BY {order} LIMIT {limit}"""


_ZONED = f"{RANK}, score DESC, kid"


@query(_search(SERVED, _ZONED, 10))
def search_topk(spark, sf_dir) -> DataFrame:
    return r.search(t.points(spark, sf_dir), query_vector(spark, sf_dir), 10)


@query(_search(SERVED, "score DESC, kid", 20))
def search_zone_merge(spark, sf_dir) -> DataFrame:
    return r.search(t.points(spark, sf_dir), query_vector(spark, sf_dir), 20, global_sort=True)


@query(_search(SERVED + " AND domain IN ('src0', 'src2', 'src4') AND subject = 'en' AND zone = 'private'", _ZONED, 10))
def search_filtered(spark, sf_dir) -> DataFrame:
    return r.search(t.points(spark, sf_dir), query_vector(spark, sf_dir), 10, {"domain": ["src0", "src2", "src4"], "subject": "en"}, scope=("private",))


@query(f"""WITH {POINTS} SELECT kid, max(round(list_cosine_similarity(vector, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 5)), 4)) AS score,
    min(content[1:200]) AS snippet FROM points WHERE parent = 'doc-00000010' GROUP BY kid ORDER BY score DESC, kid LIMIT 10""")
def find_fragment(spark, sf_dir) -> DataFrame:
    return r.find_fragment(t.points(spark, sf_dir), query_vector(spark, sf_dir, 5), "doc-00000010")


@query(f"WITH {ENTRIES} SELECT kid, zone FROM entries WHERE list_has_all(tags, ['en', 'src1']) AND {SERVED} ORDER BY {RANK}, kid LIMIT 500")
def tags_all(spark, sf_dir) -> DataFrame:
    return r.by_tags(t.entries(spark, sf_dir), ["en", "src1"], True).select("kid", "zone")


@query(f"WITH {ENTRIES} SELECT kid, zone FROM entries WHERE list_has_any(tags, ['fr', 'k7']) AND {SERVED} ORDER BY {RANK}, kid LIMIT 100")
def tags_any(spark, sf_dir) -> DataFrame:
    return r.by_tags(t.entries(spark, sf_dir), ["fr", "k7"], False, 100).select("kid", "zone")


def _values(column: str):
    def run(spark, sf_dir) -> DataFrame:
        values, totals = r.distinct_values(t.entries(spark, sf_dir), column)
        return values.join(F.broadcast(totals))

    QUERIES[f"list_{column}s"] = run
    ORACLE[f"list_{column}s"] = f"""WITH {ENTRIES}, v AS (SELECT DISTINCT {column} AS value, zone FROM entries WHERE coalesce({column}, '') <> '')
        SELECT DISTINCT value, (SELECT count(*) FROM v) AS total_count, (SELECT count(DISTINCT value) FROM v) AS distinct_count FROM v"""


for _c in ("domain", "subject", "project"):
    _values(_c)


@query(f"WITH {ENTRIES} SELECT domain, count(*) AS entries FROM entries WHERE zone = 'public' GROUP BY domain")
def knowledge_map(spark, sf_dir) -> DataFrame:
    return r.knowledge_map(t.entries(spark, sf_dir))


@query(f"""WITH {ENTRIES}, c AS (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM entries) GROUP BY tag)
    (SELECT tag, n FROM c ORDER BY n DESC, tag LIMIT 20) UNION ALL
    SELECT '...and ' || CAST(count(*) - 20 AS VARCHAR) || ' more', count(*) - 20 FROM c HAVING count(*) > 20""")
def root_index_tags(spark, sf_dir) -> DataFrame:
    return r.top_tags(t.entries(spark, sf_dir))


@query(f"""WITH {ENTRIES}, m AS (SELECT *, CAST(project IS NULL AS INTEGER) + CAST(source_url IS NULL AS INTEGER) + CAST(content_type IS NULL AS INTEGER) AS k FROM entries),
    ranked AS (SELECT domain, kid, row_number() OVER (PARTITION BY domain ORDER BY kid) AS rn FROM m WHERE k > 0),
    firsts AS (SELECT domain, string_agg(kid, ',' ORDER BY kid) AS f FROM ranked WHERE rn <= 5 GROUP BY domain)
    SELECT domain, count(*) AS entries, count(*) FILTER (k > 0) AS with_gaps, round(100.0 * count(*) FILTER (k = 0) / count(*), 1) AS coverage,
           CAST(sum(k) AS BIGINT) AS missing_fields, coalesce(any_value(f), '') AS first_gaps FROM m LEFT JOIN firsts USING (domain) GROUP BY domain""")
def section_gaps(spark, sf_dir) -> DataFrame:
    return r.section_gaps(t.entries(spark, sf_dir))


@query(f"""WITH {ENTRIES}, f AS (SELECT *, row_number() OVER (PARTITION BY domain, subject ORDER BY kid) AS rn FROM entries)
    SELECT domain, subject, count(*) AS entries, string_agg(kid, ',' ORDER BY kid) FILTER (rn <= 10) AS first_ids FROM f GROUP BY ALL""")
def l3_grouping(spark, sf_dir) -> DataFrame:
    return r.subject_groups(t.entries(spark, sf_dir))


@query(f"WITH {ENTRIES} SELECT kid, seq, {TITLE} AS title FROM entries WHERE parent = 'doc-00000020' ORDER BY seq NULLS LAST, title, kid")
def toc(spark, sf_dir) -> DataFrame:
    return r.contents(t.entries(spark, sf_dir), "doc-00000020")


@query(f"""WITH {ENTRIES}, s AS (SELECT parent, count(*) AS c, max(updated_day) AS d FROM entries WHERE parent IS NOT NULL GROUP BY parent)
    SELECT kid, domain, coalesce(c, 0) AS sections, d AS last_day FROM entries LEFT JOIN s ON s.parent = kid WHERE content_type = 'collection'""")
def collections(spark, sf_dir) -> DataFrame:
    return r.collections(t.entries(spark, sf_dir))


@query(f"WITH {ENTRIES} SELECT kid, {TITLE} AS title FROM entries")
def derive_title(spark, sf_dir) -> DataFrame:
    return t.entries(spark, sf_dir).select("kid", tx.derive_title(F.col("content"), F.col("kid")).alias("title"))


@query(f"WITH {ENTRIES} SELECT kid, {STATUS} AS status, coalesce(content_type, '') <> 'source' AS indexable, content IS NOT NULL AND regexp_matches(content, '[A-Za-zА-Яа-я0-9]') AS meaningful FROM entries")
def lifecycle_flags(spark, sf_dir) -> DataFrame:
    e = t.entries(spark, sf_dir)
    return e.select("kid", r.status_of(F.col("status")).alias("status"), (F.coalesce("content_type", F.lit("")) != "source").alias("indexable"), tx.meaningful(F.col("content")).alias("meaningful"))


@query(f"WITH {ENTRIES} SELECT domain AS name, count(*) AS entries FROM entries GROUP BY 1")
def resource_domains(spark, sf_dir) -> DataFrame:
    return r.resource(t.entries(spark, sf_dir))


@query(f"WITH {ENTRIES} SELECT kid AS name, CAST(1 AS BIGINT) AS entries FROM entries WHERE domain = 'src3' AND subject = 'en'")
def resource_entries(spark, sf_dir) -> DataFrame:
    return r.resource(t.entries(spark, sf_dir), "src3", "en")


@query(f"WITH {ENTRIES} SELECT kid, zone FROM entries WHERE kid > 'doc-00000100' ORDER BY kid LIMIT 50")
def keyset_page(spark, sf_dir) -> DataFrame:
    return r.page_after(t.entries(spark, sf_dir), "doc-00000100", 50).select("kid", "zone")


@query(f"""WITH {ENTRIES} SELECT kid, domain, version, (SELECT count(*) FROM entries WHERE parent = 'doc-00000030') AS children
    FROM entries WHERE kid = 'doc-00000030' AND zone IN ('public', 'private')""")
def get_entry(spark, sf_dir) -> DataFrame:
    return r.get_entry(t.entries(spark, sf_dir), "doc-00000030", ("public", "private")).select("kid", "domain", "version", "children")


@query(f"""WITH {ENTRIES} SELECT c.kid, CASE WHEN p.zone = 'private' AND c.zone = 'public' THEN 'private' ELSE c.zone END AS zone,
    coalesce(p.zone = 'private' AND c.zone = 'public', false) AS forced FROM entries c LEFT JOIN entries p ON p.kid = c.parent""")
def zone_inheritance(spark, sf_dir) -> DataFrame:
    e = t.entries(spark, sf_dir).select("kid", "zone", "parent")
    p = e.select(F.col("kid").alias("pid"), F.col("zone").alias("parent_zone"))
    zone, forced = r.inherit_zone(F.col("zone"), F.col("parent_zone"))
    return e.join(p, F.col("parent") == F.col("pid"), "left").select("kid", zone.alias("zone"), forced.alias("forced"))


@query("""WITH tok AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'admin' WHEN c_custkey % 3 = 0 THEN 'editor' ELSE 'subscriber' END AS level,
      c_custkey % 2 = 0 AS explicit, CASE WHEN c_custkey % 4 = 0 THEN 'private' ELSE 'public' END AS zone FROM customer)
    SELECT id, CASE WHEN level = 'admin' THEN 'private,public' WHEN explicit THEN zone WHEN level = 'editor' THEN 'private,public' ELSE 'public' END AS scope FROM tok""")
def zone_scope(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    tok = t.table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 10 == 0, "admin").when(k % 3 == 0, "editor").otherwise("subscriber").alias("level"), (k % 2 == 0).alias("explicit"), F.when(k % 4 == 0, "private").otherwise("public").alias("zone"))
    return tok.select("id", F.array_join(r.zone_scope(F.col("level"), F.col("explicit"), F.col("zone")), ",").alias("scope"))
