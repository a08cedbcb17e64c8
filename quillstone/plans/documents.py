"""Queries of the document pipeline, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.functions import time as tm
from quillstone.operators import documents as dc
from quillstone.plans.sql import ENTRIES
from quillstone.sources import tables as t

QUERIES, ORACLE = {}, {}
NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {ENTRIES} SELECT kid, length(content) AS chars, CAST(ceil(length(coalesce(content, '')) / 4) AS BIGINT) AS tokens FROM entries")
def token_count(spark, sf_dir) -> DataFrame:
    return t.entries(spark, sf_dir).select("kid", F.length("content").cast("long").alias("chars"), tx.token_count(F.col("content")).alias("tokens"))


@query(f"""WITH {ENTRIES}, w AS (SELECT kid, content, unnest(range(0, 1 + CAST(greatest(0, ceil((length(content) - 480) / 240)) AS BIGINT))) AS nth FROM entries WHERE length(content) > 0)
    SELECT kid, nth, nth * 240 AS start, sha256(content[nth * 240 + 1:nth * 240 + 480]) AS digest FROM w""")
def chunk_stride(spark, sf_dir) -> DataFrame:
    w = dc.chunk_windows(t.entries(spark, sf_dir))
    return w.select("kid", F.col("nth").cast("long").alias("nth"), F.col("start").cast("long").alias("start"), F.sha2(F.col("content").cast("binary"), 256).alias("digest"))


@query(f"""WITH {ENTRIES}, m AS (SELECT kid, replace(content, chr(10), chr(10) || '## Part' || chr(10)) AS content FROM entries), p AS (SELECT kid, string_split_regex(content, '(?m)^##[ \\t]+') AS a FROM m WHERE regexp_matches(content, '(?m)^##[ \\t]+')),
    s AS (SELECT kid, unnest(range(2, len(a) + 1)) AS i, a FROM p), h AS (SELECT kid, i - 2 AS nth, regexp_replace(regexp_extract(a[i], '^([^\\n]*)', 1), '^\\s+|\\s+$', '', 'g') AS header, regexp_replace(regexp_replace(a[i], '^[^\\n]*\\n?', ''), '^\\s+|\\s+$', '', 'g') AS body FROM s)
    SELECT kid, nth, header, length(body) AS chars FROM h WHERE body <> ''""")
def h2_sections(spark, sf_dir) -> DataFrame:
    """Every line but the first under a heading of its own."""
    marked = t.entries(spark, sf_dir).withColumn("content", F.replace("content", F.lit("\n"), F.lit("\n## Part\n")))
    return dc.h2_sections(marked).select("kid", F.col("nth").cast("long").alias("nth"), "header", F.length("body").cast("long").alias("chars"))


@query(f"""WITH {ENTRIES}, s AS (SELECT kid, list_filter(string_split_regex(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ') <> '') AS a FROM entries)
    SELECT kid, len(a) AS sentences, a[1] AS first FROM s""")
def sentence_split(spark, sf_dir) -> DataFrame:
    s = tx.sentences(F.col("content"))
    return t.entries(spark, sf_dir).select("kid", F.size(s).cast("long").alias("sentences"), F.get(s, 0).alias("first"))


@query(f"""WITH RECURSIVE {ENTRIES}, s AS MATERIALIZED (SELECT kid, list_filter(string_split_regex(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ') <> '') AS a FROM entries),
    l AS MATERIALIZED (SELECT kid, list_transform(a, lambda x: length(x)) AS n FROM s WHERE len(a) > 0),
    w AS (SELECT kid, 1 AS i, 0 AS nth, n[1] AS open FROM l UNION ALL
        SELECT w.kid, i + 1, CASE WHEN ceil((open + 1 + l.n[i + 1]) / 4) > 120 THEN nth + 1 ELSE nth END, CASE WHEN ceil((open + 1 + l.n[i + 1]) / 4) > 120 THEN l.n[i + 1] ELSE open + 1 + l.n[i + 1] END
        FROM w JOIN l USING (kid) WHERE i < len(l.n))
    SELECT kid, nth, CAST(ceil(max(open) / 4) AS BIGINT) AS tokens FROM w GROUP BY ALL""")
def sentence_packs(spark, sf_dir) -> DataFrame:
    packs = dc.pack_sentences(F.col("content"), 120)
    return t.entries(spark, sf_dir).select("kid", F.posexplode(packs).alias("nth", "pack")).select("kid", F.col("nth").cast("long").alias("nth"), tx.token_count(F.col("pack")).alias("tokens"))


@query(f"""WITH {ENTRIES}, w AS (SELECT domain, kid, unnest(regexp_extract_all(lower(content), '[a-zа-яё0-9]{{2,}}')) AS word FROM entries),
    tf AS (SELECT domain, kid, word, count(*) AS tf FROM w WHERE word NOT IN ('the', 'of', 'and', 'de', 'la') GROUP BY ALL), nd AS (SELECT domain, count(DISTINCT kid) AS n FROM entries GROUP BY domain),
    st AS (SELECT domain, word, sum(tf) AS total, count(*) AS df FROM tf GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY total DESC, word) AS f FROM st),
    x AS (SELECT tf.domain, kid, word, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN k USING (domain, word) JOIN nd USING (domain) WHERE f <= 100),
    y AS (SELECT domain, kid, word, round(w / sqrt(sum(w * w) OVER (PARTITION BY domain, kid)), 6) AS weight FROM x),
    z AS (SELECT *, row_number() OVER (PARTITION BY domain, kid ORDER BY weight DESC, word DESC) AS rank FROM y) SELECT kid, rank, word, weight FROM z WHERE rank <= 5""")
def tfidf_top(spark, sf_dir) -> DataFrame:
    k = dc.keywords(t.entries(spark, sf_dir), ["domain"], ["the", "of", "and", "de", "la"])
    return k.select("kid", F.col("rank").cast("long").alias("rank"), "word", "weight")


@query("""SELECT p_partkey AS id, trim(regexp_replace(lower(p_name || ' — ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part""")
def slugify(spark, sf_dir) -> DataFrame:
    return t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tx.slugify(F.concat("p_name", F.lit(" — "), "p_brand")).alias("slug"))


_SHAPED = """CASE WHEN length(content) <= 1000 THEN content ELSE content[1:800] || chr(10) || chr(10)
    || '[…cut ' || CAST(CAST(round_even((length(content) - 1000) * 100 / length(content), 0) AS INTEGER) AS VARCHAR) || '% …]' || chr(10) || chr(10) || right(content, 200) END"""


@query(f"WITH {ENTRIES}, s AS (SELECT kid, {_SHAPED} AS t FROM entries) SELECT kid, length(t) AS chars, sha256(t) AS digest FROM s")
def shape_section(spark, sf_dir) -> DataFrame:
    s = tx.shape_section(F.col("content"), 1000)
    return t.entries(spark, sf_dir).select("kid", F.length(s).cast("long").alias("chars"), F.sha2(s.cast("binary"), 256).alias("digest"))


@query(f"WITH {ENTRIES} SELECT kid, array_to_string(string_split(content, chr(10))[1:30], chr(10))[1:2000] AS snippet FROM entries")
def snippet(spark, sf_dir) -> DataFrame:
    return t.entries(spark, sf_dir).select("kid", tx.snippet(F.col("content")).alias("snippet"))


@query("SELECT event_id AS id, CASE WHEN left(regexp_replace(props || event_type, '[^A-Za-z0-9_.-]', '_', 'g'), 64) = '' THEN 'none' ELSE left(regexp_replace(props || event_type, '[^A-Za-z0-9_.-]', '_', 'g'), 64) END AS label FROM events")
def metric_label(spark, sf_dir) -> DataFrame:
    return t.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), tx.metric_label(F.concat("props", "event_type")).alias("label"))


@query("""WITH r AS (SELECT event_id AS id, event_id % 100 AS a, event_id % 37 AS b FROM events) SELECT id, CASE WHEN id % 3 = 0 THEN CASE WHEN b > 0 THEN greatest(0, 80 - b) END WHEN id % 3 = 1 THEN CASE WHEN a < 80 THEN a END ELSE CASE WHEN a < 80 AND a <= least(b, 79) THEN a END END AS start,
    CASE WHEN id % 3 = 0 THEN CASE WHEN b > 0 THEN 79 END WHEN id % 3 = 1 THEN CASE WHEN a < 80 THEN 79 END ELSE CASE WHEN a < 80 AND a <= least(b, 79) THEN least(b, 79) END END AS stop FROM r""")
def byte_ranges(spark, sf_dir) -> DataFrame:
    n = F.col("event_id")
    a, b = (n % 100).cast("string"), (n % 37).cast("string")
    header = F.when(n % 3 == 0, F.concat(F.lit("bytes=-"), b)).when(n % 3 == 1, F.concat(F.lit("bytes="), a, F.lit("-"))).otherwise(F.concat(F.lit("bytes="), a, F.lit("-"), b))
    r = tx.byte_range(header, F.lit(80))
    return t.table(spark, sf_dir, "events").select(n.alias("id"), r["start"].alias("start"), r["end"].alias("stop"))


_HEX = "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(zone || ':' || kid || ':0'))"


@query(f"""WITH {ENTRIES}, h AS (SELECT kid, {_HEX} AS h FROM entries)
    SELECT kid, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][(strpos('0123456789abcdef', h[17]) - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] AS point_id FROM h""")
def uuid5_points(spark, sf_dir) -> DataFrame:
    return t.entries(spark, sf_dir).select("kid", dc.point_id(NAMESPACE, F.concat_ws(":", "zone", "kid", F.lit("0"))).alias("point_id"))


@query(None)
def cluster_paragraphs(spark, sf_dir) -> DataFrame:
    p = t.table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 25").alias("doc"), F.expr("vec_id % 25").alias("nth"), F.col("embedding").alias("vector"))
    return dc.cluster_paragraphs(p)


@query(f"""WITH {ENTRIES}, a AS (SELECT domain, kid[1:9] AS k, sha256(string_agg(kid || ' ' || sha256(content), chr(10) ORDER BY kid)) AS h FROM entries GROUP BY ALL),
    b AS (SELECT domain, k[1:6] AS k, sha256(string_agg(k || ' ' || h, chr(10) ORDER BY k)) AS h FROM a GROUP BY domain, k[1:6])
    SELECT domain, sha256(string_agg(k || ' ' || h, chr(10) ORDER BY k)) AS checksum FROM b GROUP BY domain""")
def tree_checksum(spark, sf_dir) -> DataFrame:
    e = t.entries(spark, sf_dir).select("domain", "kid", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))
    return dc.tree_checksum(e, "domain", "kid", "digest", (9, 6))


@query("""SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'token=<secret> see <secret> end' WHEN 1 THEN 'Authorization: <secret>' WHEN 2 THEN 'x Bearer <secret> y'
    WHEN 3 THEN 'sum <secret> of ' || event_id WHEN 4 THEN 'API_KEY=<secret> and password=<secret>' ELSE 'plain ' || event_type || ' token' END AS masked FROM events""")
def mask_secrets(spark, sf_dir) -> DataFrame:
    """Every pattern, and a text that none matches."""
    n = F.col("event_id").cast("string")
    k = F.col("event_id") % 6
    text = (
        F.when(k == 0, F.concat(F.lit("token: abc"), n, F.lit(" see mcp_ab_K"), n, F.lit(" end"))).when(k == 1, F.concat(F.lit("Authorization: Basic "), n))
        .when(k == 2, F.concat(F.lit("x Bearer a."), n, F.lit(" y"))).when(k == 3, F.concat(F.lit("sum "), F.sha2(n.cast("binary"), 256), F.lit(" of "), n))
        .when(k == 4, F.concat(F.lit("API_KEY=k"), n, F.lit(" and password = p"), n)).otherwise(F.concat(F.lit("plain "), "event_type", F.lit(" token")))
    )
    return t.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), tx.mask_secrets(text).alias("masked"))


@query("""SELECT event_id AS id, strftime(ts, '%G-W%V') AS week, strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d') AS day, strftime(ts + INTERVAL 3 HOUR, '%Y-%m') AS month,
    CAST(86400 - (hour(ts + INTERVAL 3 HOUR) * 3600 + minute(ts) * 60 + second(ts)) AS BIGINT) AS to_midnight, (isodow(ts + INTERVAL 3 HOUR) = 1 AND hour(ts + INTERVAL 3 HOUR) >= 10) OR isodow(ts + INTERVAL 3 HOUR) IN (2, 3) AS due,
    CASE WHEN event_id >= 86400 THEN CAST(event_id // 86400 AS VARCHAR) || 'd' WHEN event_id >= 3600 THEN CAST(event_id // 3600 AS VARCHAR) || 'h' WHEN event_id >= 60 THEN CAST(event_id // 60 AS VARCHAR) || 'm' ELSE 'now' END AS age FROM events""")
def time_keys(spark, sf_dir) -> DataFrame:
    ts, zone = F.col("ts").cast("timestamp"), "Europe/Moscow"
    return t.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), tm.iso_week(ts).alias("week"), tm.local_day(ts, zone).alias("day"), tm.local_month(ts, zone).alias("month"), tm.seconds_to_midnight(ts, zone).alias("to_midnight"), tm.digest_due(ts, zone).alias("due"), tm.age_text(F.col("event_id")).alias("age"),
    )


@query("""SELECT p_partkey AS id, 'src-' || sha256('p' || p_partkey)[1:16] AS source_id, sha256(lower(trim(regexp_replace(p_name || '|' || p_brand, '\\s+', ' ', 'g')))) AS dupe_hash,
    sha256('job' || p_partkey || chr(31) || 'node' || chr(31) || p_type) AS effect_id FROM part""")
def identifiers(spark, sf_dir) -> DataFrame:
    n = F.col("p_partkey").cast("string")
    return t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tx.source_id(F.concat(F.lit("p"), n)).alias("source_id"), tx.dupe_hash(F.col("p_name"), F.col("p_brand")).alias("dupe_hash"), tx.effect_id(F.concat(F.lit("job"), n), F.lit("node"), F.col("p_type")).alias("effect_id"))
