"""Queries of graph checks and of sections by heading or page, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import graphs as gr
from quillstone.operators import pages as pg
from quillstone.sources import tables as t

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


GRAPH = """edges AS MATERIALIZED (SELECT DISTINCT event_id % 50 AS g, event_id % 12 AS src, CASE WHEN event_id % 97 = 0 THEN event_id % 12 // 2 ELSE event_id % 12 + 1 + event_id // 600 % 4 END AS dst FROM events),
    nodes AS MATERIALIZED (SELECT DISTINCT g, node, CASE WHEN node % 4 = 0 THEN 'critic-gate' ELSE 'role' END AS kind, node % 3 AS rounds, node // 2 AS on_revise, ['t' || node % 6] AS outputs,
        CASE WHEN node % 7 = 0 THEN ['v'] ELSE [] END AS verdicts, ['brief', 't' || (node + g) % 6, CASE WHEN node % 5 = 1 THEN 'verdict' ELSE 'brief' END] AS inputs
        FROM (SELECT g, src AS node FROM edges UNION SELECT g, dst FROM edges))"""


def graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Job graphs that mostly go forward, with a way back here and there."""
    n = F.col("event_id")
    dst = F.when(n % 97 == 0, F.expr("event_id % 12 div 2")).otherwise(n % 12 + 1 + F.expr("event_id div 600") % 4)
    edges = t.table(spark, sf_dir, "events").select((n % 50).alias("g"), (n % 12).alias("src"), dst.alias("dst")).distinct()
    k, token = F.col("node"), lambda c: F.concat(F.lit("t"), c.cast("string"))
    nodes = edges.select("g", F.col("src").alias("node")).union(edges.select("g", "dst")).distinct()
    return edges, nodes.select(
        "g", "node", F.when(k % 4 == 0, "critic-gate").otherwise("role").alias("kind"), (k % 3).alias("rounds"), F.expr("node div 2").alias("on_revise"), F.array(token(k % 6)).alias("outputs"),
        F.when(k % 7 == 0, F.array(F.lit("v"))).alias("verdicts"), F.array(F.lit("brief"), token((k + F.col("g")) % 6), F.when(k % 5 == 1, "verdict").otherwise("brief")).alias("inputs"),
    )


@query(f"""WITH RECURSIVE {GRAPH}, rest AS MATERIALIZED (SELECT e.* FROM edges e JOIN nodes n ON n.g = e.g AND n.node = e.src WHERE NOT (n.kind = 'critic-gate' AND n.rounds <> 0 AND n.on_revise = e.dst)),
    walk AS (SELECT g, src, dst FROM rest UNION SELECT w.g, w.src, r.dst FROM walk w JOIN rest r ON r.g = w.g AND r.src = w.dst)
    SELECT DISTINCT g, 'L1' AS code FROM walk WHERE src = dst""")
def illegal_cycles(spark, sf_dir) -> DataFrame:
    return gr.illegal_cycles(*graph(spark, sf_dir))


@query(f"""WITH RECURSIVE {GRAPH}, walk AS (SELECT g, src, dst FROM edges UNION SELECT w.g, w.src, e.dst FROM walk w JOIN edges e ON e.g = w.g AND e.src = w.dst),
    made AS (SELECT g, node, unnest(outputs || verdicts || CASE WHEN kind = 'critic-gate' THEN ['verdict'] ELSE [] END) AS token FROM nodes),
    there AS (SELECT DISTINCT w.g, w.dst, token FROM walk w JOIN made m ON m.g = w.g AND m.node = w.src),
    need AS (SELECT DISTINCT g, node AS dst, unnest(inputs) AS token FROM nodes),
    bare AS (SELECT g, dst, string_agg(token, ',' ORDER BY token) AS missing FROM need ANTI JOIN there USING (g, dst, token) WHERE token <> 'brief' GROUP BY ALL)
    SELECT g, src, dst, missing FROM edges JOIN bare USING (g, dst)""")
def missing_inputs(spark, sf_dir) -> DataFrame:
    return gr.missing_inputs(*graph(spark, sf_dir))


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id AS doc, coalesce(text, '') AS content, length(coalesce(text, '')) AS n FROM documents),
    p AS (SELECT doc, k + 1 AS page, k * 1500 AS start, least(n, k * 1500 + 1500) AS stop FROM d, LATERAL (SELECT unnest(range(0, (n + 1499) // 1500)) AS k)),
    h AS MATERIALIZED (SELECT doc, k + 1 AS nth, CASE WHEN k % 5 = 4 THEN 'not there' ELSE content[k * 900 + 41:k * 900 + 60] END AS title
        FROM d, LATERAL (SELECT unnest(range(0, n // 900)) AS k) WHERE doc % 3 <> 0),
    many AS (SELECT doc, count(*) AS total FROM h GROUP BY doc HAVING count(*) >= 2),
    w AS (SELECT doc, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS at_c, CAST(-1 AS BIGINT) AS start, CAST(-1 AS BIGINT) AS stop, '' AS title FROM many
        UNION ALL SELECT doc, nth, CASE WHEN f > 0 THEN at_c + f - 1 + length(title) ELSE at_c END, CASE WHEN f > 0 THEN at_c ELSE -1 END, at_c + f - 1, title
        FROM (SELECT w.doc, h.nth, w.at_c, h.title, strpos(d.content[w.at_c + 1:], h.title) AS f FROM w JOIN h ON h.doc = w.doc AND h.nth = w.nth + 1 JOIN d ON d.doc = w.doc)),
    s AS (SELECT doc, nth, start, stop, title FROM w WHERE start >= 0
        UNION ALL SELECT w.doc, total + 1, at_c, n, 'Последний раздел' FROM w JOIN many USING (doc) JOIN d USING (doc) WHERE nth = total),
    a AS (SELECT doc, nth, title, {_STRIP.format('content[start + 1:stop]')} AS body, start + length(content[start + 1:stop]) - length(regexp_replace(content[start + 1:stop], '^\\s+', '')) AS b FROM s JOIN d USING (doc)),
    x AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY nth) AS seq, title, body, b // 1500 + 1 AS page, (b + length(body) - 1) // 1500 + 1 AS last_page FROM a WHERE body <> ''),
    y AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY page) AS seq, body, page FROM (
        SELECT doc, page, {_STRIP.format('content[start + 1:stop]')} AS body FROM p JOIN d USING (doc) WHERE doc NOT IN (SELECT doc FROM many)) WHERE body <> '')
    SELECT doc, seq, title, sha256(body) AS digest, page, last_page FROM x UNION ALL SELECT doc, seq, 'Страница ' || seq, sha256(body), page, page FROM y""")
def imported_sections(spark, sf_dir) -> DataFrame:
    """Pages of 1,500 characters; a heading every 900 in two documents of three, each fifth of them not in the text. Long
    sections stay whole here, as SQL can't cut them; tests/test_checks.py does."""
    text = F.coalesce("text", F.lit(""))
    d = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), text.alias("content"), F.length(text).alias("n"))
    k = F.col("k")
    p = d.where("n > 0").select("doc", "n", F.explode(F.sequence(F.lit(0), F.expr("(n - 1) div 1500").cast("int"))).alias("k"))
    pages = p.select("doc", (k + 1).cast("long").alias("page"), (k * 1500).alias("start"), F.least("n", k * 1500 + 1500).alias("stop"))
    h = d.where("doc % 3 <> 0 and n >= 900").select("doc", "content", F.explode(F.sequence(F.lit(0), F.expr("n div 900 - 1").cast("int"))).alias("k"))
    title = F.when(k % 5 == 4, "not there").otherwise(F.substr("content", k * 900 + 41, F.lit(20)))
    out = pg.imported_sections(d.select("doc", "content"), h.select("doc", (k + 1).alias("nth"), title.alias("title")), pages, longest=10**9)
    return out.select("doc", F.col("seq").cast("long").alias("seq"), "title", F.sha2(F.col("body").cast("binary"), 256).alias("digest"), "page", "last_page")
