"""Queries of what happens to a text before it is an entry, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.operators import authoring as au
from quillstone.operators import documents as dc
from quillstone.operators import neighbours as nb
from quillstone.plans.sql import ENTRIES, POINTS
from quillstone.sources import tables as t

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


#: Texts with planted headings, front matter and code fences.
MARKED = f"""{ENTRIES}, marked AS (SELECT kid, n, domain, subject, tags, project, CASE n % 4
        WHEN 0 THEN replace(content, chr(10), chr(10) || '## Part two' || chr(10))
        WHEN 1 THEN '# One title' || chr(10) || content
        WHEN 2 THEN content
        ELSE '---' || chr(10) || 'k: v' || chr(10) || '---' || chr(10) || '# Head ' || kid || chr(10) || '```' || chr(10) || 'code' || chr(10)
            || '```' || chr(10) || content || chr(10) || '### Tail' || chr(10) || 'end' END AS content FROM entries)"""


def marked(spark, sf_dir) -> DataFrame:
    n, nl = F.col("n"), "\n"
    fenced = F.concat(F.lit("---\nk: v\n---\n# Head "), "kid", F.lit("\n```\ncode\n```\n"), "content", F.lit("\n### Tail\nend"))
    content = (
        F.when(n % 4 == 0, F.replace("content", F.lit(nl), F.lit("\n## Part two\n"))).when(n % 4 == 1, F.concat(F.lit("# One title\n"), "content"))
        .when(n % 4 == 2, F.col("content")).otherwise(fenced)
    )
    return t.entries(spark, sf_dir).select("kid", "n", "domain", "subject", "tags", "project", content.alias("content"))


_TITLE = _strip(r"regexp_extract(a[i], '^#{1,3}\s+(.+)', 1)")
SECTIONS = rf"""{MARKED},
    cut AS (SELECT kid, content, string_split(regexp_replace(content, '(?m)^(#{{1,3}}\s+.+)$', chr(1) || '\1', 'g'), chr(1)) AS a
            FROM marked WHERE {_strip('content')} <> ''),
    sec AS (SELECT kid, 1 AS nth, CASE WHEN len(a) = 2 THEN {_TITLE.replace('a[i]', 'a[2]')} ELSE 'Untitled' END AS title, {_strip('content')} AS body
            FROM cut WHERE len(a) < 3
            UNION ALL
            SELECT kid, i - 1, {_TITLE}, CASE WHEN i = 2 AND {_strip('a[1]')} <> '' THEN {_strip('a[1]')} || chr(10) || chr(10) ELSE '' END || {_strip('a[i]')}
            FROM (SELECT kid, a, unnest(range(2, len(a) + 1)) AS i FROM cut WHERE len(a) >= 3))"""


@query(f"WITH {SECTIONS} SELECT kid, nth, title, length(body) AS chars, sha256(body) AS digest FROM sec")
def structural_sections(spark, sf_dir) -> DataFrame:
    s = au.structural_sections(marked(spark, sf_dir))
    return s.select("kid", F.col("nth").cast("long").alias("nth"), "title", F.length("body").cast("long").alias("chars"), F.sha2(F.col("body").cast("binary"), 256).alias("digest"))


_SENTENCES = rf"string_split(regexp_replace({_strip('body')}, '([.!?])\s+', '\1' || chr(2), 'g'), chr(2))"
_MORE = "walk.tokens + lens.l[i + 1]"


@query(f"""WITH RECURSIVE {SECTIONS},
    big AS MATERIALIZED (SELECT kid, nth, title, body, list_filter(list_transform({_SENTENCES}, lambda x: {_strip('x')}), lambda x: x <> '') AS s
            FROM sec WHERE length(body) // 4 > 512),
    lens AS MATERIALIZED (SELECT kid, nth, list_transform(s, lambda x: length(x) // 4) AS l FROM big WHERE len(s) > 1),
    walk AS (SELECT kid, nth, 1 AS i, 1 AS part, l[1] AS tokens FROM lens
            UNION ALL
            SELECT kid, nth, i + 1, CASE WHEN {_MORE} > 512 THEN part + 1 ELSE part END, CASE WHEN {_MORE} > 512 THEN lens.l[i + 1] ELSE {_MORE} END
            FROM walk JOIN lens USING (kid, nth) WHERE i < len(lens.l)),
    packed AS (SELECT kid, nth, part, string_agg(s[i], ' ' ORDER BY i) AS body, any_value(title) AS title FROM walk JOIN big USING (kid, nth) GROUP BY ALL),
    parts AS (SELECT kid, nth, 1 AS part, title, body FROM sec WHERE length(body) // 4 <= 512
            UNION ALL SELECT kid, nth, 1, title, body[1:2048] FROM big WHERE len(s) <= 1
            UNION ALL SELECT kid, nth, part, title || CASE WHEN count(*) OVER (PARTITION BY kid, nth) > 1 THEN ' (part ' || part || ')' ELSE '' END, body FROM packed)
    SELECT kid, row_number() OVER (PARTITION BY kid ORDER BY nth, part) AS seq, title, length(body) AS chars, sha256(body) AS digest FROM parts""")
def hybrid_sections(spark, sf_dir) -> DataFrame:
    s = au.hybrid_sections(marked(spark, sf_dir))
    return s.select("kid", F.col("seq").cast("long").alias("seq"), "title", F.length("body").cast("long").alias("chars"), F.sha2(F.col("body").cast("binary"), 256).alias("digest"))


def paragraph_texts(spark, sf_dir) -> DataFrame:
    """The marked texts with a paragraph a line; every other one has no headings."""
    body = F.when(F.col("n") % 2 == 0, F.regexp_replace("content", r"(?m)^#+\s", "")).otherwise(F.col("content"))
    return marked(spark, sf_dir).select("kid", "n", F.replace(body, F.lit("\n"), F.lit("\n\n")).alias("content"))


def paragraph_vectors(spark, sf_dir) -> DataFrame:
    """A vector per paragraph: those of two neighbours are often the same."""
    p = paragraph_texts(spark, sf_dir).select("kid", "n", F.posexplode(dc.paragraphs(F.col("content"))).alias("nth", "text"))
    v = t.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return p.select("kid", "nth", ((F.col("n") * 31 + F.expr("nth div 2")) % 500).alias("vec_id")).join(v, "vec_id").select("kid", "nth", "vector")


@query(None)
def hybrid_clustered(spark, sf_dir) -> DataFrame:
    s = au.hybrid_sections(paragraph_texts(spark, sf_dir), vectors=paragraph_vectors(spark, sf_dir))
    return s.select("kid", F.col("seq").cast("long").alias("seq"), "title", F.length("body").cast("long").alias("chars"), F.sha2(F.col("body").cast("binary"), 256).alias("digest"))


@query(f"""WITH {SECTIONS}, w AS (SELECT *, ceil(length(body) / 4) <= 120 AS short, unnest(range(0, CASE WHEN ceil(length(body) / 4) <= 120 THEN 1
        ELSE 1 + CAST(greatest(0, ceil((length(body) - 480) / 240)) AS BIGINT) END)) AS w FROM sec)
    SELECT kid, row_number() OVER (PARTITION BY kid ORDER BY nth, w) - 1 AS chunk, w * 240 AS start,
        sha256(CASE WHEN short THEN body WHEN title = '' THEN body[w * 240 + 1:w * 240 + 480] ELSE '## ' || title || chr(10) || chr(10) || body[w * 240 + 1:w * 240 + 480] END) AS digest FROM w""")
def header_chunks(spark, sf_dir) -> DataFrame:
    s = au.structural_sections(marked(spark, sf_dir)).withColumnRenamed("title", "header")
    c = au.header_chunks(s)
    return c.select("kid", F.col("chunk").cast("long").alias("chunk"), F.col("start").cast("long").alias("start"), F.sha2(F.col("content").cast("binary"), 256).alias("digest"))


@query(f"""WITH {MARKED}, l AS (SELECT kid, n, list_filter(list_transform(string_split({_strip('content')}, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS a FROM marked
        WHERE n % 4 IN (1, 3) AND NOT contains(content, '```x')),
    m AS (SELECT kid, CASE WHEN n % 4 = 1 THEN a ELSE a[4:4] || a[8:] END AS a FROM l)
    SELECT kid, ltrim(a[1], '# ') || ' ' || CASE WHEN starts_with(a[2], '#') THEN ltrim(a[2], '# ') || ' ' || a[3] ELSE a[2] END AS text FROM m
    WHERE NOT (starts_with(a[2], '#') AND (len(a) < 3 OR starts_with(a[3], '#'))) AND NOT starts_with(a[2], '---')""")
def representative_texts(spark, sf_dir) -> DataFrame:
    """The texts with one planted heading in front, behind front matter and a fence or not."""
    lines = F.filter(F.transform(F.split(tx.strip(F.col("content")), "\n"), tx.strip), lambda s: s != "")
    m = marked(spark, sf_dir).where("n % 4 in (1, 3) and not contains(content, '```x')").withColumn("a", F.when(F.col("n") % 4 == 1, F.slice(lines, 2, 2)).otherwise(F.slice(lines, 8, 2)))
    odd = F.get("a", F.lit(0)).startswith("#") & ((F.size("a") < 2) | F.coalesce(F.get("a", F.lit(1)).startswith("#"), F.lit(True)))
    return m.where(~odd & ~F.get("a", F.lit(0)).startswith("---")).select("kid", au.representative_text(F.col("content")).alias("text"))


@query(f"""WITH {POINTS}, q AS (SELECT CASE WHEN vec_id % 100 = 0 THEN kid ELSE 'new-' || kid END AS kid, domain, vector FROM points WHERE vec_id % 50 = 0),
    s AS (SELECT q.kid, p.kid AS other, list_cosine_similarity(q.vector, p.vector) AS c FROM q JOIN points p USING (domain) WHERE q.kid <> p.kid),
    r AS (SELECT *, row_number() OVER (PARTITION BY kid ORDER BY c DESC, other) AS rank FROM s)
    SELECT kid, other, round(c, 4) AS score FROM r WHERE rank <= 8 AND c >= 0.92""")
def duplicate_gate(spark, sf_dir) -> DataFrame:
    """New texts whose vector is that of an entry, and updates of entries themselves."""
    p = t.points(spark, sf_dir)
    kid = F.when(F.col("vec_id") % 100 == 0, F.col("kid")).otherwise(F.concat(F.lit("new-"), "kid"))
    return nb.duplicate_gate(p.where("vec_id % 50 = 0").select(kid.alias("kid"), "domain", "vector"), p.select("kid", "domain", "vector"))


_SLUG = "regexp_replace(trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')[1:40], '-+$', '')"
_IDS = f"""parts AS (SELECT p_partkey AS id, coalesce(nullif({_SLUG.format('p_brand')}, ''), 'domain') AS d, coalesce(nullif({_SLUG.format("CASE WHEN p_partkey % 5 = 0 THEN '!' ELSE p_type END")}, ''), 'subject') AS s,
        {_SLUG.format("CASE WHEN p_partkey % 7 = 0 THEN 'section' ELSE p_name || ' ' || p_name || ' ' || p_name END")} AS title, {_SLUG.format("CASE WHEN p_partkey % 7 = 0 THEN 'collection' ELSE p_name || ' ' || p_name || ' ' || p_name END")} AS c FROM part)"""


@query(f"""WITH {_IDS}, x AS (SELECT *, lpad(CAST(id % 1000 AS VARCHAR), 3, '0') AS suffix FROM parts)
    SELECT id, d || '-' || s || '-' || title[1:greatest(0, least(length(title), 124 - length(d) - length(s) - length(suffix)))] || '-' || suffix AS kid,
        d || '-' || s || '-' || c[1:greatest(0, least(length(c), 124 - length(d) - length(s) - 10))] || '-collection' AS collection FROM x""")
def entry_ids(spark, sf_dir) -> DataFrame:
    n = F.col("p_partkey")
    subject = F.when(n % 5 == 0, "!").otherwise(F.col("p_type"))
    title = F.when(n % 7 == 0, "").otherwise(F.concat_ws(" ", "p_name", "p_name", "p_name"))
    suffix = F.lpad((n % 1000).cast("string"), 3, "0")
    return t.table(spark, sf_dir, "part").select(
        n.alias("id"), tx.knowledge_id(F.col("p_brand"), subject, title, suffix).alias("kid"), au.collection_id(F.col("p_brand"), subject, title).alias("collection")
    )


@query(f"""WITH {MARKED}, h AS (SELECT kid, domain, subject, content, {_SLUG.format(chr(39) + chr(39) + " || regexp_extract(content, '(?m)^##[ ]+(.+)$', 1)")} AS slug FROM marked WHERE regexp_matches(domain || subject, '^[a-z0-9]+$'))
    SELECT kid, regexp_replace((domain || '-' || subject || '-' || CASE WHEN slug = '' THEN sha256(content[1:200])[1:8] ELSE slug END)[1:127], '-+$', '') AS auto_id FROM h""")
def auto_ids(spark, sf_dir) -> DataFrame:
    plain = marked(spark, sf_dir).where(F.concat("domain", "subject").rlike("^[a-z0-9]+$"))
    return plain.select("kid", au.auto_id(F.col("domain"), F.col("subject"), F.col("content")).alias("auto_id"))


@query(f"""WITH {ENTRIES}, x AS (SELECT kid, tags || [upper(subject), 'New ' || kid, ''] AS own, [upper(domain), project] AS inherited FROM entries WHERE project IS NOT NULL),
    u AS (SELECT kid, tag, nth, row_number() OVER (PARTITION BY kid, lower(tag) ORDER BY nth) AS rn FROM (
        SELECT kid, unnest(inherited || own) AS tag, generate_subscripts(inherited || own, 1) AS nth FROM x)),
    c AS (SELECT kid, list(t ORDER BY nth) AS l FROM (SELECT kid, nth, t, row_number() OVER (PARTITION BY kid, t ORDER BY nth) AS rn FROM (
        SELECT kid, trim(regexp_replace(lower(tag), '\\s+', ' ', 'g')) AS t, nth FROM (SELECT kid, unnest(own) AS tag, generate_subscripts(own, 1) AS nth FROM x)) WHERE t <> '') WHERE rn = 1 GROUP BY kid)
    SELECT kid, merged, array_to_string(l[1:4], ',') AS clean FROM (SELECT kid, string_agg(tag, ',' ORDER BY nth) AS merged FROM u WHERE rn = 1 GROUP BY kid) JOIN c USING (kid)""")
def tag_lists(spark, sf_dir) -> DataFrame:
    e = t.entries(spark, sf_dir).where("project is not null")
    own = F.concat("tags", F.array(F.upper("subject"), F.concat(F.lit("New "), "kid"), F.lit("")))
    merged = au.merged_tags(own, F.array(F.upper("domain"), F.col("project")))
    return e.select("kid", F.array_join(merged, ",").alias("merged"), F.array_join(au.normal_tags(own, 4), ",").alias("clean"))


@query(f"""WITH {ENTRIES.replace("SELECT doc_id AS n,", "SELECT doc_id AS n, CASE doc_id % 4 WHEN 0 THEN [lang, 'k3'] WHEN 1 THEN ['k1', 'k2'] ELSE [] END AS x,")}, c AS (SELECT domain, tag, row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, tag) AS rank FROM (SELECT domain, unnest(tags) AS tag FROM entries) GROUP BY domain, tag),
    f AS (SELECT kid, tag, row_number() OVER (PARTITION BY kid ORDER BY rank) AS o FROM entries JOIN c USING (domain) WHERE rank <= 10 AND NOT list_contains(tags || x, tag)),
    p AS (SELECT kid, tags || x AS tags, unnest([domain, subject, project]) AS part, unnest([101, 102, 103]) AS o FROM entries),
    u AS (SELECT kid, tag, o FROM f WHERE o <= 5 UNION ALL SELECT kid, translate(lower(part), '_/', '--'), o FROM p WHERE part IS NOT NULL AND NOT list_contains(tags, translate(lower(part), '_/', '--'))),
    d AS (SELECT kid, tag, min(o) AS o FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY kid ORDER BY o) AS nth FROM d)
    SELECT kid, coalesce(string_agg(tag, ',' ORDER BY nth) FILTER (nth <= 7), '') AS suggested FROM entries LEFT JOIN r USING (kid) GROUP BY kid""")
def suggested_tags(spark, sf_dir) -> DataFrame:
    n = F.col("n")
    crossed = F.when(n % 4 == 0, F.array("subject", F.lit("k3"))).when(n % 4 == 1, F.array(F.lit("k1"), F.lit("k2")))
    s = au.suggested_tags(t.entries(spark, sf_dir).withColumn("cross_subjects", crossed))
    return s.select("kid", F.array_join("suggested", ",").alias("suggested"))


@query(f"""WITH {ENTRIES}, c AS (SELECT parent, CASE n % 3 WHEN 0 THEN 'gone-' || kid WHEN 1 THEN 'doc-' || n ELSE kid || '-lost' END AS child FROM entries WHERE parent IS NOT NULL),
    k AS (SELECT parent, child, list_max(list_filter(range(1, least(length(parent), length(child)) + 1), lambda i: parent[1:i] = child[1:i])) AS same FROM c WHERE child NOT IN (SELECT kid FROM entries)),
    l AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY child) AS nth FROM k WHERE length(regexp_replace(parent[1:coalesce(same, 0)], '-[^-]*$', '')) < 6)
    SELECT parent, child FROM l WHERE nth <= 5""")
def lost_children(spark, sf_dir) -> DataFrame:
    e = t.entries(spark, sf_dir)
    n = F.col("n")
    child = F.when(n % 3 == 0, F.concat(F.lit("gone-"), "kid")).when(n % 3 == 1, F.concat(F.lit("doc-"), n.cast("string"))).otherwise(F.concat("kid", F.lit("-lost")))
    return au.lost_children(e.where("parent is not null").select("parent", child.alias("child")), e)


@query(f"""WITH {ENTRIES} SELECT kid, 'source_url' AS field FROM entries WHERE source_url IS NULL UNION ALL SELECT kid, 'evergreen' FROM entries WHERE NOT evergreen
    UNION ALL SELECT kid, 'related' FROM entries WHERE n % 4 <> 1 UNION ALL SELECT kid, 'project' FROM entries WHERE coalesce(project, '') = ''""")
def recommended_missing(spark, sf_dir) -> DataFrame:
    e = t.entries(spark, sf_dir)
    related = F.when(F.col("n") % 4 == 0, F.array().cast("array<string>")).when(F.col("n") % 4 == 1, F.array("kid"))
    return au.recommended_missing(e.withColumn("related", related), ["source_url", "evergreen", "related", "project"])


@query("""SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'REVISE' WHEN 2 THEN upper(event_type) WHEN 3 THEN NULL ELSE 'REJECT' END AS verdict,
    CASE event_id % 3 WHEN 0 THEN 'Title of ' || event_type ELSE 'a b ' || event_id END AS title, '# T' || chr(10) || 'body ' || event_id AS content,
    CASE event_id % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/plain' WHEN 4 THEN 'image/webp' WHEN 5 THEN 'application/epub+zip' ELSE 'application/octet-stream' END AS mime,
    CASE event_id % 3 WHEN 0 THEN 'a b ' || event_id || '.txt' ELSE 'f' || event_id || CASE event_id % 6 WHEN 1 THEN '.txt' WHEN 4 THEN '.webp' WHEN 5 THEN '.epub' ELSE '.bin' END END AS name FROM events""")
def answers_and_titles(spark, sf_dir) -> DataFrame:
    n, kind = F.col("event_id"), F.col("event_type")
    answer = (
        F.when(n % 5 == 0, F.lit("```\n**Accept**, with notes\nmore\n```")).when(n % 5 == 1, F.lit("  # revise: the plan\n- x")).when(n % 5 == 2, F.concat(kind, F.lit(". because")))
        .when(n % 5 == 3, F.lit(" \n ")).otherwise(F.lit("- `reject`\nno"))
    )
    title = F.when(n % 3 == 0, F.concat(F.lit("## Title\nof   "), kind, F.lit(" "))).otherwise(F.concat(F.lit(" a\r\nb "), n.cast("string")))
    body = F.concat(F.lit("body "), n.cast("string"))
    content = F.when(n % 2 == 0, F.concat(F.lit("# Old name\n"), body)).otherwise(body)
    heading = F.when(n % 2 == 0, au.with_heading(content, F.lit("T"))).otherwise(F.replace(au.with_heading(content, F.lit("T")), F.lit("\n\n"), F.lit("\n")))
    mime = F.when(n % 6 == 0, "Application/PDF; charset=x").when(n % 6 == 1, "text/plain").when(n % 6 == 2, "text/html").when(n % 6 == 4, " image/webp").when(n % 6 == 5, "application/epub+zip")
    name = F.when(n % 3 == 0, F.concat(F.lit('a/ "b\n ').substr(1, 1), F.lit("/ b\t "), n.cast("string"), F.lit('".txt'))).when(n % 3 == 1, F.lit(' /"\n'))
    return t.table(spark, sf_dir, "events").select(
        n.alias("id"), au.verdict(answer).alias("verdict"), au.clean_title(title).alias("title"), heading.alias("content"), au.served_type(mime).alias("mime"),
        au.download_name(name, F.concat(F.lit("f"), n.cast("string")), au.served_type(mime)).alias("name"),
    )


@query(f"WITH {MARKED} SELECT kid, coalesce(nullif(trim(regexp_extract(content, '(?m)^#{{1,6}}\\s+(.+)$', 1)), ''), kid) AS title FROM marked")
def heading_titles(spark, sf_dir) -> DataFrame:
    """Titles of texts that mostly have a heading."""
    return marked(spark, sf_dir).select("kid", tx.derive_title(F.col("content"), F.col("kid")).alias("title"))


# a text in Cyrillic letters, its slug, a tag and its normal form
_LETTERS = [
    ("Съешь ещё этих мягких", "sesh-eshchyo-etikh-myagkikh", "Жизнь!", "zhizn"), ("Щука, Юла & Цех №5", "shchuka-yula-tsekh-5", "a--Б-", "a-b"),
    ("  Чай по-русски ", "chay-po-russki", "C++", "c"), ("Plain words", "plain-words", "Ёж_1", "yozh1"), ("— ! —", "", "--", ""),
]


@query(f"SELECT p_partkey AS id, {[x[1] for x in _LETTERS]}[p_partkey % 5 + 1] AS slug, {[x[3] for x in _LETTERS]}[p_partkey % 5 + 1] AS tag FROM part")
def cyrillic_slugs(spark, sf_dir) -> DataFrame:
    pick = lambda k: F.get(F.array(*[F.lit(x[k]) for x in _LETTERS]), (F.col("p_partkey") % 5).cast("int"))
    return t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tx.slugify(pick(0)).alias("slug"), tx.normalize_tag(pick(2)).alias("tag"))


@query(f"""WITH {ENTRIES}, x AS (SELECT kid, n, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS flat, content FROM entries WHERE NOT regexp_matches(content, '\\s\\s|\\n|^\\s|\\s$'))
    SELECT kid, CASE WHEN n % 5 = 0 THEN NULL WHEN length(trim(flat[12:12 + 60])) < 24 THEN NULL
        ELSE 1 + 11 + length(regexp_replace(flat[1:11], '[^ ]', '', 'g')) + CASE WHEN flat[12] = ' ' THEN 2 ELSE 0 END END AS start FROM x WHERE strpos(flat, trim(flat[12:12 + 60])) = CASE WHEN flat[12] = ' ' THEN 13 ELSE 12 END""")
def located_chunks(spark, sf_dir) -> DataFrame:
    """Chunks of texts whose spaces were doubled, looked for in those; every fifth is not there."""
    e = t.entries(spark, sf_dir).where(~F.col("content").rlike(r"\s\s|\n|^\s|\s$"))
    part = F.trim(F.substring("content", 12, 61))
    at = F.when(F.substring("content", 12, 1) == " ", 13).otherwise(12)
    e = e.where(F.instr("content", part) == at)
    wide = F.concat(F.lit("\n"), F.replace("content", F.lit(" "), F.when(F.col("n") % 2 == 0, "  ").otherwise("\n ")))
    chunk = F.when(F.col("n") % 5 == 0, F.lit("words that no text has, that is sure")).otherwise(part)
    return e.select("kid", au.located(wide, chunk).cast("long").alias("start"))


@query(f"""WITH {ENTRIES}, b AS (SELECT kid AS parent, zone, coalesce(nullif(trim(regexp_extract(content, '(?m)^#{{1,6}}\\s+(.+)$', 1)), ''), kid) AS book_title FROM entries)
    SELECT kid, book_title FROM entries LEFT JOIN b USING (parent, zone) WHERE parent IS NOT NULL""")
def book_titles(spark, sf_dir) -> DataFrame:
    return au.book_titles(t.entries(spark, sf_dir))


@query("""WITH p AS (SELECT 'participants.r' || c_custkey AS path, c_custkey AS n, CASE c_custkey % 5 WHEN 0 THEN 'urgent' WHEN 1 THEN NULL ELSE 'med' END AS priority,
        CASE c_custkey % 6 WHEN 0 THEN '-1' WHEN 1 THEN 'many' WHEN 2 THEN NULL ELSE '100' END AS tokens, CASE c_custkey % 7 WHEN 0 THEN '0' WHEN 1 THEN '2.5' WHEN 2 THEN NULL ELSE '3' END AS conc,
        CASE c_custkey % 8 WHEN 0 THEN [] ELSE ['c' || c_custkey % 9, 'c1'] END AS grants FROM customer),
    b AS (SELECT 'budgets.b' || s_suppkey AS path, CASE s_suppkey % 4 WHEN 0 THEN '0' WHEN 1 THEN 'yes' WHEN 2 THEN '1.5' ELSE '10' END AS lim, CASE s_suppkey % 3 WHEN 0 THEN 'EUR' ELSE 'RUB' END AS cur,
        CASE s_suppkey % 5 WHEN 0 THEN ' ' ELSE 'month' END AS period, CASE s_suppkey % 6 WHEN 0 THEN 'maybe' ELSE 'true' END AS mirror FROM supplier)
    SELECT 'Q5' AS code, path || '.priority' AS path FROM p WHERE coalesce(priority, '') <> 'med' UNION ALL SELECT 'Q6', path || '.tokens_per_day' FROM p WHERE tokens IN ('-1', 'many')
    UNION ALL SELECT 'Q7', path || '.conc' FROM p WHERE conc IN ('0', '2.5') UNION ALL SELECT 'Q8', path || '.grants' FROM p WHERE len(grants) = 0
    UNION ALL SELECT 'Q8', path || '.grants' FROM p WHERE len(grants) > 0 AND n % 9 >= 7 UNION ALL SELECT 'Q14', 'defaults.role' FROM p WHERE n = 2
    UNION ALL SELECT 'Q11', path || '.limit' FROM b WHERE lim IN ('0', 'yes') UNION ALL SELECT 'Q12', path || '.currency' FROM b WHERE cur = 'EUR'
    UNION ALL SELECT 'Q3', path || '.period' FROM b WHERE period = ' ' UNION ALL SELECT 'Q13', path || '.per_user_mirror' FROM b WHERE mirror = 'maybe' UNION ALL SELECT 'Q10', 'budgets'""")
def quota_findings(spark, sf_dir) -> DataFrame:
    """A role per customer and a budget per supplier, none of them the external one."""
    n, s = F.col("c_custkey"), F.col("s_suppkey")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    roles = t.table(spark, sf_dir, "customer").select(
        name("r", n).alias("role"), F.when(n % 5 == 0, "urgent").when(n % 5 > 1, "med").alias("priority"), F.when(n % 6 == 0, "-1").when(n % 6 == 1, "many").when(n % 6 > 2, "100").alias("tokens_per_day"),
        F.when(n % 7 == 0, "0").when(n % 7 == 1, "2.5").when(n % 7 > 2, "3").alias("conc"), F.when(n % 8 == 0, F.array().cast("array<string>")).otherwise(F.array(name("c", n % 9), F.lit("c1"))).alias("grants"),
    )
    budgets = t.table(spark, sf_dir, "supplier").select(
        name("b", s).alias("name"), F.when(s % 4 == 0, "0").when(s % 4 == 1, "yes").when(s % 4 == 2, "1.5").otherwise("10").alias("limit"), F.when(s % 3 == 0, "EUR").otherwise("RUB").alias("currency"),
        F.when(s % 5 == 0, " ").otherwise("month").alias("period"), F.lit("nightly").alias("reconcile"), F.when(s % 6 == 0, "maybe").otherwise("true").alias("per_user_mirror"),
    )
    classes = t.table(spark, sf_dir, "customer").where(n % 9 < 7).select(name("c", n % 9).alias("model_class")).distinct()
    return au.quota_findings(roles, budgets, classes, "r2")
