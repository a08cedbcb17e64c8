"""Queries of entries as files, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.plans.sql import ENTRIES
from quillstone.sources import tables as t
from quillstone.sources import walk
from quillstone.sources.shared import scratch_folder

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def written_folder(spark, sf_dir) -> str:
    """All entries as files: some in the trash, some under a name or in a folder that begins with `_`, some broken."""
    folder, n = scratch_folder(spark, "entries"), F.substring(F.regexp_extract("path", r"(\d+)\.md$", 1), -8, 8).cast("long")
    rows = walk.entry_texts(t.entries(spark, sf_dir).select("kid", "domain", "subject", "project", "tags", "version", "content"))
    place = (
        F.when(n % 10 == 3, F.concat(F.lit(".trash/"), "path")).when(n % 10 == 4, F.regexp_replace("path", "/(doc-)", "/_$1")).when(n % 10 == 5, F.concat(F.lit("_old/"), "path"))
        .otherwise(F.col("path"))
    )
    text = F.when(n % 7 == 2, F.substr("text", F.lit(5))).when(n % 7 == 4, F.regexp_replace("text", "\nsubject: ", "\nsubject: [")).otherwise(F.col("text"))
    walk.write_texts(rows.select(place.alias("path"), text.alias("text")), folder)
    return folder


_PATH = "CASE WHEN n % 10 = 5 THEN '_old/' ELSE '' END || domain || '/' || subject || coalesce('/' || project, '') || '/' || CASE WHEN n % 10 = 4 THEN '_' ELSE '' END || kid || '.md'"
_LINES = "regexp_replace(coalesce(content, ''), '\r\n?', chr(10), 'g')"


@query(rf"""WITH {ENTRIES} SELECT {_PATH} AS path, kid, domain, subject, project, CAST(len(tags) AS INTEGER) AS tags, CAST(version AS INTEGER) AS version, md5(regexp_replace({_LINES}, '^\s+|\s+$', '', 'g')) AS body
    FROM entries WHERE n % 10 NOT IN (3, 4) AND n % 7 NOT IN (2, 4)""")
def walked_entries(spark, sf_dir) -> DataFrame:
    rows = walk.stored_entries(walk.walked(spark, written_folder(spark, sf_dir)))
    return rows.select("path", F.col("meta.knowledge_id").alias("kid"), "meta.domain", "meta.subject", "meta.project", F.size("meta.tags").alias("tags"), "meta.version", F.md5("body").alias("body"))


_BODY = r"regexp_replace(regexp_replace({}, '^\s+|\s+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')".format(_LINES)


@query(rf"""WITH {ENTRIES} SELECT {_PATH} AS path, sha256({_BODY}) AS body_hash, length({_LINES}) + 2 AS length FROM entries WHERE n % 10 <> 3 AND n % 7 NOT IN (2, 4)""")
def scanned_bodies(spark, sf_dir) -> DataFrame:
    rows = walk.scanned_entries(walk.walked(spark, written_folder(spark, sf_dir), skip_underscore=False))
    return rows.select("path", tx.body_hash(F.col("body")).alias("body_hash"), F.length("body").cast("long").alias("length"))


@query(f"""WITH {ENTRIES} SELECT kid, CASE n % 9 WHEN 1 THEN 'empty' WHEN 2 THEN 'no_delimiter' WHEN 3 THEN 'unclosed' WHEN 4 THEN 'empty_front' WHEN 5 THEN 'yaml' WHEN 6 THEN 'not_a_mapping' END AS fault FROM entries""")
def strict_faults(spark, sf_dir) -> DataFrame:
    n, text = F.col("n"), lambda *p: F.concat(*[F.lit(x) if x is not None else F.col("kid") for x in p])
    made = (
        F.when(n % 9 == 0, text("---\nid: ", None, "\n---\nbody")).when(n % 9 == 1, F.when(n % 2 == 0, " \n\t")).when(n % 9 == 2, text("# ", None, "\n---\n")).when(n % 9 == 3, text("---\nid: ", None, " ---\n"))
        .when(n % 9 == 4, text("---\n\n---\n", None)).when(n % 9 == 5, text("---\nid: [", None, "\n---\n")).when(n % 9 == 6, text("---\n- ", None, "\n---\n")).when(n % 9 == 7, text(" \n---\nid: ", None, "\n---"))
        .otherwise(text("---id: ", None, "\n---more\n---\n"))
    )
    return walk.strict_faults(t.entries(spark, sf_dir).select("kid", made.alias("text"))).drop("text")
