"""Sections of an imported text by its headings, or by its pages where it has fewer than two."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.operators import authoring as au

# How a page is called, what is behind the last heading, and parts from the second on.
PAGE, REST, PART = "Страница ", "Последний раздел", " (часть "
LONG = 4000  # characters of a section that is not cut


def page_of(places: DataFrame, pages: DataFrame, at: str = "start") -> DataFrame:
    """places (doc, ..., `at`) with the number of the page they lie on: the last page that begins at or before it. Both
    sides are sorted into one order by document and the page is carried on, so there is no join by range. What
    lies before the first page has none."""
    columns = [c for c in places.columns if c != "page"]
    rows = places.select(*columns, F.lit(1).alias("_kind"), F.col(at).alias("_at"), F.lit(None).cast("long").alias("_page"))
    marks = pages.select("doc", *[F.lit(None).cast(dict(places.dtypes)[c]).alias(c) for c in columns if c != "doc"], F.lit(0).alias("_kind"), F.col("start").alias("_at"), F.col("page").cast("long").alias("_page"))
    order = Window.partitionBy("doc").orderBy("_at", "_kind", "_page").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.select(*columns, "_kind", "_at", "_page").unionByName(rows.select(*columns, "_kind", "_at", "_page"))
    return both.withColumn("page", F.last("_page", ignorenulls=True).over(order)).where("_kind = 1").select(*columns, "page")


def _parts(rows: DataFrame, longest: int) -> DataFrame:
    """rows (doc, seq, title, body, page, last_page) with bodies over so many characters cut as any long text is; parts share
    their section's number."""
    rows = rows.withColumn("kid", F.concat_ws("/", F.col("doc").cast("string"), F.col("seq").cast("string")))
    cut = au.hybrid_sections(rows.where(F.length("body") > longest).select("kid", F.col("body").alias("content"))).select("kid", F.col("seq").alias("part"), F.col("body").alias("piece"))
    out = rows.join(cut, "kid", "left").withColumns({"part": F.coalesce("part", F.lit(1)), "body": F.coalesce("piece", "body")})
    title = F.when(F.col("part") == 1, F.col("title")).otherwise(F.concat("title", F.lit(PART), F.col("part").cast("string"), F.lit(")")))
    return out.select("doc", "seq", "part", title.alias("title"), "body", "page", "last_page")


def sections_by_heading(texts: DataFrame, headings: DataFrame, pages: DataFrame, longest: int = LONG) -> DataFrame:
    """doc, seq, part, title, body, page, last_page. headings: doc, nth, title.

    Headings are looked for one behind the other; one that isn't there is passed over. The rule is kept as it is: a
    section is what stands in front of a heading and is called after that heading, and what is behind the last one has
    a title of its own. Blank sections go. The pages are those that the section begins and ends on."""
    named = headings.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("nth", "title"))).alias("named"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,title:string>>").alias("found"))

    def step(acc, h):
        at = F.call_function("locate", h["title"], F.col("content"), acc["at"] + 1) - 1
        piece = F.struct(acc["at"].alias("start"), at.alias("stop"), h["title"].alias("title"))
        return F.when(at < 0, acc).otherwise(F.struct((at + F.length(h["title"])).alias("at"), F.array_append(acc["found"], piece).alias("found")))

    rest = lambda acc: F.array_append(acc["found"], F.struct(acc["at"].alias("start"), F.length("content").alias("stop"), F.lit(REST).alias("title")))
    rows = texts.join(named, "doc").select("doc", "content", F.posexplode(F.aggregate("named", start, step, rest)).alias("nth", "s"))
    raw = F.substr("content", F.col("s.start") + 1, F.col("s.stop") - F.col("s.start"))
    rows = rows.select("doc", "nth", "s.title", "s.start", raw.alias("raw")).withColumn("body", tx.strip(F.col("raw"))).where("body <> ''")
    first = F.col("start") + F.length("raw") - F.length(F.regexp_replace("raw", r"^\s+", ""))
    rows = rows.withColumns({"start": first, "last": first + F.length("body") - 1, "seq": F.row_number().over(Window.partitionBy("doc").orderBy("nth"))})
    slim = rows.select("doc", "seq", "start", "last")
    begins = page_of(slim.select("doc", "seq", "start"), pages).select("doc", "seq", "page")
    ends = page_of(slim.select("doc", "seq", "last"), pages, "last").select("doc", "seq", F.col("page").alias("last_page"))
    return _parts(rows.select("doc", "seq", "title", "body").join(begins, ["doc", "seq"]).join(ends, ["doc", "seq"]), longest)


def sections_by_page(texts: DataFrame, pages: DataFrame, longest: int = LONG) -> DataFrame:
    """doc, seq, part, title, body, page, last_page: a section per page that isn't blank, in order. pages: doc, page, start,
    stop."""
    rows = pages.join(texts.select("doc", "content"), "doc")
    rows = rows.withColumn("body", tx.strip(F.substr("content", F.col("start") + 1, F.col("stop") - F.col("start")))).where("body <> ''")
    seq = F.row_number().over(Window.partitionBy("doc").orderBy("start", "page"))
    rows = rows.withColumn("seq", seq).withColumn("title", F.concat(F.lit(PAGE), F.col("seq").cast("string")))
    return _parts(rows.select("doc", "seq", "title", "body", "page", F.col("page").alias("last_page")), longest)


def imported_sections(texts: DataFrame, headings: DataFrame, pages: DataFrame, longest: int = LONG) -> DataFrame:
    """By headings where a document has two or more, else by pages."""
    enough = headings.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("doc")
    by_heading = sections_by_heading(texts.join(enough, "doc", "left_semi"), headings.join(enough, "doc", "left_semi"), pages, longest)
    rest = texts.join(enough, "doc", "left_anti")
    return by_heading.unionByName(sections_by_page(rest, pages.join(rest.select("doc"), "doc", "left_semi"), longest))
