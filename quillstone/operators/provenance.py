"""Provenance: locators as half-open intervals, blobs and references, availability, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(spans: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """Spans [s, e) that meet a chunk [cs, ce) of the same document. A range join: both sides are dealt to
    buckets of `width`, pairs are told once, by the bucket where their common part begins."""
    s = spans.withColumn("slot", F.explode(F.sequence(F.expr(f"s div {width}"), F.expr(f"(e - 1) div {width}"))))
    c = chunks.withColumn("slot", F.explode(F.sequence(F.expr(f"cs div {width}"), F.expr(f"(ce - 1) div {width}"))))
    both = s.join(c, ["doc", "slot"]).where("s < ce and cs < e")
    return both.where(F.expr(f"greatest(s, cs) div {width} = slot")).drop("slot")


def clip(pairs: DataFrame) -> DataFrame:
    """The common part, counted from the chunk's start."""
    out = pairs.withColumns({"start": F.greatest("s", "cs") - F.col("cs"), "end": F.least("e", "ce") - F.col("cs")})
    return out.where(F.col("start") < F.col("end"))


def covering(refs: DataFrame) -> DataFrame:
    return refs.groupBy("source_id", "kind").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def page_spans(segments: DataFrame, gap: int = 2) -> DataFrame:
    """Offsets of segments joined with a separator of so many characters."""
    before = F.sum(F.col("length") + gap).over(Window.partitionBy("doc").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0))
    return segments.withColumns({"start": start, "end": start + F.col("length")})


def orphans(blobs: DataFrame, refs: DataFrame, grace_days: int = 30) -> DataFrame:
    """Blobs that no reference names and that are old enough (or of unknown age). An empty reference
    index with blobs present is taken for a fault: then nothing is an orphan."""
    any_ref = refs.select(F.lit(1).alias("there")).limit(1)
    old = F.col("age").isNull() | (F.col("age") >= grace_days)
    return blobs.where(old).join(refs.select("sha256").distinct(), "sha256", "left_anti").join(F.broadcast(any_ref)).drop("there")


def dangling(refs: DataFrame, sources: DataFrame) -> DataFrame:
    return refs.join(sources.select("source_id"), "source_id", "left_anti")


def integrity(refs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Defects of references: blob missing, content differs, and the canonical form lost by either."""
    both = refs.join(blobs.select("sha256", "actual_sha256"), "sha256", "left")
    gone, other = F.col("actual_sha256").isNull(), F.col("actual_sha256") != F.col("sha256")
    return both.withColumn("defect", F.when(gone, "missing").when(other, "mismatch")).withColumn("canonical_lost", (F.col("ref_kind") == "canonical") & F.coalesce(gone | other, F.lit(False))).where("defect is not null")


def public_licence(licence: Column) -> Column:
    return F.coalesce(licence.isin("own", "licensed") | licence.startswith("cc-"), F.lit(False))


def available(scope: tuple) -> Column:
    """A source row may be shown: in scope, not deprecated, and if public then allowed under its licence."""
    open_ = F.coalesce(F.col("public_allowed"), F.lit(True)) & public_licence(F.col("license"))
    return F.col("zone").isin(*scope) & (F.coalesce("status", F.lit("")) != "deprecated") & ((F.col("zone") != "public") | open_)


def blob_available(refs: DataFrame, sources: DataFrame, scope: tuple) -> DataFrame:
    """Blobs with at least one reference whose source may be shown."""
    return refs.join(sources.where(available(scope)).select("source_id"), "source_id", "left_semi").select("sha256").distinct()


def initials(author: Column) -> Column:
    """The literal name, else family name and initials."""
    short = F.array_join(F.transform(F.split(author["given"], r"[\s-]+"), lambda g: F.concat(F.left(g, F.lit(1)), F.lit("."))), " ")
    return F.coalesce(F.nullif(author["literal"], F.lit("")), F.concat_ws(" ", author["family"], F.nullif(short, F.lit("."))))


def citation(title: Column, authors: Column, year: Column, publisher: Column, url: Column) -> Column:
    """Up to three authors, else the first and "[и др.]"; publisher before URL; null without title or author."""
    names = F.filter(F.transform(F.coalesce(authors, F.array().cast("array<struct<literal:string,family:string,given:string>>")), initials), lambda x: F.coalesce(x, F.lit("")) != "")
    who = F.when(F.size(names) > 3, F.concat(F.get(names, 0), F.lit(" [и др.]"))).otherwise(F.array_join(names, ", "))
    head = F.concat_ws(". ", F.nullif(who, F.lit("")), title)
    return F.when((F.coalesce(title, F.lit("")) == "") | (F.size(names) == 0), None).otherwise(F.concat_ws(". — ", head, F.coalesce(F.nullif(publisher, F.lit("")), url), year))


def citation_level(shown: Column, has_text: Column, has_blob: Column) -> Column:
    """b: text and blob; a: text only; none: nothing, as what may not be shown is wholly absent."""
    return F.when(~shown | ~has_text, "none").when(has_blob, "b").otherwise("a")


def reason() -> Column:
    """Why a canonical form is absent; the first that holds."""
    c = F.col
    known = F.coalesce(c("error").isin("encrypted", "too_large", "timeout", "conversion_failed"), F.lit(False))
    document = c("format").isin("docx", "epub", "html", "md", "txt")
    return (
        F.when(c("present"), F.lit(None).cast("string")).when(c("promised") & ~c("exists"), "blob_missing").when(~c("has_original"), "url_no_blobs")
        .when((c("format") != "pdf") & ~document, "outside_pdf_axis").when(c("policy") == "pdf_only", "policy_pdf_only").when(c("error").isNotNull(), F.when(known, c("error")).otherwise("conversion_failed"))
        .when(document & (c("policy") == "normalize"), "queued").otherwise("blob_missing")
    )


def cited(refs: DataFrame, sources: DataFrame, scope: tuple) -> DataFrame:
    """refs with level, citation and reason of their source (source_id).

    Nothing where the source isn't there, may not be shown in the scope, or has no title or author. Level b, with its
    blob, has no reason; level a has the reason why there is no canonical form, if there is one.
    sources: source_id, what `available` and `reason` look at, title, authors, year, publisher, url, and blob_shown,
    whether some reference allows to show its canonical blob."""
    text = citation(F.col("title"), F.col("authors"), F.col("year"), F.col("publisher"), F.col("url"))
    s = sources.select("source_id", F.coalesce(available(scope), F.lit(False)).alias("_shown"), text.alias("_text"), (F.col("present") & F.col("blob_shown")).alias("_blob"), reason().alias("_why"))
    rows = refs.join(s, "source_id", "left")
    seen = F.coalesce(F.col("_shown"), F.lit(False)) & F.col("_text").isNotNull()
    level = F.when(seen, F.when(F.col("_blob"), "b").otherwise("a"))
    out = rows.withColumns({"level": level, "citation": F.when(seen, F.col("_text"))})
    return out.withColumn("reason", F.when(F.col("level") == "a", F.col("_why"))).drop("_shown", "_text", "_blob", "_why")


def source_views(sources: DataFrame, refs: DataFrame, scope: tuple) -> DataFrame:
    """source_id, blobs, reason of the sources that may be shown: their blobs (kind and hash, in order) that some reference
    allows to show, and why a canonical form is absent."""
    shown = sources.where(F.coalesce(available(scope), F.lit(False)))
    own = refs.join(blob_available(refs, sources, scope), "sha256", "left_semi").select("source_id", "ref_kind", "sha256").distinct()
    blobs = own.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("ref_kind", "sha256"))).alias("blobs"))
    return shown.select("source_id", reason().alias("reason")).join(blobs, "source_id", "left")


#: What a change of a blob's registry row is; creation times don't count.
FIELDS = ("role", "size", "mime", "filename", "derived_from", "tool", "params_hash")


def registry_diff(old: DataFrame, new: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """added, removed, updated by sha; creation times don't count."""
    o, n = old.alias("o"), new.alias("n")
    changed = F.lit(False)
    for f in fields:
        changed = changed | ~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}"))
    state = F.when(F.col("o.known").isNull(), "added").when(F.col("n.known").isNull(), "removed").when(changed, "updated")
    return o.join(n, "sha256", "full_outer").select("sha256", state.alias("state")).where("state is not null")


def merge_refs(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One reference per (entry, source, kind), nulls alike; an existing one wins; order of arrival kept."""
    both = existing.withColumn("from_new", F.lit(0)).unionByName(new.withColumn("from_new", F.lit(1)))
    w = Window.partitionBy("kid", "source_id", "kind").orderBy("from_new", "nth")
    return both.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
