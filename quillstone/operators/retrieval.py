"""Retrieval and browsing: filtered k-NN, tag search, distinct values, tables of contents, maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.functions.vectors import cosine_to


def zone_rank() -> Column:
    return F.when(F.col("zone") == "public", 0).otherwise(1)


def status_of(status: Column) -> Column:
    """Absent or unknown means published."""
    return F.when(status.isin("draft", "review", "published", "deprecated", "archived"), status).otherwise("published")


def payload_filter(df: DataFrame, filters: dict | None = None, exclude_types: tuple = (), exclude_statuses: tuple = ()) -> DataFrame:
    """AND over keys; a list means any of; an array column matches if it overlaps. Nulls pass exclusions."""
    kinds = dict(df.dtypes)
    for key, want in (filters or {}).items():
        values = list(want) if isinstance(want, list | tuple | set) else [want]
        df = df.where(F.arrays_overlap(key, F.array(*map(F.lit, values))) if kinds[key].startswith("array") else F.col(key).isin(values))
    if exclude_types:
        df = df.where(~F.coalesce("content_type", F.lit("")).isin(*exclude_types))
    if exclude_statuses:
        df = df.where(~status_of(F.col("status")).isin(*exclude_statuses))
    return df


def search(points: DataFrame, query: list[float], top_k: int = 5, filters: dict | None = None, threshold: float | None = None, include_deprecated: bool = False, scope: tuple = ("public", "private"), global_sort: bool = False) -> DataFrame:
    """The best chunk of each entry by cosine, public zone first, then by score."""
    types = () if filters and "content_type" in filters else ("collection", "source")
    rows = payload_filter(points.where(F.col("zone").isin(*scope)), filters, types, () if include_deprecated else ("deprecated",))
    rows = rows.where(tx.meaningful(F.col("content"))).withColumn("score", F.round(cosine_to(query)("vector"), 4))
    if threshold is not None:
        rows = rows.where(F.col("score") >= threshold)
    best = rows.groupBy("kid").agg(F.max_by(F.struct("zone", "n", "score", "content"), F.struct(-zone_rank(), "score", "vec_id")).alias("b"))
    out = best.select("kid", "b.zone", "b.score", tx.derive_title(F.col("b.content"), F.col("kid")).alias("title"))
    order = [F.desc("score"), "kid"] if global_sort else [zone_rank(), F.desc("score"), "kid"]
    return out.orderBy(*order).limit(min(top_k, 50))


def by_tags(entries: DataFrame, tags: list[str], match_all: bool, limit: int = 500) -> DataFrame:
    wanted = F.array(*map(F.lit, tags))
    hit = F.size(F.array_intersect("tags", wanted)) == len(set(tags)) if match_all else F.arrays_overlap("tags", wanted)
    return payload_filter(entries.where(hit), None, ("collection", "source"), ("deprecated",)).orderBy(zone_rank(), "kid").limit(min(limit, 1000))


def distinct_values(entries: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Distinct non-empty values over all zones, and how many there are: per zone summed, and overall."""
    rows = entries.where(F.coalesce(F.col(column), F.lit("")) != "").select(F.col(column).alias("value"), "zone")
    per_zone = rows.distinct()
    totals = per_zone.agg(F.count(F.lit(1)).alias("total_count"), F.countDistinct("value").alias("distinct_count"))
    return rows.select("value").distinct(), totals


def knowledge_map(entries: DataFrame) -> DataFrame:
    """Public entries a domain."""
    public = entries.where("zone = 'public'").dropDuplicates(["kid"])
    return public.groupBy(F.coalesce(F.nullif("domain", F.lit("")), F.lit("_ungrouped")).alias("domain")).agg(F.count(F.lit(1)).alias("entries"))


def top_tags(entries: DataFrame, keep: int = 20) -> DataFrame:
    """Tag counts: the most frequent ones, and a row for how many more there are."""
    counts = entries.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "tag").limit(keep)
    rest = counts.agg((F.count(F.lit(1)) - keep).alias("more")).where("more > 0")
    return top.unionByName(rest.select(F.format_string("...and %d more", "more").alias("tag"), F.col("more").alias("n")))


RECOMMENDED = ("project", "source_url", "content_type")


def section_gaps(entries: DataFrame) -> DataFrame:
    """A domain's entries, how many lack a recommended field, the coverage in percent, the five first ids."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in RECOMMENDED]))
    rows = entries.withColumn("missing", missing)
    gap = F.size("missing") > 0
    counts = rows.groupBy("domain").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(gap).alias("with_gaps"), F.round(100 * F.count_if(~gap) / F.count(F.lit(1)), 1).alias("coverage"),
        F.sum(F.size("missing")).alias("missing_fields"),
    )
    first = rows.where(gap).withColumn("rank", F.row_number().over(Window.partitionBy("domain").orderBy("kid"))).where("rank <= 5")
    first = first.groupBy("domain").agg(F.array_join(F.array_sort(F.collect_list("kid")), ",").alias("first_gaps"))
    return counts.join(first, "domain", "left").withColumn("first_gaps", F.coalesce("first_gaps", F.lit("")))


def subject_groups(entries: DataFrame, keep: int = 10) -> DataFrame:
    """Per domain and subject the count and the first ids, ranked in a window so that no group is gathered."""
    w = Window.partitionBy("domain", "subject").orderBy("kid")
    first = entries.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
    names = first.groupBy("domain", "subject").agg(F.array_join(F.array_sort(F.collect_list("kid")), ",").alias("first_ids"))
    return entries.groupBy("domain", "subject").agg(F.count(F.lit(1)).alias("entries")).join(names, ["domain", "subject"])


def contents(entries: DataFrame, root: str) -> DataFrame:
    """The sections of a collection: by sequence, nulls last, then title."""
    rows = entries.where(F.col("parent") == root).groupBy("kid").agg(F.min("seq").alias("seq"), F.min("content").alias("content"))
    rows = rows.select("kid", "seq", tx.derive_title(F.col("content"), F.col("kid")).alias("title"))
    return rows.orderBy(F.asc_nulls_last("seq"), "title", "kid")


def collections(entries: DataFrame) -> DataFrame:
    """Collection roots with the number and the last change of their sections."""
    sections = entries.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("sections"), F.max("updated_day").alias("last_day"))
    roots = entries.where("content_type = 'collection'").select("kid", "domain")
    return roots.join(sections, roots.kid == sections.parent, "left").select("kid", "domain", F.coalesce("sections", F.lit(0)).alias("sections"), "last_day")


def resource(entries: DataFrame, domain: str | None = None, subject: str | None = None) -> DataFrame:
    """kb:// listings: domains, a domain's subjects, or a subject's entries, with counts."""
    if domain is None:
        return entries.groupBy(F.col("domain").alias("name")).agg(F.count(F.lit(1)).alias("entries"))
    rows = entries.where(F.col("domain") == domain)
    if subject is None:
        return rows.groupBy(F.col("subject").alias("name")).agg(F.count(F.lit(1)).alias("entries"))
    return rows.where(F.col("subject") == subject).select(F.col("kid").alias("name"), F.lit(1).cast("long").alias("entries"))


def page_after(entries: DataFrame, after: str | None, limit: int) -> DataFrame:
    """Keyset pagination by id."""
    rows = entries if after is None else entries.where(F.col("kid") > after)
    return rows.orderBy("kid").limit(limit)


def find_fragment(points: DataFrame, query: list[float], parent: str, limit: int = 10) -> DataFrame:
    """The sections of one book nearest to the query, with a snippet."""
    rows = points.where(F.col("parent") == parent).withColumn("score", F.round(cosine_to(query)("vector"), 4))
    best = rows.groupBy("kid").agg(F.max("score").alias("score"), F.min(F.substring("content", 1, 200)).alias("snippet"))
    return best.orderBy(F.desc("score"), "kid").limit(limit)


def get_entry(entries: DataFrame, kid: str, scope: tuple) -> DataFrame:
    """One entry with the number of its children; outside the scope it does not exist."""
    one = entries.where((F.col("kid") == kid) & F.col("zone").isin(*scope))
    children = entries.where(F.col("parent") == kid).agg(F.count(F.lit(1)).alias("children"))
    return one.join(F.broadcast(children))


def zone_scope(level: Column, explicit: Column, zone: Column) -> Column:
    """The zones a token may read; anything unclear means public only."""
    return F.when(level == "admin", F.array(F.lit("private"), F.lit("public"))).when(explicit & zone.isin("public", "private"), F.array(zone)).when(~explicit & (level == "editor"), F.array(F.lit("private"), F.lit("public"))).otherwise(F.array(F.lit("public")))


def inherit_zone(child: Column, parent: Column) -> tuple[Column, Column]:
    """A public child below a private parent becomes private; the second column says so."""
    forced = (parent == "private") & (child == "public")
    return F.when(forced, "private").otherwise(child), F.coalesce(forced, F.lit(False))
