"""Imports, sessions, progress, offsets, drift and other small tables beside the entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.operators import authoring as au


def imported_book(texts: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """book, seq, kid: a collection (seq 0) and its sections as entries; `store` is what stays of other books,
    with the same columns (replace mode drops the book's old entries)."""
    root = au.collection_id(F.col("domain"), F.col("subject"), F.col("title"))
    roots = texts.select(F.col("kid").alias("book"), "domain", "subject", root.alias("root"))
    parts = au.hybrid_sections(texts).withColumnRenamed("kid", "book").join(roots, "book")
    kid = tx.knowledge_id(F.col("domain"), F.col("subject"), F.col("title"), F.lpad(F.col("seq").cast("string"), 3, "0"))
    made = parts.select("book", F.col("seq").cast("long").alias("seq"), kid.alias("kid")).unionByName(roots.select("book", F.lit(0).cast("long").alias("seq"), F.col("root").alias("kid")))
    if store is None:
        return made
    return made.unionByName(store.join(roots.select("book"), "book", "left_anti"))


def import_report(sections: DataFrame, issues: DataFrame, duplicates: DataFrame, most: int = 500) -> DataFrame:
    """book, kid, checked, issues, warnings, duplicates: per section the gates' critical issues, their warnings (one more where
    there are near duplicates) and the near duplicates. Sections of books with more than `most` aren't checked.
    sections: book, kid. issues: kid, severity. duplicates: kid, other."""
    size = sections.groupBy("book").agg(F.count(F.lit(1)).alias("n"))
    found = issues.groupBy("kid").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") != "critical").alias("warned"))
    near = duplicates.groupBy("kid").agg(F.count(F.lit(1)).alias("near"))
    rows = sections.select("book", "kid").join(size, "book").join(found, "kid", "left").join(near, "kid", "left").withColumn("checked", F.col("n") <= most)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    told = lambda c: F.when(F.col("checked"), c)
    return rows.select("book", "kid", "checked", told(n("critical")).alias("issues"), told(n("warned") + (n("near") > 0).cast("long")).alias("warnings"), told(n("near")).alias("duplicates"))


def sessions(messages: DataFrame, limit: int) -> DataFrame:
    """conv_id, turns, chars: the newest conversations first."""
    out = messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"))
    return out.orderBy(F.desc("conv_id")).limit(limit)


def purged(messages: DataFrame, gone: DataFrame) -> DataFrame:
    return messages.join(gone.select("conv_id").distinct(), "conv_id", "left_anti")


def progress(events: DataFrame, keep: int = 5) -> DataFrame:
    """job, done, total, percent, phase, log: counters of a job with its last lines. events: job, seq, phase,
    n, total, line."""
    rank = F.row_number().over(Window.partitionBy("job").orderBy(F.desc("seq")))
    last = events.withColumn("rank", rank).where(F.col("rank") <= keep)
    log = last.groupBy("job").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "|").alias("log"))
    sums = events.groupBy("job").agg(F.sum("n").alias("done"), F.max("total").alias("total"), F.max_by("phase", "seq").alias("phase"))
    percent = F.when(F.col("total") > 0, F.floor(F.least(F.lit(100), 100 * F.col("done") / F.col("total"))))
    return sums.withColumn("percent", percent).join(log, "job")


def new_lines(lines: DataFrame, offsets: DataFrame, seen: DataFrame, overlap: int = 60) -> DataFrame:
    """Lines after their source's last time; the overlap before it is read again, and of it only what was not
    seen counts. Sources without an offset are read whole."""
    at = F.unix_timestamp("ts")
    rows = lines.join(offsets.select("source", F.unix_timestamp("last_ts").alias("last")), "source", "left")
    rows = rows.where(F.col("last").isNull() | (at > F.col("last") - overlap))
    fresh = F.col("last").isNull() | (at > F.col("last"))
    return rows.withColumn("fresh", fresh).join(seen.select("seq").distinct(), "seq", "left_anti").drop("last")


def once_a_day(ticks: DataFrame, zone: str, hour: int = 10) -> DataFrame:
    """day, seq: the first tick of a local day at the hour or later does the day's work."""
    local = F.from_utc_timestamp("ts", zone)
    due = ticks.where(F.hour(local) >= hour)
    return due.groupBy(F.date_format(local, "yyyy-MM-dd").alias("day")).agg(F.min_by("seq", F.struct("ts", "seq")).alias("seq"))


def drift(profiles: DataFrame, facts: DataFrame, registry: DataFrame, golden: str | None = None, prices: str | None = None) -> DataFrame:
    """cell, status, marks, reason, blocked.

    t1: the shelf has another model, or the same with another digest (a shelf that isn't seen is no drift). Marks: the
    golden tasks', or the prices', manifest is another than the profile's evidence; without t1 they make it t2
    or t3. Blocked: the class's status in the registry is another than the profile's.
    profiles: cell, model_class, model, digest, golden, prices, status. facts: cell, model, digest. registry: model_class, status."""
    f = facts.select("cell", F.col("model").alias("fact_model"), F.col("digest").alias("fact_digest"), F.lit(True).alias("seen"))
    r = registry.select("model_class", F.col("status").alias("class_status"))
    rows = profiles.join(f, "cell", "left").join(r, "model_class", "left")
    other = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    moved = F.when(F.col("seen") & other("fact_model", "model"), "model_mismatch").when(F.col("seen") & other("fact_digest", "digest"), "digest_mismatch")
    stale = lambda now, c: F.lit(now is not None) & ~F.col(c).eqNullSafe(F.lit(now).cast("string"))
    marks = F.array_compact(F.array(F.when(stale(golden, "golden"), "evidence_stale"), F.when(stale(prices, "prices"), "price_stale")))
    rows = rows.withColumns({"moved": moved, "marks": marks, "blocked": F.col("class_status").isNotNull() & other("class_status", "status")})
    state = F.when(F.col("moved").isNotNull(), "t1").when(F.array_contains("marks", "evidence_stale"), "t2").when(F.size("marks") > 0, "t3").otherwise("ok")
    reason = F.coalesce("moved", F.when(F.col("blocked"), "status_divergence"))
    return rows.select("cell", state.alias("status"), F.array_join("marks", ",").alias("marks"), reason.alias("reason"), "blocked")


def resolved_signatures(aggregates: DataFrame, state: DataFrame, sigs: DataFrame, now: Column) -> DataFrame:
    """sig, status, state, fixed_at after an operator's resolution of some signatures, in both tables."""
    hit = sigs.select("sig").distinct().withColumn("hit", F.lit(True))
    rows = aggregates.select("sig", "status").join(state.select("sig", "state"), "sig", "full_outer").join(hit, "sig", "left")
    to = lambda c: F.when(F.col("hit"), "resolved").otherwise(F.col(c))
    return rows.select("sig", to("status").alias("status"), to("state").alias("state"), F.when(F.col("hit"), now).alias("fixed_at"))


def written(new: DataFrame, store: DataFrame, duplicates: DataFrame, fields: list[str]) -> DataFrame:
    """kid, outcome, warnings of new entries: taken ids are blocked, near duplicates are held for review, the
    others are written; every recommended field that is missing is a warning."""
    missing = au.recommended_missing(new, fields).groupBy("kid").agg(F.count(F.lit(1)).alias("warnings"))
    taken = store.select("kid", F.lit(True).alias("taken"))
    held = duplicates.select("kid").distinct().withColumn("held", F.lit(True))
    rows = new.select("kid").join(taken, "kid", "left").join(held, "kid", "left").join(missing, "kid", "left")
    outcome = F.when(F.col("taken"), "blocked").when(F.col("held"), "review").otherwise("written")
    return rows.select("kid", outcome.alias("outcome"), F.coalesce("warnings", F.lit(0)).alias("warnings"))


def index_files(entries: DataFrame, limit: int, few: int = 10) -> DataFrame:
    """domain, files, listed, truncated: the index of a domain lists all its files, or the first few where
    their names would go over the size limit."""
    size = entries.groupBy("domain").agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("kid") + 4).alias("size"))
    first = entries.withColumn("rank", F.row_number().over(Window.partitionBy("domain").orderBy("kid"))).where(F.col("rank") <= few)
    names = first.groupBy("domain").agg(F.array_join(F.array_sort(F.collect_list("kid")), ",").alias("first"))
    over = F.col("size") > limit
    return size.join(names, "domain").select("domain", "files", F.when(over, F.least(F.col("files"), F.lit(few))).otherwise(F.col("files")).alias("listed"), over.alias("truncated"), "first")
