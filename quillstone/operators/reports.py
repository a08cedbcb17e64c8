"""Sections of a book as a table that is written to, and the weekly report of error signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.operators import authoring as au
from quillstone.operators import lifecycle as lc

# ---- fragments


def added_fragments(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """n, error or kid, seq, title, body, zone, forced, partial of new sections (n, collection, title, content, zone), which go behind
    a book's last one, in the order of n. entries: kid, parent, seq, domain, subject, zone, content_type, status.

    The zone is the book's if none is given; a public section of a private book becomes private (forced), a private one
    of a public book makes it public in part. The first thing that is wrong is the error."""
    book = entries.select(F.col("kid").alias("collection"), "domain", "subject", F.coalesce("zone", F.lit("private")).alias("book_zone"), "content_type", F.coalesce("status", F.lit("published")).alias("status"), F.lit(True).alias("there"))
    last = entries.where("parent is not null").groupBy(F.col("parent").alias("collection")).agg(F.max(F.coalesce("seq", F.lit(0))).alias("last"))
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    title, zone = au.clean_title(F.coalesce("title", F.lit(""))), F.col("wanted")
    rows = requests.withColumnRenamed("zone", "wanted").join(book, "collection", "left").join(last, "collection", "left")
    error = (
        F.when(empty(F.col("collection")), "no collection").when(empty(F.col("title")), "no title").when(empty(tx.strip(F.col("content"))), "no content").when(title == "", "no title")
        .when(F.col("there").isNull(), "not found").when(~F.coalesce(F.col("content_type") == "collection", F.lit(False)), "no book").when(F.col("status") == "deprecated", "deprecated")
        .when(zone.isNotNull() & ~zone.isin("public", "private"), "no zone")
    )
    rows = rows.withColumns({"error": error, "title": title})
    good = Window.partitionBy("collection", F.col("error").isNull()).orderBy("n")
    seq = (F.coalesce("last", F.lit(0)) + F.row_number().over(good)).cast("long")
    forced = (zone == "public") & (F.col("book_zone") == "private")
    own = F.when(zone.isNull() | forced, F.col("book_zone")).otherwise(zone)
    ok = lambda c: F.when(F.col("error").isNull(), c)
    rows = rows.withColumn("seq", ok(seq))
    return rows.select(
        "n", "collection", "error", ok(tx.knowledge_id(F.col("domain"), F.col("subject"), F.col("title"), F.lpad(F.col("seq").cast("string"), 3, "0"))).alias("kid"), "seq", ok(F.col("title")).alias("title"),
        ok(F.concat(F.lit("# "), "title", F.lit("\n\n"), "content")).alias("body"), ok(own).alias("zone"), ok(F.coalesce(forced, F.lit(False))).alias("forced"),
        ok(F.coalesce((zone == "private") & (F.col("book_zone") == "public"), F.lit(False))).alias("partial"),
    )


def updated_fragments(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """kid, error or content, version of sections with a new title, content or both (null: as it is). With a title the heading
    is renamed, or all is built anew if there is a new content; a new content alone keeps the heading. A
    version that isn't the entry's is a conflict. requests: kid, title, content, version. entries: kid, parent, content, version."""
    old = entries.select("kid", "parent", F.col("content").alias("old"), F.col("version").alias("held"), F.lit(True).alias("there"))
    title = au.clean_title(F.col("title"))
    rows = requests.join(old, "kid", "left").withColumn("name", title)
    heading = F.regexp_extract("old", r"(?m)^# .+$", 0)
    body = F.when(F.col("title").isNotNull(), F.when(F.col("content").isNotNull(), F.concat(F.lit("# "), "name", F.lit("\n\n"), "content")).otherwise(au.with_heading(F.col("old"), F.col("name"))))
    body = body.when(F.col("content").isNotNull(), F.when(heading != "", F.concat(heading, F.lit("\n\n"), "content")).otherwise(F.col("content"))).otherwise(F.col("old"))
    error = (
        F.when(F.col("there").isNull(), "not found").when(F.col("parent").isNull(), "no section").when(F.col("title").isNotNull() & (F.col("name") == ""), "no title")
        .when(F.col("version").isNotNull() & (F.col("version") != F.col("held")), "conflict")
    )
    return rows.select("kid", error.alias("error"), F.when(error.isNull(), body).alias("content"), F.when(error.isNull(), F.col("held") + 1).alias("version"))


def deleted_fragments(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """kid, error of sections to delete: what isn't there or is no section stays."""
    rows = requests.select("kid").join(entries.select("kid", "parent", F.lit(True).alias("there")), "kid", "left")
    return rows.select("kid", F.when(F.col("there").isNull(), "not found").when(F.col("parent").isNull(), "no section").alias("error"))


# ---- the weekly report


def cycle_metrics(aggregates: DataFrame, now: Column) -> DataFrame:
    """One row: urgent signatures active and seen within 30 days, how many of the active ones no user had reported, their share of
    those of 30 days (null if no user ever reports), candidates for rules, relapses and the first three of them, and the
    median hours to the fix. aggregates: sig, priority, status, first_seen, last_seen, fixed_at, reported."""
    urgent = F.col("priority").isin("P0", "P1")
    relapsed = (F.col("status") == "resolved") & (F.col("last_seen") > F.col("fixed_at"))
    base = lc.weekly_metrics(aggregates, now)
    silent = urgent & (F.col("status") != "resolved") & ~F.coalesce(F.col("reported"), F.lit(False))
    more = aggregates.agg(F.count_if(silent).alias("found_first"), F.coalesce(F.bool_or("reported"), F.lit(False)).alias("told"))
    first = aggregates.where(relapsed).orderBy("sig").limit(3).agg(F.array_join(F.array_sort(F.collect_list("sig")), "; ").alias("relapsed"))
    rows = base.join(F.broadcast(more)).join(F.broadcast(first))  # a row each
    return rows.withColumn("share", F.when(F.col("told") & (F.col("recent") > 0), F.round(F.col("found_first") / F.col("recent"), 2))).drop("told")


def weekly_report(aggregates: DataFrame, now: Column) -> DataFrame:
    """section, rank, sig, count_7d, note: P0 that are active, ten of P1 and P2 by actors and number, five of P3, bursts of seven days,
    candidates for rules with the kind of rule, relapses to look at, and signatures that look like an expected answer.
    aggregates: sig, priority, status, count_7d, actors (a number), burst_ts, fixed_at, week_status, non_routine, example."""
    open_ = F.col("status") != "resolved"
    urgent = F.col("priority").isin("P0", "P1")
    most = F.desc("count_7d")
    fresh = F.coalesce(F.unix_timestamp("burst_ts") >= F.unix_timestamp(now) - 7 * 86400, F.lit(False))
    hint = lc.suppress_hint(F.col("sig"), F.col("non_routine"))
    none = F.lit(None).cast("string")
    sections = [
        ("p0", (F.col("priority") == "P0") & open_, [most], 10, none), ("p1_p2", F.col("priority").isin("P1", "P2") & open_, [F.desc("actors"), most], 10, none), ("p3", F.col("priority") == "P3", [most], 5, none),
        ("bursts", fresh, [F.desc("burst_ts")], 10, none), ("rules", urgent & (F.col("status") == "resolved") & F.col("fixed_at").isNotNull(), [F.desc("fixed_at")], 10, lc.rule_hint(F.col("sig"), F.col("example"))),
        ("relapses", F.col("week_status") == "regressed", [most], 10, none), ("quiet", urgent & open_ & hint.isNotNull(), [most], 10, hint),
    ]
    out = None
    for name, wanted, order, limit, note in sections:
        rows = aggregates.where(wanted).orderBy(*order, "sig").limit(limit)
        rank = F.row_number().over(Window.orderBy(*order, "sig"))  # of ten rows
        rows = rows.select(F.lit(name).alias("section"), rank.alias("rank"), "sig", "count_7d", note.alias("note"))
        out = rows if out is None else out.unionByName(rows)
    return out
