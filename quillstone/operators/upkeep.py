"""What an operator looks at and clears away: the guard with its suppression list, what is old, the queue, what stands
against publishing an entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.operators import events as ev
from quillstone.operators import workspace as ws

# Sources that no list silences, days after which raw days go, backups that stay, parts of a path that warn,
# shelves that are always shown, priorities of a job.
IMMUNE_SOURCES = ("host", "health", "docker_events")
RAW_DAYS, BACKUPS = 90, 4
PATH_MARKERS = ("partners/", "_private/", "review-", ".trash")
SHELVES, PRIORITIES = ("local", "ext"), ("high", "med", "low")


def list_immune() -> Column:
    """An event that the suppression list doesn't silence: with a traceback, of an immune source, or of the guard itself."""
    return (F.coalesce("hint", F.lit("")) == "traceback") | F.coalesce("source", F.lit("")).isin(*IMMUNE_SOURCES) | (F.coalesce("marker", F.lit("")) == "GUARD")


def cap_immune() -> Column:
    """An event that the cap of a minute doesn't hold back: the same, and an answer 4xx to a known actor."""
    refused = F.coalesce(F.col("status").between(400, 499), F.lit(False)) & (F.coalesce("actor", F.lit("")) != "")
    return list_immune() | refused


def guarded(events: DataFrame, listed: DataFrame, today: str) -> DataFrame:
    """events with verdict (listed, immune, passed, capped) and carried.

    events: sig, ts, seq, source, marker, hint, status, actor. listed: sig (distinct), until (a day, or empty for good); an entry is
    in force to that day. What is listed takes no place in its minute and is carried by nobody, as all of its signature
    that an event could carry is silent."""
    force = listed.where(F.coalesce(F.nullif("until", F.lit("")), F.lit(today)) >= today).select("sig", F.lit(True).alias("_listed"))
    rows = events.join(force, "sig", "left").withColumn("_listed", F.coalesce("_listed", F.lit(False)) & ~list_immune())
    rest = ev.guard(rows.where("not _listed").drop("_listed").withColumn("immune", cap_immune()))
    verdict = F.when(F.col("immune"), "immune").when(F.col("allowed"), "passed").otherwise("capped")
    rest = rest.withColumn("verdict", verdict).select(*events.columns, "verdict", "carried")
    silent = rows.where("_listed").select(*events.columns, F.lit("listed").alias("verdict"), F.lit(0).cast("long").alias("carried"))
    return rest.unionByName(silent)


def list_additions(asked: DataFrame) -> DataFrame:
    """sig, until, refused of entries asked for: one for an immune source (what stands before the first bar) would do nothing."""
    return asked.select("sig", "until", F.substring_index("sig", "|", 1).isin(*IMMUNE_SOURCES).alias("refused"))


def old_days(days: DataFrame, now: Column) -> DataFrame:
    """Raw days (name, ...) that go: names that are a date before the last 90 days. Other names are left alone."""
    day = F.when(F.col("name").rlike(r"^\d{4}-\d{1,2}-\d{1,2}\z"), F.try_to_timestamp("name", F.lit("yyyy-M-d")).cast("date"))
    return days.where(day < F.date_sub(now, RAW_DAYS))


def prune_slices(days: DataFrame, aggregates: DataFrame, state: DataFrame, backups: DataFrame, now: Column) -> DataFrame:
    """kind, name of all that goes: raw days, resolved aggregates and dead states under their hold rules, backups but for
    the newest four."""
    plan = ev.prune_plan(aggregates, state, now)
    newest = backups.orderBy(F.desc("name")).limit(BACKUPS)
    part = lambda d, kind, c="name": d.select(F.lit(kind).alias("kind"), F.col(c).alias("name"))
    out = part(old_days(days, now), "day").union(part(plan.where("drop_aggregate"), "aggregate", "sig")).union(part(plan.where("drop_state"), "state", "sig"))
    return out.union(part(backups.join(newest, "name", "left_anti"), "backup"))


def promotion_checklist(entries: DataFrame, issues: DataFrame, zone: Column) -> DataFrame:
    """kid, ready, warnings of entries (kid, path) that are to go to a zone: open sensitive issues, and parts of the path in small
    letters that name what is private. It warns only, and only of the public zone."""
    n = issues.where("type = 'sensitive' and status = 'open'").groupBy("kid").agg(F.count(F.lit(1)).alias("open"))
    path = F.coalesce("path", F.lit(""))
    told = F.array(
        F.when(F.col("open") > 0, F.concat(F.col("open").cast("string"), F.lit(" open sensitive issue(s)"))),
        *[F.when(F.lower(path).contains(m), F.concat(F.lit(f"file path contains '{m}': "), path)) for m in PATH_MARKERS],
    )
    rows = entries.withColumn("_zone", zone).join(n, "kid", "left")
    rows = rows.select("kid", F.when(F.col("_zone") == "public", F.array_compact(told)).otherwise(F.array().cast("array<string>")).alias("warnings"))
    return rows.select("kid", (F.size("warnings") == 0).alias("ready"), "warnings")


def queue_jobs(calls: DataFrame, times: DataFrame, wanted: DataFrame) -> DataFrame:
    """shelf, job, position, ahead, starved, prio, class, calls, lower, upper, override, prio_source of waiting jobs.

    calls: shelf, call, job (empty: the call stands for itself), position or null, starved, prio, class. times: shelf, ema_s, p95_s.
    wanted: job, prio as someone set it, which counts if it is a priority. A job stands where its first call does and
    has that call's priority and class."""
    rows = calls.withColumn("job", F.coalesce(F.nullif("job", F.lit("")), "call"))
    lead = F.min_by(F.struct("prio", "class"), F.struct(F.col("position").isNull(), "position", "call"))
    jobs = rows.groupBy("shelf", "job").agg(F.min("position").alias("position"), F.max("starved").alias("starved"), lead.alias("lead"), F.count(F.lit(1)).alias("calls"))
    jobs = jobs.join(times, "shelf", "left").join(wanted.select("job", F.col("prio").alias("override")), "job", "left")
    lower, upper = ws.eta_range(F.col("position"), F.col("ema_s"), F.col("p95_s"))
    known = F.col("position") >= 1
    return jobs.select(
        "shelf", "job", "position", (F.col("position") - 1).alias("ahead"), "starved", "lead.prio", "lead.class", "calls", F.when(known, lower).alias("lower"), F.when(known, upper).alias("upper"),
        "override", F.when(F.col("override").isin(*PRIORITIES), "job").otherwise("account").alias("prio_source"),
    )


def queue_shelves(calls: DataFrame, told: DataFrame) -> DataFrame:
    """shelf, depth, depth_source, waiting: the depth that the queue tells (told: shelf, depth), else the calls that wait. The local
    and the outer shelf are always there."""
    waiting = calls.groupBy("shelf").agg(F.count(F.lit(1)).alias("waiting"))
    always = calls.sparkSession.createDataFrame([(s,) for s in SHELVES], "shelf string")
    shelves = waiting.select("shelf").union(told.select("shelf")).union(always).distinct()
    rows = shelves.join(waiting, "shelf", "left").join(told, "shelf", "left").withColumn("waiting", F.coalesce("waiting", F.lit(0)))
    return rows.select("shelf", F.coalesce("depth", "waiting").alias("depth"), F.when(F.col("depth").isNotNull(), "posq").otherwise("waiting").alias("depth_source"), "waiting")


def found_points(points: DataFrame) -> DataFrame:
    """Search results as they are handed out, of points with a score: it is rounded, the title is the section's or derived from
    the text, and `locator` (JSON) has those locator fields only that are there; null if none is."""
    fields = ("source_id", "locator_kind", "locator_start", "locator_end")
    any_ = F.coalesce(*[F.col(c).cast("string") for c in fields]).isNotNull()
    title = F.coalesce(F.nullif("section_header", F.lit("")), tx.derive_title(F.col("content"), F.col("kid")))
    chunk = F.coalesce("chunk_id", F.col("id").cast("string"))
    return points.select("kid", chunk.alias("chunk_id"), F.round("score", 4).alias("score"), title.alias("title"), F.when(any_, F.to_json(F.struct(*fields))).alias("locator"))


def corrected_budget(counters: DataFrame, journal: DataFrame, month: str, most: int | None = None) -> DataFrame:
    """user (null: all), before, after, refused of a month's counters, which are set to the sums of the journal.

    counters: user, micro; journal: month, user, micro. A user without a line in the journal is left alone, one without a
    counter gets one. Where the counter of all would go down by more than `most`, the journal is taken to be cut off:
    everything is refused and nothing changes."""
    lines = journal.where(F.col("month") == month)
    sums = lines.groupBy("user").agg(F.sum("micro").alias("sum")).where("user is not null")
    total = lines.agg(F.coalesce(F.sum("micro"), F.lit(0)).cast("long").alias("sum"))
    before = counters.where("user is null").agg(F.coalesce(F.max("micro"), F.lit(0)).cast("long").alias("before"))
    world = before.join(F.broadcast(total)).withColumn("refused", F.lit(False) if most is None else F.col("before") - F.col("sum") > most)
    verdict = F.broadcast(world.select("refused"))
    users = counters.where("user is not null").join(sums, "user", "full_outer").join(verdict)
    after = F.when(F.col("refused"), F.col("micro")).otherwise(F.coalesce("sum", "micro"))
    users = users.select("user", F.coalesce("micro", F.lit(0)).cast("long").alias("before"), F.coalesce(after, F.lit(0)).cast("long").alias("after"), "refused")
    none = F.lit(None).cast(dict(users.dtypes)["user"]).alias("user")
    return users.unionByName(world.select(none, "before", F.when(F.col("refused"), F.col("before")).otherwise(F.col("sum")).alias("after"), "refused"))


# The status that an action gives.
STATUS = {"deprecate": "deprecated", "restore": "published"}


def cascaded(entries: DataFrame, actions: DataFrame) -> DataFrame:
    """kid, status, reached: entries (kid, parent, zone, status) after deprecations and restorations (n distinct, kid, action, cascade).

    An action reaches its entry and, if it cascades or the entry has no parent, the sections below it in the entry's own
    zone. Of the actions that reach an entry, whose number is `reached`, the last one counts. What names no entry does nothing."""
    target = F.coalesce(*[F.when(F.col("action") == a, s) for a, s in STATUS.items()])
    heads = entries.select("kid", "zone", F.col("parent").isNull().alias("root"))
    known = actions.withColumn("to", target).where("to is not null").join(heads, "kid")
    wide = F.coalesce("cascade", F.lit(False)) | F.col("root")
    # Last actions by head come before the sections, so that a head's sections are met once.
    last = lambda d: d.agg(F.max(F.struct("n", "to")).alias("last"), F.count(F.lit(1)).alias("reached"))
    own = last(known.groupBy("kid"))
    below = last(known.where(wide).groupBy(F.col("kid").alias("parent"), "zone"))
    below = entries.where("parent is not null and parent <> kid").select("kid", "parent", "zone").join(below, ["parent", "zone"]).select("kid", "last", "reached")
    total = own.union(below).groupBy("kid").agg(F.max("last").alias("last"), F.sum("reached").alias("reached"))
    return entries.join(total, "kid", "left").select("kid", F.coalesce("last.to", "status").alias("status"), F.coalesce("reached", F.lit(0)).alias("reached"))
