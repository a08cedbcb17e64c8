"""Error-event analytics: signatures, priorities, storm guard, alerts, weekly metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.running import streamed
from quillstone.functions import score as sc

# Hints of the highest priority, and client errors that are the usual noise.
P0_HINTS = ("traceback", "critical", "5xx", "oom", "restart", "cron_nonzero", "health_degraded", "hang", "disk_critical")
BASELINE_4XX = (401, 403, 404, 429)
MINUTE_CAP, BURST_COUNT, BURST_FACTOR, BURST_HISTORY, BURST_COOLDOWN = 5, 50, 10, 12, 24


def signature_counts(events: DataFrame) -> DataFrame:
    """Per signature: totals, first and last sight, actors, sources, the last message."""
    return events.groupBy("sig").agg(
        F.count(F.lit(1)).alias("count_total"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.countDistinct("actor").alias("n_actors"),
        F.countDistinct("source").alias("n_sources"), F.max_by("message", F.struct("ts", "seq")).alias("last_example"),
    )


def first_values(events: DataFrame, column: str, keep: int) -> DataFrame:
    """The first `keep` distinct values per signature, in order: ranked, so no set is gathered whole."""
    values = events.where(F.col(column).isNotNull()).select("sig", column).distinct()
    ranked = values.withColumn("rank", F.row_number().over(Window.partitionBy("sig").orderBy(column))).where(F.col("rank") <= keep)
    return ranked.groupBy("sig").agg(F.array_join(F.array_sort(F.collect_list(column)), ",").alias(f"{column}s"))


def daily(events: DataFrame) -> DataFrame:
    return events.groupBy("sig", "day").agg(F.count(F.lit(1)).alias("n"))


def week_counts(days: DataFrame, today: Column) -> DataFrame:
    """count_7d spans the eight dates from today - 7 on; the previous week ends before it."""
    age = F.datediff(today, "day")
    return days.groupBy("sig").agg(F.coalesce(F.sum(F.when(age <= 7, F.col("n"))), F.lit(0)).alias("count_7d"), F.coalesce(F.sum(F.when((age > 7) & (age <= 14), F.col("n"))), F.lit(0)).alias("count_prev_7d"))


def histogram(events: DataFrame, key: Column, keep: int, other: str) -> DataFrame:
    """Per signature the most frequent keys and one row for the others."""
    counts = events.groupBy("sig", key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("sig").orderBy(F.desc("n"), "key"))
    return counts.withColumn("key", F.when(rank <= keep, F.col("key")).otherwise(other)).groupBy("sig", "key").agg(F.sum("n").alias("n"))


def is_baseline() -> Column:
    plain = F.col("status").isin(*BASELINE_4XX) & F.col("actor").isNull()
    return F.coalesce(plain, F.lit(False)) | F.coalesce(F.col("marker") == "HEALTH", F.lit(False)) | F.col("message").contains("[AUTH]")


def priority_ladder(cycle: DataFrame, weeks: DataFrame) -> DataFrame:
    """Priority and class of each signature from the current cycle's events; the first rule decides."""
    hint = lambda name: F.max(F.coalesce(F.col("hint") == name, F.lit(False)))
    facts = cycle.groupBy("sig").agg(
        F.max(F.coalesce(F.col("hint").isin(*P0_HINTS), F.lit(False)) & ~F.col("expected")).alias("p0"), hint("slow").alias("slow"), hint("burst_routine").alias("burst_routine"), hint("burst").alias("burst"),
        hint("watchdog_silent").alias("silent"), F.min(F.col("expected")).alias("routine"), F.countDistinct("actor").alias("actors"), F.min(is_baseline()).alias("baseline"),
    )
    f = facts.join(weeks, "sig", "left")
    grown = F.coalesce((F.col("count_prev_7d") > 0) & (F.col("count_7d") > F.col("count_prev_7d")), F.lit(False))
    user = F.when(F.col("actors") > 0, "U").otherwise("T")
    p = lambda level, cls: F.struct(F.lit(level).alias("priority"), (F.lit(cls) if isinstance(cls, str) else cls).alias("class"))
    ladder = (
        F.when(F.col("p0"), p("P0", "T")).when(F.col("slow"), p("P1", "U")).when(F.col("burst_routine"), p("P2", "T")).when(F.col("burst") | F.col("silent"), p("P1", "T"))
        .when(F.col("routine"), p("P3", "T")).when((F.col("actors") >= 2) | grown, p("P1", user)).when(F.col("baseline"), p("P3", "T")).otherwise(p("P2", user))
    )
    return f.select("sig", ladder.alias("l")).select("sig", "l.priority", "l.class")


def guard(events: DataFrame) -> DataFrame:
    """Storm guard: at most five events per signature and minute pass; the next that passes carries the
    number suppressed since the one before. Cap-immune events pass and count nothing.

    The first event of a minute always passes and what is behind the fifth never does, so what an event carries is
    what the signature's last active minute suppressed, and only a minute's first event carries any. So rows meet
    inside their minute only; the order of minutes is taken from their counts."""
    rows = events.withColumn("_minute", F.date_trunc("minute", "ts"))
    nth = F.row_number().over(Window.partitionBy("sig", "immune", "_minute").orderBy("ts", "seq"))
    rows = rows.withColumn("_nth", nth).withColumn("allowed", F.col("immune") | (F.col("_nth") <= MINUTE_CAP))
    minutes = events.where("not immune").groupBy("sig", F.date_trunc("minute", "ts").alias("_minute")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.lag(F.greatest(F.col("_n") - MINUTE_CAP, F.lit(0))).over(Window.partitionBy("sig").orderBy("_minute"))
    minutes = minutes.select("sig", "_minute", F.coalesce(before, F.lit(0)).alias("_held")).where("_held > 0")
    rows = rows.join(minutes, ["sig", "_minute"], "left")
    carried = F.when(~F.col("immune") & (F.col("_nth") == 1), F.coalesce("_held", F.lit(0))).otherwise(F.lit(0))
    return rows.withColumn("carried", carried.cast("long")).select(*events.columns, "allowed", "carried")


def burst_means(cycles: DataFrame) -> DataFrame:
    """cycles (sig, cycle, n): the mean of up to twelve earlier active cycles, and whether this one is a hit."""
    before = Window.partitionBy("sig").orderBy("cycle").rowsBetween(-BURST_HISTORY, -1)
    mean = F.avg("n").over(before)
    hit = (F.col("n") >= BURST_COUNT) | F.coalesce((mean >= 1) & (F.col("n") >= BURST_FACTOR * mean), F.lit(False))
    return cycles.withColumns({"mean_before": mean, "hit": hit})


def burst_states(cycles: DataFrame) -> DataFrame:
    """sig, cycle, n, state after each active cycle: a fold that streams a signature's ordered cycles. state:
    armed, fired, held, re-armed; what it carries is the state and the active cycles since the last fire."""

    def step(carried: dict, row: tuple) -> tuple:
        sig, cycle, n, hit = row
        state, since = carried["state"], carried["since"]
        quiet = state in ("fired", "held")
        fires = not quiet and hit and (since < 0 or since >= BURST_COOLDOWN)
        state = ("held" if hit else "re-armed") if quiet else "fired" if fires else "held" if hit else state
        carried["since"] = 0 if fires else since + (since >= 0)
        carried["state"] = state
        return sig, cycle, n, state

    rows = burst_means(cycles).select("sig", F.col("cycle").cast("long").alias("cycle"), F.col("n").cast("long").alias("n"), "hit")
    kind = dict(rows.dtypes)["sig"]
    return streamed(rows, "sig", ["cycle"], f"sig {kind}, cycle long, n long, state string", lambda: {"state": "armed", "since": -1}, step)


def hangs(starts: DataFrame, oks: DataFrame, now: Column) -> DataFrame:
    """Tool starts 30 to 120 minutes old without an ok of that tool in the batch."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("ts")) / 60
    return starts.where((age >= 30) & (age <= 120)).join(oks.select("tool").distinct(), "tool", "left_anti")


def near_deploys(events: DataFrame, deploys: DataFrame, minutes: int = 15) -> DataFrame:
    """Events within so many minutes of a deploy: an equi-join on time buckets, then the exact distance."""
    width = minutes * 60
    at = F.unix_timestamp("ts")
    d = deploys.select(F.unix_timestamp("ts").alias("at")).distinct().withColumn("slot", F.explode(F.array(*[F.floor(F.col("at") / width) + k for k in (-1, 0, 1)])))
    e = events.withColumns({"e_at": at, "slot": F.floor(at / width)})
    return e.join(d, (e.slot == d.slot) & (F.abs(e.e_at - d["at"]) <= width), "left_semi").drop("e_at", "slot")


def resolve(aggregates: DataFrame, now: Column, days: int = 7) -> DataFrame:
    silent = F.datediff(now, "last_seen") >= days
    return aggregates.withColumns({"status": F.when(silent, "resolved").otherwise("active"), "fixed_at": F.when(silent, F.col("last_seen"))})


def burst_decay(rows: DataFrame, now: Column) -> DataFrame:
    """Within seven days of a burst: P2 if routine (P0 stays), else P1 at least; afterwards the base priority."""
    fresh = F.coalesce(F.datediff(now, "burst_ts") < 7, F.lit(False))
    lifted = F.when(F.col("burst_routine"), F.when(F.col("priority_base") == "P0", "P0").otherwise("P2")).otherwise(F.when(F.col("priority_base") == "P0", "P0").otherwise("P1"))
    return rows.withColumn("priority", F.when(fresh, lifted).otherwise(F.col("priority_base")))


def suppression_active(until: Column, today: Column) -> Column:
    """No date: for ever; a date that can't be read: not active."""
    return until.isNull() | F.coalesce(F.try_to_date(until) >= today, F.lit(False))


def alert_candidates(aggregates: DataFrame, state: DataFrame, suppression: DataFrame, now: Column) -> DataFrame:
    quiet = suppression.where(suppression_active(F.col("until"), F.to_date(now))).select("sig").distinct()
    rows = aggregates.join(state, "sig", "left").join(quiet, "sig", "left_anti")
    rows = rows.where(~F.coalesce("investigating", F.lit(False)) & (F.col("cooldown_until").isNull() | (F.col("cooldown_until") <= now)))
    recent = lambda c: F.unix_timestamp(now) - F.unix_timestamp(c) <= 600
    new = (F.col("priority") == "P0") & F.col("p0_alerted_at").isNull() & recent("first_seen")
    burst = F.coalesce(recent("burst_ts"), F.lit(False)) & F.col("priority").isin("P0", "P1") & (F.col("burst_alerted_at").isNull() | (F.col("burst_ts") > F.col("burst_alerted_at")))
    return rows.withColumn("kind", F.when(new, "new_p0").when(burst, "burst")).where("kind is not null")


def alert_budget(candidates: DataFrame, per_run: int = 2, sent_this_hour: int = 0, per_hour: int = 3) -> DataFrame:
    """One run: new P0 before bursts, newest first. The first ones are sent within what the hour leaves; if there are
    more, one tail with their number, which counts to the hour and is not sent when the hour is full. Runs in
    a row, with their cooldowns, are operators/overtime.py: sent_alerts."""
    left = max(0, per_hour - sent_this_hour)
    room = min(per_run, left)
    order = [F.when(F.col("kind") == "new_p0", 0).otherwise(1), F.desc("last_seen"), F.col("sig")]
    sent = candidates.orderBy(*order).limit(room).select("kind", "sig", F.lit(1).cast("long").alias("n"), F.lit(True).alias("sent"))
    rest = candidates.join(F.broadcast(sent.select("kind", "sig")), ["kind", "sig"], "left_anti")  # `room` rows
    tail = rest.agg(F.lit("tail").alias("kind"), F.lit(None).cast("string").alias("sig"), F.count(F.lit(1)).alias("n"), F.lit(left > room).alias("sent"))
    return sent.unionByName(tail.where("n > 0"))


def weekly_status(rows: DataFrame, now: Column) -> DataFrame:
    age = F.datediff(now, "last_seen")
    again = F.coalesce(F.col("fixed_at").isNotNull() & (F.col("last_seen") > F.col("fixed_at")) & (age < 7), F.lit(False))
    relapsed = F.col("state_fixed_at").isNotNull() & (F.col("status") == "active") & (F.col("state") == "resolved")
    value = (
        F.when((F.col("status") == "resolved") & ~again & (F.coalesce(F.col("manual"), F.lit(False)) | (age >= 7)), "resolved")
        .when(again | F.coalesce(relapsed, F.lit(False)), "regressed").when((F.datediff(now, "first_seen") < 7) & F.col("reported_week").isNull(), "new").otherwise("known")
    )
    return rows.withColumn("week_status", value)


def upper_median(values: DataFrame, key: list[str], column: str) -> DataFrame:
    """The element at n div 2 (from 0) of the ordered values: ranked, not gathered."""
    w = Window.partitionBy(*key).orderBy(column)
    ranked = values.withColumns({"rn": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy(*key))})
    return ranked.where(F.col("rn") == F.floor(F.col("n") / 2) + 1).select(*key, F.col(column).alias("median"))


def noise_ratio(events: DataFrame, priorities: DataFrame) -> DataFrame:
    rows = events.join(priorities.select("sig", "priority"), "sig", "left")
    return rows.groupBy("source").agg(F.round(F.avg(F.when(F.col("priority") == "P3", 1.0).otherwise(0.0)), 4).alias("noise"), F.count(F.lit(1)).alias("events"))


def host_digest(aggregates: DataFrame) -> DataFrame:
    """Per source the number of P0, P1, P2 signatures, a colour, and the three largest."""
    n = lambda p: F.count_if(F.col("priority") == p)
    rank = F.row_number().over(Window.partitionBy("source").orderBy(sc.priority_rank(F.col("priority")), F.desc("n"), "sig"))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, F.struct("rank", "sig")))), lambda x: x["sig"]), ",")
    out = aggregates.withColumn("rank", rank).groupBy("source").agg(n("P0").alias("p0"), n("P1").alias("p1"), n("P2").alias("p2"), top.alias("top"))
    return out.withColumn("colour", F.when(F.col("p0") > 0, "red").when(F.col("p1") > 0, "yellow").otherwise("green"))


def examples(events: DataFrame, n: int = 3) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("sig").orderBy(F.desc("ts"), F.desc("seq")))
    return events.withColumn("rank", rank).where(F.col("rank") <= n)


def prune_plan(aggregates: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """sig, drop_aggregate, drop_state under the hold rules."""
    both = aggregates.join(state, "sig", "full_outer")
    age = F.datediff(now, "last_seen")
    held = F.coalesce("investigating", F.lit(False))
    out = both.withColumns({
        "drop_aggregate": F.coalesce((F.col("status") == "resolved") & (age > 90) & ~held, F.lit(False)),
        "drop_state": F.coalesce(F.col("state").isin("new", "known", "resolved") & ~held & (age > 45), F.lit(False)),
    })
    return out.where("drop_aggregate or drop_state").select("sig", "drop_aggregate", "drop_state")


def merge_aggregates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mergeable aggregates: sums, first and last times, flags, the best priority, active wins."""
    rows = a.unionByName(b)
    best = F.min_by("priority", sc.priority_rank(F.col("priority")))
    return rows.groupBy("sig").agg(F.sum("count_total").alias("count_total"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("burst").alias("burst"), best.alias("priority"), F.when(F.max(F.col("status") == "active"), "active").otherwise("resolved").alias("status"))


def edge_trigger(samples: DataFrame, seconds: int = 3600) -> DataFrame:
    """Events on the change from fine to breached, and snapshots while a breach lasts: one when at least so
    many seconds have passed since the metric's last snapshot, or since the edge if there was none yet."""
    before = F.lag("breached").over(Window.partitionBy("metric").orderBy("ts", "seq"))
    rows = samples.withColumn("edge", F.col("breached") & ~F.coalesce(before, F.lit(False))).where("breached")
    rows = rows.select("metric", "ts", "seq", "edge", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))

    def step(state: dict, row: tuple) -> tuple | None:
        metric, ts, seq, edge, at = row
        if edge:
            state["edge"] = at
            return metric, ts, seq, "edge"
        if at - state.get("snapshot", state.get("edge")) >= seconds * 1_000_000:
            state["snapshot"] = at
            return metric, ts, seq, "snapshot"
        return None

    kinds = dict(rows.dtypes)
    return streamed(rows, "metric", ["ts", "seq"], f"metric {kinds['metric']}, ts {kinds['ts']}, seq {kinds['seq']}, kind string", dict, step)


def silence_gaps(events: DataFrame, minutes: int = 30) -> DataFrame:
    """Gaps of more than so many minutes between two events of a source."""
    before = F.lag("ts").over(Window.partitionBy("source").orderBy("ts", "seq"))
    rows = events.withColumn("before", before)
    gap = F.unix_timestamp("ts") - F.unix_timestamp("before")
    return rows.where(gap > minutes * 60).select("source", "before", F.col("ts").alias("after"), gap.alias("seconds"))


def query_aggregates(aggregates: DataFrame, priority: str | None = None, source: str | None = None, text: str | None = None, since: Column | None = None, limit: int = 20) -> DataFrame:
    rows = aggregates
    if priority:
        rows = rows.where(F.col("priority") == priority)
    if source:
        rows = rows.where(F.array_contains("sources", source))
    if text:
        rows = rows.where(F.lower("sig").contains(text.lower()))
    if since is not None:
        rows = rows.where(F.col("last_seen") >= since)
    return rows.orderBy(sc.priority_rank(F.col("priority")), F.desc("last_seen"), "sig").limit(max(1, min(limit, 100)))
