"""Workspace accounting: fair queue, admission, budgets, ETA, calibration, gates, graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Weights of the fair queue and what starves after how many seconds.
CLASS_WEIGHT = {"interactive": 100, "batch": 10, "background": 1}
PRIORITY_WEIGHT = {"high": 4, "med": 2, "low": 1}
STARVE_SECONDS = {"interactive": 60, "batch": 1800, "background": 7200}


def choose(column: Column, values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def weight(cls: Column, priority: Column) -> Column:
    return choose(cls, CLASS_WEIGHT) * choose(priority, PRIORITY_WEIGHT)


def queue_rank(calls: DataFrame, now: Column) -> DataFrame:
    """Position per shelf: starved calls by deadline, then the others by virtual finish time; ties by name."""
    starved = F.coalesce(F.col("deadline") <= now, F.lit(False))
    order = [F.when(starved, 0).otherwise(1), F.when(starved, F.col("deadline")).otherwise(F.col("vft")), "call"]
    return calls.withColumns({"starved": starved, "position": F.row_number().over(Window.partitionBy("shelf").orderBy(*order))})


def virtual_finish(calls: DataFrame, virtual_time: Column) -> DataFrame:
    """Chained per priority and class: the later of V and the last finish, plus cost / weight for each call."""
    share = F.col("cost") / weight(F.col("class"), F.col("prio"))
    running = F.sum(share).over(Window.partitionBy("prio", "class").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return calls.withColumn("vft", F.greatest(virtual_time, F.coalesce("last_vft", F.lit(0.0))) + running)


def token_bucket(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """Allowed or denied in time order: a fold over each key's requests."""
    rows = requests.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "count"))).alias("r"))
    start = F.struct(F.lit(float(burst)).alias("tokens"), F.lit(None).cast("double").alias("at"), F.array().cast("array<struct<seq:bigint,allowed:boolean>>").alias("log"))

    def step(acc: Column, x: Column) -> Column:
        refilled = F.least(F.lit(float(burst)), acc["tokens"] + F.coalesce(x["ts"] - acc["at"], F.lit(0.0)) * rate)
        ok = refilled >= x["count"]
        log = F.array_append(acc["log"], F.struct(x["seq"].cast("long").alias("seq"), ok.alias("allowed")))
        return F.struct(F.when(ok, refilled - x["count"]).otherwise(refilled).alias("tokens"), x["ts"].alias("at"), log.alias("log"))

    return rows.select("key", F.explode(F.aggregate("r", start, step)["log"]).alias("l")).select("key", "l.seq", "l.allowed")


def admission(users: DataFrame) -> DataFrame:
    """held, tokens spent and limit, money spent and limit, in flight and limit -> verdict; null: no limit."""
    over = lambda a, b: F.coalesce(F.col(a) >= F.col(b), F.lit(False))
    verdict = F.when(F.col("held"), "allow:reused").when(over("tokens", "token_limit"), "deny:quota_tokens_exhausted").when(over("money", "money_limit"), "park:budget_ext_exhausted").when(over("flying", "conc_limit"), "deny:quota_conc_exceeded").otherwise("allow")
    return users.withColumn("verdict", verdict)


def ema(rows: DataFrame, key: str, alpha: float = 0.3) -> DataFrame:
    """Exponential mean in time order, as a weighted sum: weights fall with the rank from the end, and the
    first value has what is left. So a key's history is ranked, which may spill, but never gathered."""
    order = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("seq"))
    ranked = rows.withColumns({"r": F.row_number().over(order), "n": F.count(F.lit(1)).over(Window.partitionBy(key))})
    weight = F.pow(F.lit(1 - alpha), F.col("r") - 1) * F.when(F.col("r") == F.col("n"), 1.0).otherwise(alpha)
    return ranked.groupBy(key).agg(F.sum(weight * F.col("value")).alias("ema"))


def p95(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"))


def eta_range(position: Column, mean: Column, slow: Column) -> tuple[Column, Column]:
    return F.greatest(F.lit(0), position - 1) * mean, F.greatest(F.lit(1), position) * slow


def latest_window(rows: DataFrame, key: str, now: Column, seconds: int = 86_400, most: int = 200) -> DataFrame:
    """What was observed in the last day, the newest 200 at most."""
    recent = rows.where((F.col("at") > now - seconds) & (F.col("at") <= now))
    return recent.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("at"), F.desc("seq")))).where(F.col("rn") <= most).drop("rn")


# What a zone's score must reach, and when a spread is flagged.
FLOOR, SPREAD = {"public": 0.80, "private": 0.85}, 0.15


def q_report(runs: DataFrame, least_runs: int = 3) -> DataFrame:
    """Per task: mean, range, the zone's floor, marker, flag; with enough runs only."""
    out = runs.groupBy("task", "zone").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.max("score") - F.min("score"), 6).alias("spread"))
    floor = F.coalesce(choose(F.col("zone"), FLOOR), F.lit(max(FLOOR.values())))
    return out.where(F.col("n") >= least_runs).withColumns({"floor": floor, "marker": F.when(F.col("mean") < floor, "local-draft").otherwise("final"), "flagged": F.col("spread") > SPREAD})


def by_shelf(rows: DataFrame) -> DataFrame:
    """The mean of the tasks' means."""
    return rows.groupBy("shelf", "task").agg(F.avg("score").alias("m")).groupBy("shelf").agg(F.round(F.avg("m"), 6).alias("mean"))


def probe_report(runs: DataFrame) -> DataFrame:
    spread = F.max("score") - F.min("score")
    out = runs.groupBy("set").agg(F.round(F.median("score"), 6).alias("median"), F.round(spread, 6).alias("spread"), F.round(F.avg(F.col("parsed").cast("double")), 6).alias("parse_rate"), F.countDistinct("run").alias("n_runs"), F.sum("tokens").alias("tokens"))
    flags = F.array_compact(F.array(F.when(F.col("spread") > SPREAD, "unstable_cell"), F.when(F.col("parse_rate") < 1, "parse_fail"), F.when(F.col("n_runs") < 3, "n_runs_lt3"), F.when((F.col("median") >= 0.999) & (F.col("spread") == 0), "ceiling")))
    return out.withColumn("flags", F.array_join(flags, ","))


def promotion(p: DataFrame) -> DataFrame:
    """base_*, variant_* medians, needles, money, time and the golden and held-out means -> promoted."""
    c = F.col
    base_ceiling = (c("base_median") >= 0.999) & (c("base_spread") == 0)
    ceiling = base_ceiling | ((c("variant_median") >= 0.999) & (c("variant_spread") == 0))
    margin = c("variant_needle") - c("base_needle")
    at_top = (c("base_needle") < 0.5) & (c("variant_needle") >= 0.5) & (margin > 0) & (margin >= c("quantum"))
    below = (c("base_median") < c("floor")) & (c("variant_needle").isNull() | (c("variant_needle") >= 0.5))
    always = (c("variant_median") >= c("floor")) & (c("rub") <= c("rub_cap")) & (c("wall") <= c("wall_cap")) & (F.abs(c("golden") - c("heldout")) <= F.greatest(c("variant_spread"), F.lit(1e-9)))
    return p.withColumn("promoted", F.coalesce(F.when(ceiling, at_top).otherwise(below), F.lit(False)) & always)


def diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """added, removed, changed by key: a full outer join with null-safe comparison."""
    o, n = old.select(*keys, F.col(value).alias("o"), F.lit(True).alias("in_o")), new.select(*keys, F.col(value).alias("n"), F.lit(True).alias("in_n"))
    state = F.when(F.col("in_o").isNull(), "added").when(F.col("in_n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return o.join(n, keys, "full_outer").select(*keys, state.alias("state")).where("state is not null")


def context_mode(referenced: Column, changed: Column) -> Column:
    """delta only if something is referenced and all of it changed."""
    return F.when((F.size(referenced) > 0) & (F.size(F.array_except(referenced, changed)) == 0), "delta").otherwise("full")


# The states a job may go to.
TRANSITIONS = {
    "queued": ("running", "cancelled", "failed", "parked"),
    "running": ("queued", "waiting_human", "sleeping", "preempted", "parked", "done", "failed", "cancelled"),
    "waiting_human": ("running", "cancelled", "failed"), "sleeping": ("running", "cancelled", "failed", "parked"),
    "preempted": ("running", "queued", "cancelled", "failed", "parked"), "parked": ("queued", "cancelled", "failed"), "failed": ("queued",),
}


def illegal_transitions(moves: DataFrame) -> DataFrame:
    ok = F.lit(False)
    for a, targets in TRANSITIONS.items():
        ok = ok | ((F.col("from_state") == a) & F.col("to_state").isin(*targets))
    return moves.where(~ok)


def last_n(messages: DataFrame, key: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc("seq"))
    return messages.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def lru_evict(files: DataFrame, limit: int) -> DataFrame:
    """The oldest go until the rest fits: those before which the newer ones already fill the limit."""
    newer = F.sum("size").over(Window.partitionBy("cache").orderBy(F.desc("used"), F.desc("name")).rowsBetween(Window.unboundedPreceding, 0))
    return files.withColumn("held", newer).where(F.col("held") > limit)


def gpu_slots(free: Column, weights: Column, resident: Column, safety: Column, kv: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(1), F.floor((free - weights - resident - safety) / F.when(kv > 0, kv))), F.lit(1)).cast("long")


def reachable(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """All pairs (g, src, dst) with a path, of any length. Paths double in a round until there is no new pair;
    a round's pairs are cut by checkpoint() where the session has a folder for it."""
    now = edges.select("g", "src", "dst").distinct()
    held = now.count()
    durable = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if durable and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(durable)
    while True:
        after = now.select("g", F.col("src").alias("dst"), F.col("dst").alias("to"))
        then = now.union(now.join(after, ["g", "dst"]).select("g", "src", F.col("to").alias("dst"))).distinct()
        then = then.checkpoint() if durable else then.cache()
        n = then.count()
        if n == held:
            return then
        now, held = then, n


def reconcile_budget(journal: DataFrame) -> DataFrame:
    """Spend per month and user, and per month (user null)."""
    return journal.groupBy("month", "user").agg(F.sum("micro").alias("micro")).unionByName(journal.groupBy("month").agg(F.sum("micro").alias("micro")).withColumn("user", F.lit(None).cast("long")))


def token_charge(usage: DataFrame, zone: str) -> DataFrame:
    """What a user has spent so far on each local day, call by call."""
    day = F.date_format(F.from_utc_timestamp("ts", zone), "yyyy-MM-dd")
    spent = F.sum("tokens").over(Window.partitionBy("user", "day").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0))
    return usage.withColumn("day", day).withColumn("spent", spent)


def latency_histogram(rows: DataFrame, key: str, value: str, edges: tuple) -> DataFrame:
    """Cumulative counts up to each edge and in all, as monitoring systems want them; one pass, no window."""
    counts = [F.struct(F.lit(str(e)).alias("le"), F.count_if(F.col(value) <= e).alias("n")) for e in edges]
    total = F.struct(F.lit("+Inf").alias("le"), F.count(F.lit(1)).alias("n"))
    return rows.groupBy(key).agg(F.array(*counts, total).alias("h")).select(key, F.inline("h"))


def repeated_within(requests: DataFrame, seconds: int) -> DataFrame:
    """Requests that come within so many seconds of an equal one."""
    before = F.lag("at").over(Window.partitionBy("dupe_hash").orderBy("at", "id"))
    return requests.withColumn("before", before).where(F.col("at") - F.col("before") <= seconds).drop("before")


def pilot_gates(runs: DataFrame) -> DataFrame:
    """Per mode compliance, accuracy of the compliant, escalation; delta passes with an accuracy of full's
    less 0.2 and a compliance of 0.8."""
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    out = runs.groupBy("mode").agg(rate(F.col("compliant")).alias("compliance"), rate(F.when(F.col("compliant"), F.col("correct"))).alias("accuracy"), rate(F.col("correct")).alias("accuracy_raw"), rate(F.col("escalated")).alias("escalation"))
    full = out.where("mode = 'full'").select(F.col("accuracy").alias("full_accuracy"))
    return out.join(F.broadcast(full)).withColumn("passes", (F.col("accuracy") >= F.col("full_accuracy") - 0.2) & (F.col("compliance") >= 0.8)).drop("full_accuracy")


def resolve_settings(pins: DataFrame, profiles: DataFrame, defaults: dict) -> DataFrame:
    """Each setting from the pin, else the profile, else the default."""
    both = profiles.join(pins, "cell", "left")
    return both.select("cell", *[F.coalesce(f"pin_{k}", f"profile_{k}", F.lit(v)).alias(k) for k, v in defaults.items()])


def structural_score(verdict: Column, sections: Column, citation: Column, length: Column) -> Column:
    return F.round(0.2 * verdict + 0.4 * sections + 0.2 * citation + 0.2 * length, 3)
