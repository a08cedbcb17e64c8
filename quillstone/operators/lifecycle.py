"""Issues, zones, blobs, log classes and bookkeeping around entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import score as sc
from quillstone.operators.running import running_sum

CLOSES, REOPENS = ("merge", "deprecate"), ("restore",)


def apply_actions(issues: DataFrame, actions: DataFrame) -> DataFrame:
    """issues (issue_id, kid, type, status) after actions (issue_id, kid, action).

    An issue that is acted on is resolved, or ignored; a merge or a deprecation closes all open duplicate
    issues of the entry, a restoration opens its closed ones again.
    """
    direct = actions.groupBy("issue_id").agg(F.max(F.when(F.col("action") == "ignore", "ignored").otherwise("resolved")).alias("to"))
    by_kid = actions.groupBy("kid").agg(F.max(F.col("action").isin(*CLOSES)).alias("closes"), F.max(F.col("action").isin(*REOPENS)).alias("reopens"))
    rows = issues.join(direct, "issue_id", "left").join(by_kid, "kid", "left")
    status = F.coalesce("to", "status")
    dup = F.col("type") == "duplicate"
    status = F.when(dup & F.coalesce("closes", F.lit(False)) & (status == "open"), "resolved").when(dup & F.coalesce("reopens", F.lit(False)) & (status == "resolved"), "open").otherwise(status)
    return rows.select("issue_id", "kid", "type", F.col("status").alias("before"), status.alias("status"))


def action_audit(actions: DataFrame) -> DataFrame:
    """kid, action of the audit rows: a resolution whose reason says that it is no duplicate counts as a
    rejected finding, others leave no row."""
    fp = (F.col("action") == "resolve") & F.lower(F.coalesce("reason", F.lit(""))).contains("not a duplicate")
    name = F.when(fp, "fp_rejection").when(F.col("action") == "merge", "merge").when(F.col("action") == "deprecate", "deprecated").when(F.col("action") == "restore", "restored")
    return actions.select("kid", name.alias("action")).where("action is not null")


def bulk_resolve(issues: DataFrame, wanted: Column, status: str) -> DataFrame:
    """Open issues that are wanted take the status."""
    if status not in ("resolved", "ignored"):
        raise ValueError(f"not a final status: {status}")
    hit = wanted & (F.col("status") == "open")
    return issues.withColumns({"changed": F.coalesce(hit, F.lit(False)), "status": F.when(hit, status).otherwise(F.col("status"))})


def newest(issues: DataFrame, limit: int) -> DataFrame:
    return issues.orderBy(F.desc("seq")).limit(limit)


def stalled(scans: DataFrame, now: Column, limit: int = 600) -> DataFrame:
    """scans with age in seconds (not below 0) and whether they stall: running without a heartbeat for more
    than the limit. No limit, or a time that can't be read: not stalled."""
    at = F.try_to_timestamp("updated_at")
    age = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(at))
    return scans.withColumns({"age": age, "stalled": F.lit(limit > 0) & (F.col("status") == "running") & F.coalesce(age > limit, F.lit(False))})


def resolved_zone(level: Column, scope: Column, requested: Column, default: str = "both") -> Column:
    """The zone of a request; 'denied' outside the key's scope, 'unknown' for a zone that there is not."""
    named, open_ = requested.isin("public", "private"), requested.isNull() | requested.isin("both", "auto", "")
    single = F.when(F.size(scope) == 2, default).when(F.array_contains(scope, "private"), "private").otherwise("public")
    mine = F.when(named, F.when(F.array_contains(scope, requested), requested).otherwise("denied")).when(open_, single)
    full = F.when(named, requested).when(open_, default)
    return F.coalesce(F.when(level.isin("write", "system"), full).otherwise(mine), F.lit("unknown"))


def permitted(calls: DataFrame, matrix: DataFrame) -> DataFrame:
    """calls (level, tool) with whether the matrix (level, tool) has them."""
    known = matrix.select("level", "tool").distinct().withColumn("allowed", F.lit(True))
    return calls.join(known, ["level", "tool"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def egress(calls: DataFrame) -> DataFrame:
    """Calls that would send private data to a shelf that is not local."""
    return calls.where("zone = 'private' and shelf <> 'local'")


def merged_blobs(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """source_id, canonical, derived, attached: a canonical form is attached only where there is none, new
    derived ones behind those that are there."""
    i = incoming.select("source_id", F.col("canonical").alias("c"), F.col("derived").alias("d"))
    rows = existing.join(i, "source_id", "left")
    old, new = F.coalesce("derived", F.array().cast("array<string>")), F.coalesce("d", F.array().cast("array<string>"))
    added = F.array_except(new, old)
    attached = (F.size(added) > 0) | (F.col("canonical").isNull() & F.col("c").isNotNull())
    return rows.select("source_id", F.coalesce("canonical", "c").alias("canonical"), F.concat(old, added).alias("derived"), attached.alias("attached"))


def teardown(sources: DataFrame, entries: DataFrame, refs: DataFrame) -> DataFrame:
    """kind, id of what goes with the sources: they, their entries, and blobs that no other source has."""
    gone = sources.select("source_id").distinct()
    blobs = refs.join(gone, "source_id", "left_semi").select("sha").distinct().join(refs.join(gone, "source_id", "left_anti").select("sha"), "sha", "left_anti")
    part = lambda d, kind, c: d.select(F.lit(kind).alias("kind"), F.col(c).alias("id"))
    return part(gone, "source", "source_id").union(part(entries.join(gone, "source_id", "left_semi"), "entry", "kid")).union(part(blobs, "blob", "sha"))


def job_priorities(jobs: DataFrame, valid: tuple[str, ...]) -> DataFrame:
    """The job's own priority if it is valid, else the account's."""
    own = F.col("job_prio").isin(*valid)
    return jobs.withColumns({"prio": F.when(own, F.col("job_prio")).otherwise(F.col("account_prio")), "source": F.when(own, "job").otherwise("account")})


def retries(attempts: DataFrame, most: int = 3) -> DataFrame:
    """key, attempts, wait, dead: failures since the last success; a try follows after 1 and 4 seconds, and the
    third failure in a row is dead (a key that is tried again begins anew). attempts: key, seq, ok."""
    last = attempts.groupBy("key").agg(F.max(F.when(F.col("ok"), F.col("seq"))).alias("good"))
    fails = attempts.join(last, "key").where(~F.col("ok") & (F.col("good").isNull() | (F.col("seq") > F.col("good"))))
    n = fails.groupBy("key").agg(((F.count(F.lit(1)) - 1) % most + 1).alias("attempts"))
    return n.withColumns({"dead": F.col("attempts") >= most, "wait": F.when(F.col("attempts") < most, F.pow(F.lit(4), F.col("attempts") - 1).cast("long"))})


def artifacts(rows: DataFrame, now_day: int, days: int = 30) -> DataFrame:
    """Artifacts by content (id: 16 digits of its hash) that have not expired, newest first by rank."""
    made = rows.groupBy(F.substring(F.sha2(F.col("content").cast("binary"), 256), 1, 16).alias("id")).agg(F.max("day").alias("day"))
    return made.where(F.col("day") + days > now_day).withColumn("expires", F.col("day") + days)


def backfilled(index: DataFrame, store: DataFrame) -> DataFrame:
    """index (kid, seq) with missing sequence numbers from the store; entries there may be several times."""
    known = store.groupBy("kid").agg(F.min("seq").alias("stored"))
    both = index.join(known, "kid", "left")
    filled = F.col("seq").isNull() & F.col("stored").isNotNull()
    return both.select("kid", F.coalesce("seq", "stored").alias("seq"), filled.alias("filled"))


def index_plan(states: DataFrame, most: int = 50) -> DataFrame:
    """kid, mode of what a run indexes: missing and drifted entries, or all if those are too many."""
    due = states.where("state in ('missing', 'drifted')")
    n = due.agg(F.count(F.lit(1)).alias("due"))
    rows = states.where("state <> 'orphan'").join(F.broadcast(n))
    full = F.col("due") > most
    return rows.where(full | F.col("state").isin("missing", "drifted")).select("kid", F.when(full, "full").otherwise("incremental").alias("mode"))


def latest_updates(rows: DataFrame) -> DataFrame:
    """kid, updated_at: the raw value whose time is the latest; one that can't be read loses to one that can."""
    at = F.try_to_timestamp("updated_at")
    return rows.groupBy("kid").agg(F.coalesce(F.max_by("updated_at", at), F.max("updated_at")).alias("updated_at"))


def locator_payload(spans: DataFrame) -> DataFrame:
    """chunk, kind, start, stop: the kind of the earliest span of a chunk, and the range of that kind's spans."""
    firsts = spans.groupBy("chunk").agg(F.min_by("kind", F.struct("char_start", "kind")).alias("kind"))
    return spans.join(firsts, ["chunk", "kind"]).groupBy("chunk", "kind").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


# What the log lines of routine work look like.
FAIL_WORDS = r"\b(error|errors|failed|failure|fail|exception)\b"
OK_MS, TOOL_START = r"\[MCP\] tool=\S+ ok .*?\b(\d+(?:\.\d+)?) ms", r"\[MCP\] tool=\S+ start"


def routine_class(rest: Column, level: Column, marker: Column, status: Column, slow_ms: float = 60_000) -> Column:
    """struct(expected, hint) of a log line: expected lines are routine."""
    low = F.lower(rest)
    is_ = lambda *x: F.coalesce(level.isin(*x), F.lit(False))
    mark = lambda *x: F.coalesce(marker.isin(*x), F.lit(False))
    code = F.coalesce(status, F.lit(0))
    fails, calm = low.rlike(FAIL_WORDS), level.isNull() | is_("INFO")
    says = lambda *parts: F.lit(True) if not parts else rest.contains(parts[0]) & says(*parts[1:])
    ms = F.regexp_extract(rest, OK_MS, 1).try_cast("double")
    result = lambda expected, hint=None: F.struct(F.lit(expected).alias("expected"), F.lit(hint).cast("string").alias("hint"))
    return (
        F.when(is_("ERROR", "CRITICAL") | (code >= 500), result(False))
        .when(low.contains("traceback") | low.contains("exception") | (low.contains("error") & mark("MCP")), result(False))
        .when(is_("WARNING") & says("mcp_knowledge.pipeline", "Очередь переполнена — blocking put") & ~fails, result(True))
        .when((code == 429) & marker.isNull() & ~fails, result(True))
        .when(is_("WARNING") & says("mcp_knowledge.rate_limit", "Rate limit exceeded", "key=anonymous") & ~fails, result(True))
        .when(is_("WARNING"), result(False))
        .when(mark("MCP") & ms.isNotNull() & calm, F.when(ms >= slow_ms, result(False, "slow")).otherwise(result(True)))
        .when(mark("MCP"), F.when(rest.rlike(TOOL_START) & calm, result(True)).otherwise(result(False)))
        .when(mark("REQ") & (code < 400), result(True))
        .when(mark("ERRORS_QUERY") & calm & ~fails, result(True))
        .when(mark("GIN") & (code >= 200) & (code < 400), result(True))
        .otherwise(result(False))
    )


def lifecycle_event(action: Column, exit_code: Column, health: Column) -> Column:
    """struct(level, hint) of a container's event; null for one that is of no interest."""
    result = lambda level, hint=None: F.struct(F.lit(level).alias("level"), F.lit(hint).cast("string").alias("hint"))
    died = F.when(F.coalesce(exit_code, F.lit(-1)) != 0, result("ERROR", "restart")).otherwise(result("INFO"))
    ill = F.when(F.coalesce(health, F.lit("")).contains("unhealthy"), result("ERROR", "health_degraded")).otherwise(result("WARNING"))
    return F.when(action == "oom", result("ERROR", "oom")).when(action == "restart", result("ERROR", "restart")).when(action == "die", died).when(action == "health_status", ill)


def pulled_rows(lines: DataFrame) -> DataFrame:
    """id, kind, message, persons, hint: the rows of pulled JSON documents, a document a line; lines that are
    none, and rows without a message, go. Three persons or more make a row urgent."""
    schema = "struct<kind:string,rows:array<struct<message:string,persons:bigint>>>"
    doc = F.from_json("line", schema)
    rows = lines.select("id", doc["kind"].alias("kind"), F.explode(doc["rows"]).alias("r")).where("r.message is not null")
    return rows.select("id", "kind", "r.message", F.coalesce("r.persons", F.lit(0)).alias("persons"), F.when(F.col("r.persons") >= 3, "P1").alias("hint"))


# Signatures that look like an expected answer, and why.
SUPPRESS_HINTS = {
    "degraded:http_401": "401 = auth-required (ожидаемый ответ консоли)",
    "|LIFECYCLE|docker event: die": "lifecycle Docker (перезапуск/деплой)",
    "|404|": "404 пробы/сканера — ожидаемый ответ",
    "|400|": "400 пробы/сканера — ожидаемый ответ",
}
# The kind of rule for a cause.
RULE_HINTS = {
    "traceback": "pytest-регресс (воспроизвести traceback тестом)",
    "critical": "pytest-регресс / postmortem incidents.md",
    "5xx": "pytest-регресс (HTTP-контракт)",
    "oom": "ansible-гард (mem_limit) / postmortem",
    "restart": "ansible-preflight-гард (health-гейт)",
    "cron_nonzero": "ansible-гард (cron dry-run) / backup --verify",
    "health_degraded": "ansible-preflight-гард (health-гейт)",
    "hang": "pytest-регресс (timeout-контракт tool-вызова)",
    "disk_critical": "ansible-гард (host-пороги df)",
    "burst": "разбор источника шторма (§11.2-чеклист) + проверка стоп-условий",
}
OTHER_RULE = "L2-инсайт (причина вне словаря M5) — разбор вручную"


def suppress_hint(sig: Column, non_routine: Column) -> Column:
    """Why a signature looks like no incident; null once it had an event that is not routine."""
    first = F.lit(None).cast("string")
    for needle, why in reversed(SUPPRESS_HINTS.items()):
        first = F.when(sig.contains(needle), why).otherwise(first)
    return F.when(~F.coalesce(non_routine, F.lit(False)), first)


def rule_hint(sig: Column, example: Column) -> Column:
    """The rule for the first cause that the signature names, or its last example (with spaces for "_")."""
    first, text = F.lit(OTHER_RULE), F.lower(F.coalesce(example, F.lit("")))
    for cause, rule in reversed(RULE_HINTS.items()):
        first = F.when(sig.contains(cause) | text.contains(cause.replace("_", " ")), rule).otherwise(first)
    return first


def error_blocks(lines: DataFrame) -> DataFrame:
    """source, start, lines, message: tracebacks as one event. A block begins with the head line and goes on while
    lines begin with a space or tab; the first that does not belongs to it and ends it, even if it is a head itself.
    lines: source, seq, line.

    A group is a line at the margin with the indented ones behind it. A group opens a block if it begins with a head
    and the group before it is none that is open, so of heads in a row every other one opens."""
    order = Window.partitionBy("source").orderBy("seq")
    margin = ~F.substring("line", 1, 1).isin(" ", "\t")
    rows = lines.withColumn("group", F.sum(margin.cast("long")).over(order))
    groups = rows.groupBy("source", "group").agg(F.min("seq").alias("start"), F.max(margin & F.col("line").startswith("Traceback (")).alias("head"))
    by_group = Window.partitionBy("source").orderBy("group")
    groups = groups.withColumn("run", F.sum((~F.col("head")).cast("long")).over(by_group))
    nth = F.row_number().over(Window.partitionBy("source", "run", "head").orderBy("group"))
    opens = groups.where("head").withColumn("nth", nth).where("nth % 2 = 1").select("source", "start", F.explode(F.array(F.struct("group", F.lit(False).alias("ends")), F.struct((F.col("group") + 1).alias("group"), F.lit(True).alias("ends")))).alias("g"))
    inside = rows.withColumn("margin", margin).join(opens.select("source", "start", "g.group", "g.ends"), ["source", "group"]).where("not ends or margin")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n")
    return inside.groupBy("source", "start").agg(F.count(F.lit(1)).alias("lines"), text.alias("message"))


def priority_view(aggregates: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.orderBy(sc.priority_rank(F.col("priority")), F.desc("count_7d"), "sig"))
    top = aggregates.orderBy(sc.priority_rank(F.col("priority")), F.desc("count_7d"), "sig").limit(100)
    return top.withColumn("rank", rank)


def weekly_metrics(aggregates: DataFrame, now: Column) -> DataFrame:
    """One row: urgent signatures that are active or were seen within 30 days, resolved urgent ones (candidates
    for rules), relapses, and the median hours to the fix (the upper of two)."""
    urgent = F.col("priority").isin("P0", "P1")
    fixed = (F.col("status") == "resolved") & F.col("fixed_at").isNotNull()
    hours = (F.unix_timestamp("fixed_at") - F.unix_timestamp("first_seen")) / 3600
    counts = aggregates.agg(
        F.count_if(urgent & (F.col("status") != "resolved")).alias("active"), F.count_if(urgent & (F.datediff(now, "last_seen") <= 30)).alias("recent"),
        F.count_if(urgent & fixed).alias("rule_candidates"), F.count_if(fixed & (F.col("last_seen") > F.col("fixed_at"))).alias("relapses"), F.count_if(fixed).alias("fixed"),
    )
    ranked = running_sum(aggregates.where(fixed).select("sig", hours.alias("h")), [], F.floor("h"), ["h", "sig"], F.lit(1), "rn")
    median = ranked.join(F.broadcast(counts.select("fixed"))).where(F.col("rn") == F.floor(F.col("fixed") / 2) + 1).select(F.round("h", 1).alias("median_hours"))
    return counts.join(F.broadcast(median), how="left")


def filtered(aggregates: DataFrame, status: str | None = None, sig: str | None = None, text: str | None = None) -> DataFrame:
    """Aggregates of a status, with exactly that signature, or whose signature has a text in any case."""
    rows = aggregates
    if status:
        rows = rows.where(F.col("status") == status)
    if sig:
        rows = rows.where(F.col("sig") == sig)
    if text:
        rows = rows.where(F.lower("sig").contains(text.lower()))
    return rows
