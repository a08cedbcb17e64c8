"""Rules whose answer depends on what was answered before: quotas with refusals, retries and dead letters,
silences with a cooldown, alerts under a shared hourly cap, one digest a day.

Each is a batch operator; streaming/workers.py has the same rules as streams. What is sequential by nature is cut
down first: a quota is decided by a few searches, alerts walk a few rows a run, silences only gaps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.running import running_sum
from quillstone.sources.shared import scratch_folder

# Waits before the tries after the first and second failure (a third is the last), and the number
# of dead letters above which there is an alert.
WAITS, TRIES, DEAD_ALERT = (1, 4), 3, 10
# Minutes without an event that count as silence, minutes between two alerts about one source.
SILENCE_MIN, COOLDOWN_MIN = 30, 120
# An incident is news for ten minutes; two alerts a run, three messages an hour.
NEWS_MIN, PER_RUN, PER_HOUR = 10, 2, 3
# The hour a digest is due, minutes until another try.
DIGEST_HOUR, RETRY_MIN = 10, 60


# ---- quotas


def within_quota(rows: DataFrame, left: int, seq: str = "seq", size: str = "size", step: int = 10_000) -> DataFrame:
    """rows with `stored`: in order, a row is stored if it fits into what is left of the quota, and a refused row
    takes nothing.

    While 2^k <= left < 2^(k+1), rows up to 2^k are stored and larger ones at most once, as that brings what is
    left below 2^k. So the row that ends such a phase is the first for which a running sum of small rows says so,
    and as each phase halves what is left there are at most 63: each is a search over the rows behind the last,
    with sums in two levels, and no task folds over all rows. Ties of `seq` aren't allowed; negative sizes count 0.
    """
    spark = rows.sparkSession
    path = scratch_folder(spark, "quota")
    at, n = F.col(seq), F.greatest(F.col(size), F.lit(0))
    rows.select(at.cast("long").alias("s"), n.cast("long").alias("n")).write.parquet(path)
    slim, stored, last = spark.read.schema("s long, n long").parquet(path), F.lit(False), None
    while True:
        rest = slim if last is None else slim.where(F.col("s") > last)
        behind = F.lit(True) if last is None else at > last
        if left <= 0:
            return rows.withColumn("stored", stored | behind & (n == 0))
        small = 1 << left.bit_length() - 1
        fits = rest.where(F.col("n") <= left)
        sums = running_sum(fits, [], F.floor(F.col("s") / step), ["s"], F.when(F.col("n") <= small, F.col("n")).otherwise(0), "sum")
        ends = F.when(F.col("n") <= small, left - F.col("sum") < small).otherwise(F.col("n") <= left - F.col("sum"))
        found = sums.where(ends).orderBy("s").limit(1).collect()
        if not found:
            return rows.withColumn("stored", stored | behind & (n <= small))
        end = found[0]
        stored = stored | behind & ((at < end["s"]) & (n <= small) | (at == end["s"]))
        left -= end["sum"] + (end["n"] if end["n"] > small else 0)
        last = end["s"]


def put_blobs(puts: DataFrame, stored: DataFrame, quota: int) -> DataFrame:
    """puts (seq, sha, size) with their outcome. A hash that is stored already is "known"; another is stored if the
    sum of what is stored stays within the quota, else refused, and a refusal adds nothing. As the sum never falls,
    a refused hash is refused again."""
    used = int(stored.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    fresh = puts.join(stored.select("sha").distinct(), "sha", "left_anti")
    firsts = fresh.groupBy("sha").agg(F.min_by("size", "seq").alias("size"), F.min("seq").alias("seq"))
    decided = within_quota(firsts, quota - used).select("sha", F.col("seq").alias("first"), F.col("stored").alias("fits"))
    rows = puts.join(decided, "sha", "left")
    outcome = F.when(F.col("first").isNull(), "known").when(~F.col("fits"), "refused").when(F.col("seq") == F.col("first"), "stored").otherwise("known")
    return rows.select("seq", "sha", outcome.alias("outcome"))


# ---- retries and dead letters


def retry_log(attempts: DataFrame) -> DataFrame:
    """key, seq, retries, action, due of every failed attempt (key, seq, at, ok, error): a first and second failure in a
    row wait one and four seconds, a third is dead and its key starts anew. `error` stays with it."""
    order = Window.partitionBy("key").orderBy("seq")
    rows = attempts.withColumn("_run", F.sum(F.col("ok").cast("long")).over(order)).where(~F.col("ok"))
    nth = (F.row_number().over(Window.partitionBy("key", "_run").orderBy("seq")) - 1) % TRIES + 1
    wait = F.when(F.col("retries") == 1, WAITS[0]).when(F.col("retries") == 2, WAITS[1])
    rows = rows.withColumn("retries", nth.cast("long"))
    action = F.when(F.col("retries") < TRIES, "retry").otherwise("dead")
    return rows.select("key", "seq", "retries", action.alias("action"), (F.col("at") + wait).alias("due"), "error")


def dead_letters(log: DataFrame) -> DataFrame:
    """key, seq, retries, error: a dead key's last entry."""
    dead = log.where("action = 'dead'").groupBy("key").agg(F.max_by(F.struct("seq", "retries", "error"), "seq").alias("x"))
    return dead.select("key", "x.*")


def dead_alert(dead: DataFrame, above: int = DEAD_ALERT) -> DataFrame:
    """size, alert: one row; the text of an alert only where there are too many."""
    n = F.count(F.lit(1))
    text = F.concat(F.lit("DLQ size "), n.cast("string"), F.lit(f" > threshold {above}"))
    return dead.agg(n.alias("size"), F.when(n > above, text).alias("alert"))


def replayed(dead: DataFrame, entries: DataFrame) -> DataFrame:
    """key, replayed: dead letters whose entry is still there are indexed again, with no failures; the others stay."""
    known = entries.select("key", F.lit(True).alias("known")).distinct()
    return dead.select("key").join(known, "key", "left").select("key", F.coalesce("known", F.lit(False)).alias("replayed"))


# ---- silences


def silence_alerts(events: DataFrame, until: int, silence: int = SILENCE_MIN, cooldown: int = COOLDOWN_MIN) -> DataFrame:
    """source, last, at: alerts (seconds) about sources whose last event is over `silence` minutes ago, at most one in
    `cooldown` minutes, up to the moment `until`. events: source, at.

    Only gaps are walked, and only they are few: all other events go by a lag."""
    order = Window.partitionBy("source").orderBy("at")
    gaps = events.select("source", F.col("at").alias("last"), F.coalesce(F.lead("at").over(order), F.lit(until)).alias("next"))
    gaps = gaps.where(F.col("next") - F.col("last") > silence * 60)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rest = None, None
        for frame in frames:
            out = []
            for source, last, following in frame.itertuples(index=False, name=None):
                if source != key:
                    key, rest = source, None
                at = last + silence * 60 + 1 if rest is None else max(last + silence * 60 + 1, rest)
                while at <= following:
                    out.append((source, last, at))
                    rest = at = at + cooldown * 60
            yield pd.DataFrame(out, columns=["source", "last", "at"])

    return gaps.repartition("source").sortWithinPartitions("source", "last").mapInPandas(run, "source string, last long, at long")


# ---- alerts


@dataclass
class AlertState:
    """What was sent: hour and number of messages in it; per signature when about a P0 or burst, and until when it rests."""

    hour: int = -1
    in_hour: int = 0
    p0: dict = field(default_factory=dict)
    burst: dict = field(default_factory=dict)
    rests: dict = field(default_factory=dict)

    def run(self, now: int, rows: list[tuple]) -> list[tuple]:
        """rows: (sig, ts of a new P0 or None, ts of a burst or None), the best of a run. Sends: (sig, kind), and
        (None, 'tail') if others are left and a message may still go out."""
        found = []
        for sig, new, burst in rows:
            if self.rests.get(sig, 0) > now:
                continue
            if new is not None and sig not in self.p0:
                found.append((0, -new, sig))
            elif burst is not None and burst > self.burst.get(sig, -1):
                found.append((1, -burst, sig))
        found.sort()
        if now // 3600 != self.hour:
            self.hour, self.in_hour = now // 3600, 0
        room, sent = PER_HOUR - self.in_hour, []
        for kind, _, sig in found[:PER_RUN]:
            if len(sent) >= room:
                break
            sent.append((sig, "burst" if kind else "new_p0"))
            (self.burst if kind else self.p0)[sig] = now
            self.rests[sig] = now + COOLDOWN_MIN * 60
        if len(found) > len(sent) and len(sent) < room:
            sent.append((None, "tail"))
        self.in_hour += len(sent)
        return sent


def alert_candidates_by_run(incidents: DataFrame, every: int = 300, news: int = NEWS_MIN * 60) -> DataFrame:
    """run, sig, new, burst: what is news at each run (every so many seconds): the latest time of a signature's new P0
    and of its burst. incidents: sig, kind (new_p0 or burst), ts (seconds)."""
    first, last = F.ceil(F.col("ts") / every) * every, F.floor((F.col("ts") + news) / every) * every
    rows = incidents.withColumn("run", F.explode(F.sequence(first, last, F.lit(every))))
    at = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("ts")))
    return rows.groupBy("run", "sig").agg(at("new_p0").alias("new"), at("burst").alias("burst"))


def sent_alerts(incidents: DataFrame, every: int = 300) -> DataFrame:
    """run, sig, kind of the messages that go out: new P0 before bursts, newest first, two a run and three an hour with
    the tail, a signature once in two hours and as a new P0 once in all.

    Two levels. Spark finds the news of every run and keeps the best of each kind: as only signatures sent before
    are passed over, and in two hours no more than six of them are, with the P0s of a news span, a run needs no
    more than KEEP a kind. The second level walks the runs, some rows each, whatever the number of incidents."""
    keep = PER_RUN + 1 + PER_HOUR * (COOLDOWN_MIN // 60 + 2)
    rows = alert_candidates_by_run(incidents, every)
    rank = lambda c: F.row_number().over(Window.partitionBy("run").orderBy(F.desc_nulls_last(c), "sig"))
    best = rows.withColumns({"a": rank("new"), "b": rank("burst")}).where(f"new is not null and a <= {keep} or burst is not null and b <= {keep}")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, run, held, out = AlertState(), None, [], []
        for frame in frames:
            for at, sig, new, burst in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None):
                if at != run and held:
                    out += [(run, s, kind) for s, kind in state.run(run, held)]
                    held = []
                run = int(at)
                held.append((sig, None if new is None else int(new), None if burst is None else int(burst)))
            yield pd.DataFrame(out, columns=["run", "sig", "kind"])
            out = []
        if held:
            yield pd.DataFrame([(run, s, kind) for s, kind in state.run(run, held)], columns=["run", "sig", "kind"])

    slim = best.select("run", "sig", "new", "burst")
    return slim.repartition(1).sortWithinPartitions("run", "sig").mapInPandas(walk, "run long, sig string, kind string")


# ---- digests


def digest_step(state: dict, day: str, hour: int, now: int, outcome: str, flushed: bool) -> str | None:
    """One tick of the digest's machine: changes the state, tells what is done. `outcome` is what sending would come to: sent,
    spooled (kept for later), or crash. A day's attempt is noted before it is sent, so after a crash it counts as
    delivered and nothing goes out twice."""
    if hour < DIGEST_HOUR or state.get("last") == day or state.get("not_before", 0) > now:
        return None
    if state.get("attempt") != day:
        state["attempt"] = day
        state.pop("spooled", None)
        if outcome == "crash":
            return "crash"
        if outcome == "spooled":
            state |= {"spooled": day, "not_before": now + RETRY_MIN * 60}
            return "spooled"
        done = "sent"
    elif state.get("spooled") == day:
        if not flushed:
            state["not_before"] = now + RETRY_MIN * 60
            return "waits"
        done = "flushed"
    else:
        done = "assumed"
    state["last"] = day
    state.pop("not_before", None)
    return done


def digest_ticks(ticks: DataFrame, zone: str) -> DataFrame:
    """host, seq, day, hour, now, outcome, flushed: ticks (host, seq, ts, outcome, flushed) on the local clock."""
    local = F.from_utc_timestamp("ts", zone)
    return ticks.select("host", "seq", F.date_format(local, "yyyy-MM-dd").alias("day"), F.hour(local).alias("hour"), F.unix_timestamp("ts").alias("now"), "outcome", "flushed")


def digest_actions(ticks: DataFrame, zone: str) -> DataFrame:
    """host, seq, day, action of the ticks that do something, in the order of time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, {}
        for frame in frames:
            out = []
            for host, seq, day, hour, now, outcome, flushed in frame.itertuples(index=False, name=None):
                if host != key:
                    key, state = host, {}
                action = digest_step(state, day, hour, now, outcome, flushed)
                if action:
                    out.append((host, seq, day, action))
            yield pd.DataFrame(out, columns=["host", "seq", "day", "action"])

    due = digest_ticks(ticks, zone).where(F.col("hour") >= DIGEST_HOUR)
    return due.repartition("host").sortWithinPartitions("host", "now", "seq").mapInPandas(run, "host string, seq long, day string, action string")
