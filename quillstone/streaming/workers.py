"""Streams with timers: retries and dead letters of an index worker, silent sources, the daily digest.

Each equals a batch operator of operators/overtime.py. Timers are in event time: they fire when the watermark
passes them, whether or not their key has another event.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillstone.operators.overtime import COOLDOWN_MIN, DIGEST_HOUR, SILENCE_MIN, TRIES, WAITS, digest_step, digest_ticks
from quillstone.streaming.events import runs


#: Groups of an index worker's keys. A call of a stream's step costs milliseconds, however few its rows are, so keys share one;
#: a stream that goes on from a checkpoint keeps their number.
SHARDS = 1024


def _rows(frames: Iterator[pd.DataFrame], order: list[str]) -> Iterator[tuple]:
    """A group's new rows in order. Only a micro-batch of one group is held, as slim frames."""
    held = [f for f in frames if len(f)]
    if held:
        rows = held[0] if len(held) == 1 else pd.concat(held)
        yield from rows.sort_values(order).itertuples(index=False, name=None)


def index_worker(attempts: DataFrame, late: str = "1 minute", shards: int = SHARDS) -> DataFrame:
    """key, seq, retries, action, due: a dead letter at once, a retry when its wait is over. attempts: key, seq, ts, ok,
    error. State of a shard: of keys that have any, failures in a row, and the retry that is pending."""

    def step(shard: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = {key: (failures, seq, due) for key, failures, seq, due in json.loads(state.get[0])} if state.exists else {}
        out, now = [], state.getCurrentWatermarkMs()
        for _, key, n, at, ok, error, _ in () if state.hasTimedOut else _rows(frames, ["seq"]):
            failures, seq, due = kept.get(key, (0, -1, -1))
            if due >= 0:  # the next attempt is here, so the wait was over
                out.append((key, seq, failures, "retry", due, None))
                due = -1
            failures = 0 if ok else failures + 1
            if not ok and failures < TRIES:
                seq, due = int(n), int(at) + WAITS[failures - 1]
            elif not ok:
                out.append((key, int(n), failures, "dead", None, error))
                failures = 0
            kept[key] = failures, seq, due
        for key, (failures, seq, due) in kept.items():
            if due >= 0 and due * 1000 <= now:
                out.append((key, seq, failures, "retry", due, None))
                kept[key] = failures, seq, -1
        state.update((json.dumps([(key, *x) for key, x in kept.items() if x[0] or x[2] >= 0]),))
        if pending := [due for _, _, due in kept.values() if due >= 0]:
            state.setTimeoutTimestamp(min(pending) * 1000)
        if out:
            yield pd.DataFrame(out, columns=["key", "seq", "retries", "action", "due", "error"]).astype({"due": "Int64"})

    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    slim = attempts.withWatermark("ts", late).select(shard, "key", "seq", F.unix_timestamp("ts").alias("at"), "ok", "error", "ts")
    out = "key string, seq long, retries long, action string, due long, error string"
    return slim.groupBy("shard").applyInPandasWithState(step, out, "kept string", "append", GroupStateTimeout.EventTimeTimeout)


def silent_sources(events: DataFrame, silence: int = SILENCE_MIN, cooldown: int = COOLDOWN_MIN, late: str = "1 minute") -> DataFrame:
    """source, last, at: a synthetic event when a source has been silent for over `silence` minutes, told before its next
    event comes, and again after `cooldown` minutes of silence. State: the last time, and when the next alert may be."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, rest = state.get if state.exists else (-1, -1)
        out, now = [], state.getCurrentWatermarkMs() // 1000

        def silent(until: int) -> None:
            nonlocal rest
            while last >= 0 and (at := max(last + silence * 60 + 1, rest)) <= until:
                out.append((key[0], last, at))
                rest = at + cooldown * 60

        if not state.hasTimedOut:
            for start, end in zip(*runs((f["at"] for f in frames), silence * 60), strict=True):
                silent(int(start))  # inside a run nothing is silent
                last = max(last, int(end))
        silent(now)
        state.update((last, rest))
        state.setTimeoutTimestamp(max(last + silence * 60 + 1, rest) * 1000)
        if out:
            yield pd.DataFrame(out, columns=["source", "last", "at"]).astype({"last": "int64", "at": "int64"})

    slim = events.withWatermark("ts", late).select("source", F.unix_timestamp("ts").alias("at"), "ts")
    return slim.groupBy("source").applyInPandasWithState(step, "source string, last long, at long", "last long, rest long", "append", GroupStateTimeout.EventTimeTimeout)


def first_ticks(ticks: pd.DataFrame) -> pd.DataFrame:
    """Ticks of one host by time, the first two of every second: after a crash the next one counts, and behind that the day is
    done or rests for an hour."""
    ticks = ticks.sort_values(["now", "seq"], ignore_index=True)
    now = ticks["now"].to_numpy()
    return ticks[np.arange(len(now)) - np.searchsorted(now, now) < 2].reset_index(drop=True)


def digests(ticks: DataFrame, zone: str) -> DataFrame:
    """host, seq, day, action: the digest's machine over a stream of ticks; its state outlives a restart."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, attempt, spooled, not_before = state.get if state.exists else (None, None, None, 0)
        held = {k: v for k, v in (("last", last), ("attempt", attempt), ("spooled", spooled), ("not_before", not_before)) if v}
        slim, most = None, 200_000
        for f in frames:
            slim = f.drop(columns="host") if slim is None else pd.concat([slim, f.drop(columns="host")], ignore_index=True)
            if len(slim) > most:
                slim = first_ticks(slim)
                most = max(most, 2 * len(slim))
        slim = first_ticks(slim)
        out, now, at = [], slim["now"].to_numpy(), 0
        turns = np.flatnonzero(slim["day"].ne(slim["day"].shift()))
        while at < len(slim):
            r = slim.iloc[at]
            action = digest_step(held, r["day"], int(r["hour"]), int(r["now"]), r["outcome"], bool(r["flushed"]))
            if action:
                out.append((key[0], int(r["seq"]), r["day"], action))
            at = max(at + 1, int(np.searchsorted(now, held.get("not_before", 0))))  # what rests is passed over, and what is done for the day
            if at < len(slim) and held.get("last") == slim["day"].iat[at]:
                at = int(np.append(turns, len(slim))[np.searchsorted(turns, at, side="right")])
        state.update((held.get("last"), held.get("attempt"), held.get("spooled"), held.get("not_before", 0)))
        if out:
            yield pd.DataFrame(out, columns=["host", "seq", "day", "action"])

    out = "host string, seq long, day string, action string"
    kept = "last string, attempt string, spooled string, not_before long"
    due = digest_ticks(ticks, zone).where(F.col("hour") >= DIGEST_HOUR)  # earlier ones do nothing
    return due.groupBy("host").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout)


def deliver(actions: DataFrame, folder: str, send) -> None:
    """Sends what the machine says, once: the attempt is written to the shared folder before `send` is called, and a batch
    that runs again finds it and counts it as delivered. `actions` is a stream of digests(); a day and host
    make one row, so a batch's due rows are few."""
    spark = actions.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/attempts/batch={number}")
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(place):
            rows.write.format("noop").mode("overwrite").save()  # the state goes on all the same
            return
        due = rows.where("action in ('sent', 'flushed')").select("host", "day").distinct().persist()
        due.write.mode("errorifexists").parquet(f"{folder}/attempts/batch={number}")
        for r in due.collect():
            send(r["host"], r["day"])
        due.unpersist()

    actions.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
