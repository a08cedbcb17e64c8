"""Streams over error events, each a batch operator's twin on micro-batches.

State lives in RocksDB; results are written by batch id, so a repeated batch overwrites itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillstone.operators.events import BURST_COOLDOWN, BURST_COUNT, BURST_FACTOR, BURST_HISTORY, MINUTE_CAP
from quillstone.sources.shared import scratch_folder

_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def read_events(spark: SparkSession, sf_dir: str, files_per_batch: int = 64) -> DataFrame:
    """The events table, a folder of files or one file, as a stream; times are taken as UTC timestamps."""
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        stream = stream.parquet(path)
    else:  # a stream reads folders, so a single file is named by a filter
        stream = stream.option("pathGlobFilter", place.getName()).parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """Runs a stream over what is there and returns everything it has written, with its batch."""
    spark = stream.sparkSession
    folder = folder or scratch_folder(spark, "stream")
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        q.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/out/batch={i}")).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = stream.schema.add("batch", "long")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):  # nothing has come yet
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/out")


def daily(events: DataFrame) -> DataFrame:
    """Counts per type and day, updated batch by batch."""
    return events.groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def hourly_windows(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts per type and hour, closed by a watermark: later events no longer count."""
    w = events.withWatermark("ts", late).groupBy("event_type", F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("event_type", F.col("window.start").alias("start"), "n")


def deduplicated(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """Re-read overlaps dropped: an event id counts once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def guard(events: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """The storm guard as a stateful operator: per signature the open minute, how many passed in it, and
    what was suppressed since the last that passed. Immune events (column `immune`) pass and count nothing. With keep_ms (a week, say, in a stream that runs for
    good) the state of a signature goes after so long a silence; a run to the end has no timeouts."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        told = lambda seq, allowed, carried=0: pd.DataFrame({"seq": seq, "sig": key[0], "allowed": allowed, "carried": carried})
        minutes, seqs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        refused: dict[int, int] = {}  # by minute; of a minute only its first rows are held, the others are told at once
        for f in frames:
            free = f["immune"].to_numpy(bool)
            if free.any():
                yield told(f["seq"].to_numpy()[free], True)
            minutes, seqs = np.append(minutes, f["minute"].to_numpy()[~free]), np.append(seqs, f["seq"].to_numpy()[~free])
            order = np.lexsort((seqs, minutes))
            minutes, seqs = minutes[order], seqs[order]
            over = np.arange(len(minutes)) - np.searchsorted(minutes, minutes) >= MINUTE_CAP
            if over.any():
                for m, n in zip(*np.unique(minutes[over], return_counts=True), strict=True):
                    refused[int(m)] = refused.get(int(m), 0) + int(n)
                yield told(seqs[over], False)
                minutes, seqs = minutes[~over], seqs[~over]
        minute, passed, pending = state.get if state.exists else (-1, 0, 0)
        allowed, carried = np.zeros(len(seqs), bool), np.zeros(len(seqs), np.int64)
        starts = np.flatnonzero(np.diff(minutes, prepend=minutes[:1] - 1))
        for start, end in zip(starts, [*starts[1:], len(minutes)], strict=True):
            if minutes[start] != minute:
                minute, passed = int(minutes[start]), 0
            room = min(MINUTE_CAP - passed, int(end - start))
            if room > 0:
                allowed[start : start + room], carried[start], pending = True, pending, 0
            passed, pending = passed + max(room, 0), pending + int(end - start) - max(room, 0) + refused.get(minute, 0)
        state.update((minute, passed, pending))
        if keep_ms:
            state.setTimeoutDuration(keep_ms)
        yield told(seqs, allowed, carried)

    return events.groupBy("sig").applyInPandasWithState(step, "seq long, sig string, allowed boolean, carried long", "minute long, passed long, pending long", "append", GroupStateTimeout.ProcessingTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout)


def runs(times: Iterable[pd.Series], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last times of the runs whose neighbours lie no more than `gap` apart. Times come in any order and in
    pieces; runs are held, times are not."""
    starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for piece in times:
        piece = np.sort(piece.to_numpy(np.int64))
        starts, ends = np.append(starts, piece), np.append(ends, piece)
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], np.maximum.accumulate(ends[order])
        opens = np.flatnonzero(np.append(True, starts[1:] - ends[:-1] > gap)[: len(starts)])
        starts, ends = starts[opens], ends[np.append(opens[1:], len(ends)) - 1]
    return starts, ends


def silences(events: DataFrame, minutes: int = 30) -> DataFrame:
    """Gaps of more than so many minutes between two events of a source; what is kept is a source's last time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        starts, ends = runs((f["at"] for f in frames), minutes * 60)
        before = ends[:-1] if last is None else [last, *ends[:-1]]
        after = starts[1:] if last is None else starts
        rows = pd.DataFrame({"source": key[0], "before": before, "after": after}).astype({"before": "int64", "after": "int64"})
        state.update((int(ends[-1]) if last is None else max(last, int(ends[-1])),))
        yield rows[rows["after"] - rows["before"] > minutes * 60]

    return events.groupBy("source").applyInPandasWithState(step, "source string, before long, after long", "last long", "append", GroupStateTimeout.NoTimeout)


def bursts(events: DataFrame) -> DataFrame:
    """The burst machine on a stream of (sig, cycle): a signature's cycle is judged when a later one begins. Kept
    are the open cycle with its count, the counts of the last active cycles, and the machine's state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        cycle, count, state, since, history = held.get if held.exists else (-1, 0, "armed", -1, "")
        past, out = [int(x) for x in history.split(",") if x], []
        counts = pd.Series(dtype="int64")
        for f in frames:  # a number a cycle is held
            counts = counts.add(f["cycle"].value_counts(), fill_value=0)
        counts = counts.sort_index()
        for c, n in counts.items():
            if c <= cycle:  # the open cycle goes on; what is late counts to it
                count += int(n)
                continue
            if cycle >= 0:
                mean = sum(past) / len(past) if past else 0.0
                hit = count >= BURST_COUNT or (mean >= 1 and count >= BURST_FACTOR * mean)
                quiet = state in ("fired", "held")
                fires = not quiet and hit and (since < 0 or since >= BURST_COOLDOWN)
                state = ("held" if hit else "re-armed") if quiet else "fired" if fires else "held" if hit else state
                since = 0 if fires else since + (since >= 0)
                out.append((key[0], cycle, count, state))
                past = [*past, count][-BURST_HISTORY:]
            cycle, count = int(c), int(n)
        held.update((cycle, count, state, since, ",".join(map(str, past))))
        yield pd.DataFrame(out, columns=["sig", "cycle", "n", "state"])

    kept = "cycle long, count long, state string, since long, history string"
    return events.groupBy("sig").applyInPandasWithState(step, "sig string, cycle long, n long, state string", kept, "append", GroupStateTimeout.NoTimeout)


def raw_sink(events: DataFrame, folder: str) -> DataFrame:
    """Appends events to a table by day, a folder a batch and day, so that a repeated batch overwrites itself;
    returns what is there."""
    spark = events.sparkSession
    rows = events.withColumn("day", F.to_date("ts"))
    write = lambda b, i: b.write.mode("overwrite").partitionBy("day").json(f"{folder}/raw/batch={i}")
    rows.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(rows.schema.add("batch", "long")).json(f"{folder}/raw")
