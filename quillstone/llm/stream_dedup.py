"""Exact dedup as a stateful stream.

The stream groups rows by a digest of their text. Its keyed state lives on disk (RocksDB) and never
expires: per digest it holds the number of rows, the stable identifier of the row that stays (the
largest doc_id) and a content locator, the file and row where that row's bytes are. Spark
pre-aggregates every micro-batch before the state is touched, so a text with a third of all rows
costs its key one update per task.

A digest hit is not yet a proof. Rows of every digest seen twice are checked byte by byte against
the text behind the locator; digests for which any row differs are grouped again by their whole
texts. So the result is right for a digest of any width (tests use 8 bits).

Recovery: the state and the offsets are in the checkpoint folder. A second run over the same
folder goes on where the first ended.

Defined results: null text counts as empty; doc_id null orders below all others; of rows with the
same doc_id and text the one at the last locator stays; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings of the stream: state on disk, and no preallocated files (one store per shuffle partition).
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}

#: The digests seen twice are broadcast, as 64-bit hashes, if so many at most; else they are joined.
BROADCAST_ROWS = 1_000_000


#: Micro-batches of a run over a whole table.
BATCHES = 4


def _located(rows: DataFrame, digest_bits: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    sha = F.sha2(text.cast("binary"), 256)
    where = F.struct(F.col("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.select(where.alias("at"), text.alias("text"), sha.alias("text_sha256"), F.substring(sha, 1, digest_bits // 4).alias("digest"))


def read_stream(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """A stream over a Parquet table, be it a folder of files or one file."""
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(max_bytes))
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())


def batch_bytes(spark: SparkSession, path: str) -> int:
    """So many bytes that the table comes in BATCHES micro-batches, if its files allow it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    return max(1, -(-size // BATCHES))


def run_stream(spark: SparkSession, path: str, folder: str, digest_bits: int = 256, max_bytes: int | None = None) -> DataFrame:
    """Bring the state in `folder` up to date with the table; returns digest, n, keeper."""
    rows = _located(read_stream(spark, path, max_bytes or batch_bytes(spark, path)), digest_bits)
    return keep_state(rows.select("digest", "at"), folder)


def stream_of(located: DataFrame, batches: int) -> DataFrame:
    """A written table of digests and locators as a stream in so many micro-batches, fewer only if it has fewer files."""
    files = max(1, -(-len(located.inputFiles()) // batches))
    return located.sparkSession.readStream.schema(located.schema).option("maxFilesPerTrigger", files).parquet(located._scratch_path).select("digest", "at")


def keep_state(rows: DataFrame, folder: str) -> DataFrame:
    """Runs a stream of (digest, at) through the keyed state.

    Every micro-batch appends the changed keys to a table; the last line of a key is its state.
    """
    spark = rows.sparkSession
    state = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("keeper"))
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/state")
            .foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i).cast("long")).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/changes/batch={i}"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = state.withColumn("batch", F.lit(0).cast("long")).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/changes")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema).drop("batch")
    changes = spark.read.schema(schema).parquet(f"{folder}/changes")
    return changes.groupBy("digest").agg(F.max_by(F.struct("n", "keeper"), "batch").alias("s")).select("digest", "s.n", "s.keeper")


def _by_class(rows: DataFrame, *keys: str) -> DataFrame:
    classes = rows.groupBy(*keys).agg(F.max("at").alias("keeper"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(classes, list(keys))


def dedup(spark: SparkSession, path: str, digest_bits: int = 256, max_bytes: int | None = None, folder: str | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and the locator `at`.

    Digests and locators are written once, in files of a quarter of the rows at most, and streamed from there, so that
    also a table of one file comes in several micro-batches. With `folder`, a state that goes on, or
    `max_bytes`, the table itself is the stream."""
    scratch = Scratch(spark, "stream-dedup")
    table = spark.read.parquet(path)
    rows = _located(table, digest_bits)
    most = max(1, -(-table.count() // BATCHES))
    light = scratch.cut(rows.select("at", "digest", "text_sha256"), "rows", most=most)
    if folder or max_bytes:
        state = run_stream(spark, path, folder or scratch.path("stream"), digest_bits, max_bytes)
    else:
        state = keep_state(stream_of(light, BATCHES), scratch.path("stream"))
    state = scratch.cut(state, "state")
    hits = scratch.cut(state.where("n > 1").select("digest", "keeper"), "hits")
    # full bytes: each row of a digest with hits against the text at the keeper's locator. A filter
    # by hash keeps the other texts out of the shuffle.
    rough = rows
    if hits.count() <= BROADCAST_ROWS:
        marks = hits.select(F.xxhash64("digest").alias("mark")).distinct()
        rough = rows.withColumn("mark", F.xxhash64("digest")).join(F.broadcast(marks), "mark", "left_semi").drop("mark")
    copies = rough.join(hits, "digest").select("digest", "at", "text", "keeper")
    originals = copies.where("at <=> keeper").select("digest", F.col("text").alias("kept_text"))
    # written before duplicates of it go, so that the join of a digest with very many rows can be split
    differing = scratch.cut(copies.join(originals, "digest").where("text <> kept_text").select("digest"), "differing")
    known = light.join(state, "digest")
    if differing.isEmpty():
        return _result(known.select("at", "text_sha256", "keeper", F.col("n").alias("group_size")))
    collided = scratch.cut(differing.distinct(), "collided")
    good = known.join(collided, "digest", "left_anti").select("at", "text_sha256", "keeper", F.col("n").alias("group_size"))
    again = rows.join(collided, "digest", "left_semi")
    exact = _by_class(again, "digest", "text").select("at", "text_sha256", "keeper", "group_size")
    return _result(good.unionByName(exact))


def _result(rows: DataFrame) -> DataFrame:
    same: Column = F.col("at").eqNullSafe(F.col("keeper"))
    return rows.select(F.col("at.doc_id").alias("doc_id"), F.col("keeper.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), same.alias("kept"), "text_sha256", "at")
