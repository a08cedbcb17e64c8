"""What the operators share: scratch tables, the word rule, two-level prefix sums."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of code points other than the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's setting by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a local-mode session may lack the setting (tests); it then gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="quillstone-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Tables written to the shared folder, so that lost executors cost no recomputation from the start."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/quillstone-{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def cut(self, df: DataFrame, name: str = "t", partition_by: list[str] | None = None, most: int = 0) -> DataFrame:
        """Write df and read it back: the lineage ends here. most: rows of a file, if they are bounded."""
        self._n += 1
        path = self.path(f"{name}-{self._n}")
        writer = df.write.option("compression", "zstd").option("maxRecordsPerFile", most)
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")  # the table is read from now on, not what it was made of
        try:
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before) if before else self.spark.conf.unset(CLEANUP)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this object that no later result reads."""
        for t in tables:
            self.remove(t._scratch_path)

    def remove(self, path: str) -> None:
        """Delete a folder of this object's, as one partition of a table."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def is_there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def words_column(text: Column) -> Column:
    """How many words a text has; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column's values as UTF-8; null becomes empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batches, rows: int = 512):
    """Arrow batches in pieces of so many rows, so that what is made of one at a time stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def lower_ascii(text: bytes) -> bytes:
    """Lower-case A to Z only: bytes.lower leaves all other bytes."""
    return text.lower()


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(scratch: Scratch, df: DataFrame, order: list[str], sums: dict[str, str], lasts: dict[str, str] | None = None) -> DataFrame:
    """Exclusive running sums over a global order, without sorting everything in one task.

    Rows are dealt out by ranges of the order. A first pass sums each part; the few part sums
    (one row a part) are accumulated; a second pass adds them to the running sums inside a part.
    sums: new column -> summed column. lasts: new column -> column whose last non-null value
    before the row is wanted.
    """
    lasts = lasts or {}
    parts = scratch.cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    keys = [F.col(c) for c in order]
    totals = parts.groupBy("_part").agg(
        *(F.sum(v).alias(f"_t_{k}") for k, v in sums.items()),
        *(F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*keys))).alias(f"_t_{k}") for k, v in lasts.items()),
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "_part",
        *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums),
        *(F.last(f"_t_{k}", ignorenulls=True).over(before).alias(f"_b_{k}") for k in lasts),
    )
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(F.broadcast(totals), "_part")
    return out.select(
        *df.columns,
        *((F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"_b_{k}")).cast("long").alias(k) for k, v in sums.items()),
        *(F.coalesce(F.last(v, ignorenulls=True).over(inside), F.col(f"_b_{k}")).alias(k) for k, v in lasts.items()),
    )
