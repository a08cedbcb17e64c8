"""Table maintenance: copy-on-write changes as plans, and versioned tables with a pointer swap."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new` replace those with the same key."""
    return table.join(new.select(key), key, "left_anti").unionByName(new)


def delete_where(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti").select(*table.columns)


def set_columns(table: DataFrame, predicate: Column, values: dict[str, Column]) -> DataFrame:
    """New values where the predicate holds; None clears."""
    hit = F.coalesce(predicate, F.lit(False))
    return table.withColumns({c: F.when(hit, F.lit(None) if v is None else v).otherwise(F.col(c)) for c, v in values.items()})


def update_versions(table: DataFrame, updates: DataFrame) -> DataFrame:
    """updates: kid, expected, content -> kid, version, outcome. An expected version that is not the
    stored one is a conflict and changes nothing; without one the update always applies."""
    both = updates.join(table.select("kid", "version"), "kid", "left")
    fits = F.col("expected").isNull() | (F.col("expected") == F.col("version"))
    outcome = F.when(F.col("version").isNull(), "not_found").when(fits, "updated").otherwise("conflict")
    return both.select("kid", outcome.alias("outcome"), F.when(outcome == "updated", F.col("version") + 1).otherwise(F.col("version")).alias("version"))


def delete_cascade(table: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays, and the tombstones: the entries and the children of those that are roots."""
    gone = roots.select("kid").distinct()
    children = table.select("kid", F.col("parent")).join(gone.withColumnRenamed("kid", "parent"), "parent", "left_semi").select("kid")
    all_gone = table.select("kid").join(gone, "kid", "left_semi").union(children).distinct()
    return table.join(all_gone, "kid", "left_anti"), all_gone


def set_status(table: DataFrame, wanted: DataFrame, status: str) -> DataFrame:
    """kid, outcome of a bulk status change: changed, already, failed."""
    both = wanted.join(table.select("kid", F.coalesce("status", F.lit("published")).alias("now")), "kid", "left")
    return both.select("kid", F.when(F.col("now").isNull(), "failed").when(F.col("now") == status, "already").otherwise("changed").alias("outcome"))


def transition(table: DataFrame, kid: str, status: str) -> DataFrame:
    """A lifecycle change; that of a collection root takes its sections along."""
    return set_columns(table, (F.col("kid") == kid) | (F.col("parent") == kid), {"status": F.lit(status)})


def set_zone(table: DataFrame, kid: str, zone: str) -> DataFrame:
    """An entry with its sections moves to a zone."""
    return set_columns(table, (F.col("kid") == kid) | (F.col("parent") == kid), {"zone": F.lit(zone)})


def deprecation_plan(pairs: DataFrame, shield: DataFrame, fp_free: bool, cap: int = 100) -> DataFrame:
    """What bulk deprecation would do: hash-equal green pairs only, nothing if there were false positives,
    not what a restore shields, and at most `cap` in order."""
    rows = pairs.where("flow = 'green'").where(F.lit(fp_free))
    drop = F.when(F.col("keep") == F.col("kid_a"), F.col("kid_b")).otherwise(F.col("kid_a"))
    return rows.select(drop.alias("kid")).distinct().join(shield.select("kid"), "kid", "left_anti").orderBy("kid").limit(cap)


class VersionedTable:
    """A Parquet table as versions below one folder; a pointer row names the current one.

    A new version is written beside the old one, and readers move over with the pointer. The pointer is
    itself a table of one row per swap, so that swapping is an append.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _pointers(self) -> DataFrame:
        return self.spark.read.schema("nth long, version string").parquet(f"{self.folder}/pointer")

    def current(self) -> tuple[int, str | None]:
        if not self._exists(f"{self.folder}/pointer"):
            return 0, None
        row = self._pointers().orderBy(F.desc("nth")).first()
        return (row["nth"], row["version"]) if row else (0, None)

    def build(self, df: DataFrame, partition_by: list[str] | None = None) -> str:
        version = f"v-{uuid.uuid4().hex}"
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.folder}/{version}")
        return version

    def verify(self, version: str, rows: int) -> bool:
        return self.spark.read.parquet(f"{self.folder}/{version}").count() == rows

    def swap(self, version: str) -> None:
        nth, _ = self.current()
        self.spark.createDataFrame([(nth + 1, version)], "nth long, version string").coalesce(1).write.mode("append").parquet(f"{self.folder}/pointer")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.current()[1]}")

    def drop_others(self) -> None:
        """Deletes all versions but the current one."""
        keep = self.current()[1]
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for s in fs.listStatus(root):
            if s.getPath().getName().startswith("v-") and s.getPath().getName() != keep:
                fs.delete(s.getPath(), True)
