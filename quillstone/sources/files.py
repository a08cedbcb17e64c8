"""Files in and out: Markdown with YAML front matter, JSON lines, log lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.text import marker, strip

FRONT = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$"
_META = "knowledge_id string, domain string, subject string, project string, tags array<string>, status string, zone string, version int, updated_at string, parent_knowledge_id string, keys array<string>, broken boolean"


def _parse_front(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    import yaml

    names, loader = [x.strip().split(" ")[0] for x in _META.split(", ")], getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    for texts in batches:
        rows = []
        for text in texts:
            broken = False
            try:
                meta = yaml.load(text or "", Loader=loader)
            except yaml.YAMLError:
                meta, broken = None, True
            mapping = isinstance(meta, dict)
            meta = meta if mapping else {}
            row = {k: None if meta.get(k) is None else str(meta[k]) for k in names}
            row["tags"] = [str(x) for x in meta["tags"]] if isinstance(meta.get("tags"), list) else None
            row["version"] = int(meta["version"]) if str(meta.get("version", "")).isdigit() else None
            row["keys"] = sorted(map(str, meta)) if mapping else None
            row["broken"] = broken
            rows.append(row)
        yield pd.DataFrame(rows, columns=names)


def front_matter():
    """A pandas UDF: YAML front matter -> known fields, the keys that are there, and whether it is no YAML."""
    return F.pandas_udf(_parse_front, _META)


def read_markdown(spark: SparkSession, folder: str, skip_underscore: bool = True) -> DataFrame:
    """path, meta, body, error of all *.md below a folder, without .trash; `_*` names are skipped on demand.

    error: empty, no_delimiter, unclosed, not_a_mapping, or null.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    files = files.where(~F.col("path").contains("/.trash/"))
    if skip_underscore:
        files = files.where(~F.element_at(F.split("path", "/"), -1).startswith("_"))
    rows = parsed_markdown(files.select("path", F.decode("content", "UTF-8").alias("text")))
    return rows.select("path", "meta", "body", "error")


def parsed_markdown(rows: DataFrame) -> DataFrame:
    """rows with meta, body and error of their `text`, as read_markdown has them."""
    rows = rows.withColumns({"front": F.regexp_extract("text", FRONT, 1), "body": strip(F.regexp_extract("text", FRONT, 2)), "has": F.col("text").rlike(FRONT)})
    rows = rows.withColumn("meta", front_matter()(F.when(F.col("has"), F.col("front"))))
    error = (
        F.when(strip(F.col("text")) == "", "empty").when(~F.col("text").startswith("---"), "no_delimiter").when(~F.col("has"), "unclosed").when(F.col("meta.keys").isNull(), "not_a_mapping")
    )
    return rows.withColumn("error", error).drop("front", "has")


def write_markdown(entries: DataFrame, folder: str) -> None:
    """One text per entry, absent fields left out, as read_markdown reads it. Spark's text writer has a file for
    each partition value, so every entry is a folder named by its id with one file."""
    named = {"kid": "knowledge_id"}
    line = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{named.get(c, c)}: "), F.to_json(F.struct(F.col(c).alias("v")))))
    clean = lambda c: F.regexp_replace(line(c), r'\{"v":(.*)\}$', "$1")
    head = F.concat_ws("\n", F.lit("---"), *[clean(c) for c in ("kid", "domain", "subject", "project", "status", "version")], F.lit("---"))
    entries.select("kid", F.concat_ws("\n", head, "content").alias("value")).write.partitionBy("kid").text(folder)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def cron_line(line: Column) -> Column:
    """A struct of job, exit, duration and time of a cron line, or null."""
    pattern = r"\[CRON\] job=(\S+) exit=(\d+) dur=(\S+) ts=(\S+)"
    g = lambda k: F.regexp_extract(line, pattern, k)
    return F.when(line.rlike(pattern), F.struct(g(1).alias("job"), g(2).cast("int").alias("exit"), g(3).alias("dur"), g(4).alias("at")))


def access_status(line: Column) -> Column:
    """The status of an access line; in the format with bars only of a line marked GIN."""
    a = F.regexp_extract(line, r'"(\S+) (\S+) HTTP/[\d.]+" (\d{3})', 3)
    b = F.when(marker(line) == "GIN", F.regexp_extract(line, r"\|\s*(\d{3})\s*\|", 1))
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))).cast("int")


def captured(line: Column) -> Column:
    """What a log source keeps: a marker, a level from WARNING on, or a status from 400 on."""
    level = line.rlike(r"\[(WARNING|ERROR|CRITICAL)\]|^(WARNING|ERROR|CRITICAL):")
    return marker(line).isNotNull() | level | F.coalesce(access_status(line) >= 400, F.lit(False))
