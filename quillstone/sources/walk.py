"""Entries as files below a folder: written one by one, walked in parallel, and read by three rules.

Spark's own readers leave out every name that begins with `_` or `.`, folders too; here only `.trash` is left out, and
`_*` files on demand. The folder must be mounted on the driver and all executors. The driver lists no more
than some hundred folders; tasks walk what lies below them, and paths are dealt to readers by their hash, so one large
folder is read by many tasks.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.sources.files import front_matter

# The folder of deleted entries, the delimiter of front matter, names of entries, front matter as it is stored.
TRASH, DELIMITER = ".trash", "---"
NAME = r"^[a-z0-9][a-z0-9_-]{2,127}$"
STORED = r"(?sU)^---\s*\n(.*?)\n---\s*\n(.*)$"
#: Folders that the driver lists at most, and bytes of texts that a task holds.
LISTED, HELD = 256, 8 << 20


def mounted(folder: str) -> str:
    """A plain path of a folder that is mounted; other stores are refused."""
    path = folder.removeprefix("file://") if folder.startswith("file://") else folder.removeprefix("file:")
    if "://" in path:
        raise ValueError(f"not mounted: {folder}")
    return path


def _frontier(root: str) -> list[tuple[str, bool]]:
    """Folders that cover the tree: with all below them, or their own files only."""
    deep, flat = [root], []
    while deep and len(deep) + len(flat) < LISTED:
        folder, below = deep.pop(0), []
        with os.scandir(folder) as found:
            for f in found:
                if f.is_dir(follow_symlinks=False) and f.name != TRASH:
                    below.append(f.path)
                if len(below) > LISTED:
                    break
        if len(below) > LISTED:
            return [(folder, True), *((d, True) for d in deep), *((d, False) for d in flat)]
        flat.append(folder)
        deep += below
    return [*((d, True) for d in deep), *((d, False) for d in flat)]


def _walk(root: str):
    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder, below in zip(batch["folder"], batch["below"], strict=True):
                for here, folders, names in os.walk(folder):
                    folders[:] = [d for d in folders if d != TRASH] if below else []
                    found = [os.path.relpath(os.path.join(here, name), root) for name in names if name.endswith(".md")]
                    for k in range(0, len(found), 10_000):
                        yield pd.DataFrame({"path": found[k : k + 10_000]})

    return paths


def _read(root: str):
    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, rows = 0, []
            for path in batch["path"]:
                with open(os.path.join(root, path), encoding="utf-8", errors="replace") as f:
                    rows.append((path, f.read()))
                held += len(rows[-1][1])
                if held > HELD:
                    yield pd.DataFrame(rows, columns=["path", "text"])
                    held, rows = 0, []
            yield pd.DataFrame(rows, columns=["path", "text"])

    return texts


def walked(spark: SparkSession, folder: str, skip_underscore: bool = True) -> DataFrame:
    """path (below the folder), text of all *.md files outside .trash; `_*` files are left out on demand. Bytes that are no
    UTF-8 become replacement signs, line ends of any kind line feeds. A folder that isn't there is empty."""
    root = mounted(folder)
    found = _frontier(root) if os.path.isdir(root) else []
    folders = spark.createDataFrame(found, "folder string, below boolean").repartition(max(1, len(found)), "folder")
    paths = folders.mapInPandas(_walk(root), "path string")
    if skip_underscore:
        paths = paths.where(~F.element_at(F.split("path", "/"), -1).startswith("_"))
    return paths.repartition("path").mapInPandas(_read(root), "path string, text string")


def stored_entries(rows: DataFrame) -> DataFrame:
    """path, meta, body of texts as the store reads them: front matter between delimiters on lines of their own, the rest without
    outer space. Broken ones, and such without id, domain or subject, are left out."""
    rows = rows.withColumn("front", F.when(F.col("text").rlike(STORED), F.regexp_extract("text", STORED, 1)))
    rows = rows.withColumn("meta", front_matter()("front")).where(_whole(F.col("meta")))
    return rows.select("path", "meta", tx.strip(F.regexp_extract("text", STORED, 2)).alias("body"))


def scanned_entries(rows: DataFrame) -> DataFrame:
    """path, meta, body as a quality scan reads them: front matter is what stands between the first two delimiters, wherever
    these are. Lenient: what can't be read is left out."""
    parts = F.split("text", DELIMITER, 3)
    rows = rows.withColumn("front", F.when(F.col("text").startswith(DELIMITER) & (F.size(parts) > 2), F.get(parts, 1)))
    rows = rows.withColumn("meta", front_matter()("front")).where(_whole(F.col("meta")))
    return rows.select("path", "meta", F.get(parts, 2).alias("body"))


def _whole(meta: Column) -> Column:
    return meta["keys"].isNotNull() & F.coalesce(meta["knowledge_id"].rlike(NAME), F.lit(False)) & meta["domain"].isNotNull() & meta["subject"].isNotNull()


def strict_faults(rows: DataFrame) -> DataFrame:
    """rows with the fault of their `text` before it is taken in: empty, no_delimiter, unclosed, empty_front, yaml, not_a_mapping, or
    null. Space before the first delimiter is allowed; the second must begin a line."""
    text = F.regexp_replace("text", r"(?U)^\s+", "")
    inner = F.substring_index(F.substr(text, F.lit(4)), "\n" + DELIMITER, 1)
    closed = F.substr(text, F.lit(4)).contains("\n" + DELIMITER)
    front = F.when(text.startswith(DELIMITER) & closed, tx.strip(inner))
    rows = rows.withColumns({"_front": front, "_meta": front_matter()(front)})
    fault = (
        F.when(F.coalesce(text, F.lit("")) == "", "empty").when(~text.startswith(DELIMITER), "no_delimiter").when(~closed, "unclosed")
        .when(F.col("_front") == "", "empty_front").when(F.col("_meta.broken"), "yaml").when(F.col("_meta.keys").isNull(), "not_a_mapping")
    )
    return rows.withColumn("fault", fault).drop("_front", "_meta")


def pieces(batches: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """Batches of texts in pieces, so that what is made of one at a time stays small."""
    for batch in batches:
        for k in range(0, len(batch), rows):
            yield batch.iloc[k : k + rows]


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    dumper = getattr(yaml, "CSafeDumper", yaml.SafeDumper)
    for batch in pieces(batches):
        rows = []
        for row in batch.to_dict("records"):
            body = row.pop("content")
            meta = {("knowledge_id" if k == "kid" else k): v.tolist() if hasattr(v, "tolist") else v for k, v in row.items()}
            meta = {k: v for k, v in meta.items() if isinstance(v, list) or not pd.isna(v)}
            parts = [str(meta[k]) for k in ("domain", "subject", "project") if meta.get(k)]
            if any("/" in p or p in ("", ".", "..", TRASH) for p in [*parts, str(meta["knowledge_id"])]):
                raise ValueError(f"no name of a file: {parts}, {meta['knowledge_id']}")
            front = yaml.dump(meta, Dumper=dumper, allow_unicode=True, default_flow_style=False, sort_keys=False).strip()
            rows.append(("/".join([*parts, f"{meta['knowledge_id']}.md"]), f"{DELIMITER}\n{front}\n{DELIMITER}\n{body or ''}\n"))
        yield pd.DataFrame(rows, columns=["path", "text"])


def entry_texts(entries: DataFrame) -> DataFrame:
    """path, text of entries: domain/subject[/project]/kid.md, all columns but `content` as front matter, absent ones left out.
    A kid, domain, subject or project that is no name of a file is an error."""
    return entries.mapInPandas(_texts, "path string, text string")


def _write(root: str):
    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            size = 0
            for path, text in zip(batch["path"], batch["text"], strict=True):
                target = os.path.join(root, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.{uuid.uuid4().hex}"
                with open(part, "w", encoding="utf-8", newline="") as f:
                    size += f.write(text)
                os.replace(part, target)
            yield pd.DataFrame({"files": [len(batch)], "characters": [size]})

    return files


def write_texts(rows: DataFrame, folder: str) -> tuple[int, int]:
    """Writes (path, text) as files below a folder; how many files and characters. A file appears whole under its name, so a task may
    run again; of two rows with one path either stays."""
    done = rows.select("path", "text").mapInPandas(_write(mounted(folder)), "files long, characters long")
    total = done.agg(F.sum("files").alias("files"), F.sum("characters").alias("characters")).first()
    return total["files"] or 0, total["characters"] or 0
