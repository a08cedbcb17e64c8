"""Token counts by a separator scan.

A flat token file is nothing but ids, 16 bits each, every document closed by the end-of-document id;
no index says where documents lie. Files are cut into blocks; a vectorised comparison finds the
separators of a block; a prefix scan over the blocks' counts (two-level, see `prefix_sums`) gives
every block its offset in the whole stream, the number of documents before it and the last
separator before it. With those a block knows the full length of the document that runs into it,
however many blocks that document spans.

`write_flat` makes such files with Spark's text writer: a record is a document's ids, and the record
separator is the end id itself (both of its bytes are below 128). A file holds FILE_BYTES of ids and the
document that crosses them. Beside each file goes a file of the doc_ids in the same order; the scan
doesn't read it, it only names the counted documents.

The stream's order is that of part numbers and slices in the files' names, as numbers.

Defined results: a null or empty text is a document of one id; a null doc_id stays null; ids after the
last separator of all are an unfinished document, reported with `closed` false; a table without rows,
or a path that is not there, gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, is_there, prefix_sums, slices, text_bytes
from quillstone.llm.vocabularies import Remembered, forget, plain_units, shared

END_ID, BLOCK_IDS, FILE_BYTES = 2, 1 << 20, 64 << 20
_SEPARATOR = END_ID.to_bytes(2, "little").decode()


def piece_encoder(model: bytes) -> Remembered:
    """The sentencepiece library, unit by unit."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model)

    def encode(units: list[bytes]) -> list[bytes]:
        # the library puts a space in front, which the unit already has
        found = library.encode([u[1:].decode() for u in units], num_threads=1)
        # which it does not for an empty text, so a lone space (at a text's end) is named
        lone = [library.piece_to_id("▁")]
        return [np.array(lone if u == b" " else ids, "<u2").tobytes() for u, ids in zip(units, found, strict=True)]

    return Remembered(encode)


def write_flat(docs: DataFrame, path: str, model: bytes, file_bytes: int = FILE_BYTES) -> None:
    """Flat token files below path/kind=ids, the doc_ids in order below path/kind=names."""

    def run(batches):
        by_units = shared(("library pieces", zlib.crc32(model)), lambda: piece_encoder(model))
        place = size = 0
        for batch in slices(batches):
            names = [b"" if d is None else str(d).encode() for d in batch.column("doc_id").to_pylist()]
            texts = [t.replace("▁".encode(), b" ") for t in text_bytes(batch)]
            ids = by_units.many([b" " + t if t else t for t in texts], plain_units)
            parts = []
            for x in ids:
                parts.append(size // file_bytes)
                size += len(x) + 2
            places = pa.array(np.arange(place, place + len(ids)))
            place += len(ids)
            for kind, values in (("ids", ids), ("names", names)):
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(values)), pa.array(parts, pa.int32()), places, pa.array(values, pa.binary())], names=["kind", "slice", "place", "value"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "kind string, slice int, place long, value binary")
    # sorted by place as well, so that both kinds have the same order whatever the writer's own sort does
    rows = rows.sortWithinPartitions("kind", "slice", "place").select("kind", "slice", F.col("value").cast("string"))
    rows.write.option("lineSep", _SEPARATOR).partitionBy("kind", "slice").text(path)


def placed_files(spark: SparkSession, path: str) -> DataFrame:
    """part and slice (numbers from the file's name), content, of the files below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    number = lambda pattern: F.coalesce(F.regexp_extract("path", pattern, 1).try_cast("int"), F.lit(0))
    return files.select(number(r"/part-(\d+)[^/]*$").alias("part"), number(r"/slice=(\d+)/").alias("slice"), "content")


def scan_blocks(spark: SparkSession, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """part, slice, block, n_ids, n_ends, last_end (place of the last separator in the block, null if
    none), ends (places of all separators) and lengths (from the separator before, null for the first)."""

    def run(batches):
        forget()
        for batch in batches:
            for part, piece, content in zip(batch.column("part").to_pylist(), batch.column("slice").to_pylist(), batch.column("content"), strict=True):
                ids = np.frombuffer(content.as_buffer(), "<u2")
                for k in range(0, -(-len(ids) // block_ids)):
                    block = ids[k * block_ids : (k + 1) * block_ids]
                    ends = np.flatnonzero(block == end_id).astype("<i4")
                    lengths = pa.array(np.diff(ends, prepend=0).astype("<i4"), mask=np.arange(len(ends)) == 0)
                    one = lambda x: pa.array([x], pa.int64())
                    several = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part], pa.int32()), pa.array([piece], pa.int32()), one(k), one(len(block)), one(len(ends)), one(int(ends[-1]) if len(ends) else None), several(pa.array(ends)), several(lengths)],
                        names=["part", "slice", "block", "n_ids", "n_ends", "last_end", "ends", "lengths"],
                    )

    schema = "part int, slice int, block long, n_ids long, n_ends long, last_end long, ends array<int>, lengths array<int>"
    return placed_files(spark, path).mapInArrow(run, schema)


COUNTED = "ordinal long, part int, slice int, start long, n_tokens long, closed boolean"


def count_tokens(scratch: Scratch, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """ordinal, part, slice, start, n_tokens (with the end id), closed for every document of the stream."""
    if not is_there(scratch.spark, path):
        return scratch.spark.createDataFrame([], COUNTED)
    blocks = scratch.cut(scan_blocks(scratch.spark, path, end_id, block_ids), "blocks")
    order = ["part", "slice", "block"]
    placed = prefix_sums(scratch, blocks, order, {"offset": "n_ids", "before": "n_ends"})
    # a second scan carries the last separator's place in the whole stream
    placed = placed.withColumn("last_at", F.col("offset") + F.col("last_end"))
    placed = prefix_sums(scratch, placed.drop("last_end"), order, {}, {"carry": "last_at"})
    found = placed.select("part", "slice", "offset", "before", "carry", F.posexplode(F.arrays_zip("ends", "lengths")).alias("k", "x"))
    end = F.col("offset") + F.col("x.ends")
    length = F.coalesce(F.col("x.lengths").cast("long"), end - F.coalesce("carry", F.lit(-1)))
    found = found.select((F.col("before") + F.col("k")).alias("ordinal"), "part", "slice", (end - length + 1).alias("start"), length.alias("n_tokens"), F.lit(True).alias("closed"))
    total = placed.agg(F.sum("n_ids").alias("ids"), F.sum("n_ends").alias("ends"), F.max("last_at").alias("last"), F.max(F.struct("part", "slice")).alias("at"))
    last = F.coalesce("last", F.lit(-1))
    rest = total.select(F.coalesce("ends", F.lit(0)).alias("ordinal"), "at.part", "at.slice", (last + 1).alias("start"), (F.coalesce("ids", F.lit(0)) - last - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return found.union(rest.where("n_tokens > 0"))


def name_documents(scratch: Scratch, path: str, counted: DataFrame) -> DataFrame:
    """counted with doc_id: the n-th document of a file has the n-th name of the file's twin."""
    if not is_there(scratch.spark, f"{path}/kind=names"):
        return counted.select(F.lit(None).cast("long").alias("doc_id"), "ordinal", "start", "n_tokens", "closed").limit(0)
    firsts = counted.groupBy("part", "slice").agg(F.min("ordinal").alias("first"))
    names = placed_files(scratch.spark, f"{path}/kind=names")
    listed = names.select("part", "slice", F.posexplode(F.split(F.decode("content", "UTF-8"), _SEPARATOR)).alias("nth", "name"))
    mine = counted.join(firsts, ["part", "slice"]).withColumn("nth", F.col("ordinal") - F.col("first"))
    return mine.join(listed, ["part", "slice", "nth"]).select(F.expr("try_cast(name as bigint)").alias("doc_id"), "ordinal", "start", "n_tokens", "closed")
