"""Token-id files with Elias-Fano document boundaries.

A file is a row of shards. A shard holds the ids of many documents end to end, and instead of a
64-bit offset per document the ends as an Elias-Fano sequence: about 2 + log2(ids per document) bits
a document. `select` over its high bits gives any document's offset without decoding the others.
The documents' ids are kept the same way. Everything is little-endian:

    8 bytes magic | int64 x 6: documents without id, documents, ids, first doc_id, bytes of doc_id
    sequence, bytes of end sequence | the two sequences | ids, 16 or 32 bits each

and a sequence is int64 x 3: values, low bits of each, bytes of high bits | low bits | high bits
(padded to 8) | uint32 samples, the place of every 256th one.

The documents are dealt out by ranges of doc_id and sorted inside a range, so file after file, shard
after shard the doc_ids ascend. Spark's text writer commits the files (a shard is one record, a line
feed follows it), so they can lie in any store Spark writes to and lost tasks leave nothing behind.

Defined results: a null text is an empty document of one end id; null doc_ids come first; repeated
doc_ids keep all their rows, in the order of their texts' hashes; an empty table gives no files and no
rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, prefix_sums
from quillstone.llm.vocabularies import Remembered, forget, shared

MAGIC = b"EFSHARD1"
#: Shards in a file, some 65 MB of 16-bit ids: a reader holds a file in the JVM and again in Python.
FILE_SHARDS = 8
SAMPLE = 256
SHARD_IDS = 1 << 22
#: Letters of Latin-1, all in composed form; as bytes too.
_LETTERS = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
_STOPS = frozenset((b".", b",", b"!", b"?", b";", b":"))
_LETTER_BYTES = re.compile(rb"(?:[a-zA-Z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


class EliasFano:
    """A non-decreasing sequence of integers from 0 on."""

    def __init__(self, low: np.ndarray, high: np.ndarray, samples: np.ndarray, low_bits: int):
        self.low, self.high, self.samples, self.low_bits = low, high, samples, low_bits

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(ones[-1]) + 64) // 64 * 64 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4"), low_bits)._sized(n)

    def _sized(self, n: int) -> EliasFano:
        self.n = n
        return self

    def __len__(self) -> int:
        return self.n

    def to_bytes(self) -> bytes:
        return struct.pack("<3q", self.n, self.low_bits, len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: memoryview) -> EliasFano:
        n, low_bits, n_high = struct.unpack_from("<3q", raw)
        n_low = (n * low_bits + 7) // 8
        low = np.frombuffer(raw, np.uint8, n_low, 24)
        high = np.frombuffer(raw, np.uint8, n_high, 24 + n_low)
        return cls(low, high, np.frombuffer(raw, "<u4", (n + SAMPLE - 1) // SAMPLE, 24 + n_low + n_high), low_bits)._sized(n)

    def select(self, k: int) -> int:
        """Value k: from the sample before it, whole bytes of high bits are skipped by their counts."""
        place = int(self.samples[k // SAMPLE])
        left = k % SAMPLE
        byte, ones = place // 8, int(self.high[place // 8]) >> (place % 8) << (place % 8)
        while (c := ones.bit_count()) <= left:
            left -= c
            byte += 1
            ones = int(self.high[byte])
        for _ in range(left):
            ones &= ones - 1
        place = byte * 8 + (ones & -ones).bit_length() - 1
        start = k * self.low_bits
        chunk = int.from_bytes(self.low[start // 8 : (start + self.low_bits + 7) // 8].tobytes(), "little") >> start % 8
        return (place - k) << self.low_bits | chunk & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        values = (ones - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            values |= bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return values


def pack_shard(doc_ids: list[int | None], documents: list[bytes], width: int) -> bytes:
    """doc_ids ascend, nulls first; a document is its ids' bytes, end id included."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    names = EliasFano.of((known - first).astype(np.uint64)).to_bytes()
    ends = EliasFano.of(np.cumsum([len(d) // width for d in documents])).to_bytes()
    n_ids = sum(map(len, documents)) // width
    head = struct.pack("<6q", len(doc_ids) - len(known), len(doc_ids), n_ids, first, len(names), len(ends))
    return b"".join([MAGIC, head, names, ends, *documents])


class Shard:
    """A shard in a buffer, read where it lies."""

    def __init__(self, raw: memoryview, width: int):
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("not a shard")
        nulls, self.n_docs, self.n_ids, first, n_names, n_ends = struct.unpack_from("<6q", raw, 8)
        names = EliasFano.from_bytes(raw[56 : 56 + n_names]).all() + first
        self.doc_ids = [None] * nulls + names.tolist()
        self.ends = EliasFano.from_bytes(raw[56 + n_names : 56 + n_names + n_ends])
        start = 56 + n_names + n_ends
        self.size = start + self.n_ids * width
        self.ids = np.frombuffer(raw[start : self.size], f"<u{width}")

    def document(self, k: int) -> np.ndarray:
        """The ids of document k, by two selects."""
        return self.ids[self.ends.select(k - 1) if k else 0 : self.ends.select(k)]


def shards_of(content: bytes, width: int):
    raw, at = memoryview(content), 0
    while at < len(raw):
        shard = Shard(raw[at:], width)
        yield shard
        at += shard.size + 1  # the line feed


def library_encoder(vocabulary: bytes, width: int, generation: int = 80 << 20) -> Remembered:
    """The tokenizers library on units between white space; its pieces never span the white space that it drops.

    A unit of letters is one group of the library's, which an end-of-word id closes, and its normalised form is its
    lower case. Many such units go through in one call, by a tokenizer that only splits at spaces."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    library = Tokenizer.from_str(vocabulary.decode())
    suffix = json.loads(vocabulary)["model"].get("end_of_word_suffix") or None
    size = library.get_vocab_size()
    closes = np.zeros(size, bool)
    closes[[k for w, k in library.get_vocab().items() if suffix and w.endswith(suffix)]] = True
    by_spaces = Tokenizer(library.model)  # the same model, without the normaliser
    by_spaces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def encode(units: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(units)
        texts = [u.decode() for u in units]
        plain = [k for k, t in enumerate(texts) if t.isascii() and t.isalpha() or _LETTERS(t)] if suffix else []
        if plain:
            ids = np.array(by_spaces.encode_batch_fast([" ".join([texts[k] for k in plain]).lower()], add_special_tokens=False)[0].ids, f"<u{width}")
            ends, raw = ((np.flatnonzero(closes[ids]) + 1) * width).tolist(), ids.tobytes()
            if len(ends) == len(plain):
                start = 0
                for k, end in zip(plain, ends, strict=True):
                    out[k], start = raw[start:end], end
        rest = [k for k in range(len(units)) if not out[k]]
        for k, e in zip(rest, library.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, f"<u{width}").tobytes()
        return out

    return Remembered(encode, generation)


def encode_texts(units: Remembered, texts: pa.Array, width: int, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts end to end, an end id behind each, and where each text's ids end. Only distinct units are
    looked up. A text that may name a special token isn't lower-cased first."""
    texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
    named = parts.flatten().dictionary_encode()
    ids = _ids_of(units, named.dictionary.cast(pa.binary()).to_pylist())
    pool, code = np.frombuffer(b"".join(ids), f"<u{width}"), named.indices.to_numpy()
    lengths = np.fromiter(map(len, ids), np.int32, len(ids)) // width
    starts, n = np.cumsum(lengths, dtype=np.int32) - lengths, lengths[code]
    ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    place = np.repeat(starts[code] - ends[:-1].astype(np.int32), n)
    place += np.arange(ends[-1], dtype=np.int32)
    flat = pool[place]
    bounds = ends[parts.offsets.to_numpy()[1:] - parts.offsets[0].as_py()]
    return np.insert(flat, bounds, end_id).astype(f"<u{width}", copy=False), bounds + np.arange(1, len(bounds) + 1)


def _ids_of(units: Remembered, words: list[bytes]) -> list[bytes]:
    """The ids of distinct words. A stop behind letters is a group of its own for the library, so it is taken off."""
    body = [w[:-1] if w[-1:] in _STOPS and _LETTER_BYTES(w, 0, len(w) - 1) else w for w in words]
    distinct = list(dict.fromkeys(body + list(_STOPS)))
    found = dict(zip(distinct, units.each(distinct), strict=True))
    return [found[b] if len(b) == len(w) else found[b] + found[w[-1:]] for b, w in zip(body, words, strict=True)]


def by_bytes(batches, column: str = "text", most: int = 16 << 20):
    """Arrow batches in pieces whose column holds so many bytes at most, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def write_files(docs: DataFrame, path: str, vocabulary: bytes, end_id: int, width: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Shards of at least `shard_ids` ids, FILE_SHARDS a file, in ascending doc_id order."""

    def run(batches):
        by_words = shared(("words", zlib.crc32(vocabulary), width), lambda: library_encoder(vocabulary, width, 72 << 20))
        names, held, size = [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([pack_shard(names, held, width)], pa.binary())], names=["shard"])

        for batch in by_bytes(batches, most=8 << 20):
            ids, ends = encode_texts(by_words, batch.column("text"), width, end_id)
            start = 0
            for doc_id, end in zip(batch.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                names.append(doc_id)
                held.append(ids[start:end].tobytes())
                size += end - start
                start = end
                if size >= shard_ids:
                    yield flush()
                    names, held, size = [], [], 0
        if names:
            yield flush()

    rows = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    # the writer takes strings; a cast from binary keeps the bytes as they are
    shards = rows.mapInArrow(run, "shard binary").select(F.col("shard").cast("string"))
    shards.write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_SHARDS).text(path)


def read_files(scratch: Scratch, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    files = scratch.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    number = lambda pattern: F.regexp_extract("path", pattern, 1).try_cast("int")
    files = files.select(number(r"/part-(\d+)-[^/]*$").alias("part"), number(r"-c(\d+)\.txt$").alias("nth"), "content")

    def run(batches):
        forget()
        for batch in batches:
            for part, nth, content in zip(batch.column("part").to_pylist(), batch.column("nth").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_buffer()
                for k, shard in enumerate(shards_of(raw, width)):
                    ends = np.fromiter(map(shard.ends.select, range(shard.n_docs)), np.int64, shard.n_docs)
                    starts = np.concatenate([[0], ends[:-1]])
                    sums = [zlib.crc32(shard.ids[a:b].tobytes() if width == 4 else shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]
                    n = len(ends)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * n, pa.int32()), pa.array([nth] * n, pa.int32()), pa.array([k] * n, pa.int64()), pa.array(shard.doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(sums, pa.int64())],
                        names=["part", "nth", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"],
                    )

    rows = scratch.cut(files.mapInArrow(run, "part int, nth int, shard long, doc_id long, inside long, n_tokens long, ids_crc32 long"), "read")
    order = ["part", "nth", "shard"]
    shards = rows.groupBy(*order).agg(F.sum("n_tokens").alias("n"))
    bases = prefix_sums(scratch, shards, order, {"base": "n"})
    return rows.join(bases.drop("n"), order).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
