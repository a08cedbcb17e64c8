"""Packing by lexical retrieval: a sharded BM25 index fills a seed document's window with its neighbours.

The terms of the index are token ids, so a document is read once and the vocabulary bounds the tables.

1. Encoding, beside it document frequencies (a row of counts per task, added up by Spark) and a
   min-hash signature per document. Frequencies and the mean length come from all documents.
2. Documents are dealt out by ranges of the signature, so that like documents meet. A hot signature
   spreads over several ranges.
3. A range is cut into index shards of bounded size. A shard is an inverted index: a term's documents with their
   BM25 weights. The document at the start of a window is its seed; its heaviest terms are the query,
   and the unused documents follow by score until the window is full. What the last one has over goes on
   in the next window, as its seed. Without a neighbour left the next unused document follows.

Documents are cut at windows' ends only, so windows are full; the rest of a range (less than a window) goes into
sequences whose lengths are powers of two. Nothing is padded, and nothing is left out.

Defined results: a null or empty text is one end id; null doc_ids are kept; repeated rows are documents
of their own; a document longer than a window seeds the window of its last part; an empty table gives no
rows; other columns are ignored; reruns agree.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, mix64, slices
from quillstone.llm.token_files import by_bytes, encode_texts, library_encoder
from quillstone.llm.vocabularies import forget, shared

WINDOW = 4096
#: BM25's constants, and how many of a seed's terms are asked for.
K1, B, QUERY_TERMS = 1.2, 0.75, 32
SHARD_TOKENS, SHARD_DOCUMENTS = 4 << 20, 4096
_ENCODED = "kind string, doc_id long, ids binary, n long, signature long, counts array<struct<term:int,n:long>>"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def term_counts(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and how often it has it, ordered by document and term; the documents' ids lie end to end."""
    keys = ids.astype(np.int64) | np.repeat(np.arange(len(lengths), dtype=np.int64) << 32, lengths)
    keys.sort()
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[at] >> 32).astype(np.int32), (keys[at] & 0xFFFFFFFF).astype(np.int32), np.diff(np.append(at, len(keys)))


def encode(docs: DataFrame, vocabulary: bytes, end_id: int, width: int) -> DataFrame:
    """Rows of kind `docs`, and a row of kind `counts` per task with its document frequencies."""

    def run(batches):
        words = shared(("words", zlib.crc32(vocabulary), width), lambda: library_encoder(vocabulary, width))
        seen, spread = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        counts = pa.list_(pa.struct([("term", pa.int32()), ("n", pa.int64())]))
        for batch in by_bytes(batches):
            ids, ends = encode_texts(words, batch.column("text"), width, end_id)
            lengths = np.diff(ends, prepend=0)
            offsets = pa.py_buffer(np.append(0, ends * width).astype(np.int32).tobytes())
            raw = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, offsets, pa.py_buffer(ids.tobytes())])
            owner, term, _ = term_counts(ids, lengths)
            if (top := int(term.max()) + 1) > len(seen):
                seen = np.append(seen, np.zeros(top - len(seen), np.int64))
                spread = mix64(np.arange(1, top + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            found = np.bincount(term, minlength=len(seen))
            seen += found
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            hashed = spread[term]
            low = np.minimum.reduceat(hashed & np.uint64(0xFFFFFFFF), starts)
            high = np.minimum.reduceat(hashed >> np.uint64(32), starts)
            n = batch.num_rows
            columns = [["docs"] * n, batch.column("doc_id"), raw, lengths, (low >> np.uint64(1) << np.uint64(32) | high).astype(np.int64), [None] * n]
            kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), counts]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "doc_id", "ids", "n", "signature", "counts"])
        if len(seen):
            held = np.flatnonzero(seen)
            row = [{"term": int(t), "n": int(c)} for t, c in zip(held, seen[held], strict=True)]
            columns = [["counts"], [None], [None], [None], [None], [row]]
            kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), counts]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "doc_id", "ids", "n", "signature", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ENCODED)


class Index:
    """One shard: postings by term over documents that are held in memory."""

    def __init__(self, documents: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.idf, self.mean = idf, mean_length
        lengths = np.array([len(d) for d in documents])
        self.owner, self.term, often = term_counts(np.concatenate(documents), lengths)
        self.weight = self.weights(self.term, often, lengths[self.owner])
        self.rows = np.searchsorted(self.owner, np.arange(len(documents) + 1))
        by_term = np.argsort(self.term, kind="stable")
        self.posted, self.posted_weight = self.owner[by_term], self.weight[by_term]
        self.lists = np.searchsorted(self.term[by_term], np.arange(len(idf) + 1))
        self.unused = np.ones(len(documents), bool)

    def weights(self, term: np.ndarray, often: np.ndarray, length) -> np.ndarray:
        return (self.idf[term] * often * (K1 + 1) / (often + K1 * (1 - B + B * length / self.mean))).astype(np.float32)

    def query(self, ids: np.ndarray, k: int | None = None) -> np.ndarray:
        """The heaviest terms of document k of the shard, or of another document's ids."""
        if k is None:
            _, term, often = term_counts(ids, [len(ids)])
            weight = self.weights(term, often, len(ids))
        else:
            term, weight = self.term[self.rows[k] : self.rows[k + 1]], self.weight[self.rows[k] : self.rows[k + 1]]
        if len(term) > QUERY_TERMS:
            term = term[np.lexsort((term, -weight))[:QUERY_TERMS]]
        return term

    def neighbours(self, terms: np.ndarray):
        """Unused documents that share a term, best score first, ties in the shard's order. The few best are sorted
        at once, the others when they are wanted."""
        spans = [slice(self.lists[t], self.lists[t + 1]) for t in terms.tolist()]
        owners = np.concatenate([self.posted[s] for s in spans])
        scores = np.bincount(owners, np.concatenate([self.posted_weight[s] for s in spans]), len(self.unused))
        scores[~self.unused] = 0
        found = np.flatnonzero(scores)
        given = 0
        if len(found) > 64:
            edge = np.partition(scores[found], len(found) - 32)[len(found) - 32]
            best = found[scores[found] >= edge]
            yield from best[np.lexsort((best, -scores[best]))].tolist()
            given = len(best)
        yield from found[np.lexsort((found, -scores[found]))][given:].tolist()


class Packer:
    """Lays documents end to end and cuts the row of them into windows; keeps the open window's pieces."""

    def __init__(self, first_sequence: int, window: int):
        self.sequence, self.window = first_sequence, window
        self.open: list[tuple] = []
        self.filled, self.done = 0, []

    def add(self, doc_id: int | None, ids: np.ndarray) -> bool:
        """Lays a document down; tells whether a window was closed by it and part of it is in the next."""
        start, closed = 0, False
        while start < len(ids):
            length = min(len(ids) - start, self.window - self.filled)
            self.open.append((doc_id, start, ids[start : start + length], len(ids)))
            self.filled += length
            start += length
            if self.filled == self.window:
                self._close(self.open)
                self.open, self.filled, closed = [], 0, True
        return closed and bool(self.open)

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.done.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def finish(self) -> None:
        """The open window in sequences of lengths that are powers of two, the longest first."""
        rest, self.open = self.open, []
        while self.filled:
            size = 1 << self.filled.bit_length() - 1
            self.filled -= size
            part = []
            while size:
                doc_id, start, ids, n = rest[0]
                part.append((doc_id, start, ids[:size], n))
                if len(ids) > size:
                    rest[0] = (doc_id, start + size, ids[size:], n)
                else:
                    rest = rest[1:]
                size -= len(part[-1][2])
            self._close(part)

    def take(self) -> pa.RecordBatch:
        done, self.done = self.done, []
        columns = zip(*done, strict=True) if done else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack_shard(packer: Packer, names: list, documents: list[np.ndarray], idf: np.ndarray, mean_length: float, seed: np.ndarray | None) -> np.ndarray | None:
    """Packs a shard's documents. seed: the document that the open window began with, if there is one; returns
    the one that the open window then begins with."""
    index, following = Index(documents, idf, mean_length), 0
    asked = index.query(seed) if seed is not None else None
    while True:
        if asked is not None:
            for k in index.neighbours(asked):
                index.unused[k] = False
                over = packer.add(names[k], documents[k])
                if over or not packer.filled:
                    seed = documents[k] if over else None
                    asked = index.query(documents[k], k) if over else None
                    break
            else:
                asked = None
            if asked is not None:
                continue
        while following < len(documents) and not index.unused[following]:
            following += 1
        if following == len(documents):
            return seed if packer.filled else None
        k = following
        index.unused[k] = False
        starts = not packer.filled
        over = packer.add(names[k], documents[k])
        if packer.filled:
            seed = documents[k] if starts or over else seed
            asked = index.query(documents[k], k)


def pack(scratch: Scratch, docs: DataFrame, vocabulary: bytes, *, end_id: int = 2, width: int = 2, window: int = WINDOW) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    encoded = scratch.cut(encode(docs, vocabulary, end_id, width), "encoded", ["kind"])
    rows = encoded.filter("kind = 'docs'")
    n, tokens = rows.agg(F.count("*"), F.sum("n")).first()
    counted = encoded.filter("kind = 'counts'").select(F.explode("counts").alias("c")).groupBy("c.term").agg(F.sum("c.n").alias("n"))
    frequent = {r["term"]: r["n"] for r in counted.collect()}  # the vocabulary bounds them
    held = np.zeros(max(frequent, default=-1) + 1)
    held[list(frequent)] = list(frequent.values())
    idf, mean_length = np.log1p((n - held + 0.5) / (held + 0.5)).astype(np.float32), (tokens or 0) / max(1, n)

    def run(batches):
        forget()
        packer, seed = Packer(TaskContext.get().partitionId() << 40, window), None
        names, documents, size = [], [], 0
        for batch in slices(batches):
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                names.append(doc_id)
                documents.append(np.frombuffer(raw, f"<u{width}"))
                size += len(documents[-1])
                if size >= SHARD_TOKENS or len(documents) >= SHARD_DOCUMENTS:
                    seed = pack_shard(packer, names, documents, idf, mean_length, seed)
                    yield packer.take()
                    names, documents, size = [], [], 0
        if documents:
            pack_shard(packer, names, documents, idf, mean_length, seed)
        packer.finish()
        yield packer.take()

    order = ["signature", "doc_id", "h"]
    dealt = rows.select("doc_id", "ids", "signature", F.xxhash64("ids").alias("h")).repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "ids").mapInArrow(run, _PIECES)
