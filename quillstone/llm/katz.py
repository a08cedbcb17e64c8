"""A Katz backoff model of words: Good-Turing discounts and exactly normalised backoff weights.

Events. A document is its words and one end. Every word of the training documents is an event and a
history of its own; all words never seen there have the unigram level's unseen mass together. So

    p(w | h)  =  scale(h) d_r r / C(h)   if r = count(h w) > 0,   else   alpha(h) p1(w)

with Katz's discounts d_r for r <= 5, and alpha(h) such that the events of every history sum to 1.
A history whose counts are all undiscounted gives up 1 / (C + 1) of its mass.

The VOCABULARY most frequent words have numbers, which every task holds; the others ("rare", seen or
not) are named by their hashes and met in buckets only. The result does not depend on VOCABULARY.

Work is done on sorted runs of numbers, which Spark deals out and merges: a chunk (some 2 million
tokens of whole documents) sends each of its distinct bigrams once to the bigram's bucket, with its
training count; the bucket keeps the table of totals and answers every chunk in the order asked.
So a bigram in half of all sentences costs a row element per chunk, not per occurrence. Rare words and
bigrams with one go to a rare word's bucket: the second word's, whose count p1 needs, or else the
first's. A rare history's sums are told once more to the chunks that have it. The tables are kept by
kind and bucket. What the driver holds is bounded: the vocabulary, three numbers per history in it,
counts of counts.

Defined results: null text is empty and has the end only; a null doc_id counts as training; repeated
rows count repeatedly; an empty table gives an empty result; without training documents every score
is 0; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch, mix64, text_bytes
from quillstone.llm.ngram_join import WordHashes

#: Words that every task holds, at some 50 bytes a word. The others cost a row element a chunk instead.
VOCABULARY = 1_000_000
RARE, END, FIRST_WORD, START = 0, 1, 2, (1 << 32) - 1
CHUNK_TOKENS, BUCKET_TOKENS = 2_000_000, 2_000_000
#: Of rare words: each comes with up to two bigrams.
RARE_BUCKET_TOKENS = 500_000
CUTOFF = 5


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def discounts(n: np.ndarray) -> np.ndarray:
    """d[r] for r = 0..CUTOFF, by Katz from n[r], the number of types seen r times (n[0] unused).

    The cutoff is lowered until all discounts lie in (0, 1); if none does, half a count is taken off.
    """
    for k in range(CUTOFF, 0, -1):
        if not n[1 : k + 2].all():
            continue
        r = np.arange(1, k + 1)
        stars = (r + 1) * n[2 : k + 2] / n[1 : k + 1]
        common = (k + 1) * n[k + 1] / n[1]
        d = (stars / r - common) / (1 - common) if common < 1 else np.zeros(k)
        if ((d > 0) & (d < 1)).all():
            return np.concatenate([[1.0], d, np.ones(CUTOFF - k)])
    r = np.arange(1, CUTOFF + 1)
    return np.concatenate([[1.0], (r - 0.5) / r])


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d_r r for an array of counts."""
    return counts * np.where(counts <= CUTOFF, d[np.minimum(counts, CUTOFF)], 1.0)


# ---- sorted runs as bytes


def pack(a: np.ndarray) -> bytes:
    """Numbers, byte plane by byte plane, compressed; small numbers cost little."""
    a = np.ascontiguousarray(a)
    return bytes([a.itemsize]) + zlib.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(zlib.decompress(raw[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}")


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    d = unpack(raw)
    return np.cumsum(d, dtype=d.dtype)


def pack_ids(ids: list[int | None]) -> bytes:
    """64-bit ids, and behind them which of them are there."""
    return np.array([d or 0 for d in ids], "<i8").tobytes() + np.array([d is not None for d in ids], bool).tobytes()


def unpack_ids(raw: bytes) -> list[int | None]:
    n = len(raw) // 9
    return [d if here else None for d, here in zip(np.frombuffer(raw, "<i8", n).tolist(), raw[8 * n :], strict=True)]


def frames(parts: list[bytes]) -> bytes:
    return np.array([len(parts), *map(len, parts)], "<i8").tobytes() + b"".join(parts)


def unframe(raw: bytes) -> list[bytes]:
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    ends = 8 * (n + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<i8", n, 8))])
    return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


# ---- counting


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), c: counts over the training documents; the end is not among them."""

    def run(batches):
        known, hashes, counts, size = WordHashes(), [], [], 0

        def flush():
            u, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
            return u, np.bincount(inverse, np.concatenate(counts)).astype(np.int64)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch), strict=True):
                if held_out(doc_id):
                    continue
                words = text.lower().split()
                hashes.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
                counts.append(np.ones(len(words), np.int64))
                size += len(words)
                if size > 1_500_000:  # what is held shrinks to the distinct words
                    u, c = flush()
                    if len(u) > 800_000:
                        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=["word", "c"])
                        u, c = u[:0], c[:0]
                    hashes, counts, size = [u], [c], len(u)
        if hashes:
            u, c = flush()
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], names=["word", "c"])

    return docs.select("doc_id", "text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Unigrams:
    """The first level: N, V, vocabulary, p1 by class, shares inside the rare class."""

    def __init__(self, words: DataFrame, train_docs: int):
        sums = words.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.tokens = (sums["n"] or 0) + train_docs
        self.types = sums["v"] + (train_docs > 0)
        self.ends = train_docs
        n = np.zeros(CUTOFF + 2)
        for r in words.where(f"c <= {CUTOFF + 1}").groupBy("c").count().collect():
            n[r["c"]] = r["count"]
        self.d = discounts(n)
        total = max(self.tokens, 1)
        r = np.arange(CUTOFF + 1)
        unseen = float(((1 - self.d) * r * n[: CUTOFF + 1]).sum()) / total
        self.scale = 1.0
        if unseen <= 0:
            unseen, self.scale = 1 / (total + 1), total / (total + 1)
        # words by steps of their counts' logarithms, so that what is collected is bounded
        step = F.floor(F.log2("c") * 64)
        steps = sorted(((x["s"], x["count"]) for x in words.groupBy(step.alias("s")).count().collect()), reverse=True)
        held, least = 0, None
        for s, count in steps:
            held += count
            if held > VOCABULARY:
                break
            least = s
        chosen = words.where(step >= least if least is not None else F.lit(False)).select("word", "c").toArrow()
        h = chosen["word"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(h)
        self.hashes, self.counts = h[order], chosen["c"].to_numpy().astype(np.int64)[order]
        p = np.zeros(FIRST_WORD + len(self.hashes))
        p[FIRST_WORD:] = self.scale * discounted(self.counts, self.d) / total
        p[END] = self.scale * self.ends / total
        p[RARE] = max(1 - p.sum(), unseen)
        self.p1, self.unseen = p / p.sum(), unseen

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + FIRST_WORD, RARE)

    def rare_share(self, counts: np.ndarray) -> np.ndarray:
        """p(w | rare) by the word's training count; of a word never seen, that of all such words."""
        seen = self.scale * discounted(counts, self.d) / max(self.tokens, 1)
        return np.minimum(np.where(counts > 0, seen, self.unseen) / self.p1[RARE], 1.0)

    def p1_of_rare(self, counts: np.ndarray) -> np.ndarray:
        return self.p1[RARE] * self.rare_share(counts)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def bigram_keys(ids: np.ndarray, ends_at: np.ndarray) -> np.ndarray:
    """history << 32 | class for every token; a document's first has the history START."""
    before = np.empty(len(ids), np.uint64)
    before[1:] = ids[:-1]
    before[np.concatenate([[0], ends_at[:-1] + 1]).astype(np.int64)] = START
    return before << np.uint64(32) | ids.astype(np.uint64)


def plain_keys(ids: np.ndarray, ends_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the bigrams without a rare word, and which tokens end one."""
    plain = ids != RARE
    plain[1:] &= ids[:-1] != RARE
    return bigram_keys(ids, ends_at)[plain], plain


def rare_bigrams(ids: np.ndarray, rare: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The bigrams with a rare word, as owner (the rare word whose bucket has it), other word, place in ids. fr: the second
    word is rare, behind a word with an id; rr: both are, and the second owns; rf: only the first is, and owns. An end
    stands behind every document's words, so what follows a rare word is of its document."""
    at = np.flatnonzero(ids == RARE)
    before = np.where((at == 0) | (ids[at - 1] == END), START, ids[at - 1])
    both, after = np.flatnonzero(before == RARE), ids[at + 1] if len(at) else at
    fr, rf = before != RARE, after != RARE
    return {"fr": (rare[fr], before[fr].astype(np.uint64), at[fr]), "rr": (rare[both], rare[both - 1], at[both]), "rf": (rare[rf], after[rf].astype(np.uint64), at[rf] + 1)}


def distinct_pairs(owner: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, and each pair's place among them."""
    order = np.lexsort((other, owner))
    x, y = owner[order], other[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    inverse = np.empty(len(x), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return x[new], y[new], inverse


def dealt(keys: np.ndarray, buckets: int) -> list[np.ndarray]:
    """The places of every bucket's keys, in the keys' order."""
    where = bucket_of(keys, buckets)
    order = np.argsort(where, kind="stable")
    return np.split(order, np.searchsorted(where[order], np.arange(1, buckets)))


def ask(docs: DataFrame, level: Unigrams, buckets: int, rare_buckets: int) -> DataFrame:
    """Rows kind, bucket, chunk, a, b: a chunk's documents (kind docs: ids, rare words' hashes; its doc_ids and lengths in
    `names`), its distinct bigrams of words with ids by bucket with counts (kind bigram), and its distinct rare words
    and bigrams with one (kind rare: frames of keys and counts)."""
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        model, known, part, made = shared.value, WordHashes(), TaskContext.get().partitionId(), 0
        names, hashes, size = [], [], 0

        def flush():
            chunk = part << 32 | made
            lengths = np.array([len(h) + 1 for h in hashes], np.int64)
            ends_at = np.cumsum(lengths) - 1
            is_end = np.zeros(int(lengths.sum()), bool)
            is_end[ends_at] = True
            ids, flat = np.empty(len(is_end), np.int64), np.concatenate(hashes)
            ids[is_end], ids[~is_end] = END, model.ids(flat)
            rare = flat[ids[~is_end] == RARE]
            train = np.repeat(np.array([not held_out(d) for d in names]), lengths)
            rows = [("docs", -1, pack(ids.astype("<u4")), pack(rare), pack_ids(names), lengths.tolist())]
            keys, plain = plain_keys(ids, ends_at)
            u, inverse = np.unique(keys, return_inverse=True)
            c = np.bincount(inverse, train[plain], len(u)).astype("<u4")
            del keys, plain, inverse
            for k, mine in enumerate(dealt(u, buckets)):
                if len(mine):
                    rows.append(("bigram", k, pack_sorted(u[mine]), pack(c[mine]), None, []))
            u, inverse = np.unique(rare, return_inverse=True)
            asked = [(dealt(u, rare_buckets), [u], np.bincount(inverse, train[ids == RARE], len(u)).astype("<u4"))]
            for owner, other, at in rare_bigrams(ids, rare).values():
                x, y, inverse = distinct_pairs(owner, other)
                asked.append((dealt(x, rare_buckets), [x, y], np.bincount(inverse, train[at], len(x)).astype("<u4")))
            for k in range(rare_buckets):
                if len(asked[0][0][k]):  # a bigram's owner is among the words
                    parts = [[pack_sorted(key[0][m[k]]), *(pack(y[m[k]]) for y in key[1:]), pack(c[m[k]])] for m, key, c in asked]
                    rows.append(("rare", k, frames(sum(parts, [])), b"", None, []))
            kinds, ks, a, b, n, ls = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(kinds), pa.array(ks, pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.binary()), pa.array(ls, pa.list_(pa.int64()))],
                names=["kind", "bucket", "chunk", "a", "b", "names", "lengths"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch), strict=True):
                words = text.lower().split()
                names.append(doc_id)
                hashes.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
                size += len(words) + 1
                if size >= CHUNK_TOKENS:
                    yield flush()
                    names, hashes, size, made = [], [], 0, made + 1
        if names:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "kind string, bucket int, chunk long, a binary, b binary, names binary, lengths array<long>")


def counts_of_counts(totals: np.ndarray) -> bytes:
    return np.bincount(np.minimum(totals, CUTOFF + 2).astype(np.int64), minlength=CUTOFF + 3).astype("<u8").tobytes()


def answer(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket: its table of totals (chunk null), counts of counts, and an answer for each chunk."""
    kind, bucket = rows["kind"].iloc[0], rows["bucket"].iloc[0]
    if kind == "rare":
        return answer_rare(rows, bucket)
    keys = [unpack_sorted(x) for x in rows["a"]]
    u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(inverse, np.concatenate([unpack(x) for x in rows["b"]]), len(u)).astype("<u8")
    asked = np.split(totals[inverse], np.cumsum([len(k) for k in keys])[:-1])
    seen = totals > 0
    out = [("table", kind, bucket, None, pack_sorted(u[seen]), pack(totals[seen])), ("stat", kind, bucket, None, counts_of_counts(totals), b"")]
    out += [("answer", kind, bucket, chunk, pack(t), b"") for chunk, t in zip(rows["chunk"], asked, strict=True)]
    return pd.DataFrame(out, columns=["part", "kind", "bucket", "chunk", "a", "b"])


def answer_rare(rows: pd.DataFrame, bucket: int) -> pd.DataFrame:
    """A bucket of rare words. Its tables, by fr, rr and rf: histories, and frames of their bigrams' totals and what p1 of the
    second word needs, its count if it is rare, else its id. A chunk's answer: frames of totals of words, fr, rr, rf."""
    asked = [unframe(x) for x in rows["a"]]

    def column(k: int, of=unpack) -> tuple[np.ndarray, np.ndarray]:
        parts = [of(x[k]) for x in asked]
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])[:-1]

    words, cuts = column(0, unpack_sorted)
    u, inverse = np.unique(words, return_inverse=True)
    seen_words = np.bincount(inverse, column(1)[0], len(u)).astype("<u8")
    told, out = [np.split(seen_words[inverse], cuts)], []
    for k, kind in enumerate(("fr", "rr", "rf")):
        owner, cuts = column(2 + 3 * k, unpack_sorted)
        x, y, inverse = distinct_pairs(owner, column(3 + 3 * k)[0])
        totals = np.bincount(inverse, column(4 + 3 * k)[0], len(x)).astype("<u8")
        told.append(np.split(totals[inverse], cuts))
        seen = totals > 0
        x, y = x[seen], y[seen]
        history, second = (x, y) if kind == "rf" else (y, seen_words[np.searchsorted(u, x)])
        out += [("table", kind, bucket, None, pack(history), frames([pack(totals[seen]), pack(second)])), ("stat", kind, bucket, None, counts_of_counts(totals), b"")]
    out += [("answer", "rare", bucket, chunk, frames([pack(t[n]) for t in told]), b"") for n, chunk in enumerate(rows["chunk"])]
    return pd.DataFrame(out, columns=["part", "kind", "bucket", "chunk", "a", "b"])


def history_sums(tables: DataFrame, level: Unigrams, d: np.ndarray, buckets: int = 1) -> DataFrame:
    """h, bucket, c, kept, seen: by history, parts of the count, of what discounts leave of it, and of p1 of what was seen
    behind it. tables: kind, a, b. A rare history (rr, rf) is a hash, others are ids."""
    shared = tables.sparkSession.sparkContext.broadcast((level, d))

    def run(frames_):
        one, d = shared.value
        for f in frames_:
            for kind, a, b in f.itertuples(index=False, name=None):
                if kind == "bigram":
                    keys, c = unpack_sorted(a), unpack(b).astype(np.int64)
                    h, p1 = keys >> np.uint64(32), one.p1[(keys & np.uint64(START)).astype(np.int64)]
                else:
                    h, (c, second) = unpack(a), (unpack(x).astype(np.int64) for x in unframe(b))
                    p1 = one.p1[second] if kind == "rf" else one.p1_of_rare(second)
                if len(h):
                    h, inverse = np.unique(h, return_inverse=True)
                    add = lambda x, i=inverse, n=len(h): np.bincount(i, x, n)
                    yield pd.DataFrame({"h": h.view(np.int64), "bucket": bucket_of(h, buckets), "c": add(c).astype(np.int64), "kept": add(discounted(c, d)), "seen": add(p1)})

    return tables.select("kind", "a", "b").mapInPandas(run, "h long, bucket int, c long, kept double, seen double")


def weights(c: np.ndarray, kept: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """scale and alpha of histories by their sums."""
    open_p, left = 1 - seen, 1 - kept / c
    all_seen, whole = open_p < 1e-9, left < 1e-9  # every event was seen after h; no count was discounted
    scale = np.where(all_seen, c / kept, np.where(whole, c / (c + 1) * c / kept, 1.0))
    return scale, np.where(all_seen, 0.0, np.where(whole, 1 / (c + 1), left) / np.where(all_seen, 1.0, open_p))


def answer_histories(sums: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """One bucket of rare histories: to each chunk frames of the count, scale and alpha of its rare words, in its order."""
    u, inverse = np.unique(sums["h"].to_numpy().astype(np.int64).view(np.uint64), return_inverse=True)
    c, kept, seen = (np.bincount(inverse, sums[k].to_numpy().astype(float), len(u)) for k in ("c", "kept", "seen"))
    numbers = (c, *weights(c, kept, seen)) if len(u) else ()
    out = []
    for bucket, chunk, a in asked[["bucket", "chunk", "a"]].itertuples(index=False, name=None):
        words = unpack_sorted(unframe(a)[0])
        at = np.minimum(np.searchsorted(u, words), max(len(u) - 1, 0))
        found = u[at] == words if len(u) else np.zeros(len(words), bool)
        told = [np.full(len(words), x, float) for x in (0, 1, 1)]
        for t, x in zip(told, numbers, strict=False):
            t[found] = x[at[found]]
        out.append(("answer", "history", bucket, chunk, frames([pack(t) for t in told]), b""))
    return pd.DataFrame(out, columns=["part", "kind", "bucket", "chunk", "a", "b"])


class Backoff:
    """The second level's numbers by history with an id. more: the fr tables, in which such a history precedes a rare word."""

    def __init__(self, level: Unigrams, table: DataFrame, histogram: np.ndarray, more: DataFrame | None = None):
        self.d = discounts(histogram[: CUTOFF + 2].astype(float))
        tables = table.select(F.lit("bigram").alias("kind"), "a", "b")
        per = history_sums(tables if more is None else tables.union(more.select("kind", "a", "b")), level, self.d)
        # a row a class at most; START, which no class has, is the last
        found = per.groupBy("h").agg(F.sum("c").alias("c"), F.sum("kept").alias("kept"), F.sum("seen").alias("seen")).toArrow()
        column = lambda k: found[k].to_numpy().astype(float)
        size = len(level.p1) + 1
        h = self.row(found["h"].to_numpy().astype(np.int64), size)
        self.c, self.scale, self.alpha = np.zeros(size), np.ones(size), np.ones(size)
        self.c[h] = column("c")
        self.scale[h], self.alpha[h] = weights(column("c"), column("kept"), column("seen"))

    @staticmethod
    def row(history: np.ndarray, size: int) -> np.ndarray:
        return np.where(history == START, size - 1, history)

    def log10(self, level: Unigrams, history: np.ndarray, cls: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 p2(cls | history), recursing to p1 where the bigram was not seen."""
        history = self.row(history, len(self.c))
        return self.log10_of(counts, level.p1[cls], self.alpha[history], lambda seen: (self.c[history[seen]], self.scale[history[seen]]))

    def log10_of(self, counts: np.ndarray, p1: np.ndarray, alpha: np.ndarray, of_seen) -> np.ndarray:
        """The same by a bigram's count, p1 and its history's alpha; of_seen tells counts and scales of some histories."""
        seen, p = counts > 0, alpha * p1
        c, scale = of_seen(seen)
        p[seen] = scale * discounted(counts[seen], self.d) / c
        return np.log10(np.maximum(p, 1e-300))


def score(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    words = scratch.cut(word_counts(docs), "words")
    flagged = docs.select("doc_id").withColumn("s", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    train_docs = flagged.where(F.crc32(F.col("s").cast("binary")) % 5 != 1).count()
    level = Unigrams(words, train_docs)
    buckets = int(max(8, -(-level.tokens // BUCKET_TOKENS)))  # more tokens, more buckets of one size
    rare_tokens = level.tokens - level.ends - int(level.counts.sum())
    rare_buckets = int(max(8, -(-rare_tokens // RARE_BUCKET_TOKENS)))
    asked = scratch.cut(ask(docs, level, buckets, rare_buckets), "asked", partition_by=["kind"])
    schema = "part string, kind string, bucket int, chunk long, a binary, b binary"
    replies = asked.where("kind <> 'docs'").select("kind", "bucket", "chunk", "a", "b").groupBy("kind", "bucket").applyInPandas(answer, schema)
    replies = scratch.cut(replies, "replies", partition_by=["part"])
    scratch.remove(f"{asked._scratch_path}/kind=bigram")  # answered
    histogram = sum((np.frombuffer(r["a"], "<u8") for r in replies.where("part = 'stat'").select("a").collect()), np.zeros(CUTOFF + 3))
    tables = replies.where("part = 'table'")
    backoff = Backoff(level, tables.where("kind = 'bigram'"), histogram, tables.where("kind = 'fr'"))
    of_rare = history_sums(tables.where("kind in ('rr', 'rf')"), level, backoff.d, rare_buckets).groupBy("bucket")
    of_rare = of_rare.cogroup(asked.where("kind = 'rare'").select("bucket", "chunk", "a").groupBy("bucket"))
    histories = scratch.cut(of_rare.applyInPandas(answer_histories, schema), "histories")
    for path in (f"{asked._scratch_path}/kind=rare", f"{replies._scratch_path}/part=table"):
        scratch.remove(path)  # only the documents and the answers are read again
    shared = docs.sparkSession.sparkContext.broadcast((level, backoff, buckets, rare_buckets))

    def evaluate(rows: pd.DataFrame) -> pd.DataFrame:
        one, two, n_buckets, n_rare = shared.value
        doc = rows[rows["kind"] == "docs"].iloc[0]
        ids, rare = unpack(doc["a"]).astype(np.int64), unpack(doc["b"])
        lengths = np.asarray(doc["lengths"], np.int64)
        ends_at = np.cumsum(lengths) - 1

        def told(kind: str, keys: np.ndarray, n: int, of=unpack, dtype=np.int64) -> np.ndarray:
            """The answers for distinct keys in order."""
            out, mine = np.zeros(len(keys), dtype), dealt(keys, n)
            for k, a in rows.loc[rows["kind"] == kind, ["bucket", "a"]].itertuples(index=False):
                out[mine[k]] = of(a)
            return out

        keys, plain = plain_keys(ids, ends_at)
        u, inverse = np.unique(keys, return_inverse=True)
        logs = np.zeros(len(ids))
        logs[plain] = two.log10(one, (keys >> np.uint64(32)).astype(np.int64), ids[plain], told("bigram", u, n_buckets)[inverse])
        del keys, plain, u, inverse
        counts = np.zeros(len(ids), np.int64)
        counts[ids >= FIRST_WORD] = one.counts[ids[ids >= FIRST_WORD] - FIRST_WORD]
        counts[ids == END] = one.ends
        words, inverse = np.unique(rare, return_inverse=True)
        counts[ids == RARE] = told("rare", words, n_rare, lambda a: unpack(unframe(a)[0]))[inverse]
        numbers = [told("history", words, n_rare, lambda a, k=k: unpack(unframe(a)[k]).view("<f8"), float) for k in range(3)]
        for k, (kind, (owner, other, at)) in enumerate(rare_bigrams(ids, rare).items(), 1):
            x, y, inverse = distinct_pairs(owner, other)
            total = told("rare", x, n_rare, lambda a, k=k: unpack(unframe(a)[k]))[inverse]
            if kind == "fr":
                history = two.row(other.astype(np.int64), len(two.c))
                c, scale, alpha = (n[history] for n in (two.c, two.scale, two.alpha))
            else:
                history = np.searchsorted(words, owner if kind == "rf" else other)
                c, scale, alpha = (n[history] for n in numbers)
            p1 = one.p1[ids[at]] if kind == "rf" else one.p1_of_rare(counts[at])
            logs[at] = two.log10_of(total, p1, alpha, lambda seen, c=c, scale=scale: (c[seen], scale[seen]))
        starts = np.concatenate([[0], ends_at[:-1] + 1])
        per = lambda x: np.add.reduceat(x, starts)
        names = unpack_ids(doc["names"])
        return pd.DataFrame({
            "doc_id": pd.array(names, "Int64"), "held_out": list(map(held_out, names)), "n_tokens": lengths, "n_known": per((counts > 0).astype(np.int64)),
            "train_tokens": one.tokens, "base_score": per(one.base(counts)), "score": per(logs),
        })

    columns = ["kind", "bucket", "chunk", "a", "b", "names", "lengths"]
    answers = replies.where("part = 'answer'").select("kind", "bucket", "chunk", "a", "b").unionByName(histories.select("kind", "bucket", "chunk", "a", "b"))
    told = answers.withColumns({"names": F.lit(None).cast("binary"), "lengths": F.lit(None).cast("array<long>")})
    rows = asked.where("kind = 'docs'").select(columns).unionByName(told.select(columns))
    return rows.groupBy("chunk").applyInPandas(evaluate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
