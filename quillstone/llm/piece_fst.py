"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file into state tables: the normaliser (a trie of the
model's character map that rewrites the longest match, dummy space and white space rules), the pieces
(a trie whose final states emit an id), and byte fallback for characters that no piece has. Composed
with an input they give a lattice, an arc per piece that occurs there. Weights are in the tropical
semiring (min, +) and the encoding is the shortest path. One routine finds it for both model kinds:

* unigram: an arc weighs minus the piece's score (in whole units of 2^-32, so that sums are exact and a
  path's weight doesn't depend on the text before it), whatever piece came before;
* BPE: a path is the model's own encoding exactly if each piece is what merging makes of its text and
  each neighbouring pair stays a pair when merging its joint text. So the state is the last piece, and
  the pair automaton weighs an arc 0 when the pair is stable and infinite otherwise. One path of finite
  weight is left, to every place in the text, so a state that has reached 0 needs no other arc.

Units (spaces with the word after them) never share a piece, so units are solved one by one and
remembered; a model whose pieces cross spaces takes whole texts. Decoding maps ids to pieces, byte
pieces to bytes.

Defined results: a null or empty text has no pieces; the visible space in a text is read as a
space; ids are 16-bit little-endian (32-bit for models of more than 65,536 pieces); repeated rows
repeat; other columns pass through, and an added column whose name a caller's column has is named with
a "_" behind it.
"""

from __future__ import annotations

import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from quillstone.llm.common import slices, text_bytes
from quillstone.llm.vocabularies import Remembered, fine_units, plain_units, shared

VISIBLE = "\u2581"
NORMAL, USER_DEFINED, BYTE, UNIGRAM, BPE = 1, 4, 6, 1, 2
_INF = math.inf
_WEIGHT_LIMIT = 200_000
#: States of characters without a piece; ids of pieces are below.
_CHARACTERS = 1 << 20
#: What a character without a piece costs over the worst piece; fixed value.
_UNKNOWN_PENALTY = 10.0


class Trie:
    """State tables: per state its arcs by symbol and what it emits (None if it is not final)."""

    def __init__(self, entries: dict):
        self.next: list[dict] = [{}]
        self.emits: list = [None]
        for key, value in entries.items():
            state = 0
            for symbol in key:
                arcs = self.next[state]
                if symbol not in arcs:
                    arcs[symbol] = len(self.next)
                    self.next.append({})
                    self.emits.append(None)
                state = arcs[symbol]
            self.emits[state] = value


def character_map(blob: bytes) -> dict[bytes, bytes]:
    """The entries of a model's precompiled map: a double array of 32-bit units, then the replacements.

    A unit holds a label (low 8 bits), whether a value hangs below it (bit 8) and the offset to its
    children (bits 10 on, times 256 if bit 9 is set); a value unit has its top bit set.
    """
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    array, texts = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :]
    offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
    found, open_ = {}, [(b"", int(offset(array[0])))]
    while open_:
        key, base = open_.pop()
        for label in range(1, 256):
            at = base ^ label
            if at < len(array) and array[at] & 0x800000FF == label:
                unit, child = int(array[at]), key + bytes([label])
                below = at ^ int(offset(unit))
                if unit >> 8 & 1:
                    start = int(array[below]) & 0x7FFFFFFF
                    found[child] = texts[start : texts.index(b"\0", start)]
                open_.append((child, below))
    return found


class Normaliser:
    """Rewrites a text as the model wants it, spaces as spaces; the visible space counts as one."""

    def __init__(self, spec):
        entries = character_map(spec.precompiled_charsmap)
        self.trie = Trie(entries) if entries else None
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces

    def __call__(self, text: bytes) -> bytes:
        if self.trie:
            text = self._rewritten(text)
        text = text.replace(VISIBLE.encode(), b" ")
        if self.squeeze:
            text = re.sub(rb" +", b" ", text).strip(b" ")
        return b" " + text if self.dummy and text else text

    def _rewritten(self, text: bytes) -> bytes:
        arcs, emits, out, at, n = self.trie.next, self.trie.emits, [], 0, len(text)
        while at < n:
            state, end, best = 0, at, None
            while end < n and (state := arcs[state].get(text[end])) is not None:
                end += 1
                if emits[state] is not None:
                    best = (end, emits[state])
            if best is None:  # a character stays as it is
                end = at + 1
                while end < n and text[end] & 0xC0 == 0x80:
                    end += 1
                best = (end, text[at:end])
            at = best[0]
            out.append(best[1])
        return b"".join(out)


class Transducer:
    def __init__(self, model: bytes):
        m = model_pb2.ModelProto()
        m.ParseFromString(model)
        if m.trainer_spec.treat_whitespace_as_suffix or not m.normalizer_spec.escape_whitespaces or m.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models with spaces in front of words are compiled")
        self.bpe = m.trainer_spec.model_type == BPE
        self.normalise = Normaliser(m.normalizer_spec)
        self.pieces = {p.piece: (k, p.score) for k, p in enumerate(m.pieces) if p.type in (NORMAL, USER_DEFINED)}
        self.bytes = {int(p.piece[1:-1], 16): k for k, p in enumerate(m.pieces) if p.type == BYTE}
        if len(self.bytes) < 256:
            raise ValueError("the model has no byte fallback")
        self.width = 2 if len(m.pieces) <= 1 << 16 else 4
        self.text = [p.piece.replace(VISIBLE, " ").encode() for p in m.pieces]
        for b, k in self.bytes.items():
            self.text[k] = bytes([b])
        self.is_byte = np.zeros(len(m.pieces), bool)
        self.is_byte[list(self.bytes.values())] = True
        scores = [s for _, s in self.pieces.values()]
        self.fallback = self.whole(min(scores, default=0.0) - _UNKNOWN_PENALTY)  # weight of a character by its bytes
        #: Pieces that can be on a path: of a BPE model, those that merging makes of their own text.
        self.proper = {p: k for p, (k, _) in self.pieces.items() if not self.bpe or self.merged(p) == [p]}
        self.trie = Trie(self.proper)
        #: When a piece comes into being, and of what: (order, left part, right part). Characters are
        #: there from the start. Runs of spaces tie in order and are left out.
        self.born = {p: (-_INF, "", "") if len(p) == 1 else (-self.pieces[p][1], *self.merged(p, 2)) for p in self.proper if self.bpe and (len(p) == 1 or set(p) != {VISIBLE})}
        #: Weights of arcs by last piece << 22 | piece; of a unigram model all, by piece alone. A piece that
        #: the user defined always wins over others.
        top = max(scores, default=0.0)
        own = {k for k, p in enumerate(m.pieces) if p.type == USER_DEFINED}
        self.fixed = {} if self.bpe else {k: self.whole(len(p) * top - 0.1 if k in own else s) for p, (k, s) in self.pieces.items()}
        self.weights = dict(self.fixed)
        #: A weight below which no path can get; a state that has it needs no other arc.
        self.floor = 0.0 if self.bpe else -_INF
        if any(VISIBLE in p.lstrip(VISIBLE) for p in self.pieces):
            self.split = lambda t: [t] if t else []
        else:  # finer units where the model has no piece across their borders
            self.split = plain_units if any(re.search("[A-Za-z][.,]|\n", p) for p in self.pieces) else fine_units

    @staticmethod
    def whole(score: float) -> int:
        return round(-score * 2**32)

    def merged(self, text: str, least: int = 1) -> list[str]:
        """What merging makes of a short text, or what it is when `least` parts are left: always the
        best-scored pair, leftmost first."""
        parts = list(text)
        while len(parts) > least:
            best, at = -_INF, -1
            for k in range(len(parts) - 1):
                found = self.pieces.get(parts[k] + parts[k + 1])
                if found and found[1] > best:
                    best, at = found[1], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stable(self, left: str, right: str) -> bool:
        """The pair automaton: do the two stay apart when their joint text is merged?

        Followed back in time, the later-born of the two neighbours falls apart first. A piece across
        the border would have been made if it is due while both neighbours of a moment are there; a
        tie goes to the left.
        """
        born, pieces = self.born, self.pieces
        x, y = born.get(left), born.get(right)
        if not x or not y:
            return self.merged(left + right) == [left, right]
        until_x = until_y = _INF
        while True:
            across = pieces.get(left + right)
            if across and -across[1] < until_x and -across[1] <= until_y:
                return False
            if x[0] > y[0]:
                until_x, left = x[0], x[2]
                x = born.get(left)
            elif y[1]:
                until_y, right = y[0], y[1]
                y = born.get(right)
            else:
                return True

    def _weigh(self, left: str, right: str, key: int) -> float:
        """The weight of an arc that is not known yet: of a pair, or of a character by its bytes."""
        if len(self.weights) > _WEIGHT_LIMIT + len(self.fixed):
            self.weights = dict(self.fixed)
        w = (0.0 if not left or self.stable(left, right) else _INF) if self.bpe else self.fallback
        self.weights[key] = w
        return w

    def shortest_path(self, text: str) -> list[str]:
        """The pieces (or characters to be given by their bytes) on the path of least weight.

        A state is a place in the text, with the piece that ends there on the best path to it: a BPE
        model has one finite path to each place, and a unigram model forgets the piece. Of paths of equal weight the
        one with the longest last piece stays, and so on backward.
        """
        arcs, emits, bpe, floor, n = self.trie.next, self.trie.emits, self.bpe, self.floor, len(text)
        total, last, back = [0] + [_INF] * n, [0] * (n + 1), [0] * (n + 1)
        for start in range(n):
            base = total[start]
            if base == _INF:
                continue
            state, end, before = 0, start, last[start] << 22 if bpe and start else 0
            single = False
            while end < n:
                state = arcs[state].get(text[end])
                if state is None:
                    break
                end += 1
                piece = emits[state]
                if piece is None:
                    continue
                single = single or end == start + 1
                if total[end] > floor:
                    key = before | piece
                    w = self.weights.get(key) if start or not bpe else 0.0
                    if w is None:
                        w = self._weigh(text[back[start] : start], text[start:end], key)
                    if base + w < total[end]:
                        total[end], last[end], back[end] = base + w, piece, start
            if not single and total[start + 1] > floor:
                piece = _CHARACTERS + ord(text[start])
                key = before | piece
                w = self.weights.get(key) if start or not bpe else 0.0
                if w is None:
                    w = self._weigh(text[back[start] : start], text[start : start + 1], key)
                if base + w < total[start + 1]:
                    total[start + 1], last[start + 1], back[start + 1] = base + w, piece, start
        out, end = [], n
        while end:
            out.append(text[back[end] : end])
            end = back[end]
        return out[::-1]

    def encode_unit(self, unit: bytes) -> bytes:
        ids = []
        for piece in self.shortest_path(unit.decode().replace(" ", VISIBLE)):
            found = self.proper.get(piece)
            ids += [found] if found is not None else [self.bytes[b] for b in piece.encode()]
        return np.array(ids, f"<u{self.width}").tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """The normalised text of ids, as `normalise` gives it."""
        return b"".join(map(self.text.__getitem__, ids.tolist()))


class Encoder:
    """A transducer and the units that it has solved; one per Python worker."""

    def __init__(self, model: bytes):
        self.machine = Transducer(model)
        self.solved = Remembered(lambda units: list(map(self.machine.encode_unit, units)))

    def many(self, normal: list[bytes]) -> list[bytes]:
        """The ids of each normalised text."""
        return self.solved.many(normal, self.machine.split)


def encode_documents(docs: DataFrame, model: bytes, with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """docs (its text if wanted) with ids (binary, if wanted), n_pieces, n_fallback, ids_crc32 and whether
    decoding the ids gives the normalised text back."""
    added = {"ids": T.BinaryType(), "n_pieces": T.LongType(), "n_fallback": T.LongType(), "ids_crc32": T.LongType(), "decodes": T.BooleanType()}
    if not with_ids:
        added.pop("ids")
    kept = [c for c in docs.columns if with_text or c != "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(None).cast("int").alias("none"))
    slim = docs.select(row.alias("row"), "text")

    def run(batches):
        encoder = shared(("pieces", zlib.crc32(model)), lambda: Encoder(model))
        machine, dtype = encoder.machine, f"<u{encoder.machine.width}"
        for batch in slices(batches):
            normal, rows = list(map(machine.normalise, text_bytes(batch))), []
            for text, raw in zip(normal, encoder.many(normal), strict=True):
                ids = np.frombuffer(raw, dtype)
                rows.append((raw, len(ids), int(machine.is_byte[ids].sum()), zlib.crc32(raw), machine.decode(ids) == text))
            columns = dict(zip(("ids", "n_pieces", "n_fallback", "ids_crc32", "decodes"), zip(*rows, strict=True), strict=True))
            kinds = {"ids": pa.binary(), "decodes": pa.bool_()}
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(columns[c], kinds.get(c, pa.int64())) for c in added)], names=["row", *added])

    out = slim.mapInArrow(run, T.StructType([slim.schema["row"], *(T.StructField(k, v) for k, v in added.items())]))
    names: dict[str, str] = {}
    for c in added:
        names[c] = c
        while names[c] in kept:
            names[c] += "_"
    return out.select(*[F.col("row")[c].alias(c) for c in kept], *[F.col(c).alias(n) for c, n in names.items()])
