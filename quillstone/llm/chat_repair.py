"""Repair of conversation structure by the cheapest edits.

A conversation is read as a graph: a node is a place between two rows and a state of the role grammar
`(s?(ua)+)?`; an arc is an edit of the next row (Delete, Keep, Rerole to user or assistant) or an Insert in
front of it. Minimum costs from the start (forward) and to the end (backward) tell which arcs are
tight, that is, lie on a cheapest path; going through the tight arcs with a frontier of states and taking
the least letter that any of them has gives the ASCII-least of all cheapest edit strings. (In this grammar
a letter decides the next state, so the frontier holds one state.)

No task holds a conversation. Rows are dealt out by ranges of (conversation, turn); what lies of a
conversation in one range is a block. A block's rows compose to a small (min, +) matrix, a conversation's
matrices are folded forward and backward, and with both costs at its borders each block finds its steps for
every entry state on a cheapest path; the blocks' exit states are then chained. Cost vectors up to a constant
are few, so a step is a dictionary look-up. Only digests go through a conversation in order, streaming.

Order within a turn: by role, then a 64-bit hash of the text; a row's copies stay together.

Defined results: null roles and texts count as one space; a null turn sorts first and is no gap; rows without
a conversation form one; initials other than s, u, a are in no legal conversation, so such rows go or
get a new role; rows marked `gone` only keep their conversation in the result; an empty table gives no
rows; repeated rows are duplicates; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.common import Scratch, slices

SPACES = " \t\n\x0b\x0c\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
NAMES = {"u": "user", "a": "assistant"}
_INF = 1 << 50
_GONE = 16
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class Editor:
    """The grammar's states, what edits cost, and single steps of both searches."""

    #: After nothing, s, u and a; per state the next one by initial, and the initial that Insert and Rerole write.
    ARCS = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    WRITES = ["u", "u", "a", "u"]
    FINAL = (0, 3)
    INITIALS = "sua"

    def __init__(self, rerole: int = 1, delete: int = 2, insert: int = 5, truncated: int = 5):
        self.rerole, self.delete, self.insert, self.truncated = rerole, delete, insert, truncated
        self.vectors: list[tuple[int, ...]] = []
        self.known: dict[tuple[int, ...], int] = {}
        self.memory: dict = {}
        self.end = self.hold(self.inserted([0 if q in self.FINAL else _INF for q in range(4)]))[0]

    def hold(self, costs: list[int]) -> tuple[int, int]:
        """A vector's number and the constant taken off it."""
        least = min(costs)
        key = tuple(min(c - least, _INF) for c in costs)
        if key not in self.known:
            self.known[key] = len(self.vectors)
            self.vectors.append(key)
        return self.known[key], least

    def row_arcs(self, state: int, symbol: int):
        """Edits of a row at a state, in the order of their letters: letter, role written, cost, next state."""
        initial, fault = divmod(symbol, 4)
        yield "D", "", self.delete, state
        if fault not in (BLANK, DUPLICATE):
            own = self.INITIALS[initial] if initial < 3 else ""
            late = self.truncated if fault == TRUNCATED else 0
            if own in self.ARCS[state]:
                yield "K", "", late, self.ARCS[state][own]
            writes = self.WRITES[state]
            yield "R", writes, self.rerole + late, self.ARCS[state][writes]

    def inserted(self, after: list[int]) -> list[int]:
        """Costs to the end where Inserts may come first."""
        after = list(after)
        for _ in range(4):
            for q in range(4):
                after[q] = min(after[q], self.insert + after[self.ARCS[q][self.WRITES[q]]])
        return after

    def forward(self, vector: int, symbol: int) -> tuple[int, int]:
        if (found := self.memory.get((vector, symbol))) is None:
            before, after = list(self.vectors[vector]), [_INF] * 4
            if symbol == _GONE:
                after = before
            else:
                for _ in range(4):
                    for q in range(4):
                        to = self.ARCS[q][self.WRITES[q]]
                        before[to] = min(before[to], before[q] + self.insert)
                for q in range(4):
                    for _, _, cost, to in self.row_arcs(q, symbol):
                        after[to] = min(after[to], before[q] + cost)
            found = self.memory[vector, symbol] = self.hold(after)
        return found

    def backward(self, vector: int, symbol: int) -> int:
        if (found := self.memory.get((vector, symbol, "back"))) is None:
            after = self.vectors[vector]
            best = list(after) if symbol == _GONE else self.inserted([min(cost + after[to] for _, _, cost, to in self.row_arcs(q, symbol)) for q in range(4)])
            found = self.memory[vector, symbol, "back"] = self.hold(best)[0]
        return found

    def step(self, vector: int, symbol: int, state: int) -> tuple[str, int]:
        """From the costs to the end behind a row: the least tight letters at a state (each I and R followed by the
        initial written), and the state behind the row."""
        if (found := self.memory.get((vector, symbol, state))) is None:
            after, letters = self.vectors[vector], ""
            rows = lambda q: [(letter, role, cost + after[to], to) for letter, role, cost, to in self.row_arcs(q, symbol)]
            best = self.inserted([min(x[2] for x in rows(q)) for q in range(4)])
            start = state
            while symbol != _GONE:
                writes = self.WRITES[state]
                tight = [x for x in rows(state) if x[2] == best[state]]
                over = self.ARCS[state][writes]
                if self.insert + best[over] == best[state]:
                    tight.append(("I", writes, 0, over))
                letter, role, _, state = min(tight)
                letters += letter + role
                if letter != "I":
                    break
            found = self.memory[vector, symbol, start] = (letters, state)
        return found

    def tail(self, state: int) -> str:
        """The Inserts behind the last row."""
        letters = ""
        while state not in self.FINAL:
            letters += "I" + self.WRITES[state]
            state = self.ARCS[state][self.WRITES[state]]
        return letters


def damaged(messages: DataFrame) -> DataFrame:
    """The fixed damage of the query: by crc32(conv_id:turn) % 20, rows go, lose text or stops, repeat, or turn user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(name("text"), ".!?", "")).otherwise(name("text"))
    return messages.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(name("role")).alias("role"),
        text.alias("text"), (kind == 0).alias("gone"), F.explode(copies).alias("copy"),
    )


def _symbols(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """Slim rows: their number in order, conversation, turn and symbol (initial * 4 + fault, or gone)."""
    same = rows.filter(~F.col("gone")).groupBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256)).agg(F.min("row").alias("row"))
    firsts = same.select("row", F.lit(True).alias("first"))
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = (
        F.when(trimmed == "", BLANK).when(F.col("first").isNull(), DUPLICATE)
        .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    )
    initial = F.coalesce(F.expr("nullif(instr('sua', substring(role, 1, 1)), 0)"), F.lit(4)) - 1
    initial = F.when(F.col("role") == "", 3).otherwise(initial)
    symbol = F.when(F.col("gone"), _GONE).otherwise(initial * 4 + fault).cast("int")
    return scratch.cut(rows.join(firsts, "row", "left").select("row", "conv_id", "turn", symbol.alias("symbol")), "symbols")


def _in_order(rows: DataFrame, *then: str) -> DataFrame:
    """Ranges as they were numbered, each whole in a task and in order."""
    return rows.repartition(F.shiftright("row", 33)).sortWithinPartitions("row", *then)


def _summaries(symbols: DataFrame, editor: Editor) -> DataFrame:
    """A row per block: its matrix, and what counts and gaps need."""
    counts = ["n", "first", "last", "illegal", "blank", "duplicate", "truncated", "low", "high", "turns"]
    schema = T.StructType([T.StructField("block", T.LongType()), symbols.schema["conv_id"], T.StructField("matrix", T.ArrayType(T.LongType())), *(T.StructField(c, T.LongType()) for c in counts)])
    legal = {(0, 1), (1, 2), (2, 1)}

    def run(batches):
        out, held, key = [], None, None

        def closed():
            ends = []
            for vector, cost in held.pop("paths"):
                ends += [c + cost for c in editor.vectors[vector]]
            out.append(held | {"matrix": ends})

        names = ["block", "conv_id", "matrix", *counts]
        arrow = None
        for batch in batches:
            arrow = batch.schema.field("conv_id").type
            for row, conv, turn, symbol in zip(*(batch.column(c).to_pylist() for c in ("row", "conv_id", "turn", "symbol")), strict=True):
                if held is None or key != (row >> 33, conv):
                    if held:
                        closed()
                    key = (row >> 33, conv)
                    unit = [editor.hold([0 if q == e else _INF for q in range(4)]) for e in range(4)]
                    held = dict.fromkeys(names) | {"block": row, "conv_id": conv, "n": 0, "illegal": 0, "blank": 0, "duplicate": 0, "truncated": 0, "turns": 0, "paths": unit}
                if symbol == _GONE:
                    continue
                held["paths"] = [(to, cost + more) for v, cost in held["paths"] for to, more in [editor.forward(v, symbol)]]
                initial, fault = divmod(symbol, 4)
                held["illegal"] += held["n"] > 0 and (held["last"], initial) not in legal
                held["first"] = initial if not held["n"] else held["first"]
                held["last"] = initial
                held["n"] += 1
                if fault:
                    held[("blank", "duplicate", "truncated")[fault - 1]] += 1
                if turn is not None:
                    held["turns"] += held["high"] != turn
                    held["low"] = turn if held["low"] is None else held["low"]
                    held["high"] = turn
            if len(out) >= 2048:
                yield _batch(out, names, arrow)
                out.clear()
        if held:
            closed()
            yield _batch(out, names, arrow)

    return _in_order(symbols).mapInArrow(run, schema)


def _batch(rows: list[dict], names: list[str], conv: pa.DataType) -> pa.RecordBatch:
    kinds = {"conv_id": conv, "matrix": pa.list_(pa.int64()), "backward": pa.list_(pa.int64()), "counts": pa.list_(pa.int64()), "entries": pa.list_(pa.int32()), "tail": pa.string(), "entry": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.int64())) for n in names], names=names)


def _by_conversation(blocks: DataFrame, fold, names: list[str], schema: T.StructType) -> DataFrame:
    """Conversations' blocks in order through `fold`; a conversation has one block a range at most."""

    def stream(batches):
        for batch in batches:
            yield from batch.to_pylist()

    def run(batches):
        out, conv = [], None
        first = next(iter_ := iter(batches), None)
        if first is None:
            return
        conv = first.schema.field("conv_id").type

        def all_():
            yield first
            yield from iter_

        for _, group in groupby(stream(all_()), key=lambda r: r["conv_id"]):
            out += fold(list(group))
            if len(out) >= 2048:
                yield _batch(out, names, conv)
                out = []
        if out:
            yield _batch(out, names, conv)

    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(run, schema)


def _borders(blocks: DataFrame, editor: Editor) -> DataFrame:
    """Per block the costs to the end behind it and the entry states on a cheapest path; the first block of a
    conversation has its counts."""

    def fold(group):
        matrices = [[r["matrix"][4 * e : 4 * e + 4] for e in range(4)] for r in group]
        here = [0, _INF, _INF, _INF]
        forward = [here]
        for m in matrices:
            here = [min(here[i] + m[i][j] for i in range(4)) for j in range(4)]
            forward.append(here)
        here = list(editor.vectors[editor.end])
        backward = [here]
        for m in reversed(matrices):
            here = [min(m[i][j] + here[j] for j in range(4)) for i in range(4)]
            backward.append(here)
        backward.reverse()
        cost = backward[0][0]
        live = [r for r in group if r["n"]]
        illegal = sum(r["illegal"] for r in live) + sum((a["last"], b["first"]) not in {(0, 1), (1, 2), (2, 1)} for a, b in zip(live, live[1:], strict=False))
        timed = [r for r in live if r["turns"]]
        turns = sum(r["turns"] for r in timed) - sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:], strict=False))
        gaps = timed[-1]["high"] - timed[0]["low"] + 1 - turns if timed else 0
        counts = [gaps, *(sum(r[c] for r in live) for c in ("blank", "duplicate", "truncated")), illegal, cost]
        for k, r in enumerate(group):
            entries = [q for q in range(4) if forward[k][q] + backward[k][q] == cost]
            yield {"block": r["block"], "conv_id": r["conv_id"], "backward": backward[k + 1], "entries": entries, "counts": None if k else counts}

    long_, int_ = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("block", T.LongType()), blocks.schema["conv_id"], T.StructField("backward", long_), T.StructField("entries", int_), T.StructField("counts", long_)])
    return _by_conversation(blocks, fold, ["block", "conv_id", "backward", "entries", "counts"], schema)


def _steps(symbols: DataFrame, borders: DataFrame, editor: Editor) -> DataFrame:
    """Per row its letters by entry state of its block; a block's last row also has the exit states."""
    rows = symbols.select("row", "symbol", F.lit(None).cast("array<long>").alias("backward"), F.lit(None).cast("array<int>").alias("entries"))
    heads = borders.select(F.col("block").alias("row"), F.lit(-1).alias("symbol"), "backward", "entries")

    def run(batches):
        head, numbers, found = None, [], bytearray()

        def solved():
            vector, behind = editor.hold(head[1])[0], []
            for symbol in reversed(found):
                behind.append(vector)
                vector = editor.backward(vector, symbol)
            behind.reverse()
            states = [q if q in head[2] else None for q in range(4)]
            for start in range(0, len(numbers), 8192):
                letters = []
                for symbol, vector in zip(found[start : start + 8192], behind[start : start + 8192], strict=True):
                    row = [None if q is None else editor.step(vector, symbol, q) for q in states]
                    states = [None if x is None else x[1] for x in row]
                    letters.append([None if x is None else x[0] for x in row])
                part = numbers[start : start + 8192]
                exits = [None] * len(part)
                if start + len(part) == len(numbers):
                    exits[-1] = states
                yield part, [head[0]] * len(part), letters, exits

        def arrow(parts):
            columns = [list(chain.from_iterable(p[k] for p in parts)) for k in range(4)]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["row", "block", "letters", "exits"])

        parts, size = [], 0
        for batch in batches:
            for row, symbol, backward, entries in zip(*(batch.column(c).to_pylist() for c in ("row", "symbol", "backward", "entries")), strict=True):
                if symbol >= 0:
                    numbers.append(row)
                    found.append(symbol)
                    continue
                if head:
                    for part in solved():
                        parts.append(part)
                        size += len(part[0])
                        if size >= 8192:
                            yield arrow(parts)
                            parts, size = [], 0
                head, numbers, found = (row, backward, entries), [], bytearray()
        if head:
            parts += solved()
            for start in range(0, len(parts), 2048):
                yield arrow(parts[start : start + 2048])

    return _in_order(heads.unionByName(rows), "symbol").mapInArrow(run, "row long, block long, letters array<string>, exits array<int>")


def repair(scratch: Scratch, rows: DataFrame, editor: Editor | None = None) -> DataFrame:
    """rows: conv_id, turn, role, text, gone, copy. Returns them with `row` (their place in the order), `letters`
    (their edits; behind each I and R the initial written), `lines` (what is left as role:text) and, in a
    conversation's first row, `counts`: gaps, blank, duplicate, truncated, illegal, cost."""
    editor = editor or Editor()
    keys = ["conv_id", "turn", "role", F.xxhash64("text"), "copy"]
    rows = scratch.cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("row", F.monotonically_increasing_id()), "rows")
    symbols = _symbols(scratch, rows)
    borders = scratch.cut(_borders(_summaries(symbols, editor), editor), "borders")
    steps = scratch.cut(_steps(symbols, borders, editor), "steps")

    def chained(group):
        state = 0
        for k, r in enumerate(group):
            entry, state = state, r["exits"][state]
            tail = editor.tail(state) if k == len(group) - 1 else ""
            yield {"block": r["block"], "conv_id": r["conv_id"], "entry": entry, "tail": tail, "counts": r["counts"]}

    exits = steps.filter(F.col("exits").isNotNull()).select("block", "exits").join(borders.select("block", "conv_id", "counts"), "block")
    kinds = T.StructType([T.StructField("block", T.LongType()), rows.schema["conv_id"], T.StructField("entry", T.IntegerType()), T.StructField("tail", T.StringType()), T.StructField("counts", T.ArrayType(T.LongType()))])
    entries = _by_conversation(exits.select("block", "conv_id", "exits", "counts"), chained, ["block", "conv_id", "entry", "tail", "counts"], kinds).drop("conv_id")
    own = F.element_at("letters", F.col("entry") + 1)
    letters = F.when(F.col("exits").isNotNull(), F.concat(own, "tail")).otherwise(own)
    counts = F.when(F.col("row") == F.col("block"), F.col("counts"))
    edits = steps.join(entries, "block").select("row", letters.alias("letters"), counts.alias("counts"))
    edited = rows.join(edits, "row")
    return edited.withColumn("lines", _lines(F.col("letters"), F.col("role"), F.col("text")))


def _lines(letters: Column, role: Column, text: Column) -> Column:
    """What edits leave, as role:text."""
    edits = F.filter(F.regexp_extract_all(letters, F.lit("([IR][ua]|[KD])"), 1), lambda e: e != "D")
    name = lambda e: F.when(F.substring(e, 2, 1) == "u", NAMES["u"]).otherwise(NAMES["a"])
    written = lambda e: F.when(e == "K", F.concat(role, F.lit(":"), text)).when(e.startswith("R"), F.concat(name(e), F.lit(":"), text)).otherwise(F.concat(name(e), F.lit(":")))
    return F.transform(edits, written)


def digests(edits: DataFrame) -> DataFrame:
    """A row per conversation: the counts, the audit string, and the sha256 of the repaired lines, each
    conversation streamed in order."""
    slim = edits.select("conv_id", "row", F.regexp_replace("letters", "[ua]", "").alias("audit"), "lines", "counts")
    schema = T.StructType([slim.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches):
        out, key, held, conv = [], None, None, None

        def flush():
            columns = list(zip(*[(k, *counts, audit.getvalue(), sha.hexdigest()) for k, counts, audit, sha in out], strict=True))
            kinds = [conv, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

        for batch in slices(batches):
            conv = batch.schema.field("conv_id").type
            for k, audit, lines, counts in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "lines", "counts")), strict=True):
                if held is None or k != key:
                    if len(out) >= 2048:
                        yield flush()
                        out = []
                    key, held = k, (k, counts, io.StringIO(), hashlib.sha256())
                    out.append(held)
                    empty = True
                held[2].write(audit)
                for line in lines:
                    held[3].update(line.encode() if empty else b"\n" + line.encode())
                    empty = False
        if out:
            yield flush()

    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "row").drop("row").mapInArrow(run, schema)
