"""Fuzzy line dedup by MinHash, with DataFrame functions only.

A line is compared in its normal form: lower case, white space runs as one space, trimmed. Lines
without a word always stay and are not compared. Two lines link when the Jaccard similarity of their
distinct character 5-grams (of a shorter line: the line) is at least 0.8. Of each component of links
one line stays, the first by (doc_id, hash of the text, line number); so does one of exact copies.

Signatures. Shingles are the 5-grams at all positions of lines of up to ALL_TO characters, and from
SOME_FROM characters on those that start with a character of LEAD, a sample by content of about an
eighth; lines between, and long lines with few such characters (other scripts, numbers), have both.
One 64-bit hash a shingle serves all permutations: a band is a run of neighbours in the circle of a
line's sorted hashes. Up to SMALL hashes every one starts a band: at a similarity of 0.8 four fifths
of the union are common, so runs of common ones are long. Of more hashes the first in each of so many
equal intervals starts a band: 12 of five, common with a probability of 0.33 each, and from MANY
hashes on 20 of six (0.26), since long lines that do not link often share five.

Buckets are the lines that share a band. In each, the line with the most exact copies is the hub, and
all others are compared with it. After components are taken, only buckets with several components are
looked at again, and lines of different components are compared there, one of them outside the main
component. Buckets of FINE_FROM lines or more are first split by finer bands (eight neighbours, 40
intervals), so that lines that only share a passage do not meet. In each of these, lines outside the
main component are first compared with one line of it, and components are taken again; in what is
still apart, sizes and 1,024 parities of all 5-grams rule pairs out while they are joined, by an exact
bound. A bucket of copies thus costs a pair a line, not a pair per pair of lines.

Pairs are verified by their shingle hashes, if those of all positions are there. Otherwise these
estimate the similarity; pairs more than SLACK standard deviations below 0.8 go, and the rest is
verified exactly on the 5-grams of both whole lines.

Defined results: null text has no lines and stays null; a null doc_id orders first and is a document
like others; rows that repeat a doc_id with different texts are documents of their own; of rows that
repeat doc_id and text all but one lose all their lines, as copies; an empty table gives an empty
result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch
from quillstone.llm.components import components

GRAM = 5
#: First characters of the shingles of long lines.
LEAD = "[bcdglmpy258]"
ALL_TO, SOME_FROM = 160, 120
#: Long lines with fewer of these shingles, or fewer than one in 50 characters, have all of them too.
FEW = 8
#: Hashes up to which bands of four start at each besides those of five, and up to which each starts a band.
TINY, SMALL, INTERVALS = 10, 20, 12
#: Hashes from which bands are longer.
MANY, MANY_ROWS, MANY_INTERVALS = 41, 6, 20
#: Up to so many times as many they have both, so that they meet lines with fewer.
BOTH = 1.5
#: Lines from which a bucket is split by finer bands, if its lines have FINE_LENGTH characters.
FINE_FROM, FINE_LENGTH, FINE_ROWS, FINE_INTERVALS = 16, 100, 8, 40
#: So many sampled hashes do for finer bands.
FINE_SAMPLE = 100
SLACK = 3.3
SKETCH_WORDS = 16
#: Copies from which on a line is signed once; others are signed copy by copy, which costs no shuffle of their texts.
OFTEN = 100
#: Sides of joins up to so many bytes go to every executor; more are shuffled.
BROADCAST_BYTES = 64 << 20


def flat_text(docs: DataFrame) -> DataFrame:
    """uid, doc_id, rid (hash of the text), flat: the text in lower case, runs of white space inside lines
    as one space. Step by step, so that nothing is computed twice; what is rare is looked for first."""
    flat = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.xxhash64("text").alias("rid"), F.lower("text").alias("flat"))
    odd = F.lit(False)
    for c in "\t\x0b\x0c\r":
        odd = odd | F.col("flat").contains(c)
    flat = flat.withColumn("flat", F.when(odd, F.translate("flat", "\t\x0b\x0c\r", "    ")).otherwise(F.col("flat")))
    return flat.withColumn("flat", F.when(F.col("flat").contains("  "), F.regexp_replace("flat", " {2,}", " ")).otherwise(F.col("flat")))


def split_lines(docs: DataFrame) -> DataFrame:
    """uid, doc_id, rid, pos, line (normal form), node (its hash) of all lines that have a word."""
    lines = flat_text(docs).select("uid", "doc_id", "rid", F.posexplode(F.split("flat", "\n")).alias("pos", "line"))
    return lines.withColumn("line", F.trim("line")).where("line <> ''").withColumn("node", F.xxhash64("line"))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later expressions use several times: the generator keeps Spark from copying
    their expressions into every use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def grams(line: Column, lead: str = "") -> Column:
    """The hashes of a line's distinct 5-grams, or of those that begin with `lead`."""
    found = F.regexp_extract_all(line, F.lit(f"(?s)(?=({lead or '.'}.{{{GRAM - 1}}}))"), F.lit(1))
    found = found if lead else F.when(F.length(line) < GRAM, F.array(line)).otherwise(found)
    return F.array_distinct(F.transform(found, lambda s: F.xxhash64(s)))


def shingles(lines: DataFrame) -> DataFrame:
    """lines with `some` (hashes of sampled 5-grams, null for short lines) and `whole` (of all, null for
    long lines that have enough sampled ones)."""
    size = F.length("line")
    lines = once(lines, some=F.when(size >= SOME_FROM, grams(F.col("line"), LEAD)))
    few = (F.size("some") < FEW) | (F.size("some") * 50 < size)
    return once(lines, whole=F.when((size <= ALL_TO) | few, grams(F.col("line"))))


def bands(hashed: DataFrame, keep: list[str], small: int = SMALL, rows: int = 5, intervals: int = INTERVALS, many: int = 1 << 30) -> DataFrame:
    """The columns `keep` and the key of every band of the distinct hashes in column `hashes`; many: hashes from
    which bands have MANY_ROWS in MANY_INTERVALS.

    Bands are rows, not array elements, so that generated code makes them.
    """
    df = once(hashed.where("hashes is not null"), s=F.sort_array("hashes"))
    # starts from n * TINY on stand for bands of the other length: four in a very short line, MANY_ROWS in a long one
    df = once(df, n=F.size("s"), every=F.sequence(F.lit(0), F.size("s") - 1))
    other = F.transform("every", lambda i: i + F.col("n") * TINY)
    starts = F.when(F.col("n") >= BOTH * many, other).when((F.col("n") >= many) | (F.col("n") <= TINY), F.concat("every", other)).otherwise(F.col("every"))
    each = df.where("n > 0").select(*keep, "s", "n", F.explode(starts).alias("start"))
    each = each.select(*keep, "s", "n", (F.col("start") % F.col("n")).alias("start"), (F.col("start") >= F.col("n")).alias("other"))
    parts = F.when(F.col("other"), MANY_INTERVALS).otherwise(intervals)
    interval = lambda i: F.shiftright(F.shiftright(F.get("s", i), 32) * parts, 32)
    each = each.where((F.col("n") <= small) | (F.col("start") == 0) | (interval(F.col("start")) != interval(F.col("start") - 1)))
    wanted = F.when(F.col("other"), F.when(F.col("n") <= TINY, 4).otherwise(MANY_ROWS)).when(F.col("n") > small, rows).otherwise(5)
    at = lambda k: F.get("s", (F.col("start") + k) % F.col("n"))
    run = [at(k) if k < 4 else F.when(wanted > k, at(k)).otherwise(F.lit(0).cast("long")) for k in range(max(rows, 5, MANY_ROWS))]
    return each.select(F.xxhash64(wanted, *run).alias("key"), *keep)


def sized(small: DataFrame, row_bytes: int) -> DataFrame:
    """`small`, marked for broadcast if so many rows of this width, which is fixed, are few."""
    return F.broadcast(small) if small.count() * row_bytes <= BROADCAST_BYTES else small


def buckets(scratch: Scratch, lines: DataFrame, signed: DataFrame) -> DataFrame:
    """key, node: the lines of every bucket with more than one distinct line. signed: node, copies. Band keys are
    shuffled once and kept only where they are shared."""
    often = sized(scratch.cut(signed.where(f"copies > {OFTEN}").select("node"), "often"), 48)
    texts = lines.select("node", "line")
    texts = texts.join(often, "node", "left_anti").union(texts.join(often, "node", "left_semi").dropDuplicates(["node"]))
    hashed = shingles(texts).select("node", F.explode(F.array("some", "whole")).alias("hashes"))
    same = Window.partitionBy("key")
    held = bands(hashed, ["node"], many=MANY).withColumns({"lo": F.min("node").over(same), "hi": F.max("node").over(same)})
    return scratch.cut(held.where("lo <> hi").select("key", "node").distinct(), "buckets")


def bucket_texts(scratch: Scratch, lines: DataFrame, listed: DataFrame) -> DataFrame:
    """node, line, some, whole of the lines in buckets."""
    wanted = scratch.cut(listed.select("node").distinct(), "wanted")
    found = lines.select("node", "line").join(sized(wanted, 48), "node", "left_semi").dropDuplicates(["node"])
    return scratch.cut(shingles(found), "texts")


def hashes_of(texts: DataFrame, side: str) -> DataFrame:
    return texts.select(F.col("node").alias(side), F.col("some").alias(f"some_{side}"), F.col("whole").alias(f"whole_{side}"))


def kept(texts: DataFrame, wanted: DataFrame, name: str = "node") -> DataFrame:
    """The rows of texts whose node is wanted."""
    return texts.join(sized(wanted.select(F.col(name).alias("node")).distinct(), 48), "node", "left_semi")


def likely(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose shingle hashes allow a similarity of 0.8; known: the hashes prove it."""
    sets = texts.select("node", "some", "whole")
    both = pairs.join(hashes_of(sets, "b"), "b").join(hashes_of(sets, "a"), "a")
    known = F.col("whole_a").isNotNull() & F.col("whole_b").isNotNull()
    common = F.when(known, F.size(F.array_intersect("whole_a", "whole_b"))).otherwise(F.size(F.array_intersect("some_a", "some_b")))
    total = F.when(known, F.size("whole_a") + F.size("whole_b")).otherwise(F.size("some_a") + F.size("some_b"))
    both = once(both, known=known, common=common, total=total, least=F.least(F.size("some_a"), F.size("some_b")))
    sampled = f"least < {FEW} or common >= (0.8 - {SLACK} * sqrt(0.32 / total)) * (total - common)"
    return both.where(f"case when known then 9 * common >= 4 * total when common is null then true else {sampled} end").select("a", "b", "known")


def verify(scratch: Scratch, pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of lines whose Jaccard similarity is at least 0.8, as edges (u, v)."""
    near = scratch.cut(likely(pairs, texts), "near")
    line = lambda c: texts.select(F.col("node").alias(c), F.col("line").alias(f"line_{c}"))
    both = near.where("not known").select("a", "b").join(line("b"), "b").join(line("a"), "a")
    both = once(both.select("a", "b", "line_a", "line_b"), ga=grams(F.col("line_a")), gb=grams(F.col("line_b")))
    both = once(both, common=F.size(F.array_intersect("ga", "gb"))).where("9 * common >= 4 * (size(ga) + size(gb))")
    edge = [F.col("a").alias("u"), F.col("b").alias("v")]
    links = scratch.cut(near.where("known").select(*edge).union(both.select(*edge)), "links")
    scratch.drop(near)
    return links


def sketches(hashed: DataFrame) -> DataFrame:
    """node, n, s0, s1, ...: how many hashes a line has, and 1,024 parities, each of the hashes that fall to
    it. Two lines' parities differ in no more places than their sets do."""
    word = F.col("h").bitwiseAND(SKETCH_WORDS - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("h", 8).bitwiseAND(63).cast("int"))
    each = hashed.select("node", F.explode("hashes").alias("h")).select("node", word.alias("w"), bit.alias("bit"))
    parities = [F.coalesce(F.bit_xor(F.when(F.col("w") == k, F.col("bit"))), F.lit(0)).alias(f"s{k}") for k in range(SKETCH_WORDS)]
    return each.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *parities)


def may_link(a: str, b: str) -> str:
    """Whether sizes and sketches of two sides allow a similarity of 0.8: of two such sets at most a ninth
    of n_a + n_b is not common. No link is lost by it."""
    apart = " + ".join(f"bit_count({a}s{k} ^ {b}s{k})" for k in range(SKETCH_WORDS))
    return f"5 * least({a}n, {b}n) >= 4 * greatest({a}n, {b}n) and 9 * ({apart}) <= {a}n + {b}n"


def open_buckets(scratch: Scratch, listed: DataFrame, comps: DataFrame) -> DataFrame:
    """key, node, copies, length, comp of the buckets with several components, with the bucket's main one
    (the most frequent), its size and its least length. Members are counted by component first, so that
    a large bucket costs a row a task."""
    entries = listed.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    per = entries.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("length"))
    per = per.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"), F.sum("n").alias("held"), F.min("length").alias("least"))
    per = scratch.cut(per.where("comps > 1").drop("comps"), "spread")
    return scratch.cut(entries.join(per, "key"), "open")


def grown(scratch: Scratch, comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links, which join components."""
    name = lambda c: comps.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    named = links.join(name("u"), "u", "left").join(name("v"), "v", "left")
    named = scratch.cut(named.select("u", "v", F.coalesce("u_in", "u").alias("u_in"), F.coalesce("v_in", "v").alias("v_in")), "joined")
    joined = components(scratch, named.select(F.col("u_in").alias("u"), F.col("v_in").alias("v")))
    ends = named.select("u", "u_in").union(named.select("v", "v_in")).toDF("node", "component")
    old = comps.union(ends).distinct().withColumnRenamed("component", "old")
    joined = joined.select(F.col("node").alias("old"), F.col("component").alias("new"))
    return scratch.cut(old.join(joined, "old", "left").select("node", F.coalesce("new", "old").alias("component")), "components")


def ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def with_hubs(entries: DataFrame, hubs: DataFrame) -> DataFrame:
    """Pairs of the entries with their bucket's hub, the line with the most exact copies."""
    hub = hubs.groupBy("key").agg(F.max_by("node", F.struct("copies", "node")).alias("hub"))
    return ordered(entries.select("key", "node").join(hub, "key").where("node <> hub"), "node", "hub")


def across(entries: DataFrame, sketched: bool = False) -> DataFrame:
    """Pairs of entries of one bucket and different components, one of them outside the main one; of
    entries with sketches, those that may link."""
    carried = ["node", "comp", *(["n", *(f"s{k}" for k in range(SKETCH_WORDS))] if sketched else [])]
    others = entries.where("comp <> main").select("key", *[F.col(c).alias(f"o_{c}") for c in carried])
    met = entries.join(others, "key").where("comp <> o_comp and (comp = main or node < o_node)" + (f" and {may_link('', 'o_')}" if sketched else ""))
    return ordered(met, "node", "o_node")


def finer(scratch: Scratch, wide: DataFrame, texts: DataFrame) -> DataFrame:
    """key, node, copies, length: the lines of large buckets in buckets of finer bands, and short ones in their own."""
    long = wide.where(f"least >= {FINE_LENGTH}").select("node", "copies", "length").distinct()
    sample = F.when(F.size("some") >= FINE_SAMPLE, F.col("some"))
    hashed = texts.join(long, "node").select("node", "copies", "length", F.coalesce("whole", sample, grams(F.col("line"))).alias("hashes"))
    fine = bands(hashed, ["node", "copies", "length"], 0, FINE_ROWS, FINE_INTERVALS)
    short = wide.where(f"least < {FINE_LENGTH}")
    return scratch.cut(fine.union(short.select(*fine.columns)), "fine")


def line_components(scratch: Scratch, lines: DataFrame) -> DataFrame:
    """node, first (place of the line that stays), copies, own_first of the lines that are linked or copied."""
    at = F.struct("doc_id", "rid", "pos")
    signed = scratch.cut(lines.groupBy("node").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("copies")), "signed")
    listed = buckets(scratch, lines, signed)
    texts = bucket_texts(scratch, lines, listed)
    known = texts.select("node", F.length("line").alias("length")).join(signed.select("node", "copies"), "node")
    listed = scratch.cut(listed.join(known, "node"), "listed")

    tried = scratch.cut(with_hubs(listed, listed), "pairs")
    comps = components(scratch, verify(scratch, tried, texts))

    entries = open_buckets(scratch, listed, comps)
    texts = scratch.cut(kept(texts, entries), "open-texts")
    fine = finer(scratch, entries.where(f"held >= {FINE_FROM}"), texts)
    apart = open_buckets(scratch, fine, comps)
    second = with_hubs(apart.where("comp <> main"), apart.where("comp = main"))
    second = second.union(across(entries.where(f"held < {FINE_FROM}"))).distinct()
    second = scratch.cut(second.join(tried, ["a", "b"], "left_anti"), "pairs")
    comps = grown(scratch, comps, verify(scratch, second, texts))

    apart = open_buckets(scratch, fine, comps)
    hashed = kept(texts.select("node", "line"), apart).select("node", grams(F.col("line")).alias("hashes"))
    sketched = scratch.cut(apart.join(sketches(hashed), "node"), "sketched")
    rest = across(sketched, True).join(tried.union(second), ["a", "b"], "left_anti")
    comps = grown(scratch, comps, verify(scratch, scratch.cut(rest, "pairs"), texts))

    linked = scratch.cut(signed.join(comps, "node"), "linked")
    # written first, so that the join of a component with very many lines can be split
    firsts = scratch.cut(linked.groupBy("component").agg(F.min("first").alias("comp_first")), "firsts")
    linked = linked.join(firsts, "component").select("node", "copies", F.col("comp_first").alias("stays"), "first")
    alone = signed.where("copies > 1").join(comps, "node", "left_anti").select("node", "copies", F.col("first").alias("stays"), "first")
    named = linked.union(alone)
    return named.select("node", "copies", F.col("stays").alias("first"), F.col("first").alias("own_first"))


def dropped_lines(scratch: Scratch, lines: DataFrame) -> DataFrame:
    """doc_id, rid and the numbers of the lines (from 0) that go, for documents that lose any."""
    inner = Scratch(scratch.spark, "line-components")
    named = line_components(inner, lines)
    doubtful = inner.cut(named.where("copies > 1 or first <> own_first").select("node", "first"), "doubtful")
    gone = lines.select("doc_id", "rid", "pos", "node").join(doubtful, "node").where("not (doc_id <=> first.doc_id and rid = first.rid and pos = first.pos)")
    gone = gone.groupBy("doc_id", "rid").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    gone = scratch.cut(gone, "gone")
    inner.remove(inner.root)  # no later result reads it
    return gone


def spare_copies(scratch: Scratch, packed: DataFrame, lines: DataFrame) -> DataFrame:
    """packed with `spare`: true for all but one of the rows that are equal in doc_id and text."""
    again = lines.groupBy("doc_id", "rid").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi")).where("lo <> hi")
    again = scratch.cut(again.select(F.col("doc_id").alias("again_id"), F.col("rid").alias("again_rid")), "again")
    if again.isEmpty():
        return packed.withColumn("spare", F.lit(False))
    same = F.expr("doc_id <=> again_id and rid = again_rid")
    some = scratch.cut(packed.join(again, same, "left_semi").withColumn("uid", F.monotonically_increasing_id()), "repeated")
    stays = some.groupBy("doc_id", "rid").agg(F.min("uid").alias("stays")).select("stays")
    some = some.join(stays, F.col("uid") == F.col("stays"), "left").withColumn("spare", F.col("stays").isNull()).drop("uid", "stays")
    return packed.join(again, same, "left_anti").withColumn("spare", F.lit(False)).unionByName(some)


def mark_lines(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """row (the caller's columns as a struct), gone (numbers of lines that go, null if none), kept_text."""
    lines = scratch.cut(split_lines(docs.select("doc_id", "text")), "lines")
    gone = dropped_lines(scratch, lines)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", F.xxhash64("text").alias("rid"))
    packed = spare_copies(scratch, packed, lines)
    scratch.drop(lines)
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("rid").alias("gone_rid"), "gone")
    size = gone.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("gone")).alias("m")).first()
    small = 64 * size["n"] + 4 * (size["m"] or 0) <= BROADCAST_BYTES
    out = packed.join(F.broadcast(gone) if small else gone, F.expr("doc_id <=> gone_id and rid = gone_rid"), "left")
    out = once(out, parts=F.when(F.col("spare") | F.col("gone").isNotNull(), F.split("text", "\n")))
    every = F.sequence(F.lit(0), F.size("parts") - 1)
    worded = F.filter(every, lambda i: F.get("parts", i).rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("gone", F.when(F.col("spare"), F.when(F.size(worded) > 0, worded)).otherwise(F.col("gone")))
    kept = F.array_join(F.transform(F.array_except(every, F.col("gone")), lambda i: F.get("parts", i)), "\n")
    return out.select("row", "gone", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"))


def apply_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with the text of the lines that stay. Documents that lost their last word go."""
    out = mark_lines(scratch, docs)
    out = out.where(F.col("gone").isNull() | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[(F.col("kept_text") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
