"""Chat formatting by quotation linking, with DataFrame functions only.

The lines of a message are parsed into quote levels (leading ">" marks). Neighbouring lines of one
level are a passage. Units are what can be recognised again: every line of more than MIN_CHARS
characters, and every passage; a message's own units are its unquoted lines, paragraphs and whole
unquoted text. Units are hashed in a normal form (lower case, no marks, single spaces) and a quoted
unit is linked to the latest earlier message of the conversation that has it as its own. That is a
running maximum over (conversation, hash), not a join of all quotes with all originals, so a line
that everybody repeats costs one row per repetition.

A message replies to the message that most of its level-1 characters come from (ties: the latest).
Threads are followed to their roots by pointer jumping, log2(longest chain) joins. Messages are
ordered by thread, then turn, which puts every reply after what it answers; their texts lose all
quoted lines and the attribution line in front of a quote.

Defined results: a null text is empty; rows with a null conv_id or turn are their own thread without
links; rows that repeat (conv_id, turn) share links, each has its own position; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import Scratch

MARKS = r"^[ \t]*((?:>[ \t]?)+)"
ATTRIBUTION = r"(?iu)^\s*(on|am|le|el)\b.*(wrote|schrieb|écrit|escribió)\s*:\s*$"
MIN_CHARS = 8
KEY = ["conv_id", "turn"]


def normal(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))


def parse(text: Column) -> Column:
    """An array of (level, body) per line of a text."""

    def line(raw: Column) -> Column:
        marks = F.regexp_extract(raw, MARKS, 1)
        level = F.length(F.regexp_replace(marks, "[^>]", ""))
        return F.struct(level.alias("level"), F.when(level > 0, F.regexp_replace(raw, MARKS, "")).otherwise(raw).alias("body"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line)


def own_text(lines: Column) -> Column:
    """The unquoted lines, without an attribution right before a quote."""
    kept = F.filter(lines, lambda x, i: (x["level"] == 0) & ~((F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0) & x["body"].rlike(ATTRIBUTION)))
    return F.trim(F.array_join(F.transform(kept, lambda x: x["body"]), "\n"))


def units(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, level, unit (hash), chars: lines and passages of every message."""
    lines = parsed.select(*KEY, "copy", F.posexplode("lines").alias("pos", "x")).select(*KEY, "copy", "pos", "x.level", "x.body")
    # a blank unquoted line ends a paragraph
    lines = lines.withColumn("blank", normal(F.col("body")) == "")
    order = Window.partitionBy(*KEY, "copy").orderBy("pos")
    starts = F.col("blank") | F.coalesce(F.lag("level").over(order) != F.col("level"), F.lit(True)) | F.coalesce(F.lag("blank").over(order), F.lit(False))
    lines = lines.withColumn("run", F.sum(starts.cast("int")).over(order))
    body = lines.where(~F.col("blank"))
    gather = lambda *by: body.groupBy(*KEY, "copy", *by).agg(F.first("level").alias("l"), F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("b"))
    join = lambda d: d.select(*KEY, F.col("l").alias("level"), F.array_join(F.transform("b", lambda x: x["body"]), " ").alias("text"))
    passages = join(gather("run"))
    whole = join(gather("level"))
    each = body.select(*KEY, "level", F.col("body").alias("text")).where(F.length(F.trim("body")) >= MIN_CHARS)
    all_units = passages.union(whole).union(each).withColumn("text", normal(F.col("text"))).where("text <> ''")
    return all_units.select(*KEY, "level", F.xxhash64("text").alias("unit"), F.length("text").alias("chars")).distinct()


def links(found: DataFrame) -> DataFrame:
    """conv_id, turn, level, unit, chars, source: each quoted unit and the message it is from (or null)."""
    kinds = found.groupBy(*KEY, "unit", (F.col("level") > 0).alias("quoted")).agg(F.min("level").alias("level"), F.max("chars").alias("chars"))
    order = Window.partitionBy("conv_id", "unit").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    marked = kinds.withColumn("source", F.max(F.when(~F.col("quoted"), F.col("turn"))).over(order))
    return marked.where("quoted").drop("quoted")


def roots(scratch: Scratch, replies: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to -> with thread (the root's turn) and depth, by pointer jumping."""
    now = replies.select(*KEY, "reply_to", F.coalesce("reply_to", "turn").alias("thread"), F.col("reply_to").isNotNull().cast("long").alias("depth"))
    now = scratch.cut(now, "roots")
    while True:
        above = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("up"), F.col("depth").alias("more")).where("more > 0")
        moving = now.join(above, F.expr("conv_id = c and thread = t"), "left")
        then = scratch.cut(moving.select(*KEY, "reply_to", F.coalesce("up", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("up").isNotNull().alias("moved")), "roots")
        scratch.drop(now)
        now = then
        if now.where("moved").isEmpty():
            return now.drop("moved")


def order_replies(scratch: Scratch, messages: DataFrame) -> DataFrame:
    """conv_id, thread, position, depth, turn, role, reply_to, n_quotes, n_linked, text per message.

    position counts from 0 within the conversation; n_quotes are distinct quoted units, n_linked those
    whose original was found.
    """
    parsed = messages.select(*KEY, "role", "text", parse(F.col("text")).alias("lines"))
    known = parsed.where("conv_id is not null and turn is not null")
    quoting = known.where(F.exists("lines", lambda x: x["level"] > 0)).select("conv_id").distinct()
    # only conversations with a quote need units
    asked = known.join(quoting, "conv_id", "left_semi").withColumn("copy", F.xxhash64("text"))
    linked = scratch.cut(links(units(asked)), "links")
    votes = linked.where("level = 1 and source is not null").groupBy(*KEY, "source").agg(F.sum("chars").alias("chars"))
    chosen = votes.groupBy(*KEY).agg(F.max_by("source", F.struct("chars", "source")).alias("reply_to"))
    counts = linked.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_quotes"), F.count("source").alias("n_linked"))
    threads = roots(scratch, linked.select(*KEY).distinct().join(chosen, KEY, "left"))
    out = parsed.join(threads, KEY, "left").join(counts, KEY, "left")
    out = out.withColumn("thread", F.coalesce("thread", "turn"))
    place = Window.partitionBy("conv_id").orderBy("thread", "turn", "role", "text")
    return out.select(
        "conv_id", "thread", (F.row_number().over(place) - 1).cast("long").alias("position"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "turn", "role", "reply_to",
        F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), own_text(F.col("lines")).alias("text"),
    )
