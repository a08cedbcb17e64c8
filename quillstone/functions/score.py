"""Scores, ranks and money as Column -> Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REVIEW_THRESHOLD = 0.45
#: Weights of the staleness score.
AGE, MISSING, EDIT_WAR, BROKEN = 0.47, 0.16, 0.10, 0.05


def staleness(age_days: Column, evergreen: Column, missing: Column, total: Column, edit_war: Column, broken: Column, links: Column) -> Column:
    """Unknown age (null) counts as none."""
    span = F.when(evergreen, 1825).otherwise(365)
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    age = unit(F.coalesce(F.floor(age_days) / span, F.lit(0.0)))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return F.round(unit(AGE * age + MISSING * share(missing, total) + EDIT_WAR * F.when(edit_war, 1.0).otherwise(0.0) + BROKEN * share(broken, links)), 4)


def length_difference(a: Column, b: Column) -> Column:
    usable = (F.coalesce(a, F.lit(0)) > 0) & (F.coalesce(b, F.lit(0)) > 0)
    return F.when(usable, F.abs(a - b) / F.greatest(a, b))


def rank_pair(p: str = "") -> Column:
    """green, yellow or red for a duplicate pair; the first rule that holds decides."""
    c = lambda name: F.col(p + name)
    same_hash = F.coalesce(c("hash_a") == c("hash_b"), F.lit(False))
    alone = c("alone_a") & c("alone_b")
    exact = same_hash & alone & F.coalesce(c("subject_a") == c("subject_b"), F.lit(False))
    diff = length_difference(c("length_a"), c("length_b"))
    near = (c("cosine") >= 0.97) & alone & ~c("negation") & (diff.isNull() | (diff <= 0.10))
    return F.when(exact, "green").when(c("cosine").isNull() | (c("cosine") < 0.92), "red").when(same_hash, "yellow").when(near, "green").otherwise("yellow")


def canonical(left: Column, right: Column, len_a: Column, len_b: Column, alone_a: Column, alone_b: Column) -> Column:
    """The id to keep: the longer text, else the standalone side, else the right one."""
    return F.when(len_a > len_b, left).when(len_b > len_a, right).when(alone_a & ~alone_b, left).otherwise(right)


#: Words that turn a slug's meaning round.
NEGATIONS = ("ne", "not", "anti", "without", "no", "bez", "contra", "non", "не")


def negation(slug_a: Column, slug_b: Column) -> Column:
    """One slug has a negating word that the other lacks."""
    a, b = F.split(slug_a, "[-_]+"), F.split(slug_b, "[-_]+")
    return F.arrays_overlap(F.array_union(F.array_except(a, b), F.array_except(b, a)), F.array(*map(F.lit, NEGATIONS)))


def cost_micro(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Integer micro-units, each side rounded half up per million tokens; no floating point."""
    part = lambda n, p: F.call_function("div", n.cast("long") * p.cast("long") + F.lit(500_000), F.lit(1_000_000))
    return part(tokens_in, price_in) + part(tokens_out, price_out)


def usage_tokens(prompt_chars: Column, output_chars: Column) -> Column:
    return F.floor((prompt_chars + output_chars + 3) / 4).cast("long")


def priority_rank(priority: Column) -> Column:
    return F.when(priority == "P0", 0).when(priority == "P1", 1).when(priority == "P2", 2).when(priority == "P3", 3).otherwise(9)


def trend(now: Column, before: Column) -> Column:
    return F.when(before == 0, F.lit(None).cast("string")).when(now > before, "up").when(now < before, "down").otherwise("flat")
