"""Writes in batches: entries behind their gates, sources with their blobs, changes of a source's licence.

A batch is decided as if its rows came one after the other, by `n`. Of writes and licences the order is told by least and greatest
n of a key, so that every group is aggregated before it is shuffled. Ingests, whose rows are wide and hardly any
fewer by source, are shuffled once and stream through a step in order, which holds one source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators import authoring as au
from quillstone.operators.provenance import public_licence

# Zones, fields that are recommended, and what a source's id begins with.
ZONES = ("public", "private")
RECOMMENDED = ("source", "evergreen", "cross_subjects")
SOURCE_PREFIX = "src-"

def _none() -> Column:
    return F.array().cast("array<string>")


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def faulty_links(requests: DataFrame, store: DataFrame) -> DataFrame:
    """n, faults (in the order of the links) of requests (n, documents: ids of sources) with a link that is empty, leads nowhere, or
    to an entry that is no source."""
    links = requests.select("n", F.posexplode("documents").alias("pos", "to"))
    kinds = store.select(F.col("kid").alias("to"), F.coalesce("content_type", F.lit("")).alias("kind"))
    fault = (
        F.when(F.coalesce("to", F.lit("")) == "", "empty").when(F.col("kind").isNull(), F.concat(F.lit("not_found:"), "to"))
        .when(F.col("kind") != "source", F.concat(F.lit("not_source:"), "to"))
    )
    bad = links.join(kinds, "to", "left").select("n", F.struct("pos", fault.alias("fault")).alias("x")).where("x.fault is not null")
    return bad.groupBy("n").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["fault"]).alias("faults"))


def entry_writes(requests: DataFrame, store: DataFrame, duplicates: DataFrame) -> DataFrame:
    """n, id, outcome, reasons, warnings, duplicates, linked of entries to be written.

    requests: n (distinct), kid or null, content, domain, subject, zone, strict, documents and the recommended fields. store: kid,
    content_type of what is there in both zones. duplicates: n and what the duplicate gate found for it before the batch.

    outcome, the first that holds: invalid (no content, domain or subject, or an unknown zone); blocked (the id given is
    taken by the store or an earlier row that was written; under `strict` also a recommended field that is missing, and
    duplicates); refused (faulty links, all of them told); written. Without `strict` missing fields are warnings and
    duplicates are only counted. A row without id is called by its domain, subject and heading, and never blocked by its id.
    """
    missing = au.recommended_missing(requests.withColumn("kid", F.col("n")), list(RECOMMENDED)).groupBy(F.col("kid").alias("n")).agg(F.collect_list("field").alias("fields"))
    found = duplicates.groupBy("n").agg(F.count(F.lit(1)).alias("found"))
    name = F.coalesce(F.nullif("kid", F.lit("")), au.auto_id("domain", "subject", "content"))
    rows = requests.withColumns({"id": name, "given": ~_empty("kid"), "strict": F.coalesce("strict", F.lit(False))})
    rows = rows.select("n", "id", "given", "content", "domain", "subject", "zone", "strict", F.coalesce(F.size("documents"), F.lit(0)).alias("links"))
    rows = rows.join(missing, "n", "left").join(found, "n", "left").join(faulty_links(requests, store), "n", "left")
    invalid = F.coalesce(*[F.when(_empty(c), F.lit(c)) for c in ("content", "domain", "subject")], F.when(~F.coalesce("zone", F.lit("private")).isin(*ZONES), "zone"))
    fields = F.array_sort(F.coalesce("fields", _none()), lambda a, b: F.array_position(F.array(*map(F.lit, RECOMMENDED)), a).cast("int") - F.array_position(F.array(*map(F.lit, RECOMMENDED)), b).cast("int"))
    rows = rows.withColumns({"invalid": invalid, "fields": fields, "found": F.coalesce("found", F.lit(0)), "faults": F.coalesce("faults", _none())})
    strict = F.when(F.col("strict"), F.concat(F.transform("fields", lambda f: F.concat(F.lit("missing:"), f)), F.when(F.col("found") > 0, F.array(F.lit("duplicates"))).otherwise(_none()))).otherwise(_none())
    rows = rows.drop("content", "domain", "subject", "zone").withColumn("issues", strict)
    passing = F.col("invalid").isNull() & (F.size("issues") == 0) & (F.size("faults") == 0)
    first = rows.where(passing).groupBy("id").agg(F.min("n").alias("first"))
    there = store.select(F.col("kid").alias("id"), F.lit(True).alias("there"))
    rows = rows.join(first, "id", "left").join(there, "id", "left")
    taken = F.col("given") & (F.col("there").isNotNull() | F.coalesce(F.col("n") > F.col("first"), F.lit(False)))
    rows = rows.withColumn("issues", F.concat(F.when(taken, F.array(F.lit("taken"))).otherwise(_none()), "issues"))
    good = F.col("invalid").isNull()
    outcome = F.when(~good, "invalid").when(F.size("issues") > 0, "blocked").when(F.size("faults") > 0, "refused").otherwise("written")
    why = F.when(~good, F.array("invalid")).when(F.size("issues") > 0, F.col("issues")).otherwise(F.col("faults"))
    return rows.select(
        "n", F.when(outcome == "written", F.col("id")).alias("id"), outcome.alias("outcome"), F.array_join(why, ",").alias("reasons"), F.when(good & ~F.col("strict"), F.size("fields")).otherwise(0).cast("long").alias("warnings"),
        F.when(good, F.col("found")).otherwise(0).cast("long").alias("duplicates"), F.when(outcome == "written", F.col("links")).otherwise(0).cast("long").alias("linked"),
    )


def stored(store: DataFrame, requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The store (kid, content_type, domain, subject, zone, content, version) behind the writes of `outcomes`: of rows with one id,
    which only rows without a given id can be, the last stays, as it does over an entry that is there."""
    new = outcomes.where("outcome = 'written'").select("n", F.col("id").alias("kid")).join(requests.drop("kid"), "n")
    body = F.struct("n", F.lit(None).cast("string").alias("content_type"), "domain", "subject", F.coalesce("zone", F.lit("private")).alias("zone"), "content", F.lit(1).cast("long").alias("version"))
    new = new.groupBy("kid").agg(F.max_by(body, "n").alias("b")).select("kid", "b.content_type", "b.domain", "b.subject", "b.zone", "b.content", "b.version")
    old = store.join(new.select("kid"), "kid", "left_anti").select(*new.columns)
    return old.unionByName(new)


def source_id(sha256: Column) -> Column:
    """By the first sixteen digits of the original's hash; null if it isn't one."""
    return F.when(sha256.rlike(r"^[0-9a-f]{64}\z"), F.concat(F.lit(SOURCE_PREFIX), F.substring(sha256, 1, 16)))


def registered(sources: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources after a batch of ingests, and n, source_id, outcome of every ingest.

    sources: source_id, sha256, canonical, derived (array), error, license, public_allowed. incoming: n (distinct) and the same but
    for the id. outcome: invalid (no hash); collision (the id stands for another original: that of the store, or
    the first in the batch); created; attached, if it brings something; reused otherwise. A canonical form once there stays; derived
    ones are added behind; an error stands while there is no canonical form, the last one counts, and every one that comes is
    a change, as it has its own time. A source without licence is not public unless told so.
    """
    digest, mine = F.unhex("sha256"), F.col("source_id").rlike(rf"^{SOURCE_PREFIX}[0-9a-f]{{16}}\z")
    kept = ["canonical", "derived", "error", "license", "public_allowed"]
    valid = source_id(F.col("sha256")).isNotNull()
    rows = incoming.select(
        "n", F.when(valid, F.substring(digest, 1, 8)).alias("id"), F.when(valid, F.substring(digest, 9, 24)).alias("rest"), *kept, F.lit(None).cast("string").alias("old_sha"), F.lit(False).alias("old"),
    )
    there = sources.where(mine).select(
        F.lit(None).cast(dict(incoming.dtypes)["n"]).alias("n"), F.unhex(F.substring("source_id", len(SOURCE_PREFIX) + 1, 16)).alias("id"), F.lit(None).cast("binary").alias("rest"), *kept, F.col("sha256").alias("old_sha"), F.lit(True).alias("old"),
    )
    # a source's rows meet once, the store's first; those without an id are dealt out by n
    dealt = rows.unionByName(there).repartition(F.when(F.col("id").isNotNull(), F.xxhash64("id")).otherwise(F.xxhash64("n")))
    told = dealt.sortWithinPartitions("id", "n").mapInArrow(_told_in_order, f"n {dict(incoming.dtypes)['n']}, source_id string, outcome string, source {_STATE}")
    after = told.where("outcome is null").select("source_id", "source.*")
    allowed = F.when(F.col("made"), F.coalesce("public_allowed", public_licence(F.col("license")))).otherwise(F.col("public_allowed"))
    after = after.select("source_id", "sha256", "canonical", "derived", "error", "license", allowed.alias("public_allowed"))
    rest = sources.where(~F.coalesce(mine, F.lit(False))).select(*after.columns)
    return rest.unionByName(after), told.where("outcome is not null").select("n", "source_id", "outcome")


_STATE = "struct<sha256: string, canonical: string, derived: array<string>, error: string, license: string, public_allowed: boolean, made: boolean>"


class _Source:
    """A source as its ingests come, in order of n."""

    def __init__(self, key: bytes):
        self.id, self.own, self.known, self.good, self.state = key, None, False, 0, None
        self.had = self.erred = False
        self.seen: set[str] = set()

    def store(self, sha256: str | None, canonical: str | None, derived: list | None, error: str | None, license: str | None, allowed: bool | None) -> None:
        self.own, self.known, self.had, self.erred, self.seen = sha256, True, canonical is not None, error is not None, set(derived or [])
        self.state = {"sha256": sha256, "canonical": canonical, "derived": derived, "error": error, "license": license, "public_allowed": allowed, "made": False}

    def ingest(self, sha256: str, canonical: str | None, derived: list | None, error: str | None, license: str | None, allowed: bool | None) -> str:
        self.own = self.own if self.own is not None else sha256
        if sha256 != self.own:
            return "collision"
        first, self.good = not self.good, self.good + 1
        if first:
            self.state = self.state or {"canonical": None, "derived": [], "error": None, "license": license, "public_allowed": allowed, "made": True}
            self.state |= {"sha256": self.own, "derived": list(self.state["derived"] or [])}
        s, attached = self.state, first and self.had and self.erred
        if s["canonical"] is None:
            attached |= canonical is not None or error is not None
            s["canonical"], s["error"] = canonical, s["error"] if error is None else error
        for d in derived or ():
            if d is not None and d not in self.seen:
                self.seen.add(d)
                s["derived"].append(d)
                attached = True
        return "created" if first and not self.known else "attached" if attached else "reused"

    def closed(self) -> dict | None:
        """What the store has of it behind the batch; an error stands while there is no canonical form, and what had no ingest stays as it was."""
        return self.state if not self.good or self.state["canonical"] is None else self.state | {"error": None}


def _told_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Outcomes of ingests and, with no outcome, sources behind them; rows are in order of (id, n), a source of the store before its
    ingests. One source is held at a time, never its ingests."""
    source = None
    for batch in batches:
        ns, names, outcomes, states = [], [], [], []

        def tell(n: int | None, key: bytes | None, outcome: str | None, state: dict | None = None, to: tuple = (ns, names, outcomes, states)) -> None:
            for out, x in zip(to, (n, key and SOURCE_PREFIX + key.hex(), outcome, state), strict=True):
                out.append(x)

        for n, key, rest, *kept, old_sha, old in zip(*map(_values, batch.columns), strict=True):
            if key is None:
                tell(n, None, "invalid")
                continue
            if source is None or source.id != key:
                if source and source.state:
                    tell(None, source.id, None, source.closed())
                source = _Source(key)
            if old:
                source.store(old_sha, *kept)
            else:
                tell(n, key, source.ingest(key.hex() + rest.hex(), *kept))
        yield _told(ns, names, outcomes, states, batch.schema.field(0).type)
    if source and source.state:
        yield _told([None], [SOURCE_PREFIX + source.id.hex()], [None], [source.closed()], batch.schema.field(0).type)


def _values(column: pa.Array) -> list:
    """As to_pylist, which takes some microseconds a value; numbers with nulls have no other way."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        flat, ends, there = _values(column.flatten()), column.value_lengths().fill_null(0).to_numpy().cumsum().tolist(), column.is_valid().to_numpy(zero_copy_only=False).tolist()
        return [flat[a:b] if v else None for a, b, v in zip([0, *ends[:-1]], ends, there, strict=True)]
    if column.null_count and not (pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_boolean(column.type)):
        return column.to_pylist()
    return column.to_numpy(zero_copy_only=False).tolist()


def _told(ns: list, names: list, outcomes: list, states: list, kind: pa.DataType) -> pa.RecordBatch:
    text = pa.string()
    state = pa.struct([("sha256", text), ("canonical", text), ("derived", pa.list_(text)), ("error", text), ("license", text), ("public_allowed", pa.bool_()), ("made", pa.bool_())])
    return pa.RecordBatch.from_arrays([pa.array(ns, kind), pa.array(names, text), pa.array(outcomes, text), pa.array(states, state)], names=["n", "source_id", "outcome", "source"])


def relicensed(store: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store (kid, content_type, license, public_allowed, version) after changes of licences, and n, outcome of every change.

    requests: n (distinct), source_id, license, public_allowed. outcome: missing (no id), not_found, not_source, nothing (neither
    value given), ok. A licence without `public_allowed` decides it; every change that is ok counts as a version.
    """
    there = store.select(F.col("kid").alias("source_id"), F.coalesce("content_type", F.lit("")).alias("kind"))
    allowed = F.coalesce("public_allowed", F.when(F.col("license").isNotNull(), public_licence(F.col("license"))))
    rows = requests.join(there, "source_id", "left").withColumn("allowed", allowed)
    outcome = (
        F.when(F.coalesce("source_id", F.lit("")) == "", "missing").when(F.col("kind").isNull(), "not_found").when(F.col("kind") != "source", "not_source")
        .when(F.col("allowed").isNull(), "nothing").otherwise("ok")
    )
    rows = rows.withColumn("outcome", outcome)
    last = rows.where("outcome = 'ok'").groupBy(F.col("source_id").alias("kid")).agg(
        F.max_by("license", F.when(F.col("license").isNotNull(), F.col("n"))).alias("new_license"), F.max_by("allowed", "n").alias("new_allowed"), F.count(F.lit(1)).alias("times"),
    )
    after = store.join(last, "kid", "left").select(
        "kid", "content_type", F.coalesce("new_license", "license").alias("license"), F.coalesce("new_allowed", "public_allowed").alias("public_allowed"),
        (F.col("version") + F.coalesce("times", F.lit(0))).alias("version"),
    )
    return after, rows.select("n", "outcome")
