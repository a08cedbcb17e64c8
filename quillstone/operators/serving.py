"""What a knowledge base hands out: its root index, documents by range, sizes, views of what has changed; and keys
that are derived anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.operators import authoring as au
from quillstone.operators import events as ev
from quillstone.operators import provenance as pv

# How many tags the root index lists.
ROOT_TAGS = 20


def root_index(entries: DataFrame, required: list[str]) -> DataFrame:
    """kind, name, n: files of every section, the most frequent tags (tags and cross_subjects) and how many more there are,
    all entries, and the share of entries with all required fields in tenths of a percent."""
    kinds = dict(entries.dtypes)
    full = F.lit(True)
    for c in required:
        full = full & (F.size(c) > 0 if kinds[c].startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    row = lambda kind, name, n: [F.lit(kind).alias("kind"), name.alias("name"), n.cast("long").alias("n")]
    sections = entries.groupBy("domain").agg(F.count(F.lit(1)).alias("files")).select(*row("section", F.col("domain"), F.col("files")))
    tags = entries.select(F.explode(F.concat("tags", F.coalesce("cross_subjects", F.array().cast("array<string>")))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("times"))
    top = tags.orderBy(F.desc("times"), "tag").limit(ROOT_TAGS).select(*row("tag", F.col("tag"), F.col("times")))
    rest = tags.agg((F.count(F.lit(1)) - ROOT_TAGS).alias("more")).where("more > 0")
    rest = rest.select(*row("tag", F.concat(F.lit("...and "), F.col("more").cast("string"), F.lit(" more")), F.lit(0)))
    counts = entries.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.coalesce(full, F.lit(False))).alias("full"))
    totals = counts.select(*row("total", F.lit("entries"), F.col("all"))).union(counts.select(*row("total", F.lit("complete"), F.round(F.col("full") / F.greatest("all", F.lit(1)) * 1000))))
    return sections.union(top).union(rest).union(totals)


def served(requests: DataFrame, blobs: DataFrame, refs: DataFrame, sources: DataFrame, scope: tuple) -> DataFrame:
    """n, status, mime, name, start, length of requests (n, sha256, header) for documents. A name that is no hash is 400; what no
    reference allows to show, or isn't there, is 404; a range outside is 416; a part is 206.
    blobs: sha256, size, mime, filename."""
    shown = pv.blob_available(refs, sources, scope).withColumn("shown", F.lit(True))
    rows = requests.join(shown, "sha256", "left").join(blobs.select("sha256", "size", "mime", "filename"), "sha256", "left")
    part = tx.byte_range(F.col("header"), F.col("size"))
    status = (
        F.when(~F.coalesce(F.col("sha256").rlike(r"^[0-9a-f]{64}\z"), F.lit(False)), 400).when(F.col("shown").isNull() | F.col("size").isNull(), 404)
        .when(F.col("header").isNull(), 200).when(part.isNull(), 416).otherwise(206)
    )
    rows = rows.withColumns({"status": status, "part": part, "kind": au.served_type(F.col("mime"))})
    good = lambda c: F.when(F.col("status") < 300, c)
    start = F.when(F.col("status") == 206, F.col("part.start")).otherwise(F.lit(0))
    length = F.when(F.col("status") == 206, F.col("part.end") - F.col("part.start") + 1).otherwise(F.col("size"))
    return rows.select("n", "status", good(F.col("kind")).alias("mime"), good(au.download_name(F.col("filename"), F.col("sha256"), F.col("kind"))).alias("name"), good(start).cast("long").alias("start"), good(length).cast("long").alias("length"))


def migrated(aggregates: DataFrame) -> DataFrame:
    """Aggregates under the key that their last example gives (source, marker, code, message), merged where keys meet; one without
    a message keeps its key. Beside what merging needs: example_source, example_marker, example_code, example."""
    new = F.when(F.coalesce(F.col("example"), F.lit("")) == "", F.col("sig")).otherwise(tx.signature(F.col("example_source"), F.col("example_marker"), F.col("example_code"), F.col("example")))
    renamed = aggregates.withColumn("sig", new)
    return ev.merge_aggregates(renamed, renamed.limit(0))


def store_stats(entries: DataFrame, queue: DataFrame, dead: DataFrame) -> DataFrame:
    """name, n: entries by zone, waiting index jobs, dead letters; a zero where there is none."""
    zones = entries.groupBy(F.concat(F.lit("points_"), F.coalesce("zone", F.lit("private"))).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    one = lambda d, name: d.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    return zones.union(one(queue, "queue")).union(one(dead, "dead_letters"))


def delta_view(changed: Column, sections: Column, inputs: Column, critiques: Column) -> Column:
    """The names of the sections a node is shown: what changed since it last looked, if that is enough, else all its inputs.

    critiques: array of structs (section, kinds of its writers, inputs of its writer). Only fresh critique (its section has
    changed) counts; it must come from one critic gate with declared inputs, and all that these
    refer to must have changed. `changed` null: the node has not looked yet. Null if an input isn't there."""
    fresh = F.filter(critiques, lambda c: F.array_contains(changed, c["section"]))
    plain = F.forall(fresh, lambda c: (F.size(c["writers"]) == 1) & (F.get(c["writers"], 0) == "critic-gate") & (F.size(F.coalesce(c["inputs"], F.array().cast("array<string>"))) > 0))
    scope = F.array_distinct(F.flatten(F.transform(fresh, lambda c: c["inputs"])))
    enough = changed.isNotNull() & plain & (F.size(scope) > 0) & (F.size(F.array_except(scope, changed)) == 0)
    whole = F.size(F.array_except(inputs, sections)) == 0
    return F.when(whole, F.when(F.coalesce(enough, F.lit(False)), F.array_sort(F.array_intersect(changed, sections))).otherwise(inputs))


def entry_views(asked: DataFrame, entries: DataFrame, sources: DataFrame, scope: tuple) -> DataFrame:
    """kid, found, version, children, citation, citation_reason, citations of entries asked for (kid, distinct).

    What isn't there and what is outside the scope look alike: found is false, the rest null. Children are counted of collections, in
    the entry's own zone. entries: kid, zone, version, parent, content_type, source_refs (ids of sources, or null), source_id, which
    counts where there are no refs. References to one source give citation and reason, those to more give citations
    (JSON, in their order, without what may not be told). sources: as `provenance.cited` wants them."""
    rows = asked.select("kid").join(entries.where(F.col("zone").isin(*scope)).drop("parent"), "kid", "left")
    own = F.filter(F.coalesce("source_refs", F.array().cast("array<string>")), lambda s: F.coalesce(s, F.lit("")) != "")
    refs = F.when(F.size(own) > 0, own).when(F.coalesce("source_id", F.lit("")) != "", F.array("source_id")).otherwise(F.array().cast("array<string>"))
    rows = rows.select("kid", "zone", "version", "content_type", refs.alias("refs"))
    links = rows.select("kid", F.posexplode("refs").alias("pos", "source_id"), F.size(F.array_distinct("refs")).alias("distinct"))
    told = pv.cited(links, sources, scope)
    item = F.struct("source_id", "citation", F.col("reason").alias("citation_reason"))
    told = told.groupBy("kid").agg(F.max("distinct").alias("distinct"), F.array_sort(F.collect_list(F.struct("pos", item.alias("x")))).alias("all"))
    told = told.select("kid", "distinct", F.transform("all", lambda a: a["x"]).alias("all"))
    children = entries.where("parent is not null").groupBy(F.col("parent").alias("kid"), "zone").agg(F.count(F.lit(1)).alias("children"))
    rows = rows.join(told, "kid", "left").join(children, ["kid", "zone"], "left")
    one = lambda c: F.when(F.col("distinct") == 1, F.get("all", 0)[c])
    return rows.select(
        "kid", F.col("zone").isNotNull().alias("found"), "version", F.when(F.col("zone").isNotNull(), F.when(F.col("content_type") == "collection", F.coalesce("children", F.lit(0))).otherwise(0)).alias("children"),
        one("citation").alias("citation"), one("citation_reason").alias("citation_reason"), F.when(F.col("distinct") > 1, F.to_json("all")).alias("citations"),
    )
