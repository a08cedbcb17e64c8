"""Quality: staleness, duplicate pairs and their review, issue store, audit analytics, reconciliation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import score as sc
from quillstone.functions import text as tx
from quillstone.functions.vectors import unit_rows

PAIR_FIRST, PAIR_CAP, NEAR = 500, 10, 0.92


def scored(entries: DataFrame, now_day: int, edit_wars: DataFrame | None = None) -> DataFrame:
    """kid, score: an implicit date means unknown age; only the source can be missing of three fields."""
    wars = entries.withColumn("war", F.lit(False)) if edit_wars is None else entries.join(edit_wars.select("kid", F.lit(True).alias("war")), "kid", "left")
    age = F.when(F.col("explicit"), F.lit(now_day) - F.col("updated_day"))
    value = sc.staleness(age, F.col("evergreen"), F.col("source_url").isNull().cast("int"), F.lit(3), F.coalesce("war", F.lit(False)), F.lit(0), F.lit(0))
    return wars.withColumn("score", value)


def review_queue(scores: DataFrame, limit: int = 20) -> DataFrame:
    return scores.where(F.col("score") >= sc.REVIEW_THRESHOLD).groupBy("kid").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "kid").limit(min(limit, 100))


def stale_books(scores: DataFrame) -> DataFrame:
    """Books with stale sections: totals, share, worst sections; most stale first."""
    stale = F.col("score") >= sc.REVIEW_THRESHOLD
    worst = Window.partitionBy("parent").orderBy(F.desc("score"), "kid")
    ranked = scores.where("parent is not null").withColumn("rank", F.row_number().over(worst))
    out = ranked.groupBy("parent").agg(
        F.count(F.lit(1)).alias("sections"), F.count_if(stale).alias("stale"), F.max("score").alias("max_score"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(stale & (F.col("rank") <= 5), F.struct("rank", "kid")))), lambda x: x["kid"]), ",").alias("worst"),
    )
    return out.where("stale > 0").withColumn("fraction", F.round(F.col("stale") / F.col("sections"), 3)).orderBy(F.desc("fraction"), F.desc("max_score"), "parent")


def eligible(entries: DataFrame, first: int | None = PAIR_FIRST) -> DataFrame:
    """What takes part in the duplicate scan: not deprecated, no table of contents, the first 500 of a domain, or
    all (None)."""
    rows = entries.where((F.coalesce("status", F.lit("")) != "deprecated") & ~F.col("kid").contains("table-of-content"))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("domain").orderBy("kid")))
    return rows if first is None else rows.where(F.col("rn") <= first)


def cap_pairs(pairs: DataFrame, cap: int | None = PAIR_CAP) -> DataFrame:
    """At most ten pairs per left id, in scan order, or all (None)."""
    if cap is None:
        return pairs
    return pairs.withColumn("nth", F.row_number().over(Window.partitionBy("kid_a").orderBy("kid_b"))).where(F.col("nth") <= cap).drop("nth")


def vector_pairs(points: DataFrame, first: int | None = PAIR_FIRST, cap: int | None = PAIR_CAP) -> DataFrame:
    """kid_a < kid_b of one domain with a cosine of at least 0.92: a matrix product for each pair of blocks of
    PAIR_FIRST entries, so a task holds two blocks whatever the size of a domain."""
    firsts = points.groupBy("domain", "kid").agg(F.min_by("vector", "vec_id").alias("vector"), F.first("status").alias("status"))
    rows = eligible(firsts, first).withColumn("block", F.floor((F.col("rn") - 1) / PAIR_FIRST))
    blocks = rows.groupBy("domain").agg(F.max("block").alias("last"))
    rows = rows.join(F.broadcast(blocks), "domain").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    rows = rows.select("domain", "kid", "vector", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))

    def near(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("kid")
        m, block = unit_rows(rows.column("vector").to_pylist()), rows.column("block").to_numpy()
        c = np.round(m @ m.T, 4)
        p, q = rows.column("p")[0].as_py(), rows.column("q")[0].as_py()
        a, b = np.nonzero(np.triu(c >= NEAR, 1) & (block[:, None] == p) & (block[None] == q))
        names = rows.column("kid").combine_chunks()
        domain = pa.array([rows.column("domain")[0].as_py()] * len(a), pa.string())
        return pa.table({"domain": domain, "kid_a": names.take(pa.array(a)), "kid_b": names.take(pa.array(b)), "cosine": pa.array(c[a, b], pa.float64())})

    return cap_pairs(rows.groupBy("domain", "p", "q").applyInArrow(near, "domain string, kid_a string, kid_b string, cosine double"), cap)


def tag_pairs(entries: DataFrame, first: int | None = PAIR_FIRST, cap: int | None = PAIR_CAP) -> DataFrame:
    """Pairs of one domain and subject with at least half of the smaller tag set in common. A pair shares a
    tag, so candidates come from an equi-join on it."""
    rows = eligible(entries, first).select("domain", "subject", "kid", "rn", F.array_distinct("tags").alias("tags"), F.size("tags").alias("size"))
    rows = rows.withColumn("tag", F.explode("tags"))
    a, b = rows.alias("a"), rows.alias("b")
    # a pair is made at the least tag that both have, so once
    both = a.join(b, F.expr("a.domain = b.domain and a.subject = b.subject and a.tag = b.tag and a.rn < b.rn and a.tag = array_min(array_intersect(a.tags, b.tags))"))
    common = F.size(F.array_intersect("a.tags", "b.tags")).cast("long")
    both = both.select("a.domain", F.col("a.kid").alias("kid_a"), F.col("b.kid").alias("kid_b"), common.alias("common"), F.least("a.size", "b.size").alias("least_size"))
    return cap_pairs(both.where(F.col("common") / F.col("least_size") >= 0.5).select("domain", "kid_a", "kid_b", "common"), cap)


def hash_pairs(entries: DataFrame) -> DataFrame:
    """Copies by normalised body: each with the first of its domain, subject and hash."""
    rows = entries.withColumn("hash", tx.body_hash(F.col("content"))).where("status is null or status <> 'deprecated'")
    firsts = rows.groupBy("domain", "subject", "hash").agg(F.min("kid").alias("kid_a"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return rows.join(firsts, ["domain", "subject", "hash"]).where("kid <> kid_a").select("kid_a", F.col("kid").alias("kid_b"), "copies")


def dup_map(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("kid_a", "kid_b")).alias("kid")).groupBy("kid").agg(F.count(F.lit(1)).alias("pairs"))


def with_sides(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs with what ranking needs of either side."""
    facts = entries.select("kid", "subject", tx.body_hash(F.col("content")).alias("hash"), F.length(tx.normalized_body(F.col("content"))).alias("length"), F.col("parent").isNull().alias("alone"))
    for s in "ab":
        pairs = pairs.join(facts.select(F.col("kid").alias(f"kid_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("subject", "hash", "length", "alone")]), f"kid_{s}")
    return pairs.withColumn("negation", sc.negation(F.col("kid_a"), F.col("kid_b")))


def ranked_pairs(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    both = with_sides(pairs, entries)
    keep = sc.canonical(F.col("kid_a"), F.col("kid_b"), F.col("length_a"), F.col("length_b"), F.col("alone_a"), F.col("alone_b"))
    return both.select("kid_a", "kid_b", "cosine", sc.rank_pair().alias("flow"), keep.alias("keep"))


SENSITIVE = "(?i)₽|руб\\.|USD|маржа|гонорар|оклад|цена|договор"  # fixed value
PATHS = ("partners/", "_private/", "review-", ".trash/")  # fixed values


def sensitive(entries: DataFrame, path: str, content_pattern: str = SENSITIVE, paths: tuple = PATHS) -> DataFrame:
    """Entries with a marked path or two matches: the distinct matches, ten at most."""
    found = F.regexp_extract_all("content", F.lit(f"({content_pattern})"), F.lit(1))
    flag = F.exists(F.array(*map(F.lit, paths)), lambda p: F.contains(F.lower(path), p))
    rows = entries.withColumns({"found": F.coalesce(found, F.array().cast("array<string>")), "path_flag": flag}).where((F.size("found") >= 2) | F.col("path_flag"))
    return rows.select("kid", "path_flag", F.array_join(F.slice(F.array_sort(F.array_distinct("found")), 1, 10), ",").alias("matched"))


def gate_issues(entries: DataFrame, existing: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Required fields missing: critical; recommended ones: warn, or critical if strict; taken ids: critical."""
    miss = lambda c, level: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.struct(F.lit(level).alias("severity"), F.lit(c).alias("field")))
    level = "critical" if strict else "warn"
    issues = F.array_compact(F.array(*[miss(c, "critical") for c in ("kid", "domain", "subject", "tags", "version", "content")], *[miss(c, level) for c in ("project", "source_url", "content_type")]))
    found = entries.select("kid", F.explode(issues).alias("i")).select("kid", "i.severity", "i.field")
    if existing is None:
        return found
    taken = entries.join(existing.select("kid").distinct(), "kid", "left_semi")
    return found.unionByName(taken.select("kid", F.lit("critical").alias("severity"), F.lit("kid").alias("field")))


def issue_id(kind, kid, detail) -> F.Column:
    return F.concat(F.lit("iss_"), F.substring(F.sha2(F.concat_ws("|", kind, kid, detail).cast("binary"), 256), 1, 16))


def upsert_issues(store: DataFrame, found: DataFrame) -> DataFrame:
    """Full outer merge by issue id: new ones open, known ones keep their status and take the new detail."""
    s, f = store.alias("s"), found.alias("f")
    both = s.join(f, "issue_id", "full_outer")
    action = F.when(F.col("s.status").isNull(), "created").when(F.col("f.detail").isNull(), "kept").when(F.col("f.detail") != F.col("s.detail"), "refreshed").otherwise("skipped")
    return both.select("issue_id", F.coalesce("s.status", F.lit("open")).alias("status"), F.coalesce("f.detail", "s.detail").alias("detail"), action.alias("action"))


def auto_clear(issues: DataFrame, scores: DataFrame) -> DataFrame:
    """Open missing-field issues of entries that no longer need review."""
    return issues.where("type = 'missing_field' and status = 'open'").join(scores.where(F.col("score") < sc.REVIEW_THRESHOLD).select("kid", "score"), "kid")


def false_positive_rate(audit: DataFrame, scans: int = 3) -> DataFrame:
    """Rejections / (rejections + automatic deprecations) since the scan `scans` ago."""
    last = audit.where("action = 'scan_completed'").orderBy(F.desc("ts")).limit(scans)
    since = last.agg(F.when(F.count(F.lit(1)) == scans, F.min("ts")).alias("since"))
    rows = audit.join(F.broadcast(since)).where("since is null or ts >= since")
    no, auto = F.count_if(F.col("action") == "dup_rejected"), F.count_if(F.col("action") == "auto_deprecated")
    out = rows.agg(no.alias("rejections"), auto.alias("automatic"))
    return out.withColumns({"rate": F.when(F.col("rejections") + F.col("automatic") > 0, F.round(F.col("rejections") / (F.col("rejections") + F.col("automatic")), 4)), "fp_free": F.col("rejections") == 0})


def shielded(audit: DataFrame, scans: int = 3) -> DataFrame:
    """Entries restored after their last deprecation, until so many scans have passed since."""
    last = audit.groupBy("kid").agg(F.max(F.when(F.col("action") == "restored", F.col("ts"))).alias("restored"), F.max(F.when(F.col("action") == "auto_deprecated", F.col("ts"))).alias("deprecated"))
    last = last.where("restored is not null and (deprecated is null or restored > deprecated)")
    done = audit.where("action = 'scan_completed'").select(F.col("ts").alias("scan"))
    recent = done.orderBy(F.desc("scan")).limit(scans)
    floor = recent.agg(F.when(F.count(F.lit(1)) == scans, F.min("scan")).alias("floor"))
    return last.join(F.broadcast(floor)).where("floor is null or floor <= restored").select("kid", "restored")


def edit_wars(commits: DataFrame, now, hours: int = 24, least: int = 3) -> DataFrame:
    rows = commits.where((F.col("ts") > now - F.make_dt_interval(hours=F.lit(hours))) & (F.col("ts") <= now))
    return rows.groupBy("kid").agg(F.count(F.lit(1)).alias("commits")).where(F.col("commits") >= least)


def reconcile(store: DataFrame, index: DataFrame) -> DataFrame:
    """kid, state: missing in the index, orphan there, drifted, or ok."""
    s, i = store.alias("s"), index.alias("i")
    drift = F.when(F.col("i.updated_day").isNull(), F.col("s.explicit")).when(~F.col("s.explicit"), False).otherwise(F.col("s.updated_day") > F.col("i.updated_day"))
    state = F.when(F.col("i.indexed").isNull(), "missing").when(F.col("s.explicit").isNull(), "orphan").when(drift, "drifted").otherwise("ok")
    return s.join(i, "kid", "full_outer").select("kid", state.alias("state"))


def orphan_children(entries: DataFrame) -> DataFrame:
    known = entries.select(F.col("kid").alias("parent"))
    return entries.where("parent is not null").join(known, "parent", "left_anti").select("kid", "parent")


def incomplete_collections(children: DataFrame, entries: DataFrame, cap: int = 5) -> DataFrame:
    """Listed children (parent, child) that no entry has, five per collection at most."""
    gone = children.join(entries.select(F.col("kid").alias("child")), "child", "left_anti")
    return gone.withColumn("nth", F.row_number().over(Window.partitionBy("parent").orderBy("child"))).where(F.col("nth") <= cap).select("parent", "child")


def promotion_readiness(entries: DataFrame, issues: DataFrame) -> DataFrame:
    """Private entries with the number of their open sensitive issues and whether one warns."""
    n = issues.where("type = 'sensitive' and status = 'open'").groupBy("kid").agg(F.count(F.lit(1)).alias("open"))
    out = entries.where("zone = 'private'").join(n, "kid", "left").select("kid", F.coalesce("open", F.lit(0)).alias("open"))
    return out.withColumn("warn", F.col("open") > 0)


def group_similarity_text(entries: DataFrame) -> DataFrame:
    """What the scan embeds: id, subject and tags."""
    return entries.select("kid", F.concat_ws(" ", "kid", "subject", F.array_join("tags", " ")).alias("text"))
