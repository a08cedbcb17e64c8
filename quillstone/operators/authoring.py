"""What happens to a text before it is an entry: sections, parts, identifiers, tags, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as tx
from quillstone.operators import documents as dc

MAX_TOKENS, CHARS_PER_TOKEN, CHUNK_TOKENS = 512, 4, 120
_HEADER = r"(?m)^(#{1,3}\s+.+)$"
_CUT = "\x01"


def structural_sections(texts: DataFrame) -> DataFrame:
    """kid, nth (from 1), title, body: sections under headings of level 1 to 3.

    Fewer than two headings give one section of the whole text; what stands before the first of several
    headings is put in front of the first section. Blank texts give none.
    """
    rows = texts.select("kid", "content", _between_heads(F.col("content")).alias("heads"))
    return _numbered(rows.select("kid", _structural(F.col("content"), F.col("heads")).alias("sections")))


def _numbered(rows: DataFrame) -> DataFrame:
    """A row a section. The outer form, as for the plain one Spark puts a filter under it that makes the sections once more."""
    rows = rows.select("kid", F.posexplode_outer("sections").alias("nth", "s")).where("nth is not null")
    return rows.select("kid", (F.col("nth") + 1).alias("nth"), "s.title", "s.body")


def _between_heads(content: Column) -> Column:
    return F.split(F.regexp_replace(content, _HEADER, f"{_CUT}$1"), _CUT)


def _structural(content: Column, parts: Column) -> Column:
    """Sections of a text and its parts between headings, which are a column: as an expression they would be made several times.
    Null for a blank text; a filter before would make the text a second time where it is an expression."""
    title = lambda part: tx.strip(F.regexp_extract(part, r"^#{1,3}\s+(.+)", 1))
    single = F.struct(F.when(F.size(parts) == 2, title(F.get(parts, F.lit(1)))).otherwise("Untitled").alias("title"), tx.strip(content).alias("body"))
    before = tx.strip(F.get(parts, F.lit(0)))

    def section(part: Column, i: Column) -> Column:
        body = tx.strip(part)
        return F.struct(title(part).alias("title"), F.when((i == 0) & (before != ""), F.concat(before, F.lit("\n\n"), body)).otherwise(body).alias("body"))

    several = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), section)
    return F.when(content.rlike(r"\S"), F.when(F.size(parts) < 3, F.array(single)).otherwise(several))


def clustered_sections(pieces: Column, section: Column) -> Column:
    """Paragraphs with one section number after the other, joined: title (the first line, 120 characters) and body.
    `section` has a number per paragraph. Both are columns, no expressions: lambdas here look into them by position, and
    Spark computes what a lambda holds anew for every element."""
    opens = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: (i == 0) | (F.get(section, i) != F.get(section, i - 1)))
    ends = lambda starts: F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(pieces)))

    def joined(x: Column, k: Column) -> Column:
        body = F.array_join(F.slice(pieces, x["at"] + 1, x["end"] - x["at"]), "\n\n")
        head = F.substring(tx.strip(F.substring_index(F.get(pieces, x["at"]), "\n", 1)), 1, 120)
        return F.struct(tx.or_else(head, F.concat(F.lit("Section "), (k + 1).cast("string"))).alias("title"), body.alias("body"))

    return F.transform(F.arrays_zip(opens.alias("at"), ends(opens).alias("end")), joined)


def recursive_parts(sections: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """kid, nth, part, title, body: sections over the limit (four characters a token, rounded down) are cut
    between sentences, greedily; a single sentence is cut off at the limit."""
    whole = F.length("body") <= max_tokens * CHARS_PER_TOKEN + CHARS_PER_TOKEN - 1
    sents = F.filter(F.transform(F.split(tx.strip(F.col("body")), r"(?<=[.!?])\s+"), tx.strip), lambda s: s != "")
    rows = sections.withColumns({"whole": whole, "sents": F.when(whole, None).otherwise(sents)})
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("tokens"), F.array(F.lit(0)).alias("starts"))

    def step(acc: Column, s: Column) -> Column:
        tokens = F.floor(F.length(s) / CHARS_PER_TOKEN).cast("int")
        opens = (acc["i"] > 0) & (acc["tokens"] + tokens > max_tokens)
        starts = F.when(opens, F.array_append(acc["starts"], acc["i"])).otherwise(acc["starts"])
        return F.struct((acc["i"] + 1).alias("i"), F.when(opens, tokens).otherwise(acc["tokens"] + tokens).alias("tokens"), starts.alias("starts"))

    rows = rows.withColumn("starts", F.aggregate("sents", start, step, lambda acc: acc["starts"]))
    cut = F.struct(F.lit(1).alias("part"), F.lit(1).alias("parts"), F.substring("body", 1, max_tokens * CHARS_PER_TOKEN).alias("body"))
    kept = F.struct(F.lit(1).alias("part"), F.lit(1).alias("parts"), F.col("body").alias("body"))
    n = F.size("starts")

    def packed(at: Column, i: Column) -> Column:
        end = F.coalesce(F.get("starts", i + 1), F.size("sents"))
        return F.struct((i + 1).alias("part"), n.alias("parts"), F.array_join(F.slice("sents", at + 1, end - at), " ").alias("body"))

    parts = F.when(F.col("whole"), F.array(kept)).when(F.size("sents") <= 1, F.array(cut)).otherwise(F.transform("starts", packed))
    out = rows.select("kid", "nth", "title", F.explode(parts).alias("p")).select("kid", "nth", "p.part", "p.parts", "title", "p.body")
    named = F.when(F.col("parts") > 1, F.concat("title", F.lit(" (part "), F.col("part").cast("string"), F.lit(")"))).otherwise(F.col("title"))
    return out.select("kid", "nth", "part", named.alias("title"), "body")


def hybrid_sections(texts: DataFrame, max_tokens: int = MAX_TOKENS, vectors: DataFrame | None = None, most: int = 2000) -> DataFrame:
    """kid, seq (1..n over the parts of a text), title, body.

    Structural sections, unless there are fewer than two or one is over the limit: then, if `vectors` (kid, nth from
    0, vector) has the text's paragraphs, two to `most` of them, sections are its clusters. What is over
    the limit is cut between sentences at last. A text without vectors for all its paragraphs keeps its structure.
    """
    if vectors is None:
        parts = recursive_parts(structural_sections(texts), max_tokens)
    else:
        found = dc.paragraph_clusters(vectors, most=most, doc="kid").select("kid", F.col("sections").alias("numbers"))
        rows = texts.select("kid", "content").join(found, "kid", "left")  # texts travel once, before they are split
        rows = rows.withColumn("heads", _between_heads(F.col("content")))
        rows = rows.select("kid", "numbers", _structural(F.col("content"), F.col("heads")).alias("sections"), dc.paragraphs(F.col("content")).alias("pieces"))
        over = F.exists("sections", lambda s: F.floor(F.length(s["body"]) / CHARS_PER_TOKEN) > max_tokens)
        asked = ((F.size("sections") < 2) | over) & F.size("pieces").between(2, most)
        whole = asked & (F.size(F.coalesce("numbers", F.array().cast("array<bigint>"))) == F.size("pieces"))
        parts = recursive_parts(_numbered(rows.select("kid", F.when(whole, clustered_sections(F.col("pieces"), F.col("numbers"))).otherwise(F.col("sections")).alias("sections"))), max_tokens)
    order = Window.partitionBy("kid").orderBy("nth", "part")
    return parts.select("kid", F.row_number().over(order).alias("seq"), "title", "body")


def header_chunks(sections: DataFrame, tokens: int = CHUNK_TOKENS, overlap: int = 60) -> DataFrame:
    """kid, chunk, start, content: a section (kid, nth, header, body) of up to so many tokens is a chunk as it
    is; a longer one is cut into windows with an overlap, each under the section's header."""
    width, stride = tokens * CHARS_PER_TOKEN, (tokens - overlap) * CHARS_PER_TOKEN
    n = F.length("body")
    short = F.ceil(n / CHARS_PER_TOKEN) <= tokens
    last = F.when(short, 0).otherwise(F.greatest(F.lit(0), F.ceil((n - width) / stride)).cast("int"))
    rows = sections.select("kid", "nth", "header", "body", short.alias("short"), F.explode(F.sequence(F.lit(0), last)).alias("w"))
    piece = F.substr("body", F.col("w") * stride + 1, F.lit(width))
    content = F.when(F.col("short"), F.col("body")).when(F.col("header") == "", piece).otherwise(F.concat(F.lit("## "), "header", F.lit("\n\n"), piece))
    chunk = F.row_number().over(Window.partitionBy("kid").orderBy("nth", "w")) - 1
    return rows.select("kid", chunk.alias("chunk"), (F.col("w") * stride).alias("start"), content.alias("content"))


def representative_text(content: Column) -> Column:
    """The first heading and line, or the first two lines, outside front matter and code fences; of a text
    without any its first 500 characters. Every heading before the second plain line counts as well."""
    lines = F.transform(F.split(tx.strip(content), "\n"), tx.strip)
    start = F.struct(F.lit(False).alias("code"), F.lit(False).alias("front"), F.lit(False).alias("closed"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        fence, rule = line.startswith("```"), line == "---"
        seen = ~fence & ~rule & ~acc["front"] & ~acc["code"] & (acc["closed"] | ~content.startswith("---")) & (line != "") & ~acc["done"]
        heading = line.startswith("#")
        out = F.when(seen, F.array_append(acc["out"], F.when(heading, F.trim(F.regexp_replace(line, "^#+", ""))).otherwise(line))).otherwise(acc["out"])
        toggles = rule & ~fence
        return F.struct(
            (acc["code"] != fence).alias("code"), F.when(toggles, ~acc["front"]).otherwise(acc["front"]).alias("front"),
            (acc["closed"] | (toggles & acc["front"])).alias("closed"), (acc["done"] | (seen & ~heading & (F.size(out) >= 2))).alias("done"), out.alias("out"),
        )

    return F.aggregate(lines, start, step, lambda acc: F.when(F.size(acc["out"]) > 0, F.array_join(acc["out"], " ")).otherwise(F.substring(content, 1, 500)))


def collection_id(domain: Column, subject: Column, title: Column) -> Column:
    return tx.knowledge_id(domain, subject, title, F.lit("collection"), "collection")


def auto_id(domain: Column, subject: Column, content: Column) -> Column:
    """domain-subject-slug of the first second-level heading, or eight digits of the text's hash."""
    slug = tx.slugify(F.regexp_extract(content, r"(?m)^##\s+(.+)$", 1), 40)
    digits = F.substring(F.sha2(F.substring(content, 1, 200).cast("binary"), 256), 1, 8)
    head = F.concat_ws("-", tx.or_else(tx.slugify(domain, 40), "domain"), tx.or_else(tx.slugify(subject, 40), "subject"), F.when(slug == "", digits).otherwise(slug))
    return F.regexp_replace(F.substring(head, 1, 127), "-+$", "")


def distinct_by(tags: Column, key) -> Column:
    """The tags without those whose key an earlier one has."""
    keys = F.transform(tags, key)
    return F.filter(tags, lambda t, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def merged_tags(own: Column, inherited: Column) -> Column:
    """Inherited tags first, then own ones; the case of letters does not count."""
    return distinct_by(F.concat(inherited, own), F.lower)


def normal_tags(tags: Column, most: int = 10) -> Column:
    clean = F.transform(tags, lambda t: F.trim(F.regexp_replace(F.lower(t), r"\s+", " ")))
    return F.slice(F.array_distinct(F.filter(clean, lambda t: t != "")), 1, most)


def suggested_tags(entries: DataFrame) -> DataFrame:
    """kid, suggested: up to five of the ten most frequent tags of the entry's domain that it lacks, then
    domain, subject and project as tags, seven in all. What it lacks is neither in its tags nor in its
    cross_subjects. Counts are those of the whole domain; equal counts go by alphabet."""
    counts = entries.select("domain", F.explode("tags").alias("tag")).groupBy("domain", "tag").count()
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("count"), "tag"))
    top = counts.withColumn("rank", rank).where("rank <= 10").groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("rank", "tag"))).alias("top"))
    own = F.concat("tags", F.coalesce("cross_subjects", F.array().cast("array<string>")))
    rows = entries.withColumn("own", own).join(F.broadcast(top), "domain", "left")  # ten tags a domain
    often = F.slice(F.filter(F.transform("top", lambda x: x["tag"]), lambda t: ~F.array_contains("own", t)), 1, 5)
    path = F.transform(F.array_compact(F.array("domain", "subject", "project")), lambda p: F.translate(F.lower(p), "_/", "--"))
    path = F.filter(path, lambda p: ~F.array_contains("own", p))
    return rows.select("kid", F.slice(F.array_distinct(F.concat(F.coalesce(often, F.array().cast("array<string>")), path)), 1, 7).alias("suggested"))


def shared_core(a: Column, b: Column) -> Column:
    """The common beginning of two ids, cut at its last hyphen."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substr(a, F.lit(1), k) == F.substr(b, F.lit(1), k))
    core = F.substr(a, F.lit(1), F.coalesce(F.array_max(same), F.lit(0)))
    return F.regexp_replace(core, "-[^-]*$", "")


def lost_children(children: DataFrame, entries: DataFrame, least: int = 6, cap: int = 5) -> DataFrame:
    """Listed children (parent, child) that no entry has and that are no sections of the parent's book,
    which share a core of `least` characters with it; so many of a parent."""
    gone = children.join(entries.select(F.col("kid").alias("child")), "child", "left_anti").where(F.length(shared_core(F.col("parent"), F.col("child"))) < least)
    rank = F.row_number().over(Window.partitionBy("parent").orderBy("child"))
    return gone.withColumn("nth", rank).where(F.col("nth") <= cap).select("parent", "child")


def recommended_missing(entries: DataFrame, fields: list[str]) -> DataFrame:
    """kid, field: recommended fields that are null, empty, false or an empty list."""
    kinds = dict(entries.dtypes)

    def missing(c: str) -> Column:
        x = F.col(c)
        empty = F.size(x) == 0 if kinds[c].startswith("array") else ~x if kinds[c] == "boolean" else x.cast("string") == ""
        return F.when(x.isNull() | empty, F.lit(c))

    return entries.select("kid", F.explode(F.array_compact(F.array(*map(missing, fields)))).alias("field"))


def verdict(answer: Column) -> Column:
    """The first word of an answer's first line, in capitals, without Markdown marks and closing signs."""
    body = F.regexp_replace(F.regexp_replace(tx.strip(answer), r"^```[^\n]*\n?", ""), r"\s*(```\s*)+$", "")
    first = F.regexp_replace(F.split(tx.strip(body), "\n").getItem(0), r"^[`#>*\-\s—]+", "")
    word = F.regexp_replace(F.split(F.trim(first), r"\s+").getItem(0), r"[`*_.,:;!]+$", "")
    return F.nullif(F.upper(word), F.lit(""))


def clean_title(title: Column) -> Column:
    """One line, single spaces, no leading heading marks, 120 characters."""
    return F.trim(F.substring(F.regexp_replace(tx.strip(F.regexp_replace(title, r"\s+", " ")), r"^#+\s*", ""), 1, 120))


def with_heading(content: Column, title: Column) -> Column:
    """The text with its first top heading renamed, or with one in front."""
    start = F.regexp_instr(content, F.lit(r"(?m)^# .+$"))
    old = F.regexp_extract(content, r"(?m)^# .+$", 0)
    renamed = F.concat(F.substr(content, F.lit(1), start - 1), F.lit("# "), title, F.substr(content, start + F.length(old)))
    return F.when(start > 0, renamed).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), content))


# The content types that are served as they are, with the extension of a file without a name.
SERVED_TYPES = {
    "application/pdf": ".pdf", "application/epub+zip": ".epub", "image/png": ".png", "image/jpeg": ".jpg",
    "image/gif": ".gif", "image/webp": ".webp", "text/plain": ".txt", "text/markdown": ".md",
}
OTHER_TYPE, OTHER_EXTENSION = "application/octet-stream", ".bin"


def served_type(mime: Column) -> Column:
    """Without parameters, in lower case; what isn't on the list, HTML among it, is bytes to be saved."""
    plain = F.lower(tx.strip(F.split(mime, ";").getItem(0)))
    return F.when(plain.isin(*SERVED_TYPES), plain).otherwise(OTHER_TYPE)


def download_name(name: Column, sha: Column, mime: Column) -> Column:
    """The file's name without control characters, quotes and slashes; if nothing is left, its hash with the extension
    of its (served) type."""
    ending = F.lit(OTHER_EXTENSION)
    for kind, extension in SERVED_TYPES.items():
        ending = F.when(mime == kind, extension).otherwise(ending)
    return tx.or_else(tx.strip(F.regexp_replace(name, r'[\x00-\x1f\x7f"\\/]', "")), F.concat(sha, ending))


def located(text: Column, chunk: Column, least: int = 24) -> Column:
    """Where a chunk begins in a text (from 0) if runs of white space count as one space in both; null if it is
    not there, or shorter than `least` characters then."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    at = F.instr(flat(text), flat(chunk))
    before = F.substr(flat(text), F.lit(1), F.greatest(at - 1, F.lit(0)))
    words, gaps = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)), F.regexp_extract_all(text, F.lit(r"\s+"), F.lit(0))
    whole = F.length(F.regexp_replace(before, "[^ ]", ""))  # words that end before the chunk
    inner = F.length(F.regexp_extract(before, r"[^ ]*$", 0))
    lead = F.length(F.regexp_extract(text, r"^\s*", 0))
    inside = F.when(lead > 0, F.slice(gaps, 2, F.size(gaps))).otherwise(gaps)
    sums = lambda a: F.aggregate(F.slice(a, 1, whole), F.lit(0), lambda n, x: n + F.length(x))
    return F.when((F.length(flat(chunk)) >= least) & (at > 0), lead + sums(words) + sums(inside) + inner)


def book_titles(entries: DataFrame) -> DataFrame:
    """kid, book_title: the title of an entry's book in its own zone, or null."""
    books = entries.select(F.col("kid").alias("parent"), "zone", tx.derive_title(F.col("content"), F.col("kid")).alias("book_title"))
    return entries.where("parent is not null").select("kid", "parent", "zone").join(books, ["parent", "zone"], "left").select("kid", "book_title")


# What quotas may say.
PRIORITIES, CURRENCIES = ("high", "med", "low"), ("RUB", "USD")


def quota_findings(participants: DataFrame, budgets: DataFrame, classes: DataFrame, default_role: str) -> DataFrame:
    """code, path of what is wrong with a table of quotas. participants: role, priority, tokens_per_day, conc, grants; budgets:
    name, limit, currency, period, reconcile, per_user_mirror; scalars as they are written, so that a number that is
    none can be told; null tokens_per_day and conc are no limit. classes: model_class."""
    whole = lambda c: F.col(c).rlike("^[+-]?[0-9]+$")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    below = lambda c, least: F.col(c).isNotNull() & ~F.coalesce(whole(c) & (F.col(c).try_cast("decimal(38,0)") >= least), F.lit(False))

    def told(rows: DataFrame, base: Column, checks: list[tuple[Column, str, str]]) -> DataFrame:
        found = [F.when(c, F.struct(F.lit(code).alias("code"), F.concat(base, F.lit(end)).alias("path"))) for c, code, end in checks]
        return rows.select(F.inline(F.array_compact(F.array(*found))))

    p, at = participants.withColumn("n", F.size(F.coalesce("grants", F.array().cast("array<string>")))), F.concat(F.lit("participants."), "role")
    mine = told(p, at, [
        (blank(F.col("role")), "Q3", ""), (~F.coalesce(F.col("priority").isin(*PRIORITIES), F.lit(False)), "Q5", ".priority"), (below("tokens_per_day", 0), "Q6", ".tokens_per_day"),
        (below("conc", 1), "Q7", ".conc"), (F.col("n") == 0, "Q8", ".grants"), ((F.col("role") == default_role) & (F.col("tokens_per_day").isNull() | F.col("conc").isNull()), "Q14", ""),
    ])
    mine = mine.withColumn("path", F.when(F.col("code") == "Q14", "defaults.role").otherwise(F.col("path")))
    each = p.select(at.alias("path"), F.explode("grants").alias("model_class")).join(classes.select("model_class", F.lit(True).alias("known")).distinct(), "model_class", "left")
    granted = each.where(blank(F.col("model_class")) | F.col("known").isNull()).select(F.lit("Q8").alias("code"), F.concat("path", F.lit(".grants")).alias("path"))
    number = F.col("limit").try_cast("double")
    spent = told(budgets, F.concat(F.lit("budgets."), "name"), [
        (~F.coalesce((number > 0) & ~F.lower("limit").isin("true", "false"), F.lit(False)), "Q11", ".limit"), (~F.coalesce(F.col("currency").isin(*CURRENCIES), F.lit(False)), "Q12", ".currency"),
        (blank(F.col("period")), "Q3", ".period"), (blank(F.col("reconcile")), "Q3", ".reconcile"), (~F.coalesce(F.lower("per_user_mirror").isin("true", "false"), F.lit(False)), "Q13", ".per_user_mirror"),
    ])
    none = lambda rows, code, path: rows.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(code).alias("code"), F.lit(path).alias("path"))
    whole_table = none(p, "Q4", "participants").union(none(budgets.where("name = 'ext'"), "Q10", "budgets"))
    named = p.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == default_role).alias("there")).where("n > 0 and there = 0").select(F.lit("Q9").alias("code"), F.lit("defaults.role").alias("path"))
    return mine.union(granted).union(spent).union(whole_table).union(named)
