"""Text rules as Column -> Column functions, all on built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The transliteration of Cyrillic letters.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
_ONE = {k: v for k, v in CYRILLIC.items() if len(v) <= 1}
_MANY = {k: v for k, v in CYRILLIC.items() if len(v) > 1}


def transliterate(text: Column) -> Column:
    """Lower case with Cyrillic letters in Latin ones: one `translate` for the single-letter ones."""
    kept = "".join(k for k, v in _ONE.items() if v) + "".join(k for k, v in _ONE.items() if not v)
    out = F.translate(F.lower(text), kept, "".join(v for v in _ONE.values() if v))
    for k, v in _MANY.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def slugify(text: Column, max_len: int = 60) -> Column:
    slug = F.regexp_replace(F.regexp_replace(transliterate(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(slug, 1, max_len), "-+$", "")


def normalize_tag(word: Column) -> Column:
    out = F.regexp_replace(transliterate(word), "[^a-z0-9-]", "")
    return F.regexp_replace(F.regexp_replace(out, "-{2,}", "-"), "^-+|-+$", "")


def or_else(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def knowledge_id(domain: Column, subject: Column, title: Column, suffix: Column, default: str = "section") -> Column:
    """domain-subject-slug-suffix with slugs of 40 characters. Over 127 characters the title's slug is cut."""
    d, s = or_else(slugify(domain, 40), "domain"), or_else(slugify(subject, 40), "subject")
    slug = slugify(or_else(title, default), 40)
    over = F.length(d) + F.length(s) + F.length(slug) + F.length(suffix) + 3 - 127
    kept = F.substr(slug, F.lit(1), F.greatest(F.length(slug) - F.greatest(over, F.lit(0)), F.lit(0)))
    return F.concat(d, F.lit("-"), s, F.lit("-"), kept, F.lit("-"), suffix)


def derive_title(content: Column, fallback: Column) -> Column:
    """The first Markdown heading, else the fallback."""
    found = F.regexp_extract(content, r"(?m)^#{1,6}\s+(.+)$", 1)
    return F.coalesce(F.nullif(F.trim(found), F.lit("")), fallback)


def meaningful(content: Column) -> Column:
    """Has a Latin or Cyrillic letter or a digit."""
    return F.coalesce(content, F.lit("")).rlike("[A-Za-zА-Яа-я0-9]")


def strip(text: Column) -> Column:
    """Without what `\\s` matches at both ends. A pattern would look at every character, and Java's `$` also stands before a
    last line separator (U+0085, U+2028, U+2029)."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def normalized_body(content: Column) -> Column:
    return F.regexp_replace(strip(content), r"\n{3,}", "\n\n")


def body_hash(content: Column) -> Column:
    return F.sha2(normalized_body(content).cast("binary"), 256)


def token_count(text: Column) -> Column:
    """A token per four characters, rounded up; none of an empty text."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")


def mask_secrets(text: Column) -> Column:
    for pattern, by in SECRETS:
        text = F.regexp_replace(text, pattern, by)
    return text


# What counts as a secret, in this order.
SECRETS = (
    (r"(?U)\bmcp_[a-z]{1,3}_[A-Za-z0-9]+\b", "<secret>"),
    (r"(?U)\b[0-9a-fA-F]{32,}\b", "<secret>"),
    (r"(?i)Authorization:\s*.*", "Authorization: <secret>"),
    (r"(?iU)\bBearer\s+\S+", "Bearer <secret>"),
    (r"(?iU)\b(password|token|api[_-]?key|secret)\s*[=:]\s*\S+", "$1=<secret>"),
)
# What a message signature masks, in this order.
VARIABLE_PARTS = (
    (r"(?iU)\bkey=[0-9a-f]{4,64}\b", "key=<key>"),
    (r"(?iU)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<uuid>"),
    (r"(?iU)\b[0-9a-f]{16,}\b", "<hex>"),
    (r"(?U)(?<![\w./-])/(?:[\w.-]+/)*[\w.-]+", "<path>"),
    (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?", "<ts>"),
    (r"(?U)\b(?:\d+(?:\.\d+)?\s?(?:ns|µs|us|ms|s|m|h))+\b", "<dur>"),
    (r"(?U)\b\d+\b", "<n>"),
)


def deep_normalize(text: Column) -> Column:
    for pattern, by in VARIABLE_PARTS:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def signature(source: Column, marker: Column, code: Column, message: Column) -> Column:
    key = F.coalesce(F.nullif(marker, F.lit("")), F.nullif(code, F.lit("")), F.lit("-"))
    return F.concat_ws("|", source, key, deep_normalize(message))


def marker(line: Column) -> Column:
    """The first bracketed capital word that is no log level, nor HTTP."""
    found = F.regexp_extract_all(line, F.lit(r"\[([A-Z][A-Z_]+)\]"), F.lit(1))
    levels = F.array(*map(F.lit, ("INFO", "DEBUG", "WARNING", "ERROR", "CRITICAL", "HTTP")))
    return F.get(F.filter(found, lambda x: ~F.array_contains(levels, x)), 0)


def endpoint(line: Column) -> Column:
    """The route of an access line: no query, no host, ids masked, 200 characters; null if none."""
    target = F.split(F.regexp_extract(line, r'"(\S+) (\S+) HTTP/[\d.]+" (\d{3})', 2), r"\?").getItem(0)
    path = F.regexp_replace(target, "^[^/]*?://[^/]*", "")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    is_id = lambda s: s.rlike(r"^(\d+|(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-f]{16,}))$")
    route = F.concat(F.lit("/"), F.array_join(F.transform(segments, lambda s: F.when(is_id(s), "<id>").otherwise(s)), "/"))
    return F.when(target != "", F.substring(route, 1, 200))


#: A budget of so many characters or fewer shapes nothing; fixed value.
SHAPING_FLOOR = 200


def shape_section(text: Column, budget: int, mark: str = "[…cut %s% …]") -> Column:
    """Over the budget: the first 80 % and the last 20 % of it, between them a mark with the share in percent
    that was cut."""
    if budget <= SHAPING_FLOOR:
        return text
    n = F.length(text)
    head = int(budget * 0.8)
    percent = F.bround((n - budget) * 100 / n).cast("int").cast("string")
    between = F.concat(F.lit("\n\n"), F.replace(F.lit(mark), F.lit("%s"), percent), F.lit("\n\n"))
    return F.when(n <= budget, text).otherwise(F.concat(F.substring(text, 1, head), between, F.right(text, F.lit(budget - head))))


def snippet(text: Column, lines: int = 30, chars: int = 2000) -> Column:
    return F.substring(F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n"), 1, chars)


def metric_label(value: Column) -> Column:
    clean = F.substring(F.regexp_replace(value, "[^A-Za-z0-9_.-]", "_"), 1, 64)
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("none"))


def byte_range(header: Column, size: Column) -> Column:
    """`bytes=a-b` against a size -> struct(start, end) inclusive, or null."""
    a, b = (F.nullif(F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", k), F.lit("")).cast("long") for k in (1, 2))
    start = F.when(a.isNull(), F.greatest(F.lit(0), size - b)).otherwise(a)
    end = F.when(a.isNull() | b.isNull(), size - 1).otherwise(F.least(b, size - 1))
    fits = (a.isNotNull() | b.isNotNull()) & (start <= end) & (start < size) & ~(a.isNull() & (b == 0))
    return F.when(fits, F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))


def source_id(content: Column) -> Column:
    """src- and the first 16 digits of the content's SHA-256."""
    return F.concat(F.lit("src-"), F.substring(F.sha2(content.cast("binary"), 256), 1, 16))


def dupe_hash(name: Column, phone: Column) -> Column:
    """A person's requests share it: lower case, single spaces."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(F.concat_ws("|", name, phone), r"\s+", " "))).cast("binary"), 256)


def effect_id(job: Column, node: Column, effect: Column) -> Column:
    """The same for every attempt of a job's effect."""
    return F.sha2(F.concat_ws("\u001f", job, node, effect).cast("binary"), 256)


def prompt_hash(text: Column) -> Column:
    """Trailing white space of lines does not count."""
    return F.sha2(F.regexp_replace(text, r"(?m)\s+$", "").cast("binary"), 256)
