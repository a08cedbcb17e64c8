"""Quality rules by weak supervision.

Each rule votes good (+1), bad (-1) or abstains (0). Nobody labels anything: the votes of all
documents are counted by pattern, and expectation-maximisation over those counts estimates how
often each rule is right on good and on bad documents, and the share of good ones. A document's
posterior probability of being good then decides, instead of every rule having to pass.

The counts are over all documents. There are at most 3 ** len(RULES) patterns, so what reaches the
driver has a fixed bound; the rows themselves never do.

Defined results: a null or empty text has no words, fails the base rules and is dropped; repeated
rows give repeated results; an empty table gives an empty result; other columns pass through
`apply_rules` untouched.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.common import text_bytes
from quillstone.llm.vocabularies import forget

SYMBOLS = b"#*$%&|<>"
#: Frequent function words of the corpus' four languages; fixed values.
STOP_WORDS = frozenset(
    "the of and to in a is that for with as on by be this it are was or an at from which "
    "der die das und in zu den von mit ist im des auf dem nicht ein eine "
    "le la les de des et en un une du que qui dans pour par sur au est avec "
    "el los las del y en que se por con una su al para lo como".encode().split()
)
FEATURES = {
    "n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(),
    "n_repeat_words": T.LongType(), "n_lines": T.LongType(), "n_upper": T.LongType(), "n_alpha_words": T.LongType(),
    "n_stop_words": T.LongType(), "n_distinct_words": T.LongType(), "n_marked_words": T.LongType(),
}
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(0x41, 0x5B))
_SPACES = b" \t\n\x0b\x0c\r"
#: Documents that the rules' assumed votes count for in the fit, whatever the size of the corpus.
PSEUDO_COUNTS = 4.0
_HAS_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
_MARKED = re.compile(rb"(?:!!|[#*$%&|<>]{2})")


def repeated_window_words(words: list[bytes], width: int = 3) -> int:
    """How many words lie in a window of so many words that the text has twice or more."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    key = a[: n - width + 1]
    for k in range(1, width):
        # keys of shorter windows are numbered anew, so that the product can't overflow
        key = np.unique(key, return_inverse=True)[1].astype(np.int64) if len(ids) > 2_000_000 else key
        key = key * len(ids) + a[k : n - width + 1 + k]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] >= 2)
    covered = np.zeros(n, bool)
    for k in range(width):
        covered[starts + k] = True
    return int(covered.sum())


def features(text: bytes) -> tuple[int, ...]:
    """The measures in FEATURES of one whole text."""
    words = text.split()  # bytes.split() knows exactly the white space of the word rule
    spaceless = text.translate(None, _SPACES)
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct = set(words)
    return (
        len(words),
        len(spaceless.translate(None, _CONTINUATION)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_window_words(words),
        len(lines),
        len(text) - len(text.translate(None, _UPPER)),
        sum(map(bool, map(_HAS_LETTER.search, words))),
        sum(w in STOP_WORDS for w in words),
        len(distinct),
        len(_MARKED.findall(text)),
    )


def measure(docs: DataFrame) -> DataFrame:
    """The measures of every row, after the row's own columns (without text) as the struct `row`."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    slim = docs.select(F.struct(*others).alias("row"), "text")
    schema = T.StructType([*slim.schema.fields, *(T.StructField(k, v) for k, v in FEATURES.items())])

    def run(batches):
        forget()
        for batch in batches:
            rows = [features(x) for x in text_bytes(batch)]
            table = np.array(rows, np.int64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(table[:, k]) for k in range(len(FEATURES)))], names=["row", "text", *FEATURES])

    return slim.mapInArrow(run, schema)


def _vote(good, bad):
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, F.Column]:
    """The rules over the measures: name -> +1 good, -1 bad, 0 abstains."""
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    mean = F.col("word_chars") / n
    ratio = lambda c, by=n: F.col(c) / by
    enough = F.col("n_words") >= 50
    return {
        "word_length": _vote((mean >= 3) & (mean <= 9), (mean < 2) | (mean > 14)),
        "symbols": _vote(ratio("n_symbols") < 0.05, ratio("n_symbols") > 0.25),
        "duplicate_lines": _vote((F.col("n_lines") >= 3) & (ratio("n_dup_lines", lines) < 0.1), ratio("n_dup_lines", lines) > 0.4),
        "repeats": _vote(ratio("n_repeat_words") < 0.1, ratio("n_repeat_words") > 0.35),
        "capitals": _vote(F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)) < 0.15, F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)) > 0.5),
        "letters": _vote(ratio("n_alpha_words") > 0.9, ratio("n_alpha_words") < 0.6),
        "function_words": _vote(ratio("n_stop_words") > 0.1, enough & (ratio("n_stop_words") < 0.02)),
        "variety": _vote(ratio("n_distinct_words") > 0.3, enough & (F.col("n_words") < 2000) & (ratio("n_distinct_words") < 0.1)),
        "marks": _vote(ratio("n_marked_words") < 0.02, ratio("n_marked_words") > 0.2),
    }


RULES = ("word_length", "symbols", "duplicate_lines", "repeats", "capitals", "letters", "function_words", "variety", "marks")


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) and how often each occurs.

    Returns the share of good documents and table[rule, class, vote]: the probability of each vote
    (bad, abstain, good) given the class (0 bad, 1 good). Classes keep their meaning because the
    start takes every rule as better than chance, and pseudo-counts of the same kind stay in.
    """
    k = patterns.shape[1]
    prior = np.empty((k, 2, 3))
    prior[:, 1] = (0.05, 0.25, 0.7)
    prior[:, 0] = (0.5, 0.3, 0.2)
    table, good = prior.copy(), 0.8
    if not counts.sum():
        return good, table
    strength = PSEUDO_COUNTS
    hot = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
    for _ in range(rounds):
        p = posterior(patterns, good, table)
        w = np.stack([counts * (1 - p), counts * p], 1)
        new = np.einsum("nc,nkv->kcv", w, hot) + strength * prior
        new /= new.sum(2, keepdims=True)
        share = (w[:, 1].sum() + 0.8 * strength) / (counts.sum() + strength)
        moved = max(abs(share - good), np.abs(new - table).max())
        good, table = share, new
        if moved < 1e-9:
            break
    return float(good), table


def posterior(patterns: np.ndarray, good: float, table: np.ndarray) -> np.ndarray:
    """Probability that a document with these votes is good."""
    rule = np.arange(patterns.shape[1])
    log = np.log(table[rule[None], :, patterns + 1]).sum(1)
    log += np.log([1 - good, good])
    return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))


def log_odds(good: float, table: np.ndarray):
    """The posterior's log odds as a column over the vote columns: a constant plus one weight per vote."""
    out = F.lit(float(np.log(good / (1 - good))))
    for k, rule in enumerate(RULES):
        w = np.log(table[k, 1] / table[k, 0])
        out = out + F.when(F.col(f"vote_{rule}") == -1, float(w[0])).when(F.col(f"vote_{rule}") == 1, float(w[2])).otherwise(float(w[1]))
    return out


def judge(measured: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Measured documents with votes, p_good, base_failed and kept.

    The fit counts the votes of every row that passes the base rules; the others are dropped anyway
    and would make the bad class mean "short".
    """
    voted = measured.withColumns({f"vote_{k}": v for k, v in votes().items()})
    names = [f"vote_{k}" for k in RULES]
    found = voted.where(~base_failed()).groupBy(*names).count().collect()  # at most 3 ** 9 rows
    patterns = np.array([[r[c] for c in names] for r in found], int).reshape(-1, len(names))
    good, table = fit(patterns, np.array([r["count"] for r in found], float))
    odds = log_odds(good, table)
    return voted.withColumn("base_failed", base_failed()).withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def apply_rules(docs: DataFrame, scratch, threshold: float = 0.5) -> DataFrame:
    """The documents that the rules keep, with their own columns only."""
    kept = judge(scratch.cut(measure(docs), "measured"), threshold).where("kept")
    return kept.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
