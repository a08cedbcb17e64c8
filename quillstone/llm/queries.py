"""The thin queries over the ten operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import chat_repair, katz, line_dedup, mixing, ngram_join, piece_fst, quality_rules, quotes, retrieval_packing, separator_scan, sort_means, stream_dedup, token_files
from quillstone.llm.common import Scratch
from quillstone.llm.vocabularies import default_path, vocabulary_bytes

PIECES, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_piece_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabulary_bytes(default_path(PIECES))
    return piece_fst.encode_documents(_documents(spark, sf_dir).select("doc_id", "text"), model, with_ids=False, with_text=False)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "source")
    return mixing.mix(Scratch(spark, "mix"), docs).select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: lines, lines that go, and the digest of the text that stays."""
    marked = line_dedup.mark_lines(Scratch(spark, "lines"), _documents(spark, sf_dir).select("doc_id", "text"))
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(F.split("row.text", "\n"))).cast("long")
    n_gone = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return marked.select("row.doc_id", n_lines.alias("n_lines"), n_gone.alias("n_dropped"), F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op4_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return quotes.order_replies(Scratch(spark, "quotes"), messages)


def op5_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "separator-scan")
    path = scratch.path("flat")
    separator_scan.write_flat(_documents(spark, sf_dir).select("doc_id", "text"), path, vocabulary_bytes(default_path(PIECES)))
    counted = scratch.cut(separator_scan.count_tokens(scratch, f"{path}/kind=ids"), "counted")
    return separator_scan.name_documents(scratch, path, counted).select("doc_id", "n_tokens", "start", "closed")


def op6_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.dedup(spark, f"{sf_dir}/documents.parquet").drop("at")


def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(Scratch(spark, "katz"), _documents(spark, sf_dir).select("doc_id", "text"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-files")
    path = scratch.path("files")
    token_files.write_files(_documents(spark, sf_dir), path, vocabulary_bytes(default_path(WORDS)), end_id=2)
    return token_files.read_files(scratch, path)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(Scratch(spark, "ngram-join"), _documents(spark, sf_dir).select("doc_id", "text"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "quality")
    measured = quality_rules.measure(_documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    judged = quality_rules.judge(scratch.cut(measured, "measured"))
    return judged.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return sort_means.sort_means(Scratch(spark, "sort-means"), vectors, k=40, dimension=64, rounds=5, scale=256, salt="2")


def op12_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_packing.pack(Scratch(spark, "packing"), _documents(spark, sf_dir).select("doc_id", "text"), vocabulary_bytes(default_path(WORDS)), end_id=2)


def op13_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat_repair.digests(chat_repair.repair(Scratch(spark, "chat-repair"), chat_repair.damaged(messages)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_piece_fst": op1_piece_fst,
    "op2_mix_sources": op2_mix_sources,
    "op3_line_dedup": op3_line_dedup,
    "op4_quotes": op4_quotes,
    "op5_separator_scan": op5_separator_scan,
    "op6_stream_dedup": op6_stream_dedup,
    "op7_katz": op7_katz,
    "op8_token_files": op8_token_files,
    "op9_ngram_join": op9_ngram_join,
    "op10_quality_rules": op10_quality_rules,
    "op11_sort_means": op11_sort_means,
    "op12_retrieval_packing": op12_retrieval_packing,
    "op13_chat_repair": op13_chat_repair,
}



def _means(rounds: int) -> str:
    """Plain k-means over all pairs: a CTE per round. `//` cuts towards zero, so sums are made floors by their rest."""
    square = "list_sum(list_transform(list_zip(v.x, c.m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    near = "SELECT v.r, v.x, min({{'d': CAST({square} AS BIGINT), 'c': c.c}}) AS b FROM v CROSS JOIN c{n} c GROUP BY v.r, v.x"
    parts = ["""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS m FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT 40))"]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED ({near.format(square=square, n=n)})")
        if n < rounds:
            parts.append(f"""s{n} AS MATERIALIZED (SELECT c, i, sum(y) AS s, count(*) AS k FROM (SELECT b.c AS c, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{n}) GROUP BY c, i),
        c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(f.m, c{n}.m) AS m FROM c{n} LEFT JOIN (
            SELECT c, list(CAST((s - ((s % k) + k) % k) // k AS BIGINT) ORDER BY i) AS m FROM s{n} GROUP BY c) f USING (c))""")
    return "WITH " + ",\n        ".join(parts)


ORACLE: dict[str, str] = {
    "op11_sort_means": f"""{_means(5)}
        SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a5 JOIN v USING (r) JOIN c5 ON c5.c = b.c""",
    "op9_ngram_join": r"""
        WITH RECURSIVE words AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        sh AS MATERIALIZED (
            SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
            FROM words, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 3))) AS i) WHERE len(w) > 0),
        sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
        rare AS MATERIALIZED (
            SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, s) AS r
            FROM sh JOIN sizes USING (doc_id) JOIN (SELECT s, count(*) AS df FROM sh GROUP BY 1) USING (s)),
        pre AS MATERIALIZED (SELECT doc_id, s, n FROM rare WHERE r <= n - (4 * n + 4) // 5 + 1),
        cand AS MATERIALIZED (
            SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM pre a JOIN pre b USING (s)
            WHERE a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
        links AS MATERIALIZED (
            SELECT a, b FROM cand JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b AND x.s = y.s
            GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
        edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT a AS id, b AS other FROM edges UNION SELECT id, e.b FROM reach JOIN edges e ON e.a = other)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(least_other, doc_id)) AS component_id
        FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT id AS doc_id, min(other) AS least_other FROM reach GROUP BY 1) USING (doc_id)
    """,
    "op6_stream_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
