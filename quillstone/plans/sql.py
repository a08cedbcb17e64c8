"""The derived tables of sources/tables.py as SQL, for the oracle."""

ENTRIES = """entries AS (
    SELECT doc_id AS n, 'doc-' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS kid, source AS domain, lang AS subject, text AS content,
           [lang, source, 'k' || CAST(n_chars // 1000 AS VARCHAR)] AS tags,
           CASE WHEN doc_id % 11 <> 0 THEN 'p' || CAST(doc_id % 4 AS VARCHAR) END AS project,
           CASE WHEN doc_id % 5 = 0 THEN 'public' ELSE 'private' END AS zone,
           CASE WHEN doc_id % 10 <> 0 THEN 'doc-' || lpad(CAST(doc_id - doc_id % 10 AS VARCHAR), 8, '0') END AS parent,
           CASE WHEN doc_id % 10 <> 0 THEN doc_id % 10 END AS seq,
           CASE WHEN doc_id % 10 = 0 THEN 'collection' WHEN doc_id % 10 <> 9 THEN 'book' END AS content_type,
           CASE WHEN doc_id % 13 = 0 THEN 'deprecated' WHEN doc_id % 17 <> 0 THEN 'published' END AS status,
           doc_id % 7 = 0 AS evergreen,
           CASE WHEN doc_id % 3 <> 0 THEN 'https://example.org/' || CAST(doc_id AS VARCHAR) END AS source_url,
           doc_id % 730 AS updated_day, doc_id % 9 <> 0 AS explicit, doc_id % 5 + 1 AS version
    FROM documents)"""

POINTS = ENTRIES + """, points AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vector, label, entries.* FROM embeddings JOIN entries ON entries.n = vec_id - vec_id % 2)"""

EVENTS = """error_events AS (
    SELECT event_id AS seq, ts, CAST(ts AS DATE) AS day, 'svc' || CAST(user_id % 5 AS VARCHAR) AS source,
           CASE WHEN event_id % 4 = 0 THEN 'HEALTH' WHEN event_id % 4 = 1 THEN 'REQ' END AS marker,
           CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 500 ELSE 404 END WHEN event_id % 10 = 0 THEN 429 END AS status,
           'GET /items/' || CAST(event_id AS VARCHAR) || ' took ' || CAST(k AS VARCHAR) || '.5ms code ' || CAST(k % 7 AS VARCHAR) || ' ' || event_type AS message,
           CASE WHEN event_id % 6 <> 0 THEN 'u' || CAST(user_id AS VARCHAR) END AS actor, CAST(event_id % 12 AS INTEGER) AS exit_code,
           event_id % 8 = 0 AS expected,
           CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN '5xx' WHEN event_id % 97 = 0 THEN 'oom' END AS hint,
           event_type, user_id, value, k, event_type || '|' || CAST(k % 10 AS VARCHAR) AS sig
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""

TITLE = "coalesce(nullif(trim(regexp_extract(content, '(?m)^#{1,6}\\s+(.+)$', 1)), ''), kid)"
RANK = "CASE WHEN zone = 'public' THEN 0 ELSE 1 END"
STATUS = "CASE WHEN status IN ('draft', 'review', 'published', 'deprecated', 'archived') THEN status ELSE 'published' END"
SERVED = f"coalesce(content_type, '') NOT IN ('collection', 'source') AND {STATUS} <> 'deprecated'"
