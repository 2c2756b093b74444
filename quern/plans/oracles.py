"""SQL twins of the queries, for an independent engine over the same tables."""

from __future__ import annotations

from quern import fixed
from quern.functions.periods import MONTHS
from quern.operators.sql_text import NOT_A_QUERY
from quern.plans.inputs import COLUMNS


def _q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


# ---- shared pieces -----------------------------------------------------------

DOCS = "docs AS (SELECT doc_id, source || '/' || doc_id AS path, text, lang, source AS origin FROM documents)"

# Each named entity in turn, the ampersand last, then the numbered ones of an untouched text.
_BARE = """regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'),
    '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g')"""
_CODE = "CASE WHEN x[3] IN ('x', 'X') THEN CAST('0x' || x[4:-2] AS INTEGER) ELSE CAST(x[3:-2] AS INTEGER) END"
_DECODED = f"""array_to_string(list_transform(regexp_extract_all({_BARE}, '&#\\d{{1,7}};|&#[xX][0-9a-fA-F]{{1,6}};|[^&]+|&'),
    lambda x: CASE WHEN x[1:2] = '&#' THEN CASE WHEN {_CODE} BETWEEN 1 AND 55295 OR {_CODE} BETWEEN 57344 AND 1114111
         THEN replace(chr({_CODE}), '&', '&amp;') ELSE x END ELSE x END), '')"""
PLAIN = f"""trim(regexp_replace(replace(replace(replace(replace(replace(replace({_DECODED},
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&amp;', '&'), '[ \\t\\r\\n\\f]+', ' ', 'g'))"""

ARRIVALS = f"""arrivals AS (
    SELECT d.path, CASE WHEN l.quality = 1 THEN replace(d.text, 'e', 'E') ELSE replace(d.text, ' ', '') END AS text
    FROM docs d JOIN labels l ON d.doc_id = l.doc_id
    UNION ALL
    SELECT 'pages/' || page_id, {PLAIN} FROM pages)"""


def _chunks(name: str, source: str, extra: str = "") -> str:
    return f"""{name} AS (
    SELECT md5(path) || '_' || i AS chunk_id, path AS source, md5(path) AS doc_hash,
           CAST(i AS INTEGER) AS chunk_index, substr(text, i * 900 + 1, 1000) AS text_content{extra}
    FROM {source}, LATERAL (SELECT unnest(range(0, greatest(CAST(ceil((length(text) - 100) / 900.0) AS BIGINT), 1))) AS i) u)"""


CHUNKS = _chunks("chunks", "docs")
ARRIVED = _chunks("arrived", "arrivals")

UPSERTED = """upserted AS (
    SELECT coalesce(t.chunk_id, b.chunk_id) AS chunk_id, coalesce(t.source, b.source) AS source,
           coalesce(b.doc_hash, t.doc_hash) AS doc_hash, coalesce(t.chunk_index, b.chunk_index) AS chunk_index,
           coalesce(b.text_content, t.text_content) AS text_content
    FROM chunks t FULL JOIN arrived b ON t.chunk_id = b.chunk_id)"""

QUESTIONS = """questions AS (
    SELECT conv_id || '-' || turn AS question_id, CAST(conv_id AS VARCHAR) AS session_id, conv_id, turn, text AS user_query
    FROM conversations WHERE role = 'user')"""

ANSWERED = """answered AS (
    SELECT q.*, a.text AS answer FROM questions q
    JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant')"""

VERDICTS = """verdicts AS (
    SELECT doc_id, CASE WHEN toxic = 1 AND quality = 1 THEN ' YES. ' WHEN toxic = 1 THEN 'yes'
                        WHEN quality = 1 THEN 'No' ELSE 'eyes open' END AS verdict
    FROM labels)"""

CACHE = """cache AS (
    SELECT query_hash, user_query, final_response, session_id FROM (
        SELECT md5(user_query) AS query_hash, user_query, session_id,
               CAST(json_object('response_type', 'rag', 'session_id', session_id, 'user_query', user_query,
                                'rag_content', answer, 'sources', ['conversation/' || session_id]) AS VARCHAR) AS final_response
        FROM answered)
    QUALIFY row_number() OVER (PARTITION BY query_hash ORDER BY session_id, final_response) = 1)"""

REQUESTS = """requests AS (
    SELECT 'd' || doc_id AS request_id, CASE lang
        WHEN 'en' THEN 'Summarize the project ' || source || ' review document.'
        WHEN 'fr' THEN 'Compare 2024 vs 2023 total sales of ' || source || '.'
        WHEN 'de' THEN 'Show ' || source || ' shipments only.'
        ELSE 'Summarize the ' || source || '_notes_' || doc_id || '.mp3 audio file.' END AS request
    FROM documents
    UNION ALL
    SELECT 'e' || event_id, CASE event_type
        WHEN 'view' THEN 'Show trend of views of user ' || user_id || ' over time.'
        WHEN 'signup' THEN 'Which reports and tables mention user ' || user_id || '?'
        WHEN 'click' THEN 'Please transcribe ''calls/' || user_id || '.wav'' and "b.flac" now'
        WHEN 'error' THEN 'Play NOTES' || user_id || '.MP3, last 6 months vs prior 6 months'
        ELSE 'How much did user ' || user_id || ' spend in n' || user_id || '.mp3x?' END
    FROM events
    UNION ALL
    SELECT 'c' || conv_id || '-' || turn, text FROM conversations)"""

AUDIO = "nullif(regexp_extract(request, " + _q(fixed.AUDIO_PATTERN) + ", 1), '')"

INTENT_TEXTS = """intent_texts AS (
    SELECT 'e' || event_id AS request_id, event_type AS kind, CAST(user_id AS VARCHAR) AS who FROM events
    UNION ALL SELECT 'd' || doc_id, lang, NULL FROM documents),
parsed AS (
    SELECT request_id,
        CASE kind WHEN 'view' THEN 'drilldown' WHEN 'signup' THEN 'analytical' WHEN 'purchase' THEN 'forecast'
                  WHEN 'en' THEN 'unstructured' ELSE 'descriptive' END AS intent,
        CASE kind WHEN 'view' THEN 'user ' || who || '|all' WHEN 'signup' THEN '' END AS filter_targets,
        CASE kind WHEN 'view' THEN '' WHEN 'signup' THEN '2024 vs 2023' END AS comparison_periods,
        kind IN ('signup', 'purchase') AS visualization
    FROM intent_texts)"""

WORD = "[\\p{L}\\p{N}_]+"


def _terms(name: str, source: str, key: str, text: str) -> str:
    return f"""{name} AS (
    SELECT {key}, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 64 AS bucket, count(*) AS tf
    FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '{WORD}')) AS w FROM {source})
    GROUP BY ALL)"""


def _retrieved(asked: str) -> str:
    return f"""{_terms('c_terms', 'chunks', 'chunk_id', 'text_content')},
{_terms('q_terms', asked, 'question_id', 'user_query')},
c_norm AS (SELECT chunk_id, CAST(sum(tf * tf) AS DOUBLE) AS n FROM c_terms GROUP BY 1),
q_norm AS (SELECT question_id, CAST(sum(tf * tf) AS DOUBLE) AS n FROM q_terms GROUP BY 1),
dots AS (SELECT question_id, chunk_id, CAST(sum(q.tf * c.tf) AS DOUBLE) AS dot
         FROM q_terms q JOIN c_terms c ON q.bucket = c.bucket GROUP BY 1, 2),
scored AS (SELECT question_id, chunk_id, round(dot / sqrt(q_norm.n * c_norm.n), 9) AS s
           FROM dots JOIN q_norm USING (question_id) JOIN c_norm USING (chunk_id)),
retrieved AS (
    SELECT question_id, CAST(rn AS INTEGER) AS rank, chunk_id, round(s, 4) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY s DESC, chunk_id) AS rn FROM scored)
    WHERE rn <= 4)"""


RETRIEVED = _retrieved("questions")

FOUND = """found AS (
    SELECT question_id, string_agg(text_content, chr(10) || chr(10) ORDER BY rank) AS rag_result,
           list_sort(list_distinct(list(source))) AS sources
    FROM retrieved JOIN chunks USING (chunk_id) GROUP BY question_id)"""


def _lit(text: str) -> str:
    """A SQL literal with the line breaks spelled out."""
    return " || chr(10) || ".join(_q(p) for p in text.split("\n"))


HISTORY = _lit(fixed.HISTORY_HEADING)
DOCUMENTS = _lit(fixed.DOCUMENTS_HEADING)
RESULTS = _lit(fixed.RESULT_HEADING)
BREAK = _lit(fixed.SECTION_BREAK)

CONTEXTS = f"""contexts AS (
    SELECT q.*, f.sources, {HISTORY} || 'user: ' || user_query ||
           CASE WHEN rag_result <> '' THEN {BREAK} || {DOCUMENTS} || rag_result ELSE '' END AS engineered_context
    FROM questions q LEFT JOIN found f USING (question_id)),
answers AS (
    SELECT *, CAST(json_object('response_type', 'rag', 'session_id', session_id, 'user_query', user_query,
        'rag_content', engineered_context, 'sources', sources) AS VARCHAR) AS final_response
    FROM contexts)"""


def _error_json(message: str) -> str:
    return (
        "CAST(json_object('response_type', 'error', 'session_id', session_id, 'user_query', user_query, "
        f"'error_message', {_q(message)}, 'suggested_fix', NULL) AS VARCHAR)"
    )


# ---- catalog texts, from the stated column types ------------------------------

def _column_rows():
    for table, cols in COLUMNS.items():
        for i, col in enumerate(cols.split(", ")):
            name, kind = col.split(" ")
            yield table, i, name, kind


def _value_text(name: str, kind: str) -> str:
    if kind == "double":
        return f"CAST(CAST({name} AS DECIMAL(20, 4)) AS VARCHAR)"
    if kind == "timestamp_ntz":
        return f"strftime({name}, '%Y-%m-%d %H:%M:%S')"
    return f"CAST({name} AS VARCHAR)"


def _profile_sql() -> str:
    parts = []
    for table, i, name, kind in _column_rows():
        nested = kind.startswith("array")
        low = "NULL" if nested else _value_text(f"min({name})", kind)
        high = "NULL" if nested else _value_text(f"max({name})", kind)
        parts.append(
            f"SELECT '{table}' AS table_name, CAST({i} AS INTEGER) AS ordinal, '{name}' AS column_name, "
            f"count(*) AS n_rows, count(*) - count({name}) AS n_nulls, count(DISTINCT {name}) AS n_distinct, "
            f"{low} AS min_value, {high} AS max_value FROM {table}"
        )
    return "\nUNION ALL\n".join(parts)


def _inventory_sql() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({i} AS INTEGER) AS ordinal, '{k}' AS data_type, "
        f"count(*) AS n_rows, count(*) - count({c}) AS n_nulls FROM {t}"
        for t, i, c, k in _column_rows()
    )


def _context_sql() -> str:
    lines = "\nUNION ALL\n".join(
        "SELECT '{t}' AS t, {line} AS line WHERE (SELECT count(*) FROM {t}) > 0".format(
            t=t,
            line=_q(f"Table '{t}': " + ", ".join("{} ({})".format(*c.split(" ")) for c in cols.split(", "))),
        )
        for t, cols in COLUMNS.items()
    )
    return f"SELECT string_agg(line, chr(10) ORDER BY t) AS schema_text FROM ({lines})"


MONEY = "CAST({} AS DECIMAL(12, 2))".format
NET = "CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))"

_known_words = ", ".join(
    _q(w) for w in dict.fromkeys([*fixed.SQL_WORDS, *COLUMNS, *(c for _, _, c, _ in _column_rows())])
)
_sql_words = ", ".join(_q(w) for w in fixed.SQL_WORDS)
_unknown_before, _unknown_after = fixed.UNKNOWN_COLUMN.split("{name}")
_missing_before, _missing_after = fixed.AUDIO_MISSING.split("{name}")
_routes = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.ROUTES.items())
_labels = ", ".join(f"'{k}'" for k in fixed.ROUTES)
_prompt = " || ".join(
    {"user_query": "user_query", "engineered_context": "answer"}.get(p) or _lit(p)
    for p in __import__("re").split(r"\{(\w+)\}", fixed.ANSWER_TEMPLATE)
)

# The cut rule of boundary chunks, one chunk per step.
_WIN = "substr(text, {pos}, 1000)"


def _cut(pos: str) -> str:
    win = _WIN.format(pos=pos)
    newline = f"length(regexp_extract({win}, '(?s)^(.*)\\n', 1)) + 1"
    blank = f"length(regexp_extract({win}, '(?s)^(.*) ', 1)) + 1"
    return (
        f"CASE WHEN {pos} + 999 >= length(text) THEN greatest(length(text) - ({pos}) + 1, 0) "
        f"WHEN {newline} >= 500 THEN {newline} WHEN {blank} >= 500 THEN {blank} ELSE 1000 END"
    )


RULES = f"""SELECT request_id, request,
    CASE WHEN {AUDIO} IS NOT NULL THEN 'voice'
         WHEN regexp_matches(lower(request), '\\b(documents?|reports?|unstructured)\\b')
              AND regexp_matches(lower(request), '\\b(tables?|database|sql)\\b') THEN 'mixed'
         WHEN regexp_matches(lower(request), '\\b(documents?|reports?|unstructured)\\b') THEN 'unstructured'
         WHEN regexp_matches(lower(request), '\\b(narrow|filter|only)\\b') THEN 'drilldown'
         WHEN regexp_matches(lower(request), '\\b(compare|versus|vs)\\b') THEN 'analytical'
         WHEN regexp_matches(lower(request), '\\b(trend|chart|plot|graph|visuali[sz]e)\\b') THEN 'visualization'
         ELSE 'descriptive' END AS intent
    FROM requests"""

def _finer(parts: str, name: str, finer: str) -> str:
    return f"flatten(list_transform({parts}, lambda {name}: CASE WHEN length({name}) <= 1000 THEN [{name}] ELSE {finer} END))"


_WORDS = _finer("regexp_extract_all(l, '[^ ]* +|[^ ]+')", "w", "regexp_extract_all(w, '(?s).{1,1000}')")
_LINES = _finer("regexp_extract_all(p, '[^\\n]*\\n+|[^\\n]+')", "l", _WORDS)
PIECES = _finer("regexp_extract_all(text, '(?s).+?(?:\\n{2,}|\\z)')", "p", _LINES)

TALKS = """talks AS (
    SELECT 'conversation/' || conv_id AS path, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"""

# `c`: where each piece ends; a chunk goes from piece f to before piece e
WHOLE_PIECES = f"""cut AS (SELECT path, text, {PIECES} AS pieces FROM texts),
    ends AS (SELECT path, text, list_prepend(0::BIGINT, list_transform(range(1, len(pieces) + 1),
                 lambda i: list_sum(list_transform(pieces[1:i], lambda x: length(x)))::BIGINT)) AS c FROM cut),
    steps AS (
        SELECT path, 0::BIGINT AS i, 0::BIGINT AS f, (len(list_filter(c, lambda x: x <= 1000)) - 1)::BIGINT AS e FROM ends
        UNION ALL
        SELECT path, i + 1, s, (len(list_filter(c, lambda x: x <= c[s + 1] + 1000)) - 1)::BIGINT FROM (
            SELECT steps.path, i, c, len(list_filter(c, lambda x: x < greatest(c[e + 1] - 100, c[e + 2] - 1000)))::BIGINT AS s
            FROM steps JOIN ends USING (path) WHERE e < len(c) - 1)),
    whole AS (SELECT path, i, substr(text, c[f + 1] + 1, c[e + 1] - c[f + 1]) AS text_content FROM steps JOIN ends USING (path))"""

STREAMED = f"WITH {DOCS}, {ARRIVALS}, {CHUNKS}, {ARRIVED}, {UPSERTED}"

_SIDE = f"(?:q[1-4] |(?:{'|'.join(MONTHS)}) )?[0-9]{{4}}"
_PERIODS = f"\\b({_SIDE}) (?:vs\\.?|versus) ({_SIDE})\\b"
_SPANS = "\\blast ([0-9]{1,3}) (month|quarter|year)s? (?:vs\\.?|versus) (?:prior|previous) ([0-9]{1,3}) (month|quarter|year)s?\\b"
_names = ", ".join(map(_q, MONTHS))


def _month(side: str) -> str:
    name = f"split_part({side}, ' ', 1)"
    return (f"CASE WHEN length({side}) = 4 THEN 1 WHEN {side} LIKE 'q_ %' THEN 3 * CAST(substr({side}, 2, 1) AS INTEGER) - 2 "
            f"ELSE list_position([{_names}], {name}) END")


def _start(side: str) -> str:
    return f"make_date(CAST({side}[-4:] AS INTEGER), {_month(side)}, 1)"


def _length(side: str) -> str:
    return f"to_months(CASE WHEN length({side}) = 4 THEN 12 WHEN {side} LIKE 'q_ %' THEN 3 ELSE 1 END)"


def _months(n: str, unit: str) -> str:
    return f"to_months(CAST({n} AS INTEGER) * CASE {unit} WHEN 'month' THEN 1 WHEN 'quarter' THEN 3 ELSE 12 END)"


ORACLES: dict[str, str] = {
    "file_scan": f"""
        WITH {TALKS}
        SELECT 'item-' || item_id AS name, 'txt' AS kind, text || chr(10) AS text, CAST(NULL AS VARCHAR) AS error FROM benchmark
        UNION ALL SELECT replace(path, '/', '-'), 'txt', text || chr(10), NULL FROM talks
        UNION ALL SELECT 'page-' || page_id, 'json', html, NULL FROM pages""",
    "ingest_folder": f"""
        WITH RECURSIVE {TALKS}, texts AS (
            SELECT 'item-' || item_id AS path, text || chr(10) AS text FROM benchmark
            UNION ALL SELECT replace(path, '/', '-'), text || chr(10) FROM talks), {WHOLE_PIECES}
        SELECT path AS name, CAST(i AS INTEGER) AS chunk_index, text_content FROM whole""",
    "raw_to_text": f"SELECT page_id, {PLAIN} AS plain FROM pages",
    "table_scan": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 25",
    "csv_scan": "SELECT doc_id, text, lang, n_chars FROM documents",
    "error_log_append": f"""
        SELECT '2026-01-01' AS day, CAST(user_id AS VARCHAR) AS session_id, props AS user_query,
               'value ' || CAST(CAST(value AS DECIMAL(12, 2)) AS VARCHAR) AS error_message
        FROM events WHERE event_type = 'error'
        UNION ALL
        SELECT '2026-01-02', CAST(conv_id AS VARCHAR), text, {_q(fixed.NO_CONTEXT)} FROM conversations WHERE role = 'user'""",
    "doc_id": f"WITH {DOCS} SELECT doc_id, path, md5(path) AS doc_hash FROM docs",
    "chunk_fixed": f"WITH {DOCS}, {CHUNKS} SELECT source AS path, chunk_index, text_content FROM chunks",
    "chunk_boundary": f"""
        WITH RECURSIVE {DOCS}, steps AS (
            SELECT path, text, CAST(0 AS INTEGER) AS i, CAST(1 AS BIGINT) AS pos, CAST({_cut('1')} AS BIGINT) AS cut FROM docs
            UNION ALL
            SELECT path, text, i + 1, pos + cut - 100, CAST({_cut('(pos + cut - 100)')} AS BIGINT)
            FROM steps WHERE pos + 999 < length(text))
        SELECT path, i AS chunk_index, substr(text, pos, cut) AS text_content FROM steps""",
    "chunk_pieces": f"""
        WITH RECURSIVE {DOCS}, {TALKS}, texts AS (SELECT path, text FROM docs UNION ALL SELECT * FROM talks), {WHOLE_PIECES}
        SELECT md5(path) || '_' || i AS chunk_id, path AS source, md5(path) AS doc_hash, CAST(i AS INTEGER) AS chunk_index, text_content
        FROM whole""",
    "chunk_id": f"WITH {DOCS}, {CHUNKS} SELECT source AS path, doc_hash, chunk_index, chunk_id FROM chunks",
    "chunk_multipart": """
        WITH parts AS (
            SELECT conv_id, turn, i, substr(text, i * 900 + 1, 1000) AS text_content
            FROM conversations, LATERAL (SELECT unnest(range(0, greatest(CAST(ceil((length(text) - 100) / 900.0) AS BIGINT), 1))) AS i) u)
        SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) - 1 AS INTEGER) AS chunk_index, text_content
        FROM parts""",
    "chunk_stats": f"""
        WITH {DOCS}, {_chunks('chunks', 'docs', ', origin')}
        SELECT origin, count(*) AS chunks, CAST(sum(length(text_content)) AS BIGINT) AS characters,
               CAST(max(length(text_content)) AS INTEGER) AS longest
        FROM chunks GROUP BY origin""",
    "upsert_chunks": f"{STREAMED} SELECT * FROM upserted",
    "delete_chunks": f"""
        {STREAMED} SELECT * FROM upserted
        WHERE doc_hash NOT IN (SELECT doc_hash FROM arrived) OR chunk_id IN (SELECT chunk_id FROM arrived)""",
    "change_feed": f"""
        WITH {DOCS}, {ARRIVALS}, {CHUNKS}, {ARRIVED},
        known AS (SELECT * FROM chunks WHERE doc_hash IN (SELECT doc_hash FROM arrived))
        SELECT coalesce(b.chunk_id, t.chunk_id) AS chunk_id,
               CASE WHEN t.chunk_id IS NULL THEN 'insert' WHEN b.chunk_id IS NULL THEN 'delete' ELSE 'update' END AS change,
               md5(t.text_content) AS before, md5(b.text_content) AS after
        FROM known t FULL JOIN arrived b ON t.chunk_id = b.chunk_id WHERE t.text_content IS DISTINCT FROM b.text_content""",
    "upsert_cache": f"""
        WITH {QUESTIONS}, {ANSWERED}, {CACHE},
        incoming AS (
            SELECT session_id, user_query, CAST(json_object('response_type', 'sql', 'session_id', session_id, 'user_query', user_query,
                'summary', answer, 'sql_query', 'SELECT 1', 'tabular_result', '1') AS VARCHAR) AS final_response FROM answered
            UNION ALL
            SELECT CAST(conv_id AS VARCHAR), text, CAST(json_object('response_type', 'voice', 'session_id', CAST(conv_id AS VARCHAR),
                'user_query', text, 'summary', 'noted', 'transcription', '') AS VARCHAR) FROM conversations WHERE role = 'system'
            UNION ALL
            SELECT session_id, user_query, {_error_json(fixed.NO_CONTEXT)} FROM questions
            WHERE question_id NOT IN (SELECT question_id FROM answered)),
        newest AS (
            SELECT md5(user_query) AS query_hash, * FROM incoming
            QUALIFY row_number() OVER (PARTITION BY md5(user_query) ORDER BY session_id, final_response) = 1),
        batch AS (SELECT * FROM newest WHERE json_extract_string(final_response, '$.response_type') <> 'error')
        SELECT coalesce(c.query_hash, b.query_hash) AS query_hash, coalesce(c.user_query, b.user_query) AS user_query,
               coalesce(b.final_response, c.final_response) AS final_response, coalesce(b.session_id, c.session_id) AS session_id,
               CASE WHEN b.query_hash IS NULL THEN '2026-01-01' ELSE '2026-01-02' END AS day
        FROM cache c FULL JOIN batch b ON c.query_hash = b.query_hash""",
    "latest_per_key": """
        SELECT user_id, event_id, event_type, value, props FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "changed_rows": f"""
        WITH {DOCS}, {ARRIVALS}, {CHUNKS}, {ARRIVED}
        SELECT b.chunk_id, CASE WHEN t.chunk_id IS NULL THEN 'insert' WHEN t.text_content <> b.text_content THEN 'update'
                                ELSE 'unchanged' END AS change
        FROM arrived b LEFT JOIN chunks t ON t.chunk_id = b.chunk_id""",
    "stale_chunks": f"""
        WITH {DOCS}, {ARRIVALS}, {CHUNKS}, {ARRIVED}
        SELECT chunk_id, source, doc_hash, chunk_index FROM chunks
        WHERE doc_hash IN (SELECT doc_hash FROM arrived) AND chunk_id NOT IN (SELECT chunk_id FROM arrived)""",
    "query_hash": "SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, md5(text) AS query_hash FROM conversations",
    "cache_lookup": f"""
        WITH {QUESTIONS}, {ANSWERED}, {CACHE}
        SELECT q.question_id, q.session_id, md5(q.user_query) AS query_hash, c.final_response AS cached_response
        FROM questions q LEFT JOIN cache c ON c.query_hash = md5(q.user_query)""",
    "cache_lookup_bucketed": f"""
        WITH {QUESTIONS}, {ANSWERED}, {CACHE}
        SELECT q.question_id, q.session_id, md5(q.user_query) AS query_hash, c.final_response AS cached_response
        FROM questions q LEFT JOIN cache c ON c.query_hash = md5(q.user_query)""",
    "cache_split": f"""
        WITH {QUESTIONS}, {ANSWERED}, {CACHE}
        SELECT q.question_id, CASE WHEN c.query_hash IS NULL THEN 'miss' ELSE 'hit' END AS side
        FROM questions q LEFT JOIN cache c ON c.query_hash = md5(q.user_query)""",
    "schema_inventory": _inventory_sql(),
    "schema_context": _context_sql(),
    "table_profile": _profile_sql(),
    "sketch_profile": "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, true AS close FROM {t}"
        for t, _, c, _ in _column_rows()),
    "column_names": """
        WITH texts AS (SELECT 'p' || page_id AS text_id, html AS t FROM pages UNION ALL SELECT 'd' || doc_id, text FROM documents)
        SELECT DISTINCT text_id, unnest(regexp_extract_all(t, '(\\w+)\\s*\\(\\w+\\)', 1)) AS column_name FROM texts""",
    "token_audit": f"""
        WITH query_texts AS (
            SELECT 'p' || p_partkey AS query_id, 'SELECT p_brand, SUM(p_size) FROM part WHERE p_name = ''' || p_name ||
                   ''' GROUP BY p_brand -- ' || p_type || chr(10) || 'LIMIT ' || p_size AS t FROM part
            UNION ALL SELECT 'q' || p_partkey, 'SELECT ' || lower(p_type) || ' FROM part LIMIT 5' FROM part
            UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations),
        offered AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(
            regexp_replace(t, '''[^'']*''|--[^\\n]*', ' ', 'g'), '{WORD}')) AS w FROM query_texts),
        vocabulary AS (SELECT unnest([{_known_words}]) AS w
            UNION SELECT unnest(regexp_extract_all(text, '{WORD}')) FROM benchmark),
        worst AS (SELECT query_id, min(w) AS first_unknown, count(*) AS n_unknown FROM offered
            WHERE NOT regexp_matches(w, '^\\p{{N}}+$') AND upper(w) NOT IN ({_sql_words})
              AND NOT EXISTS (SELECT 1 FROM vocabulary v WHERE v.w = offered.w) GROUP BY 1)
        SELECT query_id, first_unknown, coalesce(n_unknown, 0) AS n_unknown,
               {_q(_unknown_before)} || first_unknown || {_q(_unknown_after)} AS message
        FROM query_texts LEFT JOIN worst USING (query_id)""",
    "run_sql": f"""
        SELECT l_suppkey, CAST(sum({MONEY('l_quantity')}) AS DOUBLE) AS total_quantity
        FROM lineitem GROUP BY 1 ORDER BY total_quantity DESC, l_suppkey LIMIT 100""",
    "run_texts": f"""
        WITH a AS (SELECT n_regionkey AS k, string_agg(line, chr(10) ORDER BY n_name) AS result FROM (
                SELECT n_regionkey, n_name, CAST(json_object('who', n_name, 'how_many', n) AS VARCHAR) AS line
                FROM (SELECT n_regionkey, n_name, count(*) AS n FROM nation GROUP BY ALL)) GROUP BY 1),
        b AS (SELECT r_regionkey AS k, CAST(json_object('last', max(n_name)) AS VARCHAR) AS result
              FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1)
        SELECT 'a' || r_regionkey AS query_id, NULL AS error, coalesce(result, '') AS sql_result FROM region LEFT JOIN a ON k = r_regionkey
        UNION ALL SELECT 'b' || k, NULL, result FROM b
        UNION ALL SELECT 'n' || n_nationkey, NULL, result FROM nation JOIN b ON k = n_regionkey
        UNION ALL SELECT 'c' || r_regionkey, {_q(fixed.UNKNOWN_COLUMN.format(name='n.r_name'))}, NULL FROM region
        UNION ALL SELECT 'd' || r_regionkey, {_q(fixed.UNKNOWN_COLUMN.format(name='n_name'))}, NULL FROM region
        UNION ALL SELECT 'e' || r_regionkey, {_q(NOT_A_QUERY)}, NULL FROM region""",
    "filter_project": """
        SELECT o_orderkey, o_custkey AS account, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day
        FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000""",
    "join_inner": """
        SELECT o_orderkey, l_linenumber, l_partkey, l_quantity, o_orderstatus, o_orderpriority
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "join_left": "SELECT doc_id, lang, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "join_right": """
        SELECT c_custkey, event_id, event_type, c_name FROM events RIGHT JOIN customer ON user_id = c_custkey""",
    "join_full": """
        SELECT coalesce(conv_id, doc_id) AS doc_id, turn, role, quality, toxic
        FROM conversations FULL JOIN labels ON conv_id = doc_id""",
    "agg_basic": f"""
        SELECT l_returnflag, l_linestatus, CAST(sum({MONEY('l_quantity')}) AS DOUBLE) AS sum_qty,
               CAST(sum({NET}) AS DOUBLE) AS sum_net, round(CAST(avg({MONEY('l_quantity')}) AS DOUBLE), 4) AS avg_qty,
               count(*) AS n_rows, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price
        FROM lineitem GROUP BY 1, 2""",
    "top_k_on_date": f"""
        SELECT l_suppkey, CAST(sum({MONEY('l_quantity')}) AS DOUBLE) AS total FROM lineitem
        WHERE CAST(l_shipdate AS DATE) = DATE '1998-08-01' GROUP BY 1 ORDER BY total DESC, l_suppkey LIMIT 10""",
    "monthly_trend_join": f"""
        WITH data_1 AS (
            SELECT n_name AS partner_name, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum({NET}) AS total_net_sales
            FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
            WHERE n_name ILIKE '%Nation_1%' AND year(l_shipdate) = 1997 GROUP BY 1, 2),
        data_2 AS (
            SELECT n_name AS partner_name, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum({MONEY('o_totalprice')}) AS total_ordered
            FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
            WHERE n_name ILIKE '%Nation_1%' AND year(o_orderdate) = 1997 GROUP BY 1, 2)
        SELECT partner_name, CAST(month AS VARCHAR) AS month, CAST(total_net_sales AS DOUBLE) AS total_net_sales,
               CAST(total_ordered AS DOUBLE) AS total_ordered
        FROM data_1 JOIN data_2 USING (partner_name, month)""",
    "trend_over_time": f"""
        SELECT CAST(CAST(date_trunc('month', l_shipdate) AS DATE) AS VARCHAR) AS month,
               CAST(sum({MONEY('l_quantity')}) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1""",
    "period_compare": f"""
        WITH s AS (
            SELECT l_suppkey, coalesce(sum({MONEY('l_quantity')}) FILTER (year(l_shipdate) = 1998), 0) AS a,
                   coalesce(sum({MONEY('l_quantity')}) FILTER (year(l_shipdate) = 1997), 0) AS b
            FROM lineitem WHERE year(l_shipdate) IN (1997, 1998) GROUP BY 1)
        SELECT l_suppkey, CAST(a AS DOUBLE) AS value_a, CAST(b AS DOUBLE) AS value_b, CAST(a - b AS DOUBLE) AS difference,
               round(CAST(a - b AS DOUBLE) * 100.0 / nullif(CAST(b AS DOUBLE), 0), 2) AS percent FROM s""",
    "rolling_compare": f"""
        WITH m AS (SELECT o_orderpriority, {MONEY('o_totalprice')} AS v, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders),
        newest AS (SELECT max(month) AS top FROM m),
        s AS (SELECT o_orderpriority,
                coalesce(sum(v) FILTER (month > top - INTERVAL 6 MONTH), 0) AS a,
                coalesce(sum(v) FILTER (month <= top - INTERVAL 6 MONTH), 0) AS b
              FROM m, newest WHERE month > top - INTERVAL 12 MONTH GROUP BY 1)
        SELECT o_orderpriority, CAST(a AS DOUBLE) AS recent_value, CAST(b AS DOUBLE) AS prior_value,
               CAST(a - b AS DOUBLE) AS difference, round(CAST(a - b AS DOUBLE) * 100.0 / nullif(CAST(b AS DOUBLE), 0), 2) AS percent
        FROM s""",
    "compare_periods": f"""
        WITH {REQUESTS}, asked AS (
            SELECT request_id AS question_id, lower(request) AS q FROM requests
            UNION ALL
            SELECT 'k' || c_custkey, lower(CASE c_custkey % 4
                WHEN 0 THEN 'Compare ' || (1995 + c_custkey % 7) || ' vs ' || (1995 + c_nationkey % 7) || ' sales.'
                WHEN 1 THEN 'Q' || (1 + c_custkey % 3) || ' ' || (1995 + c_custkey % 7) || ' versus March ' || (1995 + (c_custkey + 1) % 7)
                WHEN 2 THEN 'Sales of the Last ' || (1 + c_custkey % 24) || ' months vs. previous ' || (1 + c_nationkey % 4) || ' quarters?'
                ELSE 'Who is ' || c_name || ' vs ' || (1995 + c_custkey % 7) END) FROM customer),
        newest AS (SELECT CAST(date_trunc('month', max(o_orderdate)) AS DATE) + INTERVAL 1 MONTH AS e FROM orders),
        words AS (
            SELECT question_id, e, regexp_extract(q, '{_PERIODS}', ['l', 'r']) AS n, regexp_extract(q, '{_SPANS}', ['n', 'u', 'm', 'v']) AS s
            FROM asked, newest),
        ranges AS (
            SELECT question_id, CAST({_start("n.l")} AS DATE) AS a_from, CAST({_start("n.l")} + {_length("n.l")} AS DATE) AS a_to,
                   CAST({_start("n.r")} AS DATE) AS b_from, CAST({_start("n.r")} + {_length("n.r")} AS DATE) AS b_to FROM words WHERE n.l <> ''
            UNION ALL
            SELECT question_id, CAST(e - {_months("s.n", "s.u")} AS DATE), CAST(e AS DATE),
                   CAST(e - {_months("s.n", "s.u")} - {_months("s.m", "s.v")} AS DATE), CAST(e - {_months("s.n", "s.u")} AS DATE)
            FROM words WHERE n.l = '' AND s.n <> ''),
        daily AS (SELECT CAST(o_orderdate AS DATE) AS day, sum({MONEY('o_totalprice')}) AS v FROM orders GROUP BY 1),
        spans AS (SELECT a_from AS f, a_to AS t FROM ranges UNION SELECT b_from, b_to FROM ranges),
        sums AS (SELECT f, t, coalesce(sum(v), 0) AS v FROM spans LEFT JOIN daily ON day >= f AND day < t GROUP BY 1, 2)
        SELECT question_id, CAST(a_from AS VARCHAR) AS a_from, CAST(a_to AS VARCHAR) AS a_to, CAST(b_from AS VARCHAR) AS b_from,
               CAST(b_to AS VARCHAR) AS b_to, CAST(x.v AS DOUBLE) AS value_a, CAST(y.v AS DOUBLE) AS value_b,
               CAST(x.v - y.v AS DOUBLE) AS difference, round(CAST(x.v - y.v AS DOUBLE) * 100.0 / nullif(CAST(y.v AS DOUBLE), 0), 2) AS percent
        FROM ranges JOIN sums x ON x.f = a_from AND x.t = a_to JOIN sums y ON y.f = b_from AND y.t = b_to""",
    "drill_down": """
        SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'Customer#000000007') OR c_name IN ('BUILDING', 'Customer#000000007')""",
    "drill_down_frame": """
        SELECT p_partkey, p_brand, p_type FROM part
        WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING max(p_size) >= 50)""",
    "preview": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100",
    "scalars": """
        SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
               CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month,
               CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority ILIKE '%urgent%' AS urgent
        FROM orders""",
    "embed_chunks": f"""
        WITH {DOCS}, {CHUNKS}, {_terms('terms', 'chunks', 'chunk_id', 'text_content')},
        norms AS (SELECT chunk_id, sqrt(CAST(sum(tf * tf) AS DOUBLE)) AS n FROM terms GROUP BY 1)
        SELECT chunk_id, CAST(bucket AS INTEGER) AS bucket, CAST(tf AS INTEGER) AS tf,
               round(CAST(CAST(tf / n AS FLOAT) AS DOUBLE), 5) AS weight
        FROM terms JOIN norms USING (chunk_id)""",
    "vector_topk": """
        WITH scored AS (
            SELECT q.vec_id AS query_id, e.vec_id,
                   round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS s
            FROM embeddings q, embeddings e)
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, round(s, 4) AS score FROM scored
        WINDOW w AS (PARTITION BY query_id ORDER BY s DESC, vec_id) QUALIFY row_number() OVER w <= 4""",
    "vector_topk_lsh": """
        WITH planes AS (
            SELECT p, list(CASE WHEN CAST(('0x' || substr(md5(p || ':' || d), 1, 2)) AS INTEGER) & 1 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY d) AS plane
            FROM range(128) a(p), range(64) b(d) GROUP BY p),
        signs AS (
            SELECT vec_id, p // 8 AS band, p % 8 AS bit,
                   CASE WHEN list_dot_product(CAST(embedding AS DOUBLE[]), plane) >= 0 THEN 1 ELSE 0 END AS s
            FROM embeddings, planes),
        bands AS (SELECT vec_id, band, CAST(sum(s << bit) AS INTEGER) AS sig FROM signs GROUP BY 1, 2),
        probes AS (SELECT vec_id, band, xor(sig, unnest([0, 1, 2, 4, 8, 16, 32, 64, 128])) AS sig FROM bands),
        pairs AS (SELECT DISTINCT q.vec_id AS query_id, b.vec_id FROM probes q JOIN bands b ON q.band = b.band AND q.sig = b.sig),
        scored AS (
            SELECT query_id, pairs.vec_id,
                   round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS s
            FROM pairs JOIN embeddings q ON q.vec_id = query_id JOIN embeddings e ON e.vec_id = pairs.vec_id)
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, round(s, 4) AS score FROM scored
        WINDOW w AS (PARTITION BY query_id ORDER BY s DESC, vec_id) QUALIFY row_number() OVER w <= 4""",
    "text_retrieve": f"WITH {DOCS}, {CHUNKS}, {QUESTIONS}, {RETRIEVED} SELECT * FROM retrieved",
    "retrieval_context": f"""
        WITH {DOCS}, {CHUNKS}, {QUESTIONS}, {RETRIEVED}, {FOUND} SELECT question_id, rag_result FROM found""",
    "retrieval_sources": f"""
        WITH {DOCS}, {CHUNKS}, {QUESTIONS}, {RETRIEVED}, {FOUND}
        SELECT question_id, array_to_string(sources, ',') AS sources FROM found""",
    "history_append": """
        WITH last AS (SELECT conv_id, max(turn) + 1 AS nxt FROM conversations GROUP BY 1)
        SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role, text FROM conversations
        UNION ALL
        SELECT CAST(user_id AS VARCHAR), coalesce(nxt, 0) + row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1, 'event', event_type
        FROM events LEFT JOIN last ON conv_id = user_id""",
    "history_text": f"""
        SELECT CAST(conv_id AS VARCHAR) AS session_id,
               {HISTORY} || string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS history
        FROM conversations GROUP BY conv_id""",
    "context_block": f"""
        WITH h AS (SELECT conv_id, {HISTORY} || string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS history FROM conversations GROUP BY 1),
        t AS (SELECT doc_id, text AS docs FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
        n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
        r AS (SELECT user_id, string_agg(CAST(json_object('event_type', event_type, 'n', n) AS VARCHAR), chr(10) ORDER BY event_type) AS result FROM n GROUP BY 1),
        b AS (SELECT d.doc_id, concat_ws({BREAK}, history, CASE WHEN docs <> '' THEN {DOCUMENTS} || docs END,
                     CASE WHEN result <> '' THEN {RESULTS} || result END) AS block
              FROM documents d LEFT JOIN h ON h.conv_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN r ON r.user_id = d.doc_id)
        SELECT CAST(doc_id AS VARCHAR) AS session_id, nullif(block, '') AS engineered_context,
               CASE WHEN block = '' THEN {_q(fixed.NO_CONTEXT)} END AS error FROM b""",
    "prompt_render": f"WITH {QUESTIONS}, {ANSWERED} SELECT question_id, {_prompt} AS prompt FROM answered",
    "intent_parse": f"WITH {INTENT_TEXTS} SELECT * FROM parsed",
    "intent_rules": f"""
        WITH {REQUESTS}, ruled AS ({RULES})
        SELECT request_id, intent,
               CASE WHEN intent = 'drilldown' THEN regexp_extract(request, '(?i)^show (.+) \\w+ only\\b', 1) ELSE '' END AS filter_targets,
               CASE WHEN intent = 'analytical' THEN array_to_string(regexp_extract_all(lower(request),
                   '(\\d{{4}} vs \\d{{4}}|last \\d+ months vs prior \\d+ months)', 1), '|') ELSE '' END AS comparison_periods,
               regexp_matches(lower(request), '\\b(trend|chart|plot|graph|visuali[sz]e)\\b') AS visualization
        FROM ruled""",
    "route": f"""
        WITH {INTENT_TEXTS}
        SELECT request_id, intent, intent IN ({_labels}) AS known_intent, CASE intent {_routes} ELSE 'sql' END AS route FROM parsed""",
    "audio_mentions": f"WITH {REQUESTS} SELECT request_id, {AUDIO} AS audio_file FROM requests",
    "audio_manifest_check": f"""
        WITH {REQUESTS}, named AS (SELECT request_id, {AUDIO} AS audio_file FROM requests)
        SELECT request_id, audio_file, c_custkey IS NOT NULL AS audio_present,
               CASE WHEN audio_file IS NULL THEN {_q(fixed.NO_AUDIO_NAME)}
                    WHEN c_custkey IS NULL THEN {_q(_missing_before)} || audio_file || {_q(_missing_after)} END AS error
        FROM named LEFT JOIN customer ON audio_file = c_custkey || '.wav'""",
    "verdict_parse": f"""
        WITH {VERDICTS}
        SELECT doc_id, NOT contains(lower(trim(verdict)), 'yes') AS safe,
               NOT regexp_matches(lower(trim(verdict)), '\\byes\\b') AS safe_strict FROM verdicts""",
    "screen_input": f"""
        WITH {QUESTIONS}, {VERDICTS}
        SELECT question_id, CASE WHEN contains(lower(verdict), 'yes') THEN {_error_json(fixed.INPUT_BLOCKED)} END AS final_response
        FROM questions LEFT JOIN verdicts ON doc_id = conv_id""",
    "filter_output": f"""
        WITH {VERDICTS}
        SELECT d.doc_id, CASE WHEN contains(lower(verdict), 'yes') THEN {_q(fixed.OUTPUT_BLOCKED)} ELSE text END AS final_response
        FROM documents d LEFT JOIN verdicts v ON v.doc_id = d.doc_id""",
}

_ALL_RESPONSES = f"""all_responses AS (
    SELECT 'd' || doc_id AS response_id, CAST(json_object('response_type', 'rag', 'session_id', source, 'user_query', lang,
        'rag_content', text, 'sources', [source, lang]) AS VARCHAR) AS final_response, 'rag' AS kind, length(text) AS n FROM documents
    UNION ALL
    SELECT 'p' || p_partkey, CAST(json_object('response_type', 'sql', 'session_id', p_brand, 'user_query', p_name, 'summary', p_type,
        'sql_query', 'SELECT p_type FROM part', 'tabular_result', p_name || chr(10) || p_brand) AS VARCHAR), 'sql', length(p_type) FROM part
    UNION ALL
    SELECT 'm' || question_id, CAST(json_object('response_type', 'mixed', 'session_id', session_id, 'user_query', user_query,
        'synthesized_answer', answer, 'rag_sources', [session_id], 'sql_query', 'SELECT 1') AS VARCHAR), 'mixed', length(answer) FROM answered
    UNION ALL
    SELECT 'x' || question_id, {_error_json(fixed.NO_CONTEXT)}, 'error', {len(fixed.NO_CONTEXT)} FROM questions
    UNION ALL
    SELECT 'v' || question_id, CAST(json_object('response_type', 'voice', 'session_id', session_id, 'user_query', user_query,
        'summary', user_query, 'transcription', answer) AS VARCHAR), 'voice', length(user_query) FROM answered)"""

_failed_before, _failed_after = fixed.SQL_FAILED.split("{error}")


def _json(kind: str, **cells: str) -> str:
    inner = ", ".join(f"'{k}', {v}" for k, v in cells.items())
    return f"CAST(json_object('response_type', '{kind}', 'session_id', session_id, 'user_query', user_query, {inner}) AS VARCHAR)"


FLOW = f"""WITH {DOCS}, {CHUNKS}, {QUESTIONS}, {ANSWERED}, {CACHE}, {VERDICTS}, {REQUESTS}, ruled AS ({RULES}),
    asked AS (SELECT DISTINCT md5(request) AS question_id, request AS user_query FROM ruled WHERE intent IN ('unstructured', 'mixed')),
    {_retrieved('asked')}, {FOUND},
    gathered AS (
        SELECT r.request_id AS question_id, r.request AS user_query,
               CASE WHEN r.request_id LIKE 'c%' THEN regexp_extract(r.request_id, '^c(\\d+)-', 1) ELSE r.request_id END AS session_id,
               CASE intent {_routes} ELSE 'sql' END AS path, f.rag_result, f.sources,
               CASE WHEN e.event_id IS NOT NULL THEN 'SELECT value FROM events WHERE event_id = ' || e.event_id END AS sql_query,
               CASE WHEN event_type <> 'error' THEN CAST(CAST(value AS DECIMAL(12, 2)) AS VARCHAR) END AS tabular_result,
               CASE WHEN event_type = 'error' THEN props END AS sql_error, c_name AS transcription, {AUDIO} AS audio_file,
               coalesce(contains(lower(i.verdict), 'yes'), false) AS bad_in, coalesce(contains(lower(o.verdict), 'yes'), false) AS bad_out,
               h.query_hash IS NOT NULL AS hit, h.final_response AS cached
        FROM ruled r LEFT JOIN found f ON f.question_id = md5(r.request) LEFT JOIN events e ON 'e' || e.event_id = r.request_id
        LEFT JOIN customer ON {AUDIO} = c_custkey || '.wav' LEFT JOIN verdicts i ON 'd' || i.doc_id = r.request_id
        LEFT JOIN verdicts o ON 'd' || (o.doc_id - 1) = r.request_id LEFT JOIN cache h ON h.query_hash = md5(r.request)),
    blocks AS (
        SELECT *, nullif(concat_ws({BREAK}, CASE WHEN path IN ('documents', 'mixed') AND rag_result <> '' THEN {DOCUMENTS} || rag_result END,
                         CASE WHEN path IN ('sql', 'mixed') AND tabular_result <> '' THEN {RESULTS} || tabular_result END), '') AS block
        FROM gathered),
    told AS (
        SELECT *, CASE WHEN bad_in THEN {_q(fixed.INPUT_BLOCKED)}
            WHEN path = 'voice' THEN CASE WHEN transcription IS NULL THEN {_q(_missing_before)} || audio_file || {_q(_missing_after)} END
            WHEN path IN ('sql', 'mixed') AND sql_error IS NOT NULL THEN {_q(_failed_before)} || sql_error || {_q(_failed_after)}
            WHEN block IS NULL THEN {_q(fixed.NO_CONTEXT)} END AS message,
            CASE WHEN bad_in THEN 'blocked' WHEN hit THEN 'cached' ELSE 'answered' END AS outcome FROM blocks),
    typed AS (
        SELECT *, CASE WHEN outcome = 'cached' THEN 'rag' WHEN message IS NOT NULL THEN 'error'
                       WHEN path = 'documents' THEN 'rag' ELSE path END AS kind FROM told),
    worded AS (
        SELECT *, CASE WHEN outcome = 'cached' THEN cached
            WHEN kind = 'error' THEN {_json('error', error_message='message', suggested_fix='NULL')}
            WHEN kind = 'rag' THEN {_json('rag', rag_content='block', sources='sources')}
            WHEN kind = 'sql' THEN {_json('sql', summary='block', sql_query='sql_query', tabular_result='tabular_result')}
            WHEN kind = 'mixed' THEN {_json('mixed', synthesized_answer='block', rag_sources='sources', sql_query='sql_query')}
            ELSE {_json('voice', summary='transcription', transcription='transcription')} END AS response FROM typed),
    checked AS (
        SELECT question_id, session_id, user_query, outcome, CASE WHEN outcome = 'answered' THEN path END AS route, kind, message, bad_out,
               CASE WHEN bad_out THEN {_q(fixed.OUTPUT_BLOCKED)} ELSE response END AS final_response FROM worded)"""

ORACLES |= {
    "response_json": f"WITH {QUESTIONS}, {ANSWERED}, {_ALL_RESPONSES} SELECT response_id, final_response FROM all_responses",
    "response_parse": f"""
        WITH {QUESTIONS}, {ANSWERED}, {_ALL_RESPONSES}
        SELECT kind AS response_type, count(*) AS n, count(*) FILTER (kind = 'rag') AS with_sources,
               count(*) FILTER (kind IN ('sql', 'mixed')) AS with_sql, CAST(0 AS BIGINT) AS with_fix,
               CAST(sum(n) AS BIGINT) AS characters
        FROM all_responses GROUP BY kind""",
    "stream_ingest": f"{STREAMED} SELECT * FROM upserted",
    "stream_compact": f"{STREAMED} SELECT * FROM upserted",
    "stream_index_sync": f"""
        {STREAMED}, live AS (SELECT * FROM upserted
            WHERE doc_hash NOT IN (SELECT doc_hash FROM arrived) OR chunk_id IN (SELECT chunk_id FROM arrived)),
        {_terms('terms', 'live', 'chunk_id', 'text_content')}
        SELECT chunk_id, CAST(bucket AS INTEGER) AS bucket, CAST(tf AS INTEGER) AS tf FROM terms""",
    "index_resync": f"""
        {STREAMED}, {_terms('terms', 'upserted', 'chunk_id', 'text_content')}
        SELECT chunk_id, CAST(bucket AS INTEGER) AS bucket, CAST(tf AS INTEGER) AS tf FROM terms""",
    "stream_error_log": """
        SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, CAST(user_id AS VARCHAR) AS session_id, props AS user_query,
               event_type AS error_message FROM events WHERE event_type = 'error'""",
    "answer_questions": f"""
        WITH {DOCS}, {CHUNKS}, {QUESTIONS}, {RETRIEVED}, {FOUND}, {CONTEXTS}
        SELECT question_id, engineered_context, final_response FROM answers""",
    "answer_with_schema": f"""
        WITH {DOCS}, {CHUNKS}, {QUESTIONS}, {RETRIEVED}, {FOUND}, {CONTEXTS}, schemas AS ({_context_sql()}),
        whole AS (SELECT question_id, session_id, user_query, sources,
            engineered_context || {BREAK} || {_lit(fixed.SCHEMA_HEADING)} || schema_text AS context FROM contexts, schemas)
        SELECT question_id, context AS engineered_context, {_json('rag', rag_content='context', sources='sources')} AS final_response FROM whole""",
    "answer_flow": f"{FLOW} SELECT question_id, session_id, outcome, route, kind, final_response FROM checked",
    "answer_flow_cache": f"""
        {FLOW}, fresh AS (
            SELECT md5(user_query) AS query_hash, kind FROM checked
            WHERE outcome = 'answered' AND NOT coalesce(bad_out, false) AND kind <> 'error' GROUP BY ALL)
        SELECT 'cache' AS place, coalesce(f.query_hash, c.query_hash) AS query_hash, coalesce(f.kind, 'rag') AS detail
        FROM cache c FULL JOIN fresh f ON f.query_hash = c.query_hash
        UNION ALL
        SELECT 'errors', md5(user_query), coalesce(CASE WHEN NOT coalesce(bad_out, false) THEN message END, final_response)
        FROM checked WHERE kind = 'error'""",
}
