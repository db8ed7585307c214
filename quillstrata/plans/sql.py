"""DuckDB SQL for the registered queries, written apart from the engine's code."""

from __future__ import annotations


def chunks(name: str, source: str) -> str:
    """Common tables that end in `name`: the chunks of source (doc_id, text), for texts
    without blank lines."""
    p = name
    return rf"""{p}_lines AS (
  SELECT doc_id, text, i, len(ls) AS n, ls[i] || CASE WHEN i < len(ls) THEN chr(10) ELSE '' END AS line
  FROM (SELECT doc_id, text, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM {source} WHERE length(text) > 0))
), {p}_marks AS (
  SELECT *, CASE WHEN regexp_matches(line, '^[^ \t].*\S|^[^ \t\s]') AND regexp_matches(line, '\S') AND NOT regexp_matches(line, '^[ \t]')
      AND coalesce(bool_or(regexp_matches(line, '\S')) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 1 ELSE 0 END AS mark
  FROM {p}_lines WHERE line <> ''
), {p}_blocks AS (
  SELECT *, sum(mark) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM {p}_marks
), {p}_parts AS (
  SELECT doc_id, text, block AS part_index, string_agg(line, '' ORDER BY i) AS body FROM {p}_blocks GROUP BY doc_id, text, block
), {p}_placed AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id) AS parts, coalesce(sum(length(body)) OVER before, 0) AS char_start, coalesce(sum(octet_length(encode(body))) OVER before, 0) AS start_byte,
    coalesce(sum(length(body) - length(replace(body, chr(10), ''))) OVER before, 0) + 1 AS start_line
  FROM {p}_parts WINDOW before AS (PARTITION BY doc_id ORDER BY part_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), {p} AS (
  SELECT doc_id, part_index::INT AS part_index, CASE WHEN parts > 1 THEN 'indentation' ELSE 'fallback' END AS strategy, body, ceil(length(body) / 4.0)::INT AS token_count,
    char_start::INT AS char_start, (char_start + length(body))::INT AS char_end, start_byte::INT AS start_byte, (start_byte + octet_length(encode(body)))::INT AS end_byte, start_line::INT AS start_line,
    (start_line + length(left(body, length(body) - 1)) - length(replace(left(body, length(body) - 1), chr(10), '')))::INT AS end_line,
    'text:' || start_byte::BIGINT || ':' || (start_byte + octet_length(encode(body)))::BIGINT AS chunk_id
  FROM {p}_placed
)"""


ZERO = r"'\x00'::BLOB"


def versioned(content: str, *extra: str) -> str:
    return "sha256(" + f" || {ZERO} || ".join(["encode('1.0.0')", *[f"encode({x})" for x in extra], f"encode({content})"]) + ")"


def trimmed(x: str) -> str:
    return rf"regexp_replace(regexp_replace(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\s+', ''), '\s+$', '')"


HASH = versioned("body", "chunk_id", "'text'")
CHANGED = "(SELECT doc_id, CASE WHEN lang = 'de' THEN text || chr(10) || 'changed line' ELSE text END AS text FROM documents)"
STAGED = f"""WITH {chunks("c1", "documents")}, {chunks("c2", CHANGED)},
h1 AS (SELECT doc_id, chunk_id, body, token_count, start_line, end_line, strategy, char_start, char_end, {HASH} AS content_hash FROM c1),
h2 AS (SELECT doc_id, chunk_id, body, token_count, start_line, end_line, strategy, char_start, char_end, {HASH} AS content_hash FROM c2),
both_ AS (SELECT h2.doc_id, h2.chunk_id FROM h1 JOIN h2 ON h1.doc_id = h2.doc_id AND h1.chunk_id = h2.chunk_id AND h1.content_hash = h2.content_hash AND h1.strategy = h2.strategy AND h1.char_start = h2.char_start AND h1.char_end = h2.char_end),
staged AS (
  SELECT h1.doc_id::VARCHAR AS file_id, h1.chunk_id, 'b1' AS batch_id, 'b1' AS first_seen_batch, CASE WHEN b.doc_id IS NULL THEN 'b1' ELSE 'b2' END AS last_seen_batch, content_hash, CASE WHEN b.doc_id IS NULL THEN 'keep' ELSE 'touch' END AS op, body, token_count, start_line, end_line
  FROM h1 LEFT JOIN both_ b ON b.doc_id = h1.doc_id AND b.chunk_id = h1.chunk_id
  UNION ALL
  SELECT h2.doc_id::VARCHAR, h2.chunk_id, 'b2', CASE WHEN h1.doc_id IS NULL THEN 'b2' ELSE 'b1' END, 'b2', h2.content_hash, 'insert', h2.body, h2.token_count, h2.start_line, h2.end_line
  FROM h2 LEFT JOIN h1 ON h1.doc_id = h2.doc_id AND h1.chunk_id = h2.chunk_id
  WHERE NOT EXISTS (SELECT 1 FROM both_ b WHERE b.doc_id = h2.doc_id AND b.chunk_id = h2.chunk_id)
)"""
SLICES = "file_id, chunk_id, batch_id, first_seen_batch, last_seen_batch, content_hash"
SYMBOL = f"""(SELECT d.doc_id::VARCHAR AS file_id, 'doc:' || d.doc_id AS symbol_path, {versioned("c.text", "'doc:' || d.doc_id")} AS symbol_sha, 'b1' AS first_seen_batch, 'b2' AS last_seen_batch,
  CASE WHEN c.text = d.text THEN 'touch' ELSE 'update' END AS op FROM documents d JOIN {CHANGED} c ON c.doc_id = d.doc_id WHERE length(d.text) > 0)"""


def payloads(active: str) -> str:
    head = "'# doc:' || s.file_id || chr(10) || chr(10) || '- File: `' || d.source || '/' || d.doc_id || '.txt`' || chr(10) || '- Kind: document' || chr(10) || '- Chunk: `' || s.chunk_id || '`' || chr(10) || '- Handler: text v1.0.0' || chr(10) || '- Lines: ' || s.start_line || '-' || s.end_line"
    return f"SELECT s.file_id, s.chunk_id, s.token_count::BIGINT AS token_count, {head} AS header_md, s.body AS body_text FROM {active} s JOIN documents d ON d.doc_id::VARCHAR = s.file_id"


MATERIALIZED = f"""{STAGED}, p1 AS ({payloads("(SELECT doc_id::VARCHAR AS file_id, chunk_id, body, token_count, start_line, end_line FROM h1)")}), p2 AS ({payloads("(SELECT * FROM staged WHERE last_seen_batch = 'b2')")}),
done AS (
  SELECT coalesce(n.file_id, o.file_id) AS symbol_id, coalesce(n.token_count, o.token_count) AS token_count, coalesce(n.payloads, 0) AS payloads, CASE WHEN n.file_id IS NULL THEN 'keep' WHEN o.file_id IS NULL THEN 'insert' ELSE 'update' END AS op
  FROM (SELECT file_id, arg_max(token_count, chunk_id) AS token_count FROM p1 GROUP BY file_id) o
  FULL JOIN (SELECT file_id, arg_max(token_count, chunk_id) AS token_count, count(*) AS payloads FROM p2 GROUP BY file_id) n ON n.file_id = o.file_id
)"""
PATH = r"regexp_extract(url, '^[a-z]+://([^?#]*)', 1)"
SUFFIX = rf"lower(regexp_extract({PATH}, '[^/]\.([^./]+)$', 1))"
ALIGN = """WITH c AS (SELECT doc_id AS chunk_id, lang AS vdb_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)),
v AS (SELECT doc_id AS chunk_id, lang AS vdb_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
lost AS (SELECT c.* FROM c ANTI JOIN v USING (chunk_id, vdb_id)), extra AS (SELECT v.* FROM v ANTI JOIN c USING (chunk_id, vdb_id))"""


def knn(score: str, order: str) -> str:
    return f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), s AS (
  SELECT q.vec_id AS query_id, e.vec_id, {score} AS score FROM e, e q WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, vec_id)::INT AS rank FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10"""


STRUCTURAL = "body head header footer section article aside main nav div p ul ol li table thead tbody tr td form fieldset legend figure figcaption details summary script style".split()


def size(x: str) -> str:
    return f"octet_length(encode({x}))"


#: Pieces of the generated source files, as SQL.
ID, SRC, LANG, NL = "doc_id::VARCHAR", "coalesce(source, '')", "coalesce(lang, '')", "chr(10)"
FILES = "(SELECT * FROM documents WHERE doc_id IS NOT NULL)"
CODES = "string_agg(code, ',' ORDER BY code) AS codes"
LEVEL = "['ok', 'unknown', 'degraded', 'error'][max(level) + 1] AS status"


def folded(module: str, names: str, rules: list[tuple[str, str, int]]) -> str:
    """The worst level and the codes of every row of names (n_name, n_nationkey AS k)."""
    found = " UNION ALL ".join(f"SELECT n_name, '{code}' AS code, {level} AS level FROM n WHERE {when}" for code, when, level in rules)
    return f"""WITH n AS ({names}), f AS ({found}), g AS (SELECT n_name, {LEVEL}, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM f GROUP BY n_name)
SELECT '{module}' AS module, n.n_name AS name, coalesce(status, 'ok') AS status, coalesce(codes, '') AS codes FROM n LEFT JOIN g ON g.n_name = n.n_name"""


NATIONS = "SELECT n_name, n_regionkey, n_nationkey AS k FROM nation"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

ORACLE: dict[str, str] = {
    "text_chunks": f"WITH {chunks('c', 'documents')} SELECT doc_id, part_index, chunk_id, strategy, token_count, char_start, char_end, start_byte, end_byte, start_line, end_line FROM c",
    "text_chunk_hashes": f"WITH {chunks('c', 'documents')} SELECT doc_id, part_index, {HASH} AS content_hash, CASE WHEN {trimmed('body')} <> '' THEN {versioned(trimmed('body'), 'chunk_id', chr(39) + 'text' + chr(39))} END AS content_norm_hash FROM c",
    "flagship": f"WITH {chunks('c', 'documents')} SELECT source, count(*) AS chunks, sum(token_count)::BIGINT AS tokens, count(DISTINCT {HASH}) AS contents FROM c JOIN documents d ON d.doc_id = c.doc_id GROUP BY source",
    "file_hashes": f"SELECT doc_id, {versioned("coalesce(text, '')", "concat_ws('/', source, doc_id::VARCHAR)")} AS file_sha, sha256(coalesce(text, '')) AS checksum, ceil(length(coalesce(text, '')) / 4.0)::INT AS tokens, (8 + 4 * length(coalesce(text, '')))::BIGINT AS request_tokens, octet_length(encode(coalesce(text, '')))::BIGINT AS size_bytes FROM documents",
    "exact_duplicates": "SELECT sha256(coalesce(text, '')) AS checksum, count(*) AS files, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "html_raw_blocks": r"""WITH b AS (
  SELECT page_id, 'javascript' AS delegate, unnest(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1)) AS body FROM pages
  UNION ALL SELECT page_id, 'css', unnest(regexp_extract_all(html, '(?is)<style[^>]*>(.*?)</style>', 1)) FROM pages
) SELECT page_id, delegate, count(*) AS blocks, sum(octet_length(encode(body)))::BIGINT AS bytes FROM b WHERE regexp_matches(body, '\S') GROUP BY page_id, delegate""",
    "delegate_tree": r"""WITH b AS (
  SELECT page_id, unnest(regexp_extract_all(html, '(?is)<(?:script|style)[^>]*>(.*?)</(?:script|style)>', 1)) AS body FROM pages
) SELECT page_id, count(*) AS parents, count(*)::BIGINT AS children FROM b WHERE regexp_matches(body, '\S') GROUP BY page_id""",
    "url_module_names": rf"SELECT page_id, replace(regexp_replace(regexp_replace(regexp_replace({PATH}, '\.[^./]*$', ''), '^/+', ''), '/+$', ''), '/', '.') AS module, {SUFFIX} AS suffix FROM pages",
    "handler_resolution": f"""WITH h AS (SELECT CASE WHEN {SUFFIX} IN ('md', 'markdown', 'mdown', 'mkdn', 'mkd') THEN 'markdown' WHEN {SUFFIX} IN ('py', 'pyw', 'pyi') THEN 'python' WHEN {SUFFIX} IN ('js', 'jsx', 'mjs', 'cjs') THEN 'javascript'
  WHEN {SUFFIX} IN ('ts', 'tsx', 'cts', 'mts') THEN 'typescript' WHEN {SUFFIX} IN ('html', 'htm') THEN 'html' WHEN {SUFFIX} IN ('css', 'scss', 'less') THEN 'css' WHEN {SUFFIX} IN ('txt', 'log', 'ini', 'toml', 'cfg') THEN 'text' END AS by_suffix FROM pages)
SELECT coalesce(by_suffix, 'text') AS handler, CASE WHEN by_suffix IS NULL THEN 'default' ELSE 'extension' END AS reason, count(*) AS files FROM h GROUP BY ALL""",
    "stage_first_batch": f"WITH {chunks('c', 'documents')} SELECT doc_id::VARCHAR AS file_id, chunk_id, 'b1' AS batch_id, 'b1' AS first_seen_batch, 'b1' AS last_seen_batch, {HASH} AS content_hash, 'insert' AS op FROM c",
    "stage_second_batch": f"{STAGED} SELECT {SLICES}, op FROM staged",
    "stage_outcomes": f"{STAGED} SELECT count(*) FILTER (op = 'insert') AS written, count(*) FILTER (op = 'touch') AS reused, count(*) FILTER (op = 'keep') AS kept FROM staged",
    "stage_symbols": f"SELECT file_id, symbol_path, symbol_sha, first_seen_batch, last_seen_batch, op FROM {SYMBOL}",
    "active_slices": f"{STAGED} SELECT {SLICES} FROM staged WHERE last_seen_batch = 'b2'",
    "slice_history": f"{STAGED} SELECT file_id, chunk_id, last_seen_batch, row_number() OVER (PARTITION BY file_id ORDER BY chunk_id, last_seen_batch DESC) AS position FROM staged",
    "recomposed_conversations": "SELECT conv_id, count(*) AS parts, sum(ceil(length(text) / 4.0))::BIGINT AS token_count, sha256(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS text_sha FROM conversations GROUP BY conv_id",
    "slice_integrity": """WITH t AS (SELECT conv_id, count(*)::INT AS total FROM conversations GROUP BY conv_id), g AS (
  SELECT c.conv_id, count(*) AS parts, count(DISTINCT turn) AS indexes, min(turn) AS low, max(turn) AS high, any_value(total) AS total FROM conversations c JOIN t USING (conv_id) WHERE role <> 'assistant' GROUP BY c.conv_id)
SELECT conv_id, 'missing-parts' AS issue, parts, total AS part_total FROM g WHERE low <> 0 OR high <> total - 1 OR indexes <> total OR parts <> total""",
    "batch_summary": f"""{STAGED}, files AS (SELECT count(*) AS n FROM documents WHERE length(text) > 0)
SELECT b.id, CASE WHEN b.id = 'b2' THEN (SELECT n FROM files) ELSE 0 END AS files, CASE WHEN b.id = 'b2' THEN (SELECT n FROM files) ELSE 0 END AS symbols, (SELECT count(*) FROM staged WHERE batch_id = b.id) AS slices FROM (VALUES ('b1'), ('b2')) b(id)""",
    "latest_batch": "SELECT event_type AS id, count(*) AS events FROM events GROUP BY event_type ORDER BY max(ts) DESC, event_type DESC LIMIT 1",
    "batch_removal_counts": f"""{STAGED}, files AS (SELECT count(*) AS n FROM documents WHERE length(text) > 0)
SELECT count(*) FILTER (batch_id = 'b1' AND last_seen_batch = 'b2') AS chunks_reassigned, count(*) FILTER (batch_id = 'b1' AND last_seen_batch = 'b1') AS chunks_deleted, count(*) FILTER (batch_id = 'b2' AND first_seen_batch = 'b1') AS chunk_first_reassigned,
  0::BIGINT AS chunk_last_seen_reset, (SELECT n FROM files) AS symbols_reassigned, 0::BIGINT AS symbol_last_seen_reset, 0::BIGINT AS symbols_deleted, 0::BIGINT AS files_reassigned, 0::BIGINT AS files_deleted FROM staged""",
    "batch_removal_state": f"{STAGED} SELECT 'b2' AS batch_id, 'b2' AS first_seen_batch, 'b2' AS last_seen_batch, count(*) AS slices FROM staged WHERE last_seen_batch = 'b2'",
    "chunk_payloads": f"{STAGED}, p AS ({payloads('(SELECT * FROM staged WHERE last_seen_batch = ' + chr(39) + 'b2' + chr(39) + ')')}) SELECT file_id, chunk_id, token_count, sha256(header_md) AS header_sha, sha256(body_text) AS body_sha FROM p",
    "chunk_upsert_counts": f"{MATERIALIZED} SELECT op, count(*) AS chunks, sum(payloads)::BIGINT AS payloads, sum(token_count)::BIGINT AS tokens FROM done GROUP BY op",
    "sync_plan": f"{MATERIALIZED} SELECT count(*) AS total, count(*) FILTER (symbol_id NOT IN (SELECT doc_id::VARCHAR FROM labels)) AS embed, count(*) FILTER (symbol_id IN (SELECT doc_id::VARCHAR FROM labels)) AS skipped FROM done",
    "sync_limit": f"{MATERIALIZED} SELECT symbol_id, token_count FROM done WHERE symbol_id NOT IN (SELECT doc_id::VARCHAR FROM labels) ORDER BY symbol_id LIMIT 100",
    "vector_normalized": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: (x * 3::FLOAT)::DOUBLE) AS x FROM embeddings), n AS (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS n FROM e), u AS (SELECT *, list_transform(x, lambda y: y / n) AS y FROM n)
SELECT vec_id, round(n, 6) AS norm_before, round(sqrt(list_inner_product(y, y)), 6) AS norm_after, round(abs(y[1]), 3) AS first FROM u""",
    "knn_cosine": knn("list_inner_product(q.x, e.x)", "DESC"),
    "knn_ip": knn("list_inner_product(q.x, e.x)", "DESC"),
    "knn_l2": knn("list_sum([(a[1] - a[2]) * (a[1] - a[2]) FOR a IN list_zip(q.x, e.x)])", "ASC"),
    "vector_remove": "SELECT label, count(*) AS vectors FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 1) GROUP BY label",
    "vector_reconstruct": "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings WHERE label = 1",
    "vector_dim_check": "SELECT len(embedding)::INT AS dim, count(*) AS vectors FROM embeddings GROUP BY 1",
    "missing_vectors": f"{ALIGN} SELECT vdb_id, count(*) AS missing FROM lost GROUP BY vdb_id",
    "orphan_vectors": f"{ALIGN} SELECT vdb_id, count(*) AS orphans FROM extra GROUP BY vdb_id",
    "vdb_health": f"""{ALIGN}, s AS (SELECT lang AS name, (SELECT count(*) FROM c WHERE vdb_id = lang) AS cs, (SELECT count(*) FROM v WHERE vdb_id = lang) AS vs, (SELECT count(*) FROM lost WHERE vdb_id = lang) AS ls, (SELECT count(*) FROM extra WHERE vdb_id = lang) AS xs
  FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
f AS (
  SELECT name, 'not-synced' AS code, 1 AS level FROM s WHERE cs = 0 AND vs = 0 UNION ALL SELECT name, 'missing-vectors', 3 FROM s WHERE ls > 0 UNION ALL SELECT name, 'orphan-vectors', 2 FROM s WHERE xs > 0
  UNION ALL SELECT name, 'count-drift', 2 FROM s WHERE cs <> vs UNION ALL SELECT name, 'missing-sidecar', 3 FROM s WHERE name NOT IN ('en', 'de') AND vs > 0 UNION ALL SELECT name, 'index-drift', 3 FROM s WHERE name IN ('en', 'de') AND vs <> 0
  UNION ALL SELECT name, 'dim-mismatch', 3 FROM s WHERE name = 'de' UNION ALL SELECT name, 'stale-built-at', 2 FROM s WHERE name IN ('en', 'de') UNION ALL SELECT name, 'stale-batch', 2 FROM s
) SELECT 'vdb' AS module, name, ['ok', 'unknown', 'degraded', 'error'][max(level) + 1] AS status, string_agg(code, ',' ORDER BY code) AS codes FROM f GROUP BY name""",
    "vdb_reset_counts": f"{ALIGN} SELECT (SELECT count(*) FROM c WHERE vdb_id = 'en') AS chunks_deleted, (SELECT count(*) FROM v WHERE vdb_id = 'en') AS vectors_deleted, 1::BIGINT AS vdbs_deleted",
    "bounded_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, least(count(*), 5001) AS seen, CASE WHEN count(*) > 5000 THEN 'row-limit' ELSE 'counted' END AS reason FROM {t}" for t in TABLES),
    "run_summary_text": f"{STAGED} SELECT 'ok: ' || (SELECT count(*) FROM documents WHERE length(text) > 0) || ' files parsed, ' || count(*) FILTER (op = 'insert') || ' chunks written, ' || count(*) FILTER (op = 'touch') || ' reused' AS summary FROM staged",
    "uuid7_timestamps": """WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000 * 4096 + 1792 AS v FROM events)
SELECT event_id, ms, array_to_string([substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', ((v >> (55 - 5 * i)) & 31)::INT + 1, 1) FOR i IN range(12)], '') AS short FROM e""",
    "selectors": "SELECT source, lang AS batch, count(*) AS n FROM documents GROUP BY source, lang",
    "age_in_days": "SELECT floor((epoch(TIMESTAMP '2026-01-01 06:00:00') - floor(epoch(ts))) / 86400)::BIGINT AS days, count(*) AS events FROM events GROUP BY 1",
    "ledger": "SELECT sha256(string_agg(n_name || ':' || sha256(n_name), '|' ORDER BY n_nationkey)) AS checksum FROM nation",
    "pending_migrations": "SELECT n_name AS id, n_nationkey::BIGINT AS position FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) OR n_regionkey = 1",
    "health_merge": "SELECT event_type AS module, CASE WHEN event_type = 'click' THEN -1 ELSE count(*) END AS n FROM events GROUP BY event_type",
    "keyword_search": r"WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}\p{M}_]+')) AS term FROM documents) SELECT doc_id, count(*) AS n FROM t WHERE term IN ('the', 'and') GROUP BY doc_id HAVING count(DISTINCT term) = 2",
    "markdown_chunks": f"""WITH a AS (SELECT doc_id, {size(f"'---' || {NL} || 'id: ' || {ID} || {NL} || '---' || {NL}")} AS b0, {size(f"'intro' || {NL} || '# ' || {SRC} || {NL} || 'body ' || {LANG} || {NL}")} AS n1,
  {size(f"'## Part' || {NL} || '```py' || {NL}")} AS n2, {size(f"'x = ' || {ID} || {NL}")} AS n3 FROM {FILES}),
p AS (SELECT doc_id, b0, b0 + n1 AS s2, b0 + n1 + n2 AS cs, b0 + n1 + n2 + n3 AS ce, b0 + n1 + n2 + n3 + 4 AS e FROM a)
SELECT doc_id, 'markdown:front-matter' AS chunk_id, NULL AS delegate, NULL AS delegate_parent, 1 AS start_line, 3 AS end_line FROM p
UNION ALL SELECT doc_id, 'markdown:section:' || b0 || ':' || s2, NULL, NULL, 4, 6 FROM p
UNION ALL SELECT doc_id, 'markdown:section:' || s2 || ':' || e, NULL, NULL, 7, 10 FROM p
UNION ALL SELECT doc_id, 'py:delegate:markdown:fenced_code:' || cs || ':' || ce || ':0', 'py', 'markdown:section:' || s2 || ':' || e, 9, 9 FROM p""",
    "markdown_headings": f"""WITH a AS (SELECT doc_id, {SRC} AS s, {LANG} AS l, {size(f"'# ' || {SRC} || {NL}")} AS n1, {size(f"'## ' || {LANG} || {NL}")} AS n2 FROM {FILES}), p AS (SELECT *, 'markdown:heading:' AS h, n1 + n2 AS s3, n1 + n2 + 9 AS s4 FROM a)
SELECT doc_id, h || 0 AS symbol_id, s AS name, NULL AS parent, 1 AS level FROM p UNION ALL SELECT doc_id, h || n1, l, h || 0, 2 FROM p UNION ALL SELECT doc_id, h || s3, 'Deep', h || n1, 3 FROM p UNION ALL SELECT doc_id, h || s4, 'Last', NULL, 1 FROM p""",
    "python_symbols": f"""WITH p AS (SELECT doc_id, 'python:d' || {ID} || '.py::d' || {ID} AS r, {ID} AS i, {size(f"'class C' || {ID} || ':' || {NL}")}::BIGINT AS s, {size(f"'class C' || {ID} || ':' || {NL} || '    def m(self):' || {NL} || '        return ' || {ID}")}::BIGINT AS e FROM {FILES})
SELECT doc_id, r AS symbol_id, 'module' AS kind, NULL AS parent, 0::BIGINT AS start_byte, e + 1 AS end_byte FROM p UNION ALL SELECT doc_id, r || '.C' || i, 'class', r, 0, e FROM p UNION ALL SELECT doc_id, r || '.C' || i || '.m', 'function', r || '.C' || i, s, e FROM p""",
    "javascript_symbols": f"""WITH p AS (SELECT doc_id, {ID} AS i, 'javascript:d' || {ID} || '.js::d' || {ID} AS r, {size(f"'export class K' || {ID} || ' {{' || {NL} || '  '")}::BIGINT AS s, {size(f"'run() {{ return ' || {ID} || ' }}'")}::BIGINT AS m, {size(f"'export const n = ' || {ID} || ';'")}::BIGINT AS c FROM {FILES})
SELECT doc_id, r AS symbol_id, 'd' || i AS name, 'module' AS kind, 0::BIGINT AS start_byte, s + m + 3 + c + 1 AS end_byte FROM p UNION ALL SELECT doc_id, r || '.K' || i || ':0:' || (s + m + 2), 'K' || i, 'class', 0, s + m + 2 FROM p
UNION ALL SELECT doc_id, r || '.K' || i || '.run:' || s || ':' || (s + m), 'K' || i || '.run', 'method', s, s + m FROM p UNION ALL SELECT doc_id, r || '.n:' || (s + m + 3) || ':' || (s + m + 3 + c), 'n', 'const', s + m + 3, s + m + 3 + c FROM p""",
    "css_symbols": f"""WITH p AS (SELECT doc_id, {ID} AS i, {size(f"'.a' || {ID} || ', b {{ top: 0 }}'")}::BIGINT AS a, {size(f"'p {{ left: ' || {ID} || 'px }}'")}::BIGINT AS b FROM {FILES})
SELECT doc_id, 'd' || i || '.css' AS name, 'stylesheet' AS kind, 0::BIGINT AS start_byte, a + 1 + 15 + b + 3 AS end_byte FROM p UNION ALL SELECT doc_id, '.a' || i || ', b', 'rule', 0, a FROM p
UNION ALL SELECT doc_id, '@media print', 'at_rule', a + 1, a + 1 + 15 + b + 2 FROM p UNION ALL SELECT doc_id, 'p', 'rule', a + 16, a + 16 + b FROM p""",
    "html_elements": rf"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)(<(script|style)[^>]*>).*?</(script|style)>', '\1', 'g'), '<([A-Za-z][A-Za-z0-9]*)[\s/>]', 1)) AS tag FROM pages)
SELECT page_id, lower(tag) AS tag, count(*) AS elements FROM t WHERE lower(tag) IN ({", ".join(f"'{t}'" for t in STRUCTURAL)}) GROUP BY ALL""",
    "packed_lines": f"SELECT doc_id, 5::BIGINT AS parts, ceil((9 + 2 * 77) / 4.0)::INT AS most, (9 + 9 * 77 - 1)::BIGINT AS chars FROM {FILES}",
    "enabled_targets": "SELECT source, count(*) AS files, CASE WHEN length(source) % 2 = 0 THEN 'enabled' ELSE 'disabled' END AS state FROM documents GROUP BY source",
    "sync_totals": f"{ALIGN} SELECT (SELECT count(DISTINCT coalesce(vdb_id, '')) FROM (SELECT vdb_id FROM c UNION ALL SELECT vdb_id FROM v)) AS sets, (SELECT count(*) FROM c) AS chunks, (SELECT count(*) FROM v) AS vectors, (SELECT count(*) FROM lost) AS embedded",
    "skip_reasons": "SELECT 'row-limit' AS reason, count(*) AS tables FROM (" + " UNION ALL ".join(f"SELECT count(*) AS n FROM {t}" for t in TABLES) + ") WHERE n > 5000 HAVING count(*) > 0",
    "ordered_roles": "SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY conv_id, role) GROUP BY conv_id",
    "char_offsets": f"SELECT doc_id, {size('left(text, length(text) // 2)')}::INT AS byte, (length(text) // 2)::INT AS char FROM documents WHERE length(text) > 0",
    "cascade_delete": """WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
SELECT 'region' AS name, count(*) AS rows, 0::BIGINT AS nulls FROM region WHERE r_regionkey <> 1 UNION ALL SELECT 'nation', count(*), 0 FROM nation WHERE n_regionkey <> 1
UNION ALL SELECT 'customer', count(*), count(*) FILTER (c_nationkey IN (SELECT n_nationkey FROM n)) FROM customer UNION ALL SELECT 'supplier', count(*), 0 FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM n)""",
    "source_health": folded("source", NATIONS, [("disabled", "k % 2 <> 0", 1), ("missing-directory", "k % 3 = 0", 3), ("no-target", "k % 4 = 0", 2), ("unreadable-target", "k % 4 <> 0 AND k % 5 = 0", 3), ("never-refreshed", "k % 7 = 0", 1)]),
    "database_health": folded("db", NATIONS, [("missing", "k % 5 = 0", 3), ("pending", "k % 5 <> 0 AND n_regionkey < 3", 2), ("ledger-drift", "k % 2 <> 0", 3), ("vacuum-stale", "19 - k > 7", 2)]),
    "parser_health": folded("parser", NATIONS, [("never-run", "k % 3 = 0", 1), ("run-failed", "k % 4 = 0", 3), ("lock-contention", "k * 2 >= 30 OR k % 12 >= 10", 3), ("lock-contention", "NOT (k * 2 >= 30 OR k % 12 >= 10) AND (k * 2 >= 5 OR k % 12 >= 3)", 2)]),
    "sidecar_health": folded(
        "vdb", "SELECT n_name, n_nationkey AS k, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS v FROM nation",
        [("not-synced", "v = 0", 1), ("missing-sidecar", "k % 6 <= 1 AND v > 0", 3), ("sidecar-invalid", "k % 6 = 0", 3), ("sidecar-field", "k % 6 = 1", 3), ("sidecar-mismatch", "k % 6 = 2", 3), ("model-mismatch", "k % 6 = 3", 3), ("provider-mismatch", "k % 6 = 4", 3), ("missing-index", "k % 6 = 5 AND v > 0", 2)],
    ),
    "paragraph_chunks": f"""WITH p AS (SELECT doc_id, 's' || {SRC} || {NL} || {NL} AS a, 'l' || {LANG} || {NL} || ' ' || chr(9) || {NL} AS b, 'i' || {ID} AS c FROM {FILES}),
q AS (SELECT doc_id, 0 AS part_index, a AS body, 0 AS s, 0 AS char_start, 1 AS start_line FROM p UNION ALL SELECT doc_id, 1, b, {size('a')}, length(a), 3 FROM p UNION ALL SELECT doc_id, 2, c, {size('a || b')}, length(a || b), 5 FROM p),
r AS (SELECT *, 'text:' || s || ':' || (s + {size('body')}) AS chunk_id FROM q)
SELECT doc_id, part_index, chunk_id, 'paragraph' AS strategy, char_start::INT AS char_start, start_line::INT AS start_line, (start_line + CASE WHEN part_index < 2 THEN 1 ELSE 0 END)::INT AS end_line, {HASH} AS content_hash FROM r""",
    "strict_slices": f"{STAGED} SELECT {SLICES} FROM staged WHERE batch_id = 'b2'",
}
