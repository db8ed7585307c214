"""DuckDB SQL for the training-data queries that SQL can express."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = r"""
WITH docs AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rnk FROM docs GROUP BY source
), ranked AS (
  SELECT *, rnk % 3 + 1 AS weight, source_size * 3 AS cap FROM per
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked
), chosen AS (
  SELECT *, first_value(level) OVER (ORDER BY CASE WHEN level * weight <= cap THEN 0 ELSE 1 END, cap / weight, rnk) AS final FROM levels
), targets AS (
  SELECT source, source_size, rnk, CASE WHEN final * weight < cap THEN final * weight ELSE cap::DOUBLE END AS target FROM chosen
), placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rnk, floor(t.target)::BIGINT AS whole,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), used AS (
  SELECT *, (greatest(0, least(size, whole - off)) + greatest(0, least(size, whole - source_size - off)) + greatest(0, least(size, whole - 2 * source_size - off)))::BIGINT AS taken,
    CASE WHEN target > 0 THEN least(1.0::DOUBLE, off::DOUBLE / target) END AS due
  FROM placed
)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN round(CASE rnk % 3 WHEN 0 THEN 0.0::DOUBLE + (due * 1.0::DOUBLE - 0.0::DOUBLE) / 1.0::DOUBLE
    WHEN 1 THEN 0.0::DOUBLE + (sqrt(greatest(0.0::DOUBLE, 0.25::DOUBLE + 2.0::DOUBLE * (due * 1.0::DOUBLE - 0.0::DOUBLE))) - 0.5::DOUBLE) / 1.0::DOUBLE
    ELSE 0.0::DOUBLE + (sqrt(greatest(0.0::DOUBLE, 2.25::DOUBLE + -2.0::DOUBLE * (due * 1.0::DOUBLE - 0.0::DOUBLE))) - 1.5::DOUBLE) / -1.0::DOUBLE END, 9) END AS position
FROM used
"""

OP3 = r"""
WITH rules(act, rule) AS (VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')),
split AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split
), fits AS (
  SELECT n, max({'len': length(rule), 'rule': rule, 'act': act}) AS best
  FROM parts JOIN rules ON starts_with(path, substr(rule, instr(rule, '/')))
    AND ('.' || host) LIKE ('%.' || substr(rule, 1, instr(rule, '/') - 1))
  GROUP BY n
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.act, 'allow') AS verdict FROM parts LEFT JOIN fits USING (n)
"""

OP5 = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array({LOWER}, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, greatest(len(w) - 1, 2))]) AS g FROM docs WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * common >= 90 * (p.n + q.n - common)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(a, b) AS (
  SELECT x, x FROM both_ways UNION SELECT r.a, e.y FROM reach r JOIN both_ways e ON r.b = e.x
), least_of AS (
  SELECT a, min(b) AS component FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(l.component, d.doc_id) AS component_id
FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_of l ON l.a = d.doc_id
"""

OP6 = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + o AS p FROM later, range(20) t(o)
), lists AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(ps, k)) END, ' '), '')) AS kept_sha256
FROM docs d LEFT JOIN lists l ON l.doc_id = d.doc_id
"""


ORACLE: dict[str, str] = {"op1_mixing": OP1, "op3_url_filter": OP3, "op5_ngram_join": OP5, "op6_substring": OP6}

OP10 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS n, doc_id, list_filter(regexp_split_to_array({LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), items AS (
  SELECT item_id, list_filter(regexp_split_to_array({LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark
), known AS (
  SELECT DISTINCT item_id, len(w[i:i + 9]) AS len, array_to_string(w[i:i + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM items WHERE len(w) > 0)
), probes AS (
  SELECT n, i, len, array_to_string(w[i:i + len - 1], ' ') AS g
  FROM (SELECT n, w, len, unnest(range(1, len(w) - len + 2)) AS i FROM docs, (SELECT DISTINCT len FROM known))
), hits AS (
  SELECT n, i, p.len, item_id FROM probes p JOIN known k ON p.len = k.len AND p.g = k.g
), words AS (
  SELECT n, count(DISTINCT i + o) AS n_hit FROM hits, range(10) t(o) WHERE o < len GROUP BY n
), found AS (
  SELECT n, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits WHERE item_id IS NOT NULL GROUP BY n
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (n) LEFT JOIN found USING (n)
"""
ORACLE["op10_decontamination"] = OP10
