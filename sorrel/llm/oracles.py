"""SQL of the llm queries that SQL can express."""

ORACLES: dict[str, str] = {
    "p4_rebuilt": """SELECT DISTINCT chunk_key, md5(text) AS text_md5, md5(text) AS rebuilt, true AS fits, true AS lapped, start_line AS first_line,
  CAST(start_line + length(text) - length(replace(text, chr(10), '')) - CAST(ends_with(text, chr(10)) AS INTEGER) AS INTEGER) AS last_line FROM doc_chunks WHERE length(text) > 1600""",
    "p4_found": "SELECT DISTINCT chunk_key FROM doc_chunks WHERE length(text) > 1600",
    # windows of three lines that say something; equal windows are equal hashes
    "p3_shared": r"""WITH l AS (SELECT DISTINCT file_key, coalesce(repo_name, '') AS repo, content, list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 4 AND NOT starts_with(x, 'import ') AND NOT starts_with(x, 'from ')) AS ls
    FROM files WHERE content IS NOT NULL AND path IS NOT NULL
  ), w AS (SELECT DISTINCT file_key, repo, content, unnest(list_transform(range(1, len(ls) - 1), lambda i: ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2])) AS w FROM l WHERE len(ls) >= 3
  ), s AS (SELECT w FROM w GROUP BY 1 HAVING min(repo) < max(repo))
  SELECT DISTINCT file_key, CAST(count(*) AS INTEGER) AS size, count(s.w) AS shared FROM w LEFT JOIN s USING (w) GROUP BY file_key, repo, content""",
    "p9_windows": r"""WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'i', item_id, text FROM eval_items WHERE text IS NOT NULL
  ), w AS (SELECT kind, id, regexp_extract_all(regexp_replace(lower(text), '(?s)</?[a-zA-Z][^<>\n]*>|<!--.*?-->|&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);|\]\([^()\s]*\)', ' ', 'g'), '[\p{L}\p{N}]+') AS ws FROM t
  ), g AS (SELECT kind, id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM w WHERE len(ws) >= 3
  ), k AS (SELECT DISTINCT g FROM g WHERE kind = 'i'), n AS (SELECT id, count(*) AS windows, count(k.g) AS hits FROM g LEFT JOIN k USING (g) WHERE kind = 'd' GROUP BY 1)
  SELECT w.id AS doc_id, coalesce(windows, 0) AS windows, coalesce(hits, 0) AS hits FROM w LEFT JOIN n USING (id) WHERE kind = 'd'""",
    "p10_counts": r"""SELECT doc_id, len(ws) AS n_words, CASE WHEN len(ws) = 0 THEN 0.0 ELSE round(list_sum(list_transform(ws, lambda x: length(x))) / len(ws), 6) END AS mean_word_length
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+') AS ws FROM documents WHERE regexp_matches(text, '[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]'))""",
    "p10_ranks": """WITH v AS (SELECT lang, CAST(n_chars AS DOUBLE) AS value FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL), p AS (SELECT * FROM v UNION ALL SELECT '*', value FROM v
  ), c AS (SELECT lang, value, count(*) AS n FROM p GROUP BY 1, 2
  ), r AS (SELECT lang, value, n, CAST(sum(n) OVER (PARTITION BY lang) AS BIGINT) AS a, sum(n) OVER (PARTITION BY lang ORDER BY value DESC) AS ge FROM c)
  SELECT lang, value, n, a AS "all", round((ge + CASE WHEN value > 0 THEN 0 ELSE 400 END) / (a + 400), 9) AS tail FROM r""",
}
