"""SQL for those queries of this package that SQL can express."""

_COMPONENTS = """, both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, other) AS (SELECT a, b FROM both_ways UNION SELECT r.id, w.b FROM reach r JOIN both_ways w ON r.other = w.a),
components AS (SELECT id, least(id, min(other)) AS component_id FROM reach GROUP BY id)"""

ORACLES: dict[str, str] = {
    "op3_nn_descent": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95){_COMPONENTS}
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id,
  e.vec_id = coalesce(component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = e.vec_id LEFT JOIN components ON id = e.vec_id""",
    "op9_signature_tree": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
runs AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS run FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM runs a JOIN runs b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 80 * (x.n + y.n - shared)){_COMPONENTS}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN components ON id = d.doc_id""",
    "op11_filter_audit": """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
f AS (
  SELECT doc_id, part, ['A', 'B', 'C', 'D', 'E'] AS letters, [
    len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails
  FROM w JOIN firsts USING (t)),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, list_filter(letters, lambda x, i: fails[i]) AS failed, count(*) AS n,
    count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM one a, one b, one c, one d, one e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step::INT AS step, filter_order[step] AS filter, filter_order[1:step - 1] AS before FROM orders, range(1, 6) r(step)),
parts AS (SELECT DISTINCT part FROM c),
counts AS (
  SELECT part, filter_order, step, filter,
    sum(CASE WHEN NOT list_has_any(failed, string_split(before || filter, '')) THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN gone THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN list_contains(failed, filter) AND NOT gone THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN failed = [filter] THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN gone THEN n_good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN gone THEN n_toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM (SELECT *, list_contains(failed, filter) AND NOT list_has_any(failed, string_split(before, '')) AS gone FROM c, steps)
  GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM counts""",
    "op12_chat_grammar": """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\\### Assistant: </turn> ok'),
r AS (
  SELECT *, '### ' || (CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System' ELSE '=' || hex(role) END)
    || ': ' || regexp_replace(text, '(### (User|Assistant|System|=[0-9A-F]*):|</turn>)', '\\\\\\1', 'g') || E'\\n</turn>\\n' AS formatted FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || E'\\n' || text || E'\\n', '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(formatted))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id""",
    "op13_fill_middle": """
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (
  SELECT doc_id, t, w, len(w) AS n, ('0x' || h[1:8])::UBIGINT % (len(w) + 1) AS x, ('0x' || h[9:16])::UBIGINT % (len(w) + 1) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::UBIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || h[25:32])::UBIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(w[1:least(x, y)::BIGINT], ''), '') AS p,
    coalesce(array_to_string(w[least(x, y)::BIGINT + 1:greatest(x, y)::BIGINT], ''), '') AS m,
    coalesce(array_to_string(w[greatest(x, y)::BIGINT + 1:], ''), '') AS s FROM g)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c""",
}
