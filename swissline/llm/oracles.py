"""SQL that gives the rows of those text operators whose results SQL can state. It spells out every window and pair: for small tables."""

_WORDS = r"[^\x20\x09-\x0D]+"

#: A window of 20 words goes if its words stand earlier; a window is named by its words joined, which hold no space.
SUBSTRING = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
  x AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 19), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
  late AS (SELECT doc_id, p FROM x QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM late),
  word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
  kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

#: Bytes are two hexadecimal digits each; runs of late strings that touch make one span, and what lies between the spans is kept.
SUFFIX = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
  x AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100)),
  late AS (SELECT doc_id, p FROM x QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
  span AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT doc_id, p, sum(starts) OVER (PARTITION BY doc_id ORDER BY p) AS g
    FROM (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 1 ELSE 0 END AS starts FROM late)) GROUP BY doc_id, g),
  edge AS (SELECT doc_id, a, b FROM span UNION ALL SELECT doc_id, n, n FROM d),
  piece AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS since FROM edge),
  kept AS (SELECT doc_id, coalesce(string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a, since), '') AS t FROM piece JOIN d USING (doc_id) WHERE a > since GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(n - length(coalesce(t, '')) // 2 AS BIGINT) AS n_removed, CAST((SELECT count(*) FROM span s WHERE s.doc_id = d.doc_id) AS BIGINT) AS n_spans, sha256(from_hex(coalesce(t, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

#: Shingles of five words, their common counts for all pairs that share one, and the pairs' closure.
JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
  long AS (SELECT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)),
  sh AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (SELECT * FROM long UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
  size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
  pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
  link AS MATERIALIZED (SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * i >= 80 * (p.n + q.n - i)),
  both_ways AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
  reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON e.x = r.y)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id FROM d LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = doc_id"""

#: The template's marks are counted by role; texts gain a backslash for each control string in them.
CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
  e AS (SELECT *, length(regexp_replace(text, '([<\[]\\*)(/?(?:s>|INST\]|SYS\]|ROLE\]|TEXT\]))', '\1\\\2', 'g')) AS n,
    length(regexp_replace(role, '([<\[]\\*)(/?(?:s>|INST\]|SYS\]|ROLE\]|TEXT\]))', '\1\\\2', 'g')) AS r FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 WHEN 'system' THEN 13 ELSE 19 + r END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

#: Every anchor's score with every row, its first five of the same label, and the first three of other labels in each one's range.
NEGATIVES = """
WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
    FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
  n AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank, s.other_id AS negative_id, positive_score, s.score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT * FROM n WHERE rank <= 3"""

ORACLES = {"op3_substring_dedup": SUBSTRING, "op7_suffix_dedup": SUFFIX, "op9_jaccard_groups": JACCARD, "op12_chat_rendering": CHAT, "op13_bit_sliced_negatives": NEGATIVES}
