"""DuckDB twins of the queries that SQL can express.

The others: SimHash needs XXH64 majorities, n-best segmentation and hashed naive
Bayes or latent vectors are no SQL, extraction iterates, and the nearest
neighbours are approximate. ``tests/llm`` holds them against brute force, exact
round trips, held-out accuracy or recall.
"""

from __future__ import annotations

_CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, length(replace(replace(replace(replace(replace(replace(replace(text,
    chr(92), chr(92) || 'e'), '<s>', chr(92) || 'a'), '</s>', chr(92) || 'b'), '[INST]', chr(92) || 'c'),
    '[/INST]', chr(92) || 'd'), '<<SYS>>', chr(92) || 'f'), '<</SYS>>', chr(92) || 'g')) + length(role) + 8 AS piece
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(piece) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""

_LINES = r"""
WITH texts AS (
  SELECT page_id,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
    trim(regexp_replace(regexp_replace(html, '<[^>]*>', chr(10), 'g'), '\n[ \t\n\v\f\r]*', chr(10), 'g'), ' ') AS text
  FROM pages
), numbered AS MATERIALIZED (
  SELECT row_number() OVER () AS n, * FROM texts
), split AS (
  SELECT n, host, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS at FROM numbered
), totals AS (
  SELECT host, count(*) AS n_pages FROM numbered GROUP BY host
), counts AS (
  SELECT host, trim(line, ' ') AS mark, count(DISTINCT n) AS held FROM split WHERE trim(line, ' ') <> '' GROUP BY 1, 2
), often AS (
  SELECT c.host, c.mark FROM counts c JOIN totals t ON c.host IS NOT DISTINCT FROM t.host
  WHERE t.n_pages >= 5 AND c.held >= 5 AND c.held > t.n_pages * 0.1
), kept AS (
  SELECT s.n, string_agg(s.line, chr(10) ORDER BY s.at) FILTER (o.mark IS NULL) AS kept,
    count(*) AS n_lines, count(o.mark) AS n_dropped
  FROM split s LEFT JOIN often o ON s.host IS NOT DISTINCT FROM o.host AND trim(s.line, ' ') = o.mark
  GROUP BY s.n
)
SELECT p.page_id, p.host, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines,
  CAST(coalesce(k.n_dropped, 0) AS BIGINT) AS n_dropped,
  CASE WHEN p.text IS NOT NULL THEN sha256(coalesce(k.kept, '')) END AS kept_sha256,
  CASE WHEN p.text IS NOT NULL THEN coalesce(k.kept, '') END AS kept
FROM numbered p LEFT JOIN kept k USING (n)
"""

_DECONTAMINATION = r"""
WITH doc AS MATERIALIZED (
  SELECT row_number() OVER () AS n, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS size, array_to_string(words[i:i + least(13, len(words)) - 1], ' ') AS phrase
  FROM item, unnest(range(1, greatest(2, len(words) - 11))) AS r(i) WHERE len(words) > 0
), sizes AS (SELECT DISTINCT size FROM windows
), places AS (
  SELECT n, size, i, array_to_string(words[i:i + size - 1], ' ') AS phrase
  FROM doc, sizes, unnest(range(1, len(words) - size + 2)) AS r(i)
), met AS (
  SELECT p.n, p.i, p.size, w.item_id FROM places p JOIN windows w ON p.size = w.size AND p.phrase = w.phrase
), hits AS (
  SELECT n, count(DISTINCT k) AS n_hit FROM met, unnest(range(i, i + size)) AS r(k) GROUP BY n
), items AS (
  SELECT n, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS held
  FROM (SELECT DISTINCT n, item_id FROM met) GROUP BY n
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.held, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.words) AS contaminated
FROM doc d LEFT JOIN hits h USING (n) LEFT JOIN items i USING (n)
"""

def _edit(path: str, cost: str, letters: str) -> str:
    """SQL for a path with letters more behind."""
    return f"(lpad(CAST(CAST(({path})[1:10] AS BIGINT) + {cost} AS VARCHAR), 10, '0') || ({path})[11:] || '{letters}')"


def _crc_table() -> str:
    """SQL that turns a list of bytes into the remainders of CRC-32, bit by bit."""
    t = "t"
    for _ in range(8):
        t = f"list_transform({t}, lambda x: xor(x >> 1, (x & 1) * 3988292384))"
    return t


_REPAIR = rf"""
WITH RECURSIVE bytes AS (
  SELECT range(256) AS t
), crc AS (
  SELECT {_crc_table()} AS t FROM bytes
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), hashed AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(
      list_prepend(4294967295, list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT))),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 20 AS h
  FROM keyed, crc
), rows AS MATERIALIZED (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(CASE WHEN h = 3 THEN 2 ELSE 1 END) WHERE h <> 0
), known AS (
  SELECT *, role[1] AS ini, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), seen) AS i,
    right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM rows)
), faults AS MATERIALIZED (
  SELECT *, CASE WHEN last = '' THEN 1 WHEN seen > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS ini_before FROM known
), convs AS (
  SELECT DISTINCT conv_id FROM conversations
), counts AS (
  SELECT c.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (ini_before || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(i) AS n
  FROM convs c LEFT JOIN faults f ON c.conv_id IS NOT DISTINCT FROM f.conv_id GROUP BY 1
), paths AS (
  -- the least path to each of the states none, s, u and a, as ten digits of cost and the letters
  SELECT conv_id, 0::BIGINT AS i, '0000000000' AS f0, NULL::VARCHAR AS f1, NULL::VARCHAR AS f2, NULL::VARCHAR AS f3 FROM convs
  UNION ALL
  SELECT conv_id, i,
    {_edit("f0", "4", "D")},
    least({_edit("f1", "4", "D")}, CASE WHEN fine AND ini = 's' THEN {_edit("f0", "extra", "K")} END),
    least({_edit("g2", "4", "D")}, CASE WHEN fine AND ini = 'u' THEN {_edit("into_u", "extra", "K")} WHEN fine THEN {_edit("into_u", "3 + extra", "R")} END),
    least({_edit("g3", "4", "D")}, CASE WHEN fine AND ini = 'a' THEN {_edit("g2", "extra", "K")} WHEN fine THEN {_edit("g2", "3 + extra", "R")} END)
  FROM (
    SELECT *, least(f0, f1, g3) AS into_u FROM (
      SELECT *, least(f2, {_edit("least(f0, f1, f3)", "3", "I")}) AS g2, least(f3, {_edit("f2", "3", "I")}) AS g3 FROM (
        SELECT f.conv_id, f.i, f.ini, f.fault NOT IN (1, 2) AS fine, CASE WHEN f.fault = 3 THEN 3 ELSE 0 END AS extra, p.f0, p.f1, p.f2, p.f3
        FROM paths p JOIN faults f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = p.i + 1)))
), best AS (
  SELECT c.conv_id, least(f0, f3, {_edit("f2", "3", "I")}, {_edit("f1", "6", "II")}) AS w
  FROM counts c JOIN paths p ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i
), verdicts AS MATERIALIZED (
  SELECT conv_id, CAST(w[1:10] AS BIGINT) AS cost, w[11:] AS audit FROM best
), walk AS (
  SELECT conv_id, 0::BIGINT AS pos, 0::BIGINT AS i, '' AS before, '' AS said, FALSE AS begun FROM verdicts
  UNION ALL
  SELECT conv_id, pos, i, CASE WHEN letter = 'D' THEN before ELSE now[1] END,
    CASE WHEN letter = 'D' THEN said ELSE said || CASE WHEN begun THEN chr(10) ELSE '' END || now || ':' || text END,
    begun OR letter <> 'D'
  FROM (
    SELECT w.conv_id, w.pos + 1 AS pos, w.i + CASE WHEN letter = 'I' THEN 0 ELSE 1 END AS i, w.before, w.said, w.begun, letter,
      CASE WHEN letter = 'K' THEN f.role WHEN w.before = 'u' THEN 'assistant' ELSE 'user' END AS now,
      CASE WHEN letter = 'I' THEN '' ELSE f.text END AS text
    FROM (SELECT w.*, v.audit[w.pos + 1] AS letter FROM walk w JOIN verdicts v
          ON v.conv_id IS NOT DISTINCT FROM w.conv_id AND w.pos < length(v.audit)) w
    LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1)
), done AS (
  SELECT conv_id, arg_max(said, pos) AS said FROM walk GROUP BY conv_id
)
SELECT c.conv_id, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, v.cost, v.audit, sha256(d.said) AS repaired_sha256
FROM counts c JOIN verdicts v ON c.conv_id IS NOT DISTINCT FROM v.conv_id JOIN done d ON c.conv_id IS NOT DISTINCT FROM d.conv_id
"""

_NEGATIVES = r"""
WITH rows AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a, rows b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, p.positive_score, n.vec_id AS negative_id, n.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS rank
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
  AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""

ORACLES = {
    "op1_chat": _CHAT, "op6_line_dedup": _LINES, "op10_decontamination": _DECONTAMINATION, "op11_repair": _REPAIR,
    "op12_negatives": _NEGATIVES}
