"""DuckDB SQL of the corpus queries that SQL can express.

The others are tested against brute force: SentencePiece merges (1), XXH64 and
connected components (4), fitted classifiers (5, 9), byte-triplet digests (6),
offsets of matches with look-around (7), runs of hashed units (8), the
set-similarity join, too slow in SQL on whole tables (10), eigenvectors (11) and
trained weights (13).
"""

from __future__ import annotations

from .mixing import DRAW_DIGITS, DRAWS, IN_DIGEST, MOST_REPEATS, WEIGHTS
from .quality_rules import BULLET, ELLIPSIS, SENTENCE_END, STOP_WORDS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
WEIGHT = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
HEX = " + ".join(f"(instr('0123456789abcdef', substr(digits, {i + 1}, 1)) - 1) * {16 ** (DRAW_DIGITS - 1 - i)}" for i in range(DRAW_DIGITS))

OP2 = f"""
WITH sized AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} {WEIGHT} END AS weight FROM per_source),
ordered AS (SELECT *, row_number() OVER w AS k, coalesce(sum(source_size * {MOST_REPEATS}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights, sum(source_size) OVER () AS total
  FROM weighted WINDOW w AS (ORDER BY source_size / weight, source IS NULL, source)),
level AS (SELECT CAST(total - capped AS DOUBLE) / CAST(weights AS DOUBLE) AS level FROM ordered WHERE weight * (CAST(total - capped AS DOUBLE) / CAST(weights AS DOUBLE)) <= source_size * {MOST_REPEATS} ORDER BY k LIMIT 1),
targets AS (SELECT source, source_size, least(CAST(source_size * {MOST_REPEATS} AS DOUBLE), weight * level) AS target FROM weighted CROSS JOIN level),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, {MOST_REPEATS}.0) ELSE 0.0 END AS rate FROM targets),
drawn AS (SELECT s.doc_id, s.source, s.size, r.source_size, r.target, r.rate, k,
  substr(sha256(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || (k // {IN_DIGEST})), CAST((k % {IN_DIGEST}) * {DRAW_DIGITS} + 1 AS BIGINT), {DRAW_DIGITS}) AS digits
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source CROSS JOIN (SELECT unnest(range(0, {DRAWS})) AS k)),
copied AS (SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN ({HEX}) / {16 ** DRAW_DIGITS}.0 < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM drawn),
gaps AS (SELECT source, k, abs(sum(copies * size) - max(target)) AS gap FROM copied GROUP BY source, k),
best AS (SELECT source, k FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY gap, k) AS rn FROM gaps) WHERE rn = 1)
SELECT c.doc_id, c.size, c.source_size, c.target, CAST(c.copies * c.size AS BIGINT) AS taken FROM copied c JOIN best b ON c.source IS NOT DISTINCT FROM b.source AND c.k = b.k
"""

LIKE = {name: pattern.replace("'", "''") for name, pattern in (("bullet", BULLET), ("ellipsis", ELLIPSIS), ("sentence", SENTENCE_END))}
LINES = ", ".join(f"len(list_filter(lines, lambda x: regexp_matches(x, '{pattern}'))) AS n_{name}_lines" for name, pattern in LIKE.items())
STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
OP3 = f"""
WITH worded AS (SELECT doc_id, {WORDS} AS w, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
placed AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM worded WHERE len(w) >= 3)),
often AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM placed) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM often CROSS JOIN (VALUES (0), (1), (2)) t(j) GROUP BY doc_id),
measured AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, {LINES}, coalesce(c.n, 0) AS n_repeat_words,
  len(list_filter(w, lambda x: x IN ({STOPS}))) AS n_stops FROM worded d LEFT JOIN covered c USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed
  AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words AND 4 * n_symbols <= n_words AND 100 * n_stops >= n_words AND 2 * n_dup_lines <= n_lines
  AND 10 * n_bullet_lines <= 9 * n_lines AND 10 * n_ellipsis_lines <= 3 * n_lines AND 10 * n_sentence_lines >= n_lines AS kept FROM judged
"""

DRAWN = ", ".join(f"CAST(CAST('0x' || h[{8 * i + 1}:{8 * i + 8}] AS UBIGINT) AS BIGINT) AS h{i + 1}" for i in range(4))
OP12 = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
split AS (SELECT *, string_split(t, chr(10)) AS parts FROM texts),
cut AS (SELECT doc_id, t, list_filter(list_transform(parts, lambda x, i: CASE WHEN i < len(parts) THEN x || chr(10) ELSE x END), lambda x: x <> '') AS u, {DRAWN} FROM split),
placed AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM cut),
pieces AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM pieces
"""

ORACLE: dict[str, str] = {"op2_mixing": OP2, "op3_quality_rules": OP3, "op12_fill_in_middle": OP12}
