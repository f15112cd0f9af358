"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

_OP2 = r"""
WITH sized AS (
  SELECT doc_id, source, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
keyed AS (
  SELECT doc_id, source, len(w)::BIGINT AS size,
    -ln((('0x' || md5('42|' || coalesce(doc_id::VARCHAR, ''))[1:13])::BIGINT + 0.5) / 4503599627370496.0)
      / greatest(len(list_distinct(w))::DOUBLE / greatest(len(w), 1), 1e-6) AS key
  FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM keyed GROUP BY source),
weighed AS (
  SELECT *, (place % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER ()::DOUBLE AS words
  FROM sources),
stepped AS (
  SELECT *, row_number() OVER o AS nth,
    (words - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit
  FROM weighed WINDOW o AS (ORDER BY cap / weight, place)),
targets AS (
  SELECT source, source_size,
    least(cap, weight * min_by(unit, CASE WHEN cap >= unit * weight THEN nth END) OVER ()) AS target
  FROM stepped),
summed AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN size > 0 AND target - epochs * source_size > 0
                          AND upto - size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
"""

_WORDS4 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP4 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS4} AS w FROM documents),
items AS (SELECT item_id, {_WORDS4} AS w FROM benchmark WHERE item_id IS NOT NULL),
grams AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2),
    lambda i: array_to_string(w[i : i + least(10, len(w)) - 1], ' '))) AS g
  FROM items WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM grams),
windows AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item_id FROM windows JOIN grams USING (n, g)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN places USING (r) LEFT JOIN found USING (r)
"""

_OP5 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
said AS (
  SELECT *, length(text) + (length(text) - length(replace(text, '\', '')))
      + (length(text) - length(replace(text, '<|', ''))) // 2 AS text_chars,
    length(role) + (length(role) - length(replace(role, '\', '')))
      + (length(role) - length(replace(role, '<|', ''))) // 2
      + 2 * (length(role) - length(replace(role, chr(10), ''))) AS role_chars
  FROM turns),
rows AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS all_turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(12 + role_chars + 1 + text_chars + 11)::BIGINT AS formatted_chars
  FROM said GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(all_turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
  sha256(loss) AS loss_sha256, formatted_chars
FROM rows
"""

_HEAD11 = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?"""
_PATTERNS11 = (
    (0, _HEAD11 + "[A-Za-z0-9+/_.=-]+"),
    (1, "AKIA[A-Z0-9]+"),
    (2, "[0-9a-f]{32,}"),
    (3, "[A-Za-z0-9+/_.=-]{8,}"),
)
_CUT11 = " UNION ALL ".join(
    f"""SELECT r, {kind} AS kind, string_split_regex(
        regexp_replace(t, '({pattern})', chr(57344) || '\\1' || chr(57345), 'g'), '[\\x{{E000}}\\x{{E001}}]') AS s
    FROM docs WHERE regexp_matches(t, '{pattern}')"""
    for kind, pattern in _PATTERNS11
)
_SPANS11 = "coalesce(string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind)"

_OP11 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source,
    translate(coalesce(text, ''), chr(57344) || chr(57345), chr(57346) || chr(57346)) AS t
  FROM documents),
cuts AS (SELECT r, kind, unnest(s) AS m, generate_subscripts(s, 1) AS i FROM ({_CUT11})),
placed AS (SELECT r, kind, m, i, sum(length(m)) OVER (PARTITION BY r, kind ORDER BY i) - length(m) AS s FROM cuts),
found AS (
  SELECT r, kind, s, s + length(m) AS e, m, CASE WHEN kind = 0 THEN regexp_replace(m, '^{_HEAD11}', '')
    WHEN kind = 3 THEN regexp_replace(m, '\.+$', '') ELSE m END AS v
  FROM placed WHERE i % 2 = 0),
base AS (SELECT * FROM found WHERE length(v) >= [8, 16, 32, NULL][kind + 1]),
free AS (
  SELECT r, kind, s, s + length(v) AS e, v FROM found f
  WHERE kind = 3 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = f.r AND b.s < f.e AND f.s < b.e)),
keyed AS (
  SELECT r, kind, s, e, v, regexp_replace(v, '\.+$', '') AS k, string_split(v, '') AS chars
  FROM (SELECT r, kind, s, e, v FROM base UNION ALL SELECT r, kind, s, e, v FROM free)),
spots AS (
  SELECT *, regexp_matches(v, '[0-9]') AND len(list_distinct(chars)) >= 6
    AND NOT regexp_matches(v, '(?i)example|sample|dummy|change_?me|placeholder|your|test|fake|1234567|abcdef')
    AND len(list_filter(chars, lambda c: contains(lower(v), repeat(lower(c), 4)))) = 0 AS live
  FROM keyed
  WHERE kind < 3 OR k IN (SELECT k FROM keyed WHERE kind < 3)
    OR length(v) >= 20 AND len(list_distinct(chars)) >= 12 AND regexp_full_match(v, '[A-Za-z0-9_-]+')
      AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')),
owners AS (
  SELECT k, count(DISTINCT source) + max((source IS NULL)::INT) AS n FROM spots JOIN docs USING (r) GROUP BY k),
judged AS (SELECT r, kind, s, e, n >= 3 AS copied, n < 3 AND live AS owned FROM spots JOIN owners USING (k)),
said AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    {_SPANS11} FILTER (kind < 3), '') AS base,
    {_SPANS11} FILTER (kind < 3 OR owned), '') AS spans,
    {_SPANS11} FILTER (owned), '') AS owned_spans,
    {_SPANS11} FILTER (copied), '') AS copied_spans
  FROM judged GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(owned_spans, '') AS owned_spans, coalesce(copied_spans, '') AS copied_spans
FROM docs LEFT JOIN said USING (r)
"""

def _assigned13(name: str, book: str) -> str:
    """Every part with its nearest entry; distances are whole numbers, so 64 * d + e orders ties too."""
    return f"""{name} AS (
  SELECT r, p, any_value(v) AS v, arg_min(e, 64 * d + e) AS e, min(d) AS d
  FROM (SELECT r, p, v, e, list_sum(list_transform(list_zip(v, c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d
        FROM parts JOIN {book} USING (p))
  GROUP BY r, p)"""


def _moved13(name: str, assigned: str, book: str) -> str:
    return f"""{name} AS (
  SELECT p, e, coalesce(m, c) AS c FROM {book} LEFT JOIN (
    SELECT p, e, list(floor(total / n)::BIGINT ORDER BY j) AS m
    FROM (SELECT p, e, j, sum(v[j])::DOUBLE AS total, count(*) AS n
          FROM {assigned}, (SELECT unnest(range(1, (SELECT max(w) FROM kept) + 1)) AS j) GROUP BY p, e, j)
    GROUP BY p, e) USING (p, e))"""


_OP13 = f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, x, len(x) // 16 AS w
  FROM (SELECT vec_id, label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
        WHERE embedding IS NOT NULL
          AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0)),
parts AS (SELECT r, p, x[p * w + 1 : (p + 1) * w] AS v FROM kept, (SELECT unnest(range(16)) AS p)),
first AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e FROM kept),
book0 AS (SELECT p, e, v AS c FROM parts JOIN first USING (r) WHERE e < 64),
{_assigned13("near0", "book0")},
{_moved13("book1", "near0", "book0")},
{_assigned13("near1", "book1")},
{_moved13("book2", "near1", "book1")},
{_assigned13("near2", "book2")},
coded AS (
  SELECT r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
  FROM near2 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM coded JOIN kept USING (r)
"""

ORACLES = {"op2_mixing": _OP2, "op4_decontamination": _OP4, "op5_chat_formatting": _OP5, "op11_secret_owners": _OP11, "op13_norm_bounds": _OP13}
