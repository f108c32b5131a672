"""The corpus queries that SQL can express, for DuckDB."""

ORACLES: dict[str, str] = {}

ORACLES["op6_decontaminate"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT item, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hit AS (SELECT r, i, k, item FROM dw JOIN bw USING (k, gram)),
words AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT r, i, k FROM hit)) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN named USING (r)
"""

ORACLES["op7_substring_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT r, i, sha256(array_to_string(w[i:i + 19], ' ')) AS k FROM (SELECT r, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
ranked AS (SELECT r, i, row_number() OVER (PARTITION BY k ORDER BY r, i) AS place FROM wins),
gone AS (SELECT DISTINCT r, j FROM (SELECT r, unnest(range(i, i + 20)) AS j FROM ranked WHERE place > 1)),
words AS (SELECT r, j, w[j] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
left_over AS (
  SELECT words.r, count(*) AS n, string_agg(word, ' ' ORDER BY words.j) AS kept
  FROM words LEFT JOIN gone ON gone.r = words.r AND gone.j = words.j WHERE gone.j IS NULL GROUP BY words.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (r)
"""

ORACLES["op8_license_scan"] = r"""
WITH t AS (
  SELECT license, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\p{L}\p{N}]+') AS w FROM (VALUES
    ('all-rights-reserved', 'All rights reserved.'),
    ('Apache-2.0', 'Licensed under the Apache License, Version 2.0.'),
    ('CC-BY-NC-4.0', 'Licensed under CC BY-NC 4.0.'),
    ('CC-BY-4.0', 'This work is licensed under a Creative Commons Attribution 4.0 International License.'),
    ('GPL-3.0', 'This work is licensed under the GNU General Public License, version 3.'),
    ('MIT', 'Released under the MIT License.'),
    ('MIT-notice', 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files'),
    ('MPL-2.0', 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.')) AS v(license, body)),
sized AS (
  SELECT license, w, k, m, greatest(1, CAST(floor(m / 5) AS BIGINT)) AS stride
  FROM (SELECT license, w, least(5, len(w)) AS k, len(w) - least(5, len(w)) + 1 AS m FROM t)),
ts AS (SELECT DISTINCT license, k, m, stride, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM sized)),
whole AS (SELECT license, count(*) AS n FROM ts GROUP BY license),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\p{L}\p{N}]+') AS w FROM documents),
ds AS (
  SELECT doc_id, k, len(w) - k + 1 AS n_sh, i - 1 AS pos, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM sized) WHERE len(w) >= k)),
hit AS (SELECT doc_id, license, m, stride, n_sh, pos, gram FROM ds JOIN ts USING (k, gram)),
placed AS (
  SELECT DISTINCT doc_id, license, gram, place FROM (
    SELECT *, unnest(range(CAST(ceil(greatest(0, pos - m - stride + 2) / stride) AS BIGINT) * stride, least(pos, greatest(n_sh - m, 0)) + 1, stride)) AS place FROM hit)),
shares AS (SELECT doc_id, license, place, count(*) / any_value(n) AS containment FROM placed JOIN whole USING (license) GROUP BY doc_id, license, place)
SELECT doc_id, license, max(containment) AS containment, count(*) AS n_windows, CAST(min(place) AS INTEGER) AS first_word
FROM shares WHERE containment >= 0.8 GROUP BY doc_id, license
"""

ORACLES["op4_tool_calls"] = r"""
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, conv_id || ':' || turn AS call_id, role, text FROM conversations WHERE role <> 'assistant'),
results AS (
  SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'assistant'),
followed AS (
  SELECT c.*, coalesce(one.call_id, two.call_id) AS after FROM calls c
  LEFT JOIN calls one ON one.conv_id = c.conv_id AND one.turn = c.turn - 1 LEFT JOIN calls two ON two.conv_id = c.conv_id AND two.turn = c.turn - 2),
placed AS (
  SELECT call_id, 0 AS level FROM followed WHERE after IS NULL
  UNION ALL SELECT f.call_id, p.level + 1 FROM followed f JOIN placed p ON f.after = p.call_id),
checked AS (
  SELECT f.*, p.level, r.call_id IS NOT NULL AS answered, r.text AS result,
    CASE WHEN role = 'user' THEN CASE WHEN length(f.text) < 1 THEN 'prompt: too short' WHEN length(f.text) > 300 THEN 'prompt: too long' ELSE '' END
      ELSE concat_ws('; ', CASE WHEN length(f.text) < 1 THEN 'instructions: too short' END, CASE WHEN turn > 0 THEN 'turn: too large' END) END AS errors
  FROM followed f JOIN placed p USING (call_id) LEFT JOIN results r ON r.call_id = f.call_id),
said AS (SELECT *, CASE WHEN errors <> '' THEN 'invalid' WHEN answered THEN 'linked' ELSE 'no result' END AS status FROM checked)
SELECT conv_id, call_id, turn, CAST(level AS BIGINT) AS level, status, errors, CAST(1 AS BIGINT) AS copies,
  '{"arguments":' || CASE WHEN role = 'user' THEN json_object('prompt', text, 'turn', turn) ELSE json_object('instructions', text, 'turn', turn) END
    || ',"id":' || to_json(call_id) || ',"level":' || level || ',"name":' || CASE WHEN role = 'user' THEN '"ask"' ELSE '"configure"' END
    || CASE WHEN answered THEN ',"result":' || to_json(result) ELSE '' END || ',"status":' || to_json(status) || '}' AS json
FROM said
UNION ALL
SELECT conv_id, call_id, NULL, NULL, 'orphan result', '', 1, '{"id":' || to_json(call_id) || ',"result":' || to_json(text) || ',"status":"orphan result"}'
FROM results WHERE call_id NOT IN (SELECT call_id FROM calls)
"""

ORACLES["op11_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
drawn AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM d),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM formed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""


def _vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """One pair of views for each round: the nearest entry of every part, and the entries moved to the means."""
    near = """SELECT r, part, entry, d FROM (SELECT x.r, x.part, c.entry, sum((x.x - c.c) * (x.x - c.c)) AS d FROM x JOIN {c} c ON c.part = x.part AND c.pos = x.pos GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY d, entry) = 1"""
    views = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, embedding AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)",
        f"x AS MATERIALIZED (SELECT r, (i - 1) // w AS part, (i - 1) % w AS pos, CAST(floor(1024 * CAST(e[i] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT r, e, len(e) // {parts} AS w, unnest(range(1, len(e) + 1)) AS i FROM v))",
        f"s AS MATERIALIZED (SELECT r, n - 1 AS entry FROM (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, e) AS n FROM v) WHERE n <= {entries})",
        "c0 AS MATERIALIZED (SELECT part, entry, pos, x AS c FROM x JOIN s USING (r))",
    ]
    for k in range(rounds):
        views += [
            f"a{k} AS MATERIALIZED ({near.format(c=f'c{k}')})",
            f"m{k} AS MATERIALIZED (SELECT a.part, a.entry, x.pos, CAST(floor(sum(x.x) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS c FROM a{k} a JOIN x ON x.r = a.r AND x.part = a.part GROUP BY ALL)",
            f"c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.pos, coalesce(m.c, c.c) AS c FROM c{k} c LEFT JOIN m{k} m ON m.part = c.part AND m.entry = c.entry AND m.pos = c.pos)",
        ]
    views += [
        f"last AS MATERIALIZED ({near.format(c=f'c{rounds}')})",
        "coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY r)",
        f"spelled AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{rounds})",
    ]
    return "WITH " + ",\n".join(views) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN coded USING (r), spelled"""


ORACLES["op12_vector_codes"] = _vector_codes()
