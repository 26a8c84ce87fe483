"""SQL for DuckDB that gives what the queries give, by plainer ways."""

from __future__ import annotations

from tidefold.llm import chat, licenses

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _escaped(column: str) -> str:
    out = f"replace({column}, '&', '&amp;')"
    for c in chat.CONTROLS:
        entity = dict(chat.ENTITIES)[c[0]]
        out = f"replace({out}, '{c}', '{entity}{c[1:]}')"
    return out


OP1 = f"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
n AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
  FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY i)) AS turns_sha256,
       sum(CASE WHEN r = 'assistant' THEN length(x) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN r = 'assistant' THEN x END, '' ORDER BY i), '')) AS loss_sha256,
       sum({len(chat.OPEN) + 1 + len(chat.CLOSE)} + length(replace({_escaped('r')}, chr(10), '&nl;')) + length({_escaped('x')}))::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""

def _norm(column: str) -> str:
    return rf"string_split(trim(regexp_replace(lower({column}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"


_TEMPLATES = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in licenses.TEMPLATES.items())

OP2 = rf"""
WITH c AS (SELECT template, {_norm('t')} AS w FROM (VALUES {_TEMPLATES}) AS v(template, t)),
cg AS (SELECT template, size, w[i] || ' ' || w[i + 1] AS g, count(*) AS k FROM (SELECT template, w, len(w) - 1 AS size, unnest(generate_series(1, len(w) - 1)) AS i FROM c) GROUP BY ALL),
d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, regexp_split_to_array(text, '\n[ \t\r]*\n') AS blocks FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
u AS (
  SELECT doc_id, generate_subscripts(units, 1) AS unit, unnest(units) AS x
  FROM (SELECT doc_id, list_concat([text], CASE WHEN len(lines) > 1 THEN lines ELSE [] END, CASE WHEN len(blocks) > 1 THEN blocks ELSE [] END) AS units FROM d)),
n AS (SELECT * FROM (SELECT doc_id, unit, {_norm('x')} AS w FROM u) WHERE len(w) > 1 AND len(w) - 1 <= 1.5 * (SELECT max(size) FROM cg)),
ng AS (SELECT doc_id, unit, n, w[i] || ' ' || w[i + 1] AS g, count(*) AS k FROM (SELECT doc_id, unit, w, len(w) - 1 AS n, unnest(generate_series(1, len(w) - 1)) AS i FROM n) GROUP BY ALL),
s AS (SELECT doc_id, unit, template, 2 * sum(least(ng.k, cg.k))::DOUBLE / (n + size) AS dice FROM ng JOIN cg USING (g) GROUP BY doc_id, unit, template, n, size),
b AS (SELECT doc_id, unit, dice, template, row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, template) AS r FROM s WHERE dice >= {licenses.THRESHOLD}::DOUBLE)
SELECT doc_id, template, round(max(dice), 6) AS dice FROM b WHERE r = 1 GROUP BY doc_id, template
"""

OP3 = rf"""
WITH l AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k
  FROM documents),
w AS (SELECT doc_id, k, line, {WORDS.replace('text', 'line')} AS words FROM l),
o AS (SELECT words, min(struct_pack(d := doc_id, k := k)) AS place, len(words) AS n, array_to_string(words, ' ') AS c FROM w WHERE len(words) > 0 GROUP BY words),
v AS (SELECT words, place, n, i, list_concat(words[:i - 1], words[i + 1:]) AS less FROM (SELECT *, unnest(generate_series(1, n)) AS i FROM o WHERE n >= 5)),
vc AS (SELECT words, place, i, substr(c, 1, i - 1) || substr(c, i + 1) AS less FROM (SELECT *, unnest(generate_series(1, length(c))) AS i FROM o WHERE n <= 5 AND length(c) >= 5)),
gone AS (
  SELECT words FROM (SELECT words, place, min(place) OVER (PARTITION BY i, less) AS first FROM v) WHERE first < place
  UNION SELECT v.words FROM v JOIN o ON o.words = v.less WHERE o.place < v.place
  UNION SELECT o.words FROM v JOIN o ON o.words = v.less WHERE v.place < o.place
  UNION SELECT words FROM (SELECT words, place, min(place) OVER (PARTITION BY i, less) AS first FROM vc) WHERE first < place
  UNION SELECT vc.words FROM vc JOIN o ON o.c = vc.less WHERE o.place < vc.place AND o.n <= 5
  UNION SELECT o.words FROM vc JOIN o ON o.c = vc.less WHERE vc.place < o.place AND o.n <= 5),
s AS (
  SELECT w.doc_id, w.k, w.line, len(w.words) > 0 AS worded,
         len(w.words) > 0 AND (o.place <> struct_pack(d := w.doc_id, k := w.k) OR g.words IS NOT NULL) AS removed
  FROM w LEFT JOIN o ON o.words = w.words LEFT JOIN (SELECT DISTINCT words FROM gone) g ON g.words = w.words)
SELECT doc_id, count(*) FILTER (worded) AS n_lines, count(*) FILTER (removed) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT removed), '')) AS kept_sha256
FROM s GROUP BY doc_id
"""

TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

#: Any window of 13 words with 2 substitutions, or one of 8 to 12 as tolerated, has 4 words in a row that agree. Shorter items are found whole.
OP4 = f"""
WITH d AS (SELECT doc_id, {TOKENS} AS words FROM documents),
i AS (SELECT item_id, {TOKENS} AS words FROM benchmark),
b AS (SELECT words, min(item_id) AS item_id, len(words) AS n, least(13, len(words)) AS size FROM i GROUP BY words HAVING len(words) >= 8),
dg AS (SELECT doc_id, p, array_to_string(words[p:p + 3], ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(words) - 3)) AS p FROM d WHERE len(words) >= 4)),
bg AS (SELECT item_id, q, array_to_string(words[q:q + 3], ' ') AS g FROM (SELECT *, unnest(generate_series(1, n - 3)) AS q FROM b)),
h AS (SELECT DISTINCT doc_id, item_id, p - q AS shift FROM dg JOIN bg USING (g)),
x AS (
  SELECT h.doc_id, h.item_id, h.shift, b.size, q, (q + h.shift >= 1 AND d.words[q + h.shift] IS NOT DISTINCT FROM b.words[q])::INT AS same
  FROM (SELECT h.*, unnest(generate_series(1, b.n)) AS q FROM h JOIN b USING (item_id)) h JOIN b USING (item_id) JOIN d USING (doc_id)),
y AS (SELECT *, sum(same) OVER w AS hits, count(*) OVER w AS width FROM x WINDOW w AS (PARTITION BY doc_id, item_id, shift ORDER BY q ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING))
SELECT DISTINCT y.doc_id, i.item_id FROM y JOIN b USING (item_id) JOIN i ON i.words = b.words WHERE width = y.size AND hits >= y.size - CASE WHEN y.size >= 12 THEN 2 ELSE 1 END
UNION SELECT d.doc_id, i.item_id FROM i JOIN d ON contains(' ' || array_to_string(d.words, ' ') || ' ', ' ' || array_to_string(i.words, ' ') || ' ') WHERE len(i.words) BETWEEN 1 AND 7
"""

OP7 = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM (SELECT *, unnest(generate_series(1, len(words) - 34)) AS i FROM w WHERE len(words) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM p) WHERE c > 1),
c AS (SELECT DISTINCT doc_id, i + unnest(range(35)) AS j FROM r),
k AS (
  SELECT u.doc_id, string_agg(u.word, ' ' ORDER BY u.j) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM w) u ANTI JOIN c ON c.doc_id = u.doc_id AND c.j = u.j
  GROUP BY u.doc_id)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, (len(w.words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
