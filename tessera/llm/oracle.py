"""SQL for DuckDB that returns the same rows as the queries, where SQL can express them."""

from __future__ import annotations

from .quality import BOILERPLATE, SEPARATORS, Rules
from .queries import SHARDS
from .sharding import SLOTS, lookup_table

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = rf"""
WITH sized AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INT)] AS DOUBLE) AS w, 3 * source_size AS cap FROM src),
lv AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level, row_number() OVER (ORDER BY cap / w, source ASC NULLS LAST) AS k
  FROM w WINDOW o AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
top AS (SELECT min(k) AS k FROM lv WHERE cap > w * level),
plan AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(w * (SELECT level FROM lv JOIN top USING (k)), 0.0)) AS target FROM lv),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS r,
    CAST(CAST('0x' || substr(md5('17:' || coalesce(source, '')), 1, 5) AS BIGINT) AS DOUBLE) / 1048576.0 AS u FROM plan),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) - 1 AS DOUBLE) AS k FROM sized)
SELECT doc_id, size, source_size, target, CAST(least(floor(u + r * (k + 1)) - floor(u + r * k), ceil(r)) AS BIGINT) * size AS taken
FROM ranked JOIN r ON ranked.source IS NOT DISTINCT FROM r.source
"""


OP7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT w.doc_id, CAST(count(s) AS BIGINT) AS n FROM w LEFT JOIN sh USING (doc_id) GROUP BY w.doc_id),
k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""


#: The tables hold turns alone, no tool calls; each user's turn is a call to the assistant.
OP4 = r"""
WITH u AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id, turn),
a AS (SELECT conv_id, turn - 1 AS turn, min(text) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn)
SELECT u.conv_id, CAST(u.turn AS VARCHAR) AS call_id, u.turn, 0 AS item, 0 AS level, 'respond' AS name, a.turn IS NOT NULL AS is_linked, false AS is_repeat, CAST(NULL AS VARCHAR) AS problem,
  '{"arguments":{' || CASE WHEN u.turn >= 2 THEN '"after":{"$ref":"' || CAST(u.turn - 2 AS VARCHAR) || '"},' ELSE '' END || '"prompt":' || CAST(to_json(u.text) AS VARCHAR) || '},"id":"' || CAST(u.turn AS VARCHAR) || '","name":"respond","result":' || coalesce(CAST(to_json(a.text) AS VARCHAR), 'null') || '}' AS record
FROM u LEFT JOIN a ON u.conv_id = a.conv_id AND u.turn = a.turn
"""

OP6 = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t WHERE len(w) >= 50)),
first AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (h) WHERE first < doc_id),
lost AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id),
each AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM t),
kept AS (SELECT each.doc_id, sha256(string_agg(x, ' ' ORDER BY p)) AS s FROM each ANTI JOIN gone ON each.doc_id = gone.doc_id AND each.p = gone.p GROUP BY each.doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed, coalesce(kept.s, sha256('')) AS kept_sha256
FROM t LEFT JOIN lost ON t.doc_id = lost.doc_id LEFT JOIN kept ON t.doc_id = kept.doc_id
"""

_R = Rules()
_PHRASES = "|".join(BOILERPLATE)
OP3 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
twice AS (SELECT doc_id, s FROM win GROUP BY doc_id, s HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS p FROM win JOIN twice USING (doc_id, s)),
rep AS (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id),
lines AS (SELECT doc_id, line, {WORDS.replace("coalesce(text, '')", "line")} AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)),
n_lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS k FROM lines WHERE len(w) > 0 GROUP BY doc_id),
first AS (SELECT DISTINCT doc_id, line, w FROM lines WHERE len(w) > 0),
judged AS (SELECT doc_id, length(array_to_string(w, '')) AS chars,
    len(regexp_extract_all(line, '[#*$%&<>]')) > len(w) * {_R.max_symbols}
    OR len(regexp_extract_all(line, '!')) > greatest(1.0, len(w) * {_R.max_shouts})
    OR (n > 1 AND len(w) < {_R.min_open_words} AND NOT regexp_matches(line, '[.!?:;,…。！？"''”’)\]][\x20\x09-\x0D]*$'))
    OR (len(regexp_extract_all(line, '[{SEPARATORS}]')) >= greatest(2, len(w) * {_R.max_separators}))
    OR (len(w) >= 10 AND len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) >= len(w) * {_R.max_stutter})
    OR (regexp_matches(lower(line), '{_PHRASES}') AND (len(w) <= {_R.short_line} OR length(lower(line)) - length(regexp_replace(lower(line), '{_PHRASES}', '', 'g')) >= length(lower(line)) * {_R.min_phrases})) AS fails
  FROM first JOIN n_lines USING (doc_id)),
good AS (SELECT doc_id, count(*) AS n, sum(chars) AS chars FROM judged WHERE NOT fails GROUP BY doc_id),
b AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(coalesce(l.n - l.k, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(l.n, 0) - coalesce(good.n, 0) AS BIGINT) AS lines_dropped, CAST(coalesce(good.chars, 0) AS BIGINT) AS kept_chars
  FROM t LEFT JOIN rep USING (doc_id) LEFT JOIN n_lines l USING (doc_id) LEFT JOIN good USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND kept_chars >= word_chars * {_R.min_kept} AS kept FROM b
"""

#: The lookup table stands in the SQL as its rule gives it (held against a plain version in the tests); SQL finds each row's slot in it.
OP5 = """
WITH o AS (SELECT [{owners}] AS owner),
s AS (SELECT doc_id, n_chars, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) % {slots} AS BIGINT) AS slot FROM documents)
SELECT doc_id, n_chars, slot, 'shard-' || lpad(CAST(owner[slot + 1] AS VARCHAR), 3, '0') AS shard FROM s, o
"""


def oracle_sql() -> dict[str, str]:
    op5 = OP5.format(owners=",".join(map(str, lookup_table(SHARDS))), slots=SLOTS)
    return {"op2_mix": OP2, "op3_quality": OP3, "op5_sharding": op5, "op4_chat": OP4, "op6_substring": OP6, "op7_neardup": OP7}
