"""SQL for DuckDB of those queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import linededup, quality, spelling, topk, yinyang

W = "[^\\x20\\x09-\\x0D]+"
WORDS = "regexp_extract_all({0}, '" + W + "')"


def _plain(pattern: str) -> str:
    return pattern.replace("'", "''")


OP1 = f"""
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.rid AS query, q.vec_id AS query_id, d.rid, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
  FROM e q JOIN e d ON d.rid <> q.rid WHERE q.vec_id % {topk.QUERY_EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST, rid) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= {topk.K}"""

# neighbours share what stands between them, so a second pass finds every other phrase of a row
_PHRASE = f"([^{quality.LETTER}])(?:{quality.PHRASES})([^{quality.LETTER}])"
OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {WORDS.format("text")} AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{W}')) AS lines FROM d),
p AS (SELECT id, unnest(words) AS a, unnest(range(len(words))) AS i FROM w),
x AS (SELECT id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY id ORDER BY i)),
t AS (SELECT id, i, count(*) OVER (PARTITION BY id, a, b, c) AS n FROM x WHERE c IS NOT NULL),
c AS (SELECT id, count(DISTINCT place) AS n_repeat_words FROM (SELECT id, unnest([i, i + 1, i + 2]) AS place FROM t WHERE n > 1) u GROUP BY 1),
l AS (SELECT id, unnest(lines) AS line FROM w),
lw AS (SELECT id, line, {WORDS.format("line")} AS lw FROM l),
lx AS (SELECT *, CASE WHEN len(lw) >= {quality.LONG_LINE} THEN ' ' || lower(line) || ' ' END AS low FROM lw),
ly AS (SELECT *, regexp_replace(regexp_replace(low, '{_plain(_PHRASE)}', '\\1' || chr(1) || '\\2', 'g'), '{_plain(_PHRASE)}', '\\1' || chr(1) || '\\2', 'g') AS rest FROM lx),
lp AS (SELECT *, len(regexp_extract_all(low, '[{quality.LETTER}]+')) - len(regexp_extract_all(rest, '[{quality.LETTER}]+')) AS phrases FROM ly),
k AS (SELECT id, sum(CASE WHEN (CASE WHEN len(lw) >= {quality.LONG_LINE} THEN phrases <= CAST({quality.PHRASE_SHARE} AS DOUBLE) * len(lw) END OR len(lw) < {quality.LONG_LINE} AND regexp_matches(line, '{_plain(quality.CLOSED)}')
      AND NOT regexp_matches(line, '(?i){_plain(quality.MENU)}') AND NOT regexp_matches(line, '(?i){_plain(quality.BOILERPLATE)}'))
    AND NOT (len(list_filter(lw, lambda x: regexp_matches(x, '[#*$%&|<>{{}}]'))) > CAST({quality.SYMBOL_SHARE} AS DOUBLE) * len(lw)
      OR len(list_filter(lw, lambda x: regexp_full_match(x, '[{quality.SEPARATORS}]+'))) > CAST({quality.SYMBOL_SHARE} AS DOUBLE) * len(lw))
    THEN len(lw) ELSE 0 END) AS kept_words FROM lp GROUP BY 1),
m AS (SELECT w.id, doc_id, len(words) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(kept_words, 0) AS BIGINT) AS kept_words
  FROM w LEFT JOIN c ON c.id = w.id LEFT JOIN k ON k.id = w.id),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept_words,
  NOT base_failed AND n_words - kept_words <= CAST({quality.MOST_LOST} AS DOUBLE) * n_words AS kept FROM f"""

_RUN = linededup.RUN_WORDS
OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{W}')) AS lines FROM documents),
l AS (SELECT id, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
n AS (SELECT *, len({WORDS.format("line")}) AS n FROM l),
c AS (SELECT *, sum(n) OVER (PARTITION BY id ORDER BY pos) AS e FROM n),
b AS (SELECT *, e - n AS c FROM c),
w AS (SELECT *, list(line) OVER f AS ahead, max(e) OVER f AS upto, list(line) OVER g AS behind, min(c) OVER g AS since FROM b
  WINDOW f AS (PARTITION BY id ORDER BY c RANGE BETWEEN CURRENT ROW AND {_RUN - 1} FOLLOWING), g AS (PARTITION BY id ORDER BY e RANGE BETWEEN {_RUN - 1} PRECEDING AND CURRENT ROW)),
r AS (SELECT id, doc_id, pos AS a, pos + len(ahead) - 1 AS z, ahead AS run FROM w WHERE upto - c >= {_RUN}
  UNION SELECT id, doc_id, pos - len(behind) + 1, pos, behind FROM w WHERE e - since >= {_RUN}),
t AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS LAST, id, a) AS k FROM r),
gone AS (SELECT DISTINCT id, unnest(range(a, z + 1)) AS pos FROM t WHERE k > 1),
s AS (SELECT l.id, count(*) AS n_lines, count(gone.pos) AS n_removed, coalesce(string_agg(CASE WHEN gone.pos IS NULL THEN line END, chr(10) ORDER BY l.pos), '') AS clean
  FROM l LEFT JOIN gone ON gone.id = l.id AND gone.pos = l.pos GROUP BY 1)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN n_removed > 0 THEN clean ELSE text END AS text
FROM d LEFT JOIN s ON s.id = d.id"""



def _lloyd(rounds: int) -> str:
    """Plain Lloyd, every part against every entry of its codebook."""
    assigned = "a{0} AS MATERIALIZED (SELECT rid, part, any_value(x) AS x, min({{'d': CAST(list_sum(list_transform(x, lambda y, i: (y - c[i]) * (y - c[i]))) AS BIGINT), 'e': entry}}) AS m FROM p JOIN c{0} USING (part) GROUP BY rid, part)"
    moved = """c{1} AS MATERIALIZED (SELECT o.part, o.entry, coalesce(n.c, o.c) AS c FROM c{0} o LEFT JOIN (
      SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM (
        SELECT part, m.e AS entry, j, sum(x[j]) AS s, count(*) AS n FROM (SELECT part, m, x, unnest(range(1, len(x) + 1)) AS j FROM a{0}) GROUP BY ALL) GROUP BY ALL) n ON n.part = o.part AND n.entry = o.entry)"""
    return ",\n".join([*(f"{assigned.format(k)},\n{moved.format(k, k + 1)}" for k in range(rounds)), assigned.format(rounds)])


OP11 = f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({yinyang.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (SELECT rid, part, v[part * len(v) // {yinyang.PARTS} + 1 : (part + 1) * len(v) // {yinyang.PARTS}] AS x FROM e, range({yinyang.PARTS}) r(part)),
f AS (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS entry FROM e),
c0 AS MATERIALIZED (SELECT part, entry, x AS c FROM p JOIN f USING (rid) WHERE entry < {yinyang.ENTRIES}),
{_lloyd(yinyang.ROUNDS)},
s AS (SELECT rid, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{yinyang.ROUNDS} GROUP BY 1),
b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{yinyang.ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN s USING (rid), b"""

_MARK = r"([<\[])(\\*)(s>|/s>|/?SYS\]|/?INST\]|/?ROLE\]|NEXT\]|TURN\])"
OP12 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
w AS (SELECT *, lag(role) OVER o AS before, lead(role) OVER o AS after FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
s AS (SELECT *, length(regexp_replace(text, '{_MARK}', '\\1\\\\\\2\\3', 'g')) + CASE
    WHEN before IS NOT DISTINCT FROM role THEN 6 WHEN role = 'assistant' THEN 0 WHEN role = 'system' THEN 5 WHEN role = 'user' THEN 6 ELSE 12 + length(regexp_replace(role, '{_MARK}', '\\1\\\\\\2\\3', 'g')) END
  + CASE WHEN after IS NOT DISTINCT FROM role THEN 0 WHEN role = 'assistant' THEN 4 WHEN role = 'system' THEN 6 ELSE 7 END AS size FROM w)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS LAST, role, text), '')) AS loss_sha256,
  CAST(3 + sum(size) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id"""

# crc32 is linear: what each byte adds follows from its distance to the end, so the sums are joins with a table of (distance, byte)
_STEP = "xor({0} >> 1, ({0} & 1) * 3988292384)"
OP13 = f"""
WITH RECURSIVE bits(b, k, c) AS (SELECT b, 0, CAST(b AS BIGINT) FROM range(256) r(b) UNION ALL SELECT b, k + 1, {_STEP.format("c")} FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT b, c FROM bits WHERE k = 8),
r AS MATERIALIZED (SELECT doc_id, run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key, count(*) AS times FROM (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{spelling.UPPER}', '{spelling.LOWER}') AS run FROM documents) WHERE length(run) >= {spelling.LENGTH} GROUP BY ALL),
adds(d, b, c) AS (SELECT 0, b, c FROM tab UNION ALL SELECT d + 1, a.b, xor(a.c >> 8, t.c) FROM adds a JOIN tab t ON t.b = a.c & 255 WHERE d < (SELECT max(strlen(key)) FROM r)),
start(d, c) AS (SELECT 0, CAST(4294967295 AS BIGINT) UNION ALL SELECT d + 1, xor(s.c >> 8, t.c) FROM start s JOIN tab t ON t.b = s.c & 255 WHERE d < (SELECT max(strlen(key)) FROM r)),
u AS (SELECT key, any_value(strlen(key)) AS n, any_value(hex(encode(key))) AS h FROM r GROUP BY 1),
y AS (SELECT key, n, unnest(range(n)) AS i, h FROM u),
z AS (SELECT key, any_value(n) AS n, bit_xor(adds.c) AS c FROM y JOIN adds ON adds.d = n - 1 - i AND adds.b = CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) GROUP BY 1),
k AS (SELECT key, xor(xor(z.c, start.c), 4294967295) AS crc FROM z JOIN start ON start.d = z.n),
w AS (SELECT CASE WHEN crc % {spelling.SLIP} = 0 THEN left(run, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, times FROM r JOIN k USING (key)),
v AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM w WHERE length(word) >= {spelling.LENGTH} GROUP BY 1 HAVING sum(times) >= {spelling.SEEN}),
g AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
near AS MATERIALIZED (SELECT a.word, b.word AS other, b.n FROM g a JOIN g b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT g.word, v.word, v.n FROM g JOIN v ON v.word = g.less UNION SELECT v.word, g.word, g.n FROM g JOIN v ON v.word = g.less),
best AS (SELECT word, count(*) AS n_near, min({{'less': -n, 'word': other}}) AS b FROM near GROUP BY 1),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= {spelling.TIMES} * v.n THEN b.word END AS form, CASE WHEN -b.less >= {spelling.TIMES} * v.n THEN -b.less END AS form_n FROM v LEFT JOIN best USING (word)),
way(word, up) AS (SELECT word, word FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.up WHERE f.form IS NOT NULL)
SELECT f.word, f.form, way.up AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM f JOIN way ON way.word = f.word JOIN f last ON last.word = way.up WHERE last.form IS NULL"""

ORACLE_SQL = {"op1_exact_topk": OP1, "op4_quality_rules": OP4, "op10_line_dedup": OP10, "op11_yinyang_codes": OP11, "op12_chat_formatting": OP12, "op13_spelling_variants": OP13}
