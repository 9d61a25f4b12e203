"""DuckDB SQL of the corpus queries that SQL can express; fixed values come from the operators."""

from . import chat, quality

_WORDS = r"'[^\x20\x09-\x0D]+'"

#: Exact at any size, but a join on all shingles: meant for small tables.
JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS words FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS digest FROM s GROUP BY doc_id),
c AS (SELECT *, min(doc_id) OVER (PARTITION BY digest, n) AS class_id FROM n),
r AS (SELECT class_id, n, shingle FROM c JOIN s USING (doc_id) WHERE doc_id = class_id),
p AS (SELECT a.class_id AS x, b.class_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS i FROM r a JOIN r b ON a.shingle = b.shingle AND a.class_id < b.class_id GROUP BY a.class_id, b.class_id),
l AS (SELECT x, y FROM p WHERE 100 * i >= 85 * (nx + ny - i)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
reach AS (SELECT class_id AS x, class_id AS y FROM c UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y),
k AS (SELECT x AS class_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT w.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(k.component_id, w.doc_id) AS component_id, coalesce(c.class_id, w.doc_id) AS class_id
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN k ON k.class_id = c.class_id
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, l.y FROM reach JOIN l ON l.x = reach.y),
k AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT embeddings.vec_id, (SELECT count(*) FROM l WHERE l.x = embeddings.vec_id) AS n_links, component_id, embeddings.vec_id = component_id AS kept FROM embeddings JOIN k USING (vec_id)
"""

_STOP = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))


def _rule(r: quality.Rule) -> str:
    return f"coalesce(n_words < {r.words} OR {r.numerator}::DOUBLE / nullif({r.denominator}, 0) BETWEEN {r.low} AND {r.high}, true)"


QUALITY = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_WORDS})) AS lines FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
reps AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(reps.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
    len(list_filter(words, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop_words, (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::BIGINT AS n_capitals, (length(t) - length(translate(t, '!', '')))::BIGINT AS n_exclamations
    FROM w LEFT JOIN reps USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {" AND ".join(map(_rule, quality.RULES))} AS kept FROM b
"""

_SAID = "chr(92) || '### Assistant: </turn> ok'"
_LENGTH = f"({len(chat.HEAD) + len(chat.BETWEEN) + len(chat.TAIL)} + length(role) + length(text) + (2 * length(role) + length(text) - length(translate(role, chr(92) || '#<', '')) - length(translate(role, ':', '')) - length(translate(text, chr(92) || '#<', ''))))"

CHAT = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', {_SAID} UNION ALL SELECT -7, 1, 'assistant', {_SAID})),
o AS (SELECT *, {_LENGTH} AS size, row_number() OVER w - 1 AS place, coalesce(sum(len(regexp_extract_all(text, {_WORDS}))) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
s AS (SELECT *, before // {chat.STRIDE} AS span, place = 0 AND role = 'system' AS is_system FROM o),
spans AS (SELECT conv_id, span, min(before) AS begin, min(place) AS first FROM s GROUP BY conv_id, span),
every AS (SELECT conv_id, size FROM s UNION ALL
    SELECT s.conv_id, s.size FROM s JOIN spans ON spans.conv_id = s.conv_id AND spans.span = s.span + 1 AND spans.begin - s.before <= {chat.HISTORY} WHERE NOT s.is_system UNION ALL
    SELECT s.conv_id, s.size FROM s JOIN spans ON spans.conv_id = s.conv_id AND spans.first > 0 WHERE s.is_system),
sizes AS (SELECT conv_id, CAST(sum(size) AS BIGINT) AS formatted_chars FROM every GROUP BY conv_id),
texts AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = '{chat.TARGET}'), '') AS target FROM s GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(target) AS loss_chars, sha256(target) AS loss_sha256, formatted_chars FROM texts JOIN sizes USING (conv_id)
"""

# Bytes and seven zeros each, shifted out bit by bit: crc32 without a table.
CRC32 = "xor(list_reduce(flatten(list_transform(range(1, length({hex}) // 2 + 1), lambda i: [('0x' || substr({hex}, 2 * i - 1, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0])), lambda h, v: CASE WHEN xor(h, v) % 2 = 1 THEN xor(xor(h, v) // 2, 3988292384) ELSE xor(h, v) // 2 END, 4294967295), 4294967295)"


def _cheapest(*ways: str) -> str:
    """The least of texts that begin with a cost of nine digits; null ways don't count."""
    return f"least({', '.join(ways)})"


def _step(state: str, letter: str, cost: str) -> str:
    return f"printf('%09d', left({state}, 9)::BIGINT + {cost}) || substr({state}, 10) || '{letter}'"


# Of each state (w0 nothing, w1 after s, w2 after u, w3 after a) the cheapest way; v: with turns inserted. Costs are fixed values of the contract.
_V2 = _cheapest("w2", *(_step(w, "I", "3") for w in ("w0", "w1", "w3")))
_IN = f"SELECT *, {_cheapest('w3', _step('v2', 'I', '3'))} AS v3 FROM (SELECT *, {_V2} AS v2 FROM {{0}})"
_D = {v: _step(v, "D", "4") for v in ("w0", "w1", "v2", "v3")}
_KEEP = lambda state, initial: f"CASE WHEN NOT gone AND initial = '{initial}' THEN {_step(state, 'K', 'charge')} END"
_RENAME = lambda state: f"CASE WHEN NOT gone THEN {_step(state, 'R', '3 + charge')} END"

REPAIR = rf"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS hex FROM conversations),
hashed AS (SELECT *, {CRC32.format(hex="hex")} % 20 AS k FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM hashed, (SELECT unnest([0, 1]) AS copy) WHERE k <> 0 AND (copy = 0 OR k = 3)),
placed AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM placed),
r AS (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
coded AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS charge FROM r),
walk AS (SELECT DISTINCT conv_id, 0::BIGINT AS n, '000000000' AS w0, '900000000' AS w1, '900000000' AS w2, '900000000' AS w3 FROM r
    UNION ALL SELECT conv_id, n, {_D["w0"]}, {_cheapest(_D["w1"], _KEEP("w0", "s"))}, {_cheapest(_D["v2"], *(_KEEP(v, "u") for v in ("w0", "w1", "v3")), *(_RENAME(v) for v in ("w0", "w1", "v3")))},
        {_cheapest(_D["v3"], _KEEP("v2", "a"), _RENAME("v2"))} FROM ({_IN.format("(SELECT c.*, w0, w1, w2, w3 FROM walk w JOIN coded c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.n + 1)")})),
ends AS (SELECT conv_id, arg_max({_cheapest("w0", "v3")}, n) AS best FROM ({_IN.format("walk")}) GROUP BY conv_id),
audits AS (SELECT conv_id, left(best, 9)::BIGINT AS cost, substr(best, 10) AS audit FROM ends),
ops AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS i, audit[i] AS edit FROM audits),
edits AS (SELECT conv_id, i, edit, length(replace(audit[1:i], 'I', '')) AS n, length(replace(audit[1:i], 'D', '')) AS place, length(replace(audit, 'D', '')) % 2 AS odd FROM ops WHERE edit <> 'D'),
turns AS (SELECT e.conv_id, e.i, CASE WHEN edit = 'K' THEN c.role WHEN (place - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE c.text END AS turn FROM edits e LEFT JOIN coded c ON c.conv_id IS NOT DISTINCT FROM e.conv_id AND c.n = e.n),
said AS (SELECT conv_id, string_agg(turn, chr(10) ORDER BY i) AS whole FROM turns GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
    count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM k.conv_id
"""

SPELLING = rf"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) GROUP BY ALL),
keyed AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hex FROM runs),
hashed AS (SELECT run, n, {CRC32.format(hex="hex")} AS h FROM keyed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS (SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS short FROM places),
masked AS (SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS mask FROM places),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN words b ON b.word = a.short UNION ALL SELECT b.word, a.word, a.n FROM cut a JOIN words b ON b.word = a.short
    UNION ALL SELECT a.word, b.word, b.n FROM masked a JOIN masked b ON a.mask = b.mask AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, min((-other_n, other)) AS best FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 10 * w.n THEN best[2] END AS form, CASE WHEN -best[1] >= 10 * w.n THEN -best[1] END::BIGINT AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS last, 0 AS k FROM words UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON f.word = c.last WHERE f.form IS NOT NULL)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(last, k) AS root FROM chain GROUP BY word) USING (word)
"""
