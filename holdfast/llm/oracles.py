"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP2 = """
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
drops AS (
  SELECT line FROM lines WHERE trim(line, ' ') <> ''
  GROUP BY line HAVING count(DISTINCT coalesce('+' || source, '-')) >= 8),
found AS (
  SELECT l.doc_id, list(DISTINCT d.line) AS gone FROM lines l JOIN drops d USING (line) GROUP BY l.doc_id),
kept AS (
  SELECT d.doc_id, d.text, f.gone,
    CASE WHEN f.gone IS NULL THEN d.text
      ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(f.gone, x)), chr(10))
    END AS short
  FROM documents d LEFT JOIN found f USING (doc_id))
SELECT doc_id,
  CAST(len(string_split(text, chr(10))) - CASE WHEN gone IS NULL THEN len(string_split(text, chr(10)))
    ELSE len(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(gone, x))) END AS BIGINT) AS lines_removed,
  CAST(length(short) AS BIGINT) AS n_chars, sha256(short) AS text_sha256
FROM kept
"""

_CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|body|>", "<|end|>", "<|image|>", "<|audio|>", "<|document|>")


def _escaped(column: str) -> str:
    sql = f"replace({column}, '\\', '\\\\')"
    for control in _CONTROL:
        sql = f"replace({sql}, '{control}', '{control[0]}\\-{control[1:]}')"
    return sql


OP3 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
joined AS (
  SELECT conv_id, count(*) AS n,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, {_escaped("text")}) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, ''
      ORDER BY turn NULLS FIRST, role, {_escaped("text")}), '') AS learned,
    sum(length({_escaped("role")}) + length({_escaped("text")}) + length('<|turn|><|body|><|end|>')) AS marked
  FROM turns GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(said) AS turns_sha256,
  CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256,
  CAST(marked + length('<s></s>') AS BIGINT) AS formatted_chars
FROM joined
"""

OP7 = """
WITH said AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
words AS (
  SELECT kind, id, list_filter(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
    lambda w: w <> '') AS w FROM said),
shingles AS (
  SELECT DISTINCT kind, id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)),
    lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s FROM words),
items AS (SELECT id, s, count(*) OVER (PARTITION BY id) AS n FROM shingles WHERE kind = 'i')
SELECT d.id AS doc_id, i.id AS item_id, CAST(any_value(i.n) AS BIGINT) AS n_item, CAST(count(*) AS BIGINT) AS n_shared
FROM shingles d JOIN items i ON d.s = i.s WHERE d.kind = 'd'
GROUP BY d.id, i.id HAVING 100 * count(*) >= 80 * any_value(i.n)
"""

OP9 = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 20
"""

# DuckDB has no crc32: the table of its 256 steps and the step per byte of UTF-8.
_CRC_TABLE = """list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"""

OP12 = f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS steps),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(list_reduce(flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
      lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END)),
    lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) AS h
  FROM each, crc),
said AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM said WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS short FROM words, unnest(range(1, length(word) + 1)) AS t(i)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.short = b.short AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.short = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.short = b.word),
best AS (
  SELECT word, count(*) AS n_near, min((-n, other)) AS best FROM near GROUP BY word),
judged AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN -best[1] >= 2 * w.n THEN best[2] END AS form, CASE WHEN -best[1] >= 2 * w.n THEN -best[1] END AS form_n
  FROM words w LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS at FROM judged
  UNION SELECT k.word, j.form FROM walk k JOIN judged j ON j.word = k.at WHERE j.form IS NOT NULL),
ends AS (SELECT k.word, k.at AS root FROM walk k JOIN judged j ON j.word = k.at WHERE j.form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM judged JOIN ends USING (word)
"""

OP13 = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (
  SELECT lang, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i : i])) AS g FROM words
  UNION ALL SELECT lang, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i : i + 1])) FROM words
  UNION ALL SELECT lang, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i : i + 2])) FROM words),
counts AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY lang, g),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE len(g) = 1 GROUP BY lang),
halves AS (
  SELECT lang, g, f AS a, 1 AS k, g[1 : 1] AS one, g[2 : 3] AS two FROM counts WHERE f >= 10 AND len(g) > 1
  UNION ALL SELECT lang, g, f, 2, g[1 : 2], g[3 : 3] FROM counts WHERE f >= 10 AND len(g) = 3),
cuts AS (
  SELECT h.lang, h.g, a, k, x.f AS l, y.f AS r, (1000000 :: HUGEINT * a * a) // (x.f :: HUGEINT * y.f) AS score
  FROM halves h JOIN counts x ON x.lang = h.lang AND x.g = h.one JOIN counts y ON y.lang = h.lang AND y.g = h.two),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_of AS (
  SELECT lang, unnest([g[1 : 2], g[2 : 3]]) AS g, f FROM counts WHERE len(g) = 3 AND f >= 10),
widest AS (SELECT lang, g, max(f) AS f FROM inner_of GROUP BY lang, g),
kept AS (
  SELECT worst.* FROM worst LEFT JOIN widest i ON i.lang = worst.lang AND i.g = worst.g
  WHERE i.f IS NULL OR 100 * i.f < 50 * a),
ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM kept)
SELECT lang, CAST(row_number() OVER best AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN sizes USING (lang)
WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER best <= 2000
"""

ORACLES = {
    "op2_linededup": OP2,
    "op3_chat": OP3,
    "op7_decontamination": OP7,
    "op9_vectorsearch": OP9,
    "op12_spellings": OP12,
    "op13_collocations": OP13,
}
