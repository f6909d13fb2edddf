"""SQL that gives the rows of the queries where SQL can state them."""

from __future__ import annotations

CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
sized AS (SELECT *, 24 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS n FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""

SUFFIXES = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
pieces AS (SELECT doc_id, len(hx) // 2 AS n, k, substr(hx, 1000 * k + 1, 1098) AS piece
           FROM (SELECT *, unnest(range(0, len(hx) // 1000 + 1)) AS k FROM docs)),
spots AS (SELECT doc_id, n, 500 * k + j + 1 AS s, substr(piece, 2 * j + 1, 100) AS ahead
          FROM (SELECT *, unnest(range(0, 500)) AS j FROM pieces) WHERE 500 * k + j < n),
windows AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY md5(ahead)) AS first FROM spots WHERE s <= n - 49),
cover AS (SELECT doc_id, s, max(CASE WHEN first < doc_id THEN s END) OVER (
            PARTITION BY doc_id ORDER BY s RANGE BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
          FROM (SELECT doc_id, s, first FROM windows
                UNION ALL SELECT doc_id, s, NULL FROM spots WHERE s > n - 49)),
marked AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY s), false) AS opens FROM cover),
kept AS (SELECT m.doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
           string_agg(substr(ahead, 1, 2), '' ORDER BY m.s) FILTER (NOT gone) AS left_over
         FROM marked m JOIN spots p ON p.doc_id = m.doc_id AND p.s = m.s GROUP BY m.doc_id)
SELECT d.doc_id, CAST(len(hx) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(left_over, ''))) AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id"""

WORDS = r"""
WITH docs AS (SELECT doc_id, list_filter(
    string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
"""

SUBSTRINGS = WORDS + """
spots AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS s FROM docs),
windows AS (SELECT doc_id, s, row_number() OVER (
              PARTITION BY md5(array_to_string(ws[s:s + 19], ' ')) ORDER BY doc_id, s) AS nth
            FROM spots WHERE s <= len(ws) - 19),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS s FROM windows WHERE nth > 1),
kept AS (SELECT p.doc_id, count(g.s) AS n_removed,
           string_agg(p.ws[p.s], ' ' ORDER BY p.s) FILTER (g.s IS NULL) AS left_over
         FROM spots p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.s = p.s GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(left_over, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id"""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, n AS size, 8 + length(bin(n)) AS m,
    (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':8'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM (SELECT doc_id, source, CAST(len(list_filter(
          string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n FROM documents)),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM sized GROUP BY source),
-- sources fill up in the order of size per weight: the level is that of the first that does not
filled AS (
  SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST) AS nth, sum(source_size) OVER () AS total,
    coalesce(sum(3 * source_size) OVER up, 0) AS held, sum(w) OVER () - coalesce(sum(w) OVER up, 0) AS open
  FROM sources
  WINDOW up AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT arg_min((total - held)::DOUBLE / open::DOUBLE, nth) FILTER (
    (total - held)::DOUBLE / open::DOUBLE < 3.0::DOUBLE * source_size / w) AS level FROM filled),
targets AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, coalesce(w * level, (3 * source_size)::DOUBLE)) AS target
  FROM sources, levels),
cells AS (SELECT source, m, sum(size) AS x FROM sized WHERE size > 0 GROUP BY source, m),
rated AS (
  SELECT c.source, m, x, target,
    (target - 3 * coalesce(sum(x) OVER (PARTITION BY c.source ORDER BY m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(x * m) OVER (PARTITION BY c.source ORDER BY m DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rate
  FROM cells c JOIN targets t ON t.source IS NOT DISTINCT FROM c.source),
chosen AS (
  SELECT *, max(CASE WHEN rate * m <= 3 THEN {'m': m, 'rate': rate} END) OVER (PARTITION BY source) AS first FROM rated),
expected AS (SELECT *, coalesce(least(3.0::DOUBLE, first.rate * m), 3.0::DOUBLE) AS e FROM chosen),
certain AS (
  SELECT source, m, e, floor(e) AS c, target - sum(CAST(floor(e) AS BIGINT) * x) OVER (PARTITION BY source)::DOUBLE AS rest
  FROM expected),
drawn AS (
  SELECT s.*, e, c, rest, CASE WHEN e > c THEN (u / (1 - u)) / ((e - c) / (1 - (e - c))) END AS q
  FROM sized s LEFT JOIN certain k ON k.source IS NOT DISTINCT FROM s.source AND k.m = s.m),
ranked AS (
  SELECT *, sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER (
    PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum FROM drawn),
counted AS (
  SELECT *, coalesce(CAST(c AS BIGINT), 0) + CASE WHEN q IS NOT NULL AND 2 * cum - size <= 2 * rest THEN 1 ELSE 0 END AS copies FROM ranked)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, c.source, copies
FROM counted c JOIN targets t ON t.source IS NOT DISTINCT FROM c.source"""


def crc32(text: str) -> str:
    """The unsigned crc32 of a text of ASCII and Latin-1 letters' UTF-8 bytes, bit by bit."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT)"
    byte = ("list_reduce(list_prepend(xor(c, b), range(8)), "
            "lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)")
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {byte}), 4294967295)"


PREFIXES = rf"""
WITH own AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
    md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT conv_id, base, key, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, key) AS pos,
    len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM own),
heads AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own)),
turns AS (
  SELECT c.conv_id, 0 AS part, n.pos, n.key, n.words FROM heads c JOIN numbered n ON n.conv_id = c.base AND n.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, n.pos, n.key, n.words FROM heads c JOIN numbered n ON n.conv_id = c.conv_id AND n.pos > c.h),
prefixes AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(key, '') OVER w AS path, words FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, '', 0 FROM heads),
ended AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (
  SELECT conv_id, arg_max(path, depth) AS path FROM prefixes GROUP BY conv_id) GROUP BY path),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved FROM prefixes GROUP BY path, depth),
kids AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
known AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
under AS (SELECT left(path, 32 * up) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved FROM (
  SELECT *, unnest(range(0, depth + 1)) AS up FROM known) GROUP BY ALL)
SELECT k.conv_id, CAST(k.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, k.n_convs, CAST(k.n_children AS BIGINT) AS n_children,
  CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM known k JOIN under u USING (path) LEFT JOIN ended e USING (path)
LEFT JOIN nodes p ON k.depth > 0 AND p.path = left(k.path, 32 * (k.depth - 1))"""

VARIANTS = rf"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{7,}}')) AS run FROM documents),
lowered AS (SELECT translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, id FROM runs),
hashed AS (SELECT run, {crc32("id || ':' || run")} AS h FROM lowered),
noisy AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
v AS MATERIALIZED (SELECT word, count(*) AS n FROM noisy WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, v.word FROM cut JOIN v ON cut.rest = v.word
  UNION SELECT v.word, cut.word FROM cut JOIN v ON cut.rest = v.word),
near AS (SELECT a AS word, count(*) AS n_near, arg_min(b, {{'n': -n, 'w': b}}) AS best, max(n) AS best_n FROM pairs JOIN v ON v.word = b GROUP BY a),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * v.n THEN best END AS form,
    CASE WHEN best_n >= 10 * v.n THEN best_n END AS form_n FROM v LEFT JOIN near USING (word)),
way AS (SELECT word, form, 1 AS step FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT way.word, forms.form, step + 1 FROM way JOIN forms ON forms.word = way.form WHERE forms.form IS NOT NULL),
ends AS (SELECT word, arg_max(form, step) AS root FROM way GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)"""
