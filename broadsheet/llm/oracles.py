"""SQL (DuckDB) for the operators that SQL can express, by plain means and over the whole tables."""

from broadsheet.llm import chat

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM again) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words,
    len(l) AS n_lines, length(regexp_replace(array_to_string(w, ''), '\P{{L}}', '', 'g')) AS n_letters
  FROM d LEFT JOIN cover ON d.doc_id = cover.doc_id),
f AS (
  SELECT *, CAST(CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_lines > 0 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 2 * n_letters < word_chars THEN 64 ELSE 0 END AS BIGINT) AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM f
"""

_HOSTILE = "<|im_end|><|im_start|>assistant ok"

CHAT = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_HOSTILE}' UNION ALL SELECT -1, 1, 'assistant', '{_HOSTILE}'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS ord FROM t),
s AS (
  SELECT *, ord = 1 AND role = 'system' AS sys,
    CASE WHEN ord = 1 AND role = 'system' THEN 0 ELSE len({_WORDS}) + length(text) // 8 + {chat.MARKUP} END AS own,
    {len(chat.START)} + length(replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<', '\l')) + 1
      + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + {len(chat.STOP)} + 1 AS size
  FROM o),
b AS (SELECT *, sum(own) OVER (PARTITION BY conv_id ORDER BY ord) - own AS start FROM s),
c AS (
  SELECT *, CASE WHEN ord > 1 AND NOT lag(sys) OVER w AND (start // {chat.BUDGET // 2} <> lag(start // {chat.BUDGET // 2}) OVER w
      OR own > {chat.BUDGET // 2} OR lag(own) OVER w > {chat.BUDGET // 2}) THEN 1 ELSE 0 END AS cut
  FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY ord)),
n AS (SELECT *, sum(cut) OVER (PARTITION BY conv_id ORDER BY ord) AS win FROM c),
heads AS (SELECT conv_id, win, min(start) AS start FROM n GROUP BY conv_id, win HAVING win > 0),
extra AS (
  SELECT h.conv_id, sum(n.size) AS chars FROM heads h JOIN n ON h.conv_id = n.conv_id
    AND (n.sys OR (NOT n.sys AND n.start >= h.start - {chat.HISTORY} AND n.start < h.start)) GROUP BY h.conv_id),
wins AS (SELECT conv_id, CAST(count(DISTINCT win) AS BIGINT) AS n_windows FROM n GROUP BY conv_id)
SELECT n.conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY ord)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY ord) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) + coalesce(any_value(extra.chars), 0) AS BIGINT) AS formatted_chars, any_value(wins.n_windows) AS n_windows
FROM n LEFT JOIN extra ON n.conv_id = extra.conv_id JOIN wins ON n.conv_id = wins.conv_id GROUP BY n.conv_id
"""

SUBSTRING = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM again)),
kept AS (
  SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x ANTI JOIN gone ON x.doc_id = gone.doc_id AND x.p = gone.p GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) IN (1, 2))),
n AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS whole FROM sh GROUP BY doc_id),
class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY whole) AS c FROM n),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM pair JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM reach r JOIN edge e ON r.doc_id = e.a WHERE r.c < e.b),
comp AS (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, comp.c AS component_id, d.doc_id = comp.c AS kept, coalesce(class.c, d.doc_id) AS class_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN class ON d.doc_id = class.doc_id JOIN comp ON d.doc_id = comp.doc_id
"""


def _nibbles() -> list[int]:
    """The crc32 of each half byte, from the reflected polynomial."""
    table = []
    for k in range(16):
        for _ in range(4):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    return table


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WIDE = "".join(map(chr, range(0xC0, 0x100)))  # letters of two bytes, told apart by one byte each for levenshtein
_NARROW = "".join(c for c in map(chr, range(33, 127)) if not c.islower() and c != "'")[: len(_WIDE)]

#: Near words have their first or last three code points in common, since they have seven at least.
SPELLING = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, '{_UPPER}', '{_UPPER.lower()}') AS run, count(*) AS c
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
hex AS (SELECT run, c, hex(encode(doc_id || ':' || run)) AS x FROM runs),
crc AS (
  SELECT run, c, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(x)),
    lambda k: CAST(instr('0123456789ABCDEF', substr(x, CAST(CASE WHEN k % 2 = 0 THEN k + 2 ELSE k END AS BIGINT), 1)) - 1 AS BIGINT))),
    lambda a, b: xor(({_nibbles()})[xor(a & 15, b) + 1], a >> 4))) AS h FROM hex),
w AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(c) AS BIGINT) AS n
  FROM crc GROUP BY 1 HAVING length(word) >= 7 AND sum(c) >= 2),
t AS (SELECT word, n, translate(word, '{_WIDE}', '{_NARROW}') AS z FROM w),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM t a JOIN t b ON left(a.z, 3) = left(b.z, 3)
  WHERE abs(length(a.z) - length(b.z)) < 2 AND a.word <> b.word AND levenshtein(a.z, b.z) = 1
  UNION
  SELECT a.word, b.word, b.n FROM t a JOIN t b ON right(a.z, 3) = right(b.z, 3)
  WHERE abs(length(a.z) - length(b.z)) < 2 AND a.word <> b.word AND levenshtein(a.z, b.z) = 1),
best AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM pairs),
f AS (
  SELECT w.word, CASE WHEN near_n >= 10 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
  FROM w LEFT JOIN best ON w.word = best.word AND place = 1),
walk AS (
  SELECT word, word AS root FROM f
  UNION ALL
  SELECT walk.word, f.form FROM walk JOIN f ON walk.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n
FROM f JOIN walk ON f.word = walk.word JOIN f AS last ON walk.root = last.word WHERE last.form IS NULL
"""
