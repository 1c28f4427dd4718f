"""DuckDB SQL for the corpus queries that SQL can state over whole tables."""

from __future__ import annotations

from matchlake.llm.quality import COMMON_WORDS, EVERY, LOWER, MARKS, UPPER

_SPACE = r"[\x20\x09-\x0D]+"
_LISTS = ", ".join(f"('{g}', {words})" for g, words in COMMON_WORDS.items())
_BARE = f"trim(translate(y, '{UPPER}', '{LOWER}'), '{MARKS.replace(chr(39), chr(39) * 2)}')"


def _count(kind: str) -> str:
    """Code points of text in a class."""
    return f"length(text) - length(regexp_replace(text, '[{kind}]', '', 'g'))"


OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ('de', 'en', 'es', 'fr') THEN lang ELSE 'other' END AS g FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> '') AS words FROM d),
f AS (SELECT r, doc_id, g, words, list_transform(words, lambda y: {_BARE}) AS bare, len(words) AS n_words, length(text) AS n_chars, {_count(chr(92) + 'x20' + chr(92) + 'x09-' + chr(92) + 'x0D')} AS spaces, {_count('a-z')} AS lower_, {_count('A-Z')} AS upper_, {_count('0-9')} AS digits,
  {_count('#*$%&|<>')} AS n_symbols, {_count(chr(92) + 'x21-' + chr(92) + 'x2f' + chr(92) + 'x3a-' + chr(92) + 'x40' + chr(92) + 'x5b-' + chr(92) + 'x60' + chr(92) + 'x7b-' + chr(92) + 'x7e')} AS marks,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
g5 AS (SELECT r, i, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT r, words, unnest(range(1, n_words - 3)) AS i FROM f WHERE n_words >= 5)),
twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, gram) AS c FROM g5) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
b AS (SELECT f.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed FROM f LEFT JOIN rep USING (r)),
lists AS (SELECT * FROM (VALUES {_LISTS}, ('other', {EVERY})) t(g, refs)),
h AS (SELECT r, g, base_failed, 'c' AS kind, unnest(range(0, 7)) AS pos, unnest([lower_, spaces, upper_, digits, n_symbols, marks - n_symbols, n_chars - lower_ - spaces - upper_ - digits - marks]) AS n FROM b
  UNION ALL SELECT r, g, base_failed, 'w', unnest(range(0, len(refs))), unnest(list_transform(refs, lambda x: len(list_filter(bare, lambda y: y = x)))) FROM b JOIN lists USING (g)
  UNION ALL SELECT r, g, base_failed, 'w', -1, len(list_filter(bare, lambda y: NOT list_contains({EVERY}, y))) FROM b),
ref AS (SELECT g, kind, pos, sum(n) AS q FROM h WHERE NOT base_failed AND g <> 'other' GROUP BY ALL
  UNION ALL SELECT 'other', kind, pos, sum(n) FROM h WHERE NOT base_failed AND (kind = 'c' OR pos = -1) GROUP BY ALL
  UNION ALL SELECT 'other', 'w', pos, sum(len(list_filter(bare, lambda y: y = x))) FROM b, (SELECT unnest({EVERY}) AS x, unnest(range(0, len({EVERY}))) AS pos) WHERE NOT base_failed GROUP BY pos),
p AS (SELECT r, kind, n / nullif(sum(n) OVER (PARTITION BY r, kind), 0) AS p, q / nullif(sum(q) OVER (PARTITION BY r, kind), 0) AS q FROM h JOIN ref USING (g, kind, pos)),
js AS (SELECT r, kind, sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2))) AS dist FROM p WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY ALL),
j AS (SELECT r, max(CASE WHEN kind = 'c' THEN dist END) AS cd, max(CASE WHEN kind = 'w' THEN dist END) AS wd FROM js GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_chars - spaces AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(n_words >= 50 AND (cd > 0.28 OR wd > 0.60), false) AS kept, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance
FROM b LEFT JOIN j USING (r)"""

OP6 = rf"""
WITH words AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
items AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '{_SPACE}'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
isz AS (SELECT item_id, w, len(w) AS l FROM items WHERE len(w) >= 5),
ish AS (SELECT item_id, l, i, array_to_string(w[i:i + 4], ' ') AS h FROM (SELECT *, unnest(range(1, l - 3)) AS i FROM isz)),
wt AS (SELECT h, 1.0 / count(DISTINCT item_id) AS weight FROM ish GROUP BY h),
own AS (SELECT DISTINCT item_id, l, h, weight FROM ish JOIN wt USING (h)),
mass AS (SELECT item_id, l, sum(weight) AS mass FROM own GROUP BY ALL),
dsh AS (SELECT doc_id, text, len(w) AS n, i, array_to_string(w[i:i + 4], ' ') AS h FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
win AS (SELECT DISTINCT doc_id, text, item_id, l, least(greatest(dsh.i - ish.i, 0), n - l) AS start FROM dsh JOIN ish USING (h) WHERE n >= l),
seen AS (SELECT DISTINCT win.doc_id, win.text, win.item_id, win.l, win.start, dsh.h FROM win JOIN dsh ON dsh.doc_id = win.doc_id AND dsh.text = win.text AND dsh.i - 1 BETWEEN win.start AND win.start + win.l - 5),
sims AS (SELECT doc_id, text, item_id, l, start, coalesce(sum(weight), 0) / (any_value(mass) + count(*) FILTER (weight IS NULL)) AS similarity FROM seen LEFT JOIN own USING (item_id, l, h) JOIN mass USING (item_id, l) GROUP BY ALL)
SELECT doc_id, item_id, round(similarity, 6) AS similarity, CAST(start AS BIGINT) AS start, CAST(l AS BIGINT) AS length
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text, item_id ORDER BY round(similarity, 9) DESC, start) AS nth FROM sims WHERE similarity >= 0.8) WHERE nth = 1"""

OP3 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, h FROM (SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS h FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, len(w) || ' ' || array_to_string(w, ' ') FROM d WHERE len(w) IN (1, 2))),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
s AS (SELECT doc_id, h, n FROM sh JOIN sz USING (doc_id)),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS node, doc_id AS r FROM d UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.node)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id FROM d LEFT JOIN sz USING (doc_id) JOIN (SELECT node AS doc_id, min(r) AS c FROM reach GROUP BY node) USING (doc_id)"""

OP11 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, list_transform(range(0, 4), lambda i: CAST('0x' || substring(x, 8 * i + 1, 8) AS BIGINT)) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
    ELSE '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END) AS output_sha256, sha256(t) AS restored_sha256
FROM c"""


def _value(column: str) -> str:
    """A value as the leaf's digest takes it."""
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen(CAST({column} AS VARCHAR)) || ':' || {column} END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_value(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: The unsigned crc32 of x, a byte after the other and a bit after the other; the polynomial is a fixed value.
_CRC32 = """xor(list_reduce(list_transform(range(1, CAST(length(x) AS BIGINT) + 1), lambda i: CAST(ascii(substring(x, i, 1)) AS BIGINT)),
  lambda c, b: list_reduce(range(0, 8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(c, b)), 4294967295), 4294967295)"""

OP12 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, *, coalesce(CAST(doc_id AS VARCHAR), '') AS x FROM documents),
c AS (SELECT r, doc_id, lang, {_leaf("n_chars")} AS leaf, n_chars + CASE WHEN {_CRC32} % 7 = 0 THEN 1 ELSE 0 END AS told, source, text FROM d),
leaves AS (SELECT r, doc_id, lang, leaf, {_leaf("told")} AS claimed, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM c),
lower_(lang, k, pos, n, h) AS (SELECT lang, 0, pos, n, leaf FROM leaves
  UNION ALL SELECT lang, k + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM lower_ WHERE n > 1 GROUP BY lang, k, pos // 2, n),
subs AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM lower_ WHERE n = 1),
upper_(k, pos, n, h) AS (SELECT 0, pos, n, subroot FROM subs UNION ALL SELECT k + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM upper_ WHERE n > 1 GROUP BY k, pos // 2, n),
steps AS (SELECT leaves.r, l.k, (leaves.pos >> l.k) & 1 AS odd, coalesce(s.h, '') AS h FROM leaves JOIN (SELECT DISTINCT lang, k, n FROM lower_ WHERE n > 1) l ON leaves.lang IS NOT DISTINCT FROM l.lang
    LEFT JOIN lower_ s ON s.lang IS NOT DISTINCT FROM leaves.lang AND s.k = l.k AND s.pos = xor(leaves.pos >> l.k, 1)
  UNION ALL SELECT leaves.r, 1000 + u.k, (subs.pos >> u.k) & 1, coalesce(s.h, '') FROM leaves JOIN subs ON leaves.lang IS NOT DISTINCT FROM subs.lang, (SELECT DISTINCT k, n FROM upper_ WHERE n > 1) u
    LEFT JOIN upper_ s ON s.k = u.k AND s.pos = xor(subs.pos >> u.k, 1)),
path AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY k) AS nth FROM steps),
fold(r, nth, h) AS (SELECT r, 0, claimed FROM leaves UNION ALL SELECT fold.r, fold.nth + 1, sha256(CASE WHEN odd = 1 THEN path.h || fold.h ELSE fold.h || path.h END) FROM fold JOIN path ON path.r = fold.r AND path.nth = fold.nth + 1),
ends AS (SELECT r, arg_max(h, nth) AS folded_root FROM fold GROUP BY r),
proofs AS (SELECT r, string_agg(h, '' ORDER BY nth) AS proof FROM path GROUP BY r),
top AS (SELECT h AS root FROM upper_ WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subs ON leaves.lang IS NOT DISTINCT FROM subs.lang JOIN ends USING (r) LEFT JOIN proofs USING (r), top"""

ORACLES = {"op11_split_offsets": OP11, "op12_proof_push": OP12, "op3_set_relation_skipping": OP3, "op6_simhash_windows": OP6, "op7_distribution_divergence": OP7}
