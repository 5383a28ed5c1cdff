"""SQL that must give the same rows as the prefix trie, the ranked search and the URL filter."""

from __future__ import annotations

from logloom.llm import ranked, trie, urls


def crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a SQL text."""
    bits = "list_transform(range(8), lambda z: 0::BIGINT)"
    byte = f"list_reduce(list_prepend(xor(a, b), {bits}), lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))"
    data = f"list_transform(range(0, length(hex(encode({text}))), 2), lambda i: ('0x' || substr(hex(encode({text})), i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda a, b: {byte}), 4294967295)"


OP11_SQL = rf"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
whole AS (SELECT c, list({{'role': role, 'text': text}} ORDER BY pos) AS l FROM turns GROUP BY c),
shared AS (SELECT c, l, c - c % {trie.GROUP} AS d, {crc32("c::VARCHAR")} % {trie.MOST_SHARED} AS h FROM whole),
rebuilt AS (
  SELECT s.c, list_concat(coalesce(g.l[1:s.h], []), s.l[s.h + 1:]) AS l FROM shared s LEFT JOIN whole g ON g.c = s.d),
members AS (SELECT c, len(l) AS n, unnest(range(0, len(l) + 1)) AS depth, l FROM rebuilt),
prefixed AS (SELECT c, n, depth, l[1:depth] AS p FROM members),
nodes AS (
  SELECT p, depth, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = depth), '')) AS ends_sha256,
    CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(p[depth].text, '[^\x20\x09-\x0D]+')) END AS words
  FROM prefixed GROUP BY p, depth),
kids AS (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
known AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.p = n.p),
above AS (SELECT n_convs, words, n_children, p AS own, unnest(range(0, depth + 1)) AS lv FROM known),
sums AS (
  SELECT own[1:lv] AS p, lv AS depth, sum((n_convs - 1) * words) AS saved, count(*) FILTER (n_children = 0) AS n_leaves FROM above GROUP BY ALL)
SELECT k.conv_id, k.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, k.n_convs::BIGINT AS n_convs, k.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, k.ends_sha256
FROM known k JOIN sums s ON s.depth = k.depth AND s.p = k.p
LEFT JOIN known q ON q.depth = k.depth - 1 AND q.p = k.p[1:k.depth - 1]
"""

_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS row, {_TERMS.format("text")} AS terms FROM documents WHERE text IS NOT NULL),
filled AS (SELECT doc_id, row, terms, len(terms) AS n FROM docs WHERE len(terms) > 0),
whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM filled),
items AS (
  SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM filled)
  WHERE term IN (SELECT term FROM items) GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term),
shares AS (
  SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))) AS share
  FROM tf JOIN df USING (term), whole),
scored AS (
  SELECT item_id, row, doc_id, sum(repeats * share)::BIGINT AS score FROM shares JOIN items USING (term) GROUP BY ALL),
placed AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= {ranked.K}
"""


def _op13_sql() -> str:
    order, micro, step = urls.ORDER, urls.MICRO, urls.STEP
    rules = sorted(urls.RULES, key=lambda r: -len(r.host) - len(r.path))
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in rules]
    case = " ".join(f"WHEN {x} THEN '{{}}'".format(r.host + r.path) for x, r in zip(fits, rules))
    verdict = " ".join(f"WHEN {x} THEN '{r.verdict}'" for x, r in zip(fits, rules))
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    levels = []
    for k in range(order + 1):
        low = f"1.0::DOUBLE / count(*) OVER (PARTITION BY left(s, {k}))"
        levels.append(f"""
s{k} AS (SELECT right(g, {k + 1}) AS s, sum(na) AS na, sum(nr) AS nr FROM counts GROUP BY 1),
w{k} AS (SELECT s, na, nr, sum(na) OVER c AS all_a, sum(nr) OVER c AS all_r, count(*) FILTER (na > 0) OVER c AS kinds_a,
  count(*) FILTER (nr > 0) OVER c AS kinds_r, {low if k == 0 else "NULL"} AS base FROM s{k} WINDOW c AS (PARTITION BY left(s, {k}))),
l{k} AS (SELECT w.*, {"base AS low_a, base AS low_r FROM w0 w" if k == 0 else f"b.pa AS low_a, b.pr AS low_r FROM w{k} w JOIN p{k - 1} b ON b.s = right(w.s, {k})"}),
p{k} AS (SELECT s,
  CASE WHEN all_a + kinds_a > 0 THEN (na + kinds_a * low_a) / (all_a + kinds_a) ELSE low_a END AS pa,
  CASE WHEN all_r + kinds_r > 0 THEN (nr + kinds_r * low_r) / (all_r + kinds_r) ELSE low_r END AS pr FROM l{k})""")
    return f"""
WITH split AS (
  SELECT page_id, url, contains(url, '://') AS found, substr(url, strpos(url, '://') + 3) AS rest FROM pages),
cut AS (SELECT *, CASE WHEN found THEN regexp_extract(rest, '^[^/?#]*') ELSE '' END AS raw FROM split),
placed AS (
  SELECT page_id, {fold.format("coalesce(raw, '')")} AS host,
    CASE WHEN found THEN regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') ELSE '' END AS path,
    CASE WHEN found THEN {fold.format("raw")} || substr(rest, length(raw) + 1) ELSE coalesce(url, '') END AS text FROM cut),
seen AS (SELECT *, CASE {case} END AS rule, CASE {verdict} END AS by_rule FROM placed),
texts AS (
  SELECT text, label, CASE WHEN label = 'judge' THEN 'judge' WHEN {crc32("text")} % {urls.HOLD_OUT} = 0 THEN 'calibrate' ELSE 'train' END AS role
  FROM (SELECT DISTINCT text, coalesce(by_rule, 'judge') AS label FROM seen)),
grams AS (
  SELECT text, label, role, substr(padded, i, {order + 1}) AS g FROM (
    SELECT *, unnest(range(1, length(text) + 2)) AS i, repeat(chr(2), {order}) || text || chr(3) AS padded FROM texts)),
counts AS (SELECT g, count(*) FILTER (role = 'train' AND label = 'allow') AS na, count(*) FILTER (role = 'train' AND label = 'block') AS nr
  FROM grams GROUP BY g),{",".join(levels)},
ratios AS (SELECT s AS g, round((ln(pa) - ln(pr)) * {micro})::BIGINT AS ratio FROM p{order}),
scored AS (
  SELECT text, label, role, floor(sum(ratio)::DOUBLE / count(*))::BIGINT AS score FROM grams JOIN ratios USING (g) WHERE role <> 'train' GROUP BY ALL),
bins AS (
  SELECT greatest(-{urls.BINS}, least({urls.BINS}, floor(score / {step})))::BIGINT AS bin, count(*) FILTER (label = 'allow') AS a,
    count(*) FILTER (label = 'block') AS r FROM scored WHERE role = 'calibrate' GROUP BY 1),
cuts AS (SELECT bin, sum(a) OVER d AS a, sum(r) OVER d AS r, lead(bin) OVER d AS below, sum(a) OVER () AS all_a, sum(r) OVER () AS all_r
  FROM bins WINDOW d AS (ORDER BY bin DESC)),
best AS (SELECT floor((bin + coalesce(below, bin) + 1) / 2) * {step} AS least FROM cuts WHERE all_a > 0 AND all_r > 0
  ORDER BY a * all_r - r * all_a DESC, bin LIMIT 1),
limits AS (SELECT coalesce((SELECT least FROM best), 0) AS least, count(*) FILTER (role = 'train' AND label = 'allow') > 0
  AND count(*) FILTER (role = 'train' AND label = 'block') > 0 AS learnt FROM texts)
SELECT page_id, host, path, rule, CASE WHEN by_rule IS NOT NULL THEN by_rule WHEN NOT learnt OR score >= least THEN 'allow' ELSE 'block' END AS verdict,
  CASE WHEN by_rule IS NULL THEN CASE WHEN learnt THEN score ELSE 0 END END AS score
FROM seen LEFT JOIN (SELECT text AS t, score FROM scored WHERE role = 'judge') j ON by_rule IS NULL AND j.t = seen.text, limits
"""


OP13_SQL = _op13_sql()
