"""SQL that states the results of queries of this subpackage, where SQL can."""

from __future__ import annotations

from stratlas.llm import quality, url_rules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _low(x: str) -> str:
    return f"translate(coalesce({x}, ''), '{_UPPER}', '{_LOWER}')"


LICENSE_BASE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_low('text')}, '{ALNUM}') AS w FROM documents),
phrases(words, label) AS (VALUES (['cc', 'by'], 'cc-by'), (['general', 'public', 'license'], 'gpl'), (['all', 'rights', 'reserved'], 'reserved')),
h AS (SELECT doc_id, i - 1 AS first, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), phrases WHERE w[i : i + len(words) - 1] = words),
c AS (SELECT doc_id, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM d LEFT JOIN c USING (doc_id)
"""

OP6 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), r AS (
  SELECT *, contains(text, '</turn>' || chr(10)) AS esc FROM t
), s AS (
  SELECT *, 6 + length(role) + CASE WHEN esc THEN 6 ELSE 2 END + CASE WHEN esc THEN length(replace(replace(text, '\', '\s'), '<', '\l')) ELSE length(text) END + 8 AS shown FROM r
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(shown) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""

OP7 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_low('text')}, '{ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_low('text')}, '{ALNUM}') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
h AS (SELECT doc_id, n, i, item_id FROM x JOIN p USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, n, i FROM h)) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""

#: Fine on the smaller tables; pairs of documents that share a shingle grow too fast for larger ones.
OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_low('text')}, '{SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(g) AS g FROM (SELECT doc_id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d) UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT both_.b AS doc_id, r.root FROM r JOIN both_ ON r.doc_id = both_.a)
SELECT doc_id, coalesce(max(n.n), 0) AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


def _mask() -> str:
    return " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(quality.RULES.values()))


#: One row per document with all measurements of the rules, and from them the bits of the rules it fails.
_LEDGER = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS m FROM g), range(3) r(k) WHERE m > 1 GROUP BY doc_id),
l AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{SPACED}')),
k AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (regexp_matches(line, '^[ \t]*([-*\x{{2022}}\x{{B7}}\x{{25AA}}\x{{25BA}}\x{{2013}}]|[0-9]+[.)])[ \t]')) AS n_bullets,
    count(*) FILTER (regexp_matches(line, '(\x{{2026}}|\.\.\.)[ \t\r]*$')) AS n_ellipses FROM l GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    length(t) - length(translate(t, '{_UPPER}', '')) AS n_upper, length(t) - length(translate(t, '{_LOWER}', '')) AS n_lower, length(t) - length(replace(t, '!', '')) AS n_exclaim,
    len(list_distinct(w)) AS n_distinct, len(list_filter(w, lambda x: regexp_full_match(x, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS n_bare,
    length(t) - length(translate(t, '0123456789', '')) AS n_digits, length(t) - length(regexp_replace(t, '[A-Za-z]|[^\x00-\x7F]', '', 'g')) AS n_letters, length(t) - length(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) AS n_foreign,
    len(list_intersect(w, [{', '.join(f"'{x}'" for x in quality.COMMON)}])) AS n_stop, coalesce(n_bullets, 0) AS n_bullets, coalesce(n_ellipses, 0) AS n_ellipses,
    (length(t) - length(replace(t, '://', ''))) // 3 AS n_links, length(t) - length(translate(t, '{{}}', '')) AS n_braces, CAST(contains(t, 'orem ipsum dolor') AS BIGINT) AS n_lorem,
    length(t) - length(replace(t, chr(65533), '')) AS n_broken, len(list_filter(w, lambda x: length(x) >= 40)) AS n_long, length(t) - length(regexp_replace(t, '[\x00-\x08\x0E-\x1F\x7F]', '', 'g')) AS n_controls
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
), f AS (SELECT *, CAST({_mask()} AS BIGINT) AS fail_mask FROM m)
"""

OP10 = f"""{_LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_mask & {quality.BASE} <> 0 AS base_failed, fail_mask & {quality.POLICIES[quality.NEWEST]} = 0 AS kept, fail_mask FROM f
"""

#: Of each rule: documents that fail it, and those that only it rejects, counted over documents.
ABLATION = f"""{_LEDGER}
SELECT rule, CAST(count(*) FILTER (fail_mask & bit <> 0) AS BIGINT) AS failed, CAST(count(*) FILTER (fail_mask = bit) AS BIGINT) AS failed_alone
FROM f, (VALUES {', '.join(f"('{k}', {1 << i})" for i, k in enumerate(quality.RULES))}) r(rule, bit) GROUP BY rule
"""


def _words(lists) -> str:
    return "[" + ", ".join(f"'{w}'" for w in lists) + "]"


def _every(families: dict[str, str]) -> list[str]:
    return sorted({w for words in families.values() for w in words.split()})


#: The rule families by string functions: words of the host, its labels, its end and its start, folders and the last name of the path.
OP3 = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, string_split(string_split(rest, '?')[1], '#')[1] AS rest FROM rest
), parts AS (
  SELECT page_id, translate(string_split(rest, '/')[1], '{_UPPER}', '{_LOWER}') AS host, substr(rest, length(string_split(rest, '/')[1]) + 1) AS path FROM cut
), sites(name, verdict) AS (VALUES ('com/en/', 'block'), ('example.com/en/7', 'allow'), ('net/de/', 'allow'), ('example.net/de/8', 'block'), ('org/es/', 'block')
), fits AS (
  SELECT page_id, arg_max(name, length(name)) AS rule, arg_max(s.verdict, length(name)) AS verdict FROM parts, sites s
  WHERE (host = string_split(name, '/')[1] OR ends_with(host, '.' || string_split(name, '/')[1])) AND starts_with(path, substr(name, instr(name, '/'))) GROUP BY page_id
), read AS (
  SELECT page_id, host, path, regexp_extract_all(host, '[a-z0-9]+') AS words, string_split(string_split(host, ':')[1], '.') AS labels, string_split(path, '/') AS folders FROM parts
), judged AS (
  SELECT *, list_has_any(words, {_words(_every(url_rules.HOST_WORDS))})
    OR list_has_any(labels, {_words(url_rules.HOST_PAIRS)})
    OR len(labels) > 1 AND list_contains({_words(url_rules.TOPS)}, labels[-1])
    OR len(labels) > 1 AND list_contains({_words(url_rules.SERVERS)}, labels[1])
    OR list_has_any(folders[2:], {_words(_every(url_rules.FOLDERS))})
    OR len(folders) > 1 AND list_contains({_words(url_rules.FILES)}, folders[-1])
    OR list_has_any(list_transform(string_split(host, '-')[:-2], lambda x: regexp_extract(x, '[a-z0-9]+$')), ['secure', 'verify']) AND contains(path, '/login/verify')
    OR len(folders) > 1 AND list_has_any(folders[2:], ['admin', 'login', 'setup']) AND len(string_split(host, '.')) = 4 AND NOT list_contains(string_split(host, '.'), '') AND translate(host, '0123456789.', '') = '' AS blocked FROM read
)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN verdict WHEN blocked THEN 'block' ELSE 'allow' END AS verdict FROM judged LEFT JOIN fits USING (page_id)
"""

OP11 = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM t JOIN g USING (t)
"""


def _field(x: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({x} AS VARCHAR))) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"


def _tree(name: str, leaves: str) -> str:
    """Tables: name (t, lv, pos, node, c) of all levels of the trees t over the leaves (t, pos, node), c nodes in a level."""
    return f"""{name}_ AS (SELECT t, 0 AS lv, pos, node, count(*) OVER (PARTITION BY t) AS c FROM {leaves}
  UNION ALL SELECT t, lv + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), any_value((c + 1) // 2) FROM {name}_ WHERE c > 1 GROUP BY t, lv, pos // 2),
{name} AS (SELECT x.t, x.lv, x.pos, s.node AS sibling FROM {name}_ x LEFT JOIN {name}_ s ON s.t = x.t AND s.lv = x.lv AND s.pos = xor(x.pos, 1) WHERE x.c > 1)"""


OP12 = f"""
WITH RECURSIVE bytes AS (SELECT CAST(b AS BIGINT) AS b, CAST(b AS BIGINT) AS v, 0 AS k FROM range(256) r(b) UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bytes WHERE k < 8),
crc AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 1 AS i, CAST(4294967295 AS BIGINT) AS v FROM documents
  UNION ALL SELECT doc_id, s, i + 1, xor(bytes.v, crc.v >> 8) FROM crc JOIN bytes ON bytes.k = 8 AND bytes.b = xor(crc.v, ascii(substr(s, i, 1))) & 255 WHERE i <= length(s)),
tampered AS (SELECT doc_id FROM crc WHERE i = length(s) + 1 AND xor(v, 4294967295) % 7 = 0),
d AS (SELECT doc_id, coalesce('=' || lang, '') AS t, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos,
  sha256({_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field('n_chars')} || {_field('text')}) AS node,
  sha256({_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field('(n_chars + 1)')} || {_field('text')}) AS other FROM documents),
{_tree('low', 'd')},
tops AS (SELECT '' AS t, t AS k, row_number() OVER (ORDER BY t) - 1 AS pos, node FROM low_ WHERE c = 1),
{_tree('high', 'tops')},
start AS (SELECT doc_id, t, pos, node AS leaf, CASE WHEN doc_id IN (FROM tampered) THEN other ELSE node END AS folded FROM d),
up AS (SELECT doc_id, t, 0 AS lv, pos, folded, '' AS proof FROM start
  UNION ALL SELECT doc_id, up.t, up.lv + 1, up.pos // 2, sha256(CASE WHEN up.pos % 2 = 1 THEN coalesce(sibling, '') || folded ELSE folded || coalesce(sibling, '') END), proof || coalesce(sibling, '') FROM up JOIN low ON low.t = up.t AND low.lv = up.lv AND low.pos = up.pos),
most AS (SELECT doc_id, arg_max(folded, lv) AS folded, arg_max(proof, lv) AS proof FROM up GROUP BY doc_id),
over_ AS (SELECT doc_id, 0 AS lv, tops.pos, most.folded, most.proof FROM most JOIN start USING (doc_id) JOIN tops ON tops.k = start.t
  UNION ALL SELECT doc_id, over_.lv + 1, over_.pos // 2, sha256(CASE WHEN over_.pos % 2 = 1 THEN coalesce(sibling, '') || folded ELSE folded || coalesce(sibling, '') END), proof || coalesce(sibling, '') FROM over_ JOIN high ON high.lv = over_.lv AND high.pos = over_.pos),
done AS (SELECT doc_id, arg_max(folded, lv) AS folded_root, sha256(arg_max(proof, lv)) AS proof_sha256 FROM over_ GROUP BY doc_id)
SELECT doc_id, leaf, tops.node AS subroot, r.node AS root, proof_sha256, folded_root, folded_root = r.node AS verified
FROM start JOIN tops ON tops.k = start.t JOIN done USING (doc_id), (SELECT node FROM high_ WHERE c = 1) r
"""

#: Counts of all phrases of one to five words, and every cut of the frequent ones.
OP13 = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_low('text')}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
w AS (SELECT lang, p, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT lang, row_number() OVER () AS p, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM p)),
v AS (SELECT lang, w AS w0, {', '.join(f'lead(w, {k}) OVER (PARTITION BY p ORDER BY i) AS w{k}' for k in range(1, 5))} FROM w),
g AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM ({' UNION ALL '.join(f"SELECT lang, {k + 1} AS k, {(" || ' ' || ").join(f'w{j}' for j in range(k + 1))} AS phrase FROM v WHERE w{k} IS NOT NULL" for k in range(5))}) GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM g WHERE f >= 100 AND k > 1),
i AS (SELECT lang || chr(10) || phrase AS id, f FROM g),
x AS (SELECT c.lang, c.k, phrase, c.f AS a, j, array_to_string(string_split(phrase, ' ')[:j], ' ') AS first, array_to_string(string_split(phrase, ' ')[j + 1 :], ' ') AS last FROM c, range(1, 5) r(j) WHERE j < c.k),
s AS (SELECT x.*, p.f AS l, q.f AS r, n, CAST((1000::HUGEINT * a * n) // (p.f::HUGEINT * q.f) AS BIGINT) AS score FROM x JOIN t USING (lang) JOIN i p ON p.id = lang || chr(10) || first JOIN i q ON q.id = lang || chr(10) || last),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
k AS (SELECT * FROM b WHERE NOT EXISTS (FROM c WHERE c.lang = b.lang AND c.k > b.k AND 100 * c.f >= 100 * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM k QUALIFY rank <= 2000
"""

ORACLES = {
    "op3_url_filters": OP3,
    "op6_chat_formatting": OP6,
    "op7_benchmark_decontamination": OP7,
    "op9_minhash_near_dedup": OP9,
    "op10_quality_rules": OP10,
    "op11_exact_dedup": OP11,
    "op12_merkle_manifest": OP12,
    "op13_phrase_collocations": OP13,
    "quality_rule_ablation": ABLATION,
    "license_base_places": LICENSE_BASE,
}
