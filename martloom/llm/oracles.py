"""SQL that gives the rows of a query in DuckDB, where SQL can. Written from what the queries return, not how."""

from __future__ import annotations

from martloom.llm.queries import RULES

# string_split_regex of a text that begins or ends with white space has empty parts
_WORDS = r"list_filter(string_split_regex(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, {_WORDS.format(text=_LOWER.format(text="text"))} AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM words
), classes AS (
  SELECT md5(array_to_string(list_sort(s), chr(10))) AS c, any_value(s) AS s, min(doc_id) AS least FROM sets WHERE len(s) > 0 GROUP BY 1
), tokens AS (
  SELECT c, len(s) AS n, hash(unnest(s)) AS t FROM classes
), pairs AS (
  SELECT a.c AS x, b.c AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.c <> b.c
  GROUP BY a.c, b.c HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT c AS x, c AS y FROM classes UNION SELECT reach.x, pairs.y FROM reach JOIN pairs ON reach.y = pairs.x
), roots AS (
  SELECT reach.x AS c, min(classes.least) AS component_id FROM reach JOIN classes ON classes.c = reach.y GROUP BY 1
), degrees AS (
  SELECT x AS c, count(*) AS n_links FROM pairs GROUP BY 1
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(n_links, 0) AS n_links
FROM sets LEFT JOIN (roots LEFT JOIN degrees USING (c)) roots ON len(s) > 0 AND roots.c = md5(array_to_string(list_sort(s), chr(10)))
"""

SUBSTRINGS = f"""
WITH words AS (
  SELECT doc_id, {_WORDS.format(text="text")} AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)
), repeated AS (
  SELECT doc_id, unnest(range(i, i + 35)) AS k FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)
), gone AS (
  SELECT doc_id, list(DISTINCT k) AS g FROM repeated GROUP BY doc_id
)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN g IS NULL THEN array_to_string(w, ' ')
    ELSE coalesce((SELECT string_agg(w[k], ' ' ORDER BY k) FROM (SELECT unnest(range(1, len(w) + 1)) AS k) WHERE NOT list_contains(g, k)), '') END) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)
"""

EXACT = f"""
WITH norm AS (SELECT doc_id, sha256({_LOWER.format(text="coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM norm WINDOW g AS (PARTITION BY text_sha256)
"""


def _rule_sql(pick: str) -> str:
    """The longest rule that fits: the first of the rules, longest first."""
    cases = []
    for rule in sorted(RULES, key=lambda r: -len(r.text)):
        fits = f"(host = '{rule.host}' OR suffix(host, '.{rule.host}')) AND starts_with(path, '{rule.path}')"
        cases.append(f"WHEN {fits} THEN '{rule.text if pick == 'rule' else rule.verdict}'")
    return f"CASE {' '.join(cases)} END"


_SECOND = "ac|co|com|edu|gov|net|org"
URLS = f"""
WITH parts AS (
  SELECT page_id, position('://' IN url) AS mark, substr(url, position('://' IN url) + 3) AS rest, url FROM pages
), split AS (
  SELECT page_id, CASE WHEN coalesce(mark, 0) = 0 THEN '' ELSE regexp_extract(rest, '^[^?#]*') END AS place FROM parts
), urls AS (
  SELECT page_id, {_LOWER.format(text="split_part(place, '/', 1)")} AS host,
    CASE WHEN position('/' IN place) = 0 THEN '' ELSE substr(place, position('/' IN place)) END AS path
  FROM split
), outcomes AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1
), hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
    regexp_replace(regexp_replace(host, '^.*@', ''), '\\.?(:[0-9]*)?$', '') AS machine
  FROM urls LEFT JOIN outcomes USING (page_id) GROUP BY host
), names AS (
  SELECT *, regexp_matches(machine, '^([0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}|\\[.*\\])$') AS address,
    regexp_matches(machine, '(^|\\.)({_SECOND})\\.[a-z]{{2}}$') AS two
  FROM hosts
), hosts2 AS (
  SELECT host, n, bad, CASE WHEN address THEN machine WHEN two THEN regexp_extract(machine, '([^.]*\\.)?[^.]*\\.[^.]*$') ELSE regexp_extract(machine, '([^.]*\\.)?[^.]*$') END AS domain,
    CASE WHEN address THEN 'ip' WHEN two THEN regexp_extract(machine, '\\.?[^.]*\\.[^.]*$') ELSE regexp_extract(machine, '\\.?[^.]*$') END AS suffix
  FROM names
), overall AS (
  SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) AS p FROM hosts2
), s0 AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT p FROM overall) AS p FROM hosts2 GROUP BY 1
), s1 AS (
  SELECT sum(n * pow(bad / n - p, 2) - p * (1 - p)) / nullif(sum((n - 1) * p * (1 - p)), 0) AS rho FROM s0 WHERE n > 0
), s2 AS (
  SELECT suffix, (bad + (1 / r - 1) * p) / (n + 1 / r - 1) AS m FROM s0, (SELECT coalesce(least(0.5, greatest(0.001, rho)), 0.5) AS r FROM s1)
), d0 AS (
  SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(m) AS p FROM hosts2 JOIN s2 USING (suffix) GROUP BY 1, 2
), d1 AS (
  SELECT sum(n * pow(bad / n - p, 2) - p * (1 - p)) / nullif(sum((n - 1) * p * (1 - p)), 0) AS rho FROM d0 WHERE n > 0
), d2 AS (
  SELECT domain, suffix, (bad + (1 / r - 1) * p) / (n + 1 / r - 1) AS m FROM d0, (SELECT coalesce(least(0.5, greatest(0.001, rho)), 0.5) AS r FROM d1)
), h0 AS (
  SELECT host, n, bad, m AS p FROM hosts2 JOIN d2 USING (domain, suffix)
), h1 AS (
  SELECT sum(n * pow(bad / n - p, 2) - p * (1 - p)) / nullif(sum((n - 1) * p * (1 - p)), 0) AS rho FROM h0 WHERE n > 0
), h2 AS (
  SELECT host, bad + (1 / r - 1) * p AS a, n - bad + (1 / r - 1) * (1 - p) AS b
  FROM h0, (SELECT coalesce(least(0.5, greatest(0.001, rho)), 0.5) AS r FROM h1)
), bounds AS (
  SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM h2
)
SELECT page_id, host, path, {_rule_sql("rule")} AS rule,
  coalesce({_rule_sql("verdict")}, CASE WHEN low > 0.5 AND host <> '' THEN 'block' ELSE 'allow' END) AS verdict
FROM urls JOIN bounds USING (host)
"""

# CRC-32 of the decimal id: eight shifts a character
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def _leaf_sql(n_chars: str) -> str:
    fields = [f"CAST({f} AS VARCHAR)" for f in ("doc_id", "source", "lang", n_chars, "text")]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf_sql("n_chars + 1")} END AS claim FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree
  FROM leaves
), inner_nodes AS (
  SELECT tree, 0 AS level, pos, size, leaf AS node FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 2, (any_value(size) + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM inner_nodes WHERE size > 1 GROUP BY tree, level, pos // 2
), subroots AS (
  SELECT tree, level AS height, node AS subroot, tree - 1 AS pos, count(*) OVER () AS size FROM inner_nodes WHERE size = 1
), outer_nodes AS (
  SELECT 0 AS level, pos, size, subroot AS node FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (any_value(size) + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM outer_nodes WHERE size > 1 GROUP BY level, pos // 2
), steps AS (
  SELECT placed.tree, placed.pos, n.level, n.pos < placed.pos >> n.level AS before, n.node
  FROM placed JOIN inner_nodes n ON n.tree = placed.tree AND n.pos = xor(placed.pos >> n.level, 1)
  UNION ALL
  SELECT placed.tree, placed.pos, s.height + n.level, n.pos < s.pos >> n.level, n.node
  FROM placed JOIN subroots s USING (tree) JOIN outer_nodes n ON n.pos = xor(s.pos >> n.level, 1)
), heights AS (
  SELECT placed.tree, placed.pos, unnest(range(s.height + (SELECT max(level) FROM outer_nodes))) AS level FROM placed JOIN subroots s USING (tree)
), witnesses AS (
  SELECT tree, pos, list(CASE WHEN node IS NULL THEN '' WHEN before THEN 'l' || node ELSE 'r' || node END ORDER BY level) AS w,
    string_agg(node, '' ORDER BY level) AS all_nodes
  FROM heights LEFT JOIN steps USING (tree, pos, level) GROUP BY tree, pos
), folded AS (
  SELECT placed.*, coalesce(all_nodes, '') AS all_nodes,
    list_reduce(list_concat([coalesce(claim, leaf)], coalesce(w, [])), lambda h, s: sha256(CASE WHEN s = '' THEN h WHEN s[1] = 'l' THEN s[2:] || h ELSE h || s[2:] END)) AS folded_root
  FROM placed LEFT JOIN witnesses USING (tree, pos)
)
SELECT doc_id, leaf, subroot, root, sha256(all_nodes) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded JOIN subroots USING (tree), (SELECT node AS root FROM outer_nodes WHERE size = 1)
"""

ORACLES = {
    "op1_ngram_jaccard_join": JACCARD,
    "op2_substring_dedup": SUBSTRINGS,
    "op7_url_reputation": URLS,
    "op9_content_sort_dedup": EXACT,
    "op13_merkle_manifest": MERKLE,
}
