"""Pieces of DuckDB SQL that the oracles of several operators share."""

from passbook.llm.merkle import LOWER, UPPER

#: One row whose ``table`` holds the 256 remainders of crc32 (polynomial 0xEDB88320, a fixed value).
CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])),
  lambda c, k: xor(c >> 1, (c & 1) * 3988292384))) AS remainders)"""


def crc32(text: str) -> str:
    """crc32 of a text of Latin-1 characters in UTF-8; the query has to join the one row of ``crc``."""
    letters = f"list_transform(range(1, length({text}) + 1), lambda p: CAST(unicode(substr({text}, p, 1)) AS BIGINT))"
    octets = f"flatten(list_transform({letters}, lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + (u >> 6), 128 + (u & 63)] END))"
    reduced = f"list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, o: xor(c >> 8, remainders[(xor(c, o) & 255) + 1]))"
    return f"xor({reduced}, 4294967295)"


def lower_ascii(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
lowered AS (SELECT doc_id, {lower_ascii('run')} AS run, count(*) AS times FROM runs WHERE length(run) >= 5 GROUP BY ALL),
labelled AS (SELECT doc_id || ':' || run AS label, run, times FROM lowered),
hashed AS (SELECT run, times, {crc32('label')} AS h FROM labelled, crc),
drawn AS (SELECT times, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM drawn WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM words),
gaps AS (SELECT word, n, place, substr(word, 1, place - 1) || substr(word, place + 1) AS rest FROM places),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.place = b.place AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.rest = w.word
  UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.rest = w.word),
best AS (SELECT word, count(*) AS n_near, min((-other_n, other)) AS first FROM pairs GROUP BY word),
judged AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -first[1] >= 2 * w.n THEN first[2] END AS form,
    CASE WHEN -first[1] >= 2 * w.n THEN -first[1] END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
walk AS (
  SELECT word, word AS root, form AS next FROM judged
  UNION ALL SELECT w.word, j.word, j.form FROM walk w JOIN judged j ON w.next = j.word)
SELECT j.word, j.form, w.root, j.n, CAST(j.n_near AS BIGINT) AS n_near, CAST(j.form_n AS BIGINT) AS form_n
FROM judged j JOIN walk w ON j.word = w.word WHERE w.next IS NULL
"""


def _leaf(text: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({v}) AS VARCHAR) || ':' || {v}, '-')" for v in values) + ")"


def _tree(name: str, begin: str) -> str:
    """Nodes of every level (g, level, i, n, digest), and their runs (g, level, run, kids)."""
    return f"""{name} AS (
  {begin}
  UNION ALL SELECT g, level + 1, i // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY i)) FROM {name}
  WHERE n > 1 GROUP BY g, level, i // 16, n),
{name}_runs AS (SELECT g, level, i // 16 AS run, n, list(digest ORDER BY i) AS kids FROM {name} WHERE n > 1 GROUP BY g, level, i // 16, n)"""


def _climb(name: str, tree: str, begin: str) -> str:
    left, right = "array_to_string(kids[1:w.i % 16], '')", "array_to_string(kids[w.i % 16 + 2:], '')"
    return f"""{name} AS (
  {begin}
  UNION ALL SELECT w.doc_id, w.leaf, w.g, w.level + 1, w.i // 16, w.proof || {left} || {right}, sha256({left} || w.folded || {right})
  FROM {name} w JOIN {tree}_runs r ON w.g = r.g AND w.level = r.level AND w.i // 16 = r.run)"""


OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
named AS (SELECT *, CAST(doc_id AS VARCHAR) AS id_text FROM documents),
marked AS (SELECT *, {crc32('id_text')} % 5 = 0 AS touched FROM named, crc),
found AS (SELECT *, {_leaf('text')} AS leaf, CASE WHEN touched THEN {_leaf(lower_ascii('text'))} ELSE {_leaf('text')} END AS seen FROM marked),
leaves AS (
  SELECT doc_id, leaf, seen, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM found),
{_tree('low', 'SELECT g, 0 AS level, i, n, leaf AS digest FROM leaves')},
subroots AS (SELECT g AS source_no, level, digest AS subroot, count(*) OVER () AS n FROM low WHERE n = 1),
{_tree('high', 'SELECT CAST(0 AS BIGINT) AS g, 0 AS level, source_no AS i, n, subroot AS digest FROM subroots')},
{_climb('up', 'low', "SELECT doc_id, leaf, g, 0 AS level, i, '' AS proof, seen AS folded FROM leaves")},
ends AS (SELECT u.*, s.subroot FROM up u JOIN subroots s ON u.g = s.source_no AND u.level = s.level),
handed AS (SELECT doc_id, leaf || subroot AS leaf, CAST(0 AS BIGINT) AS g, 0 AS level, g AS i, proof, folded FROM ends),
{_climb('top', 'high', 'SELECT * FROM handed')},
roots AS (SELECT level, digest AS root FROM high WHERE n = 1)
SELECT doc_id, substr(leaf, 1, 64) AS leaf, substr(leaf, 65) AS subroot, root, sha256(proof) AS proof_sha256,
  folded AS folded_root, folded = root AS verified
FROM top JOIN roots ON top.level = roots.level
"""
