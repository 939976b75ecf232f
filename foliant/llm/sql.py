"""DuckDB SQL of the operators that it can express: the manifest by recursion over levels, contamination by a join of
windows."""

from __future__ import annotations

from .manifest import FANOUT, LOWER, UPPER
from .winnowing import WINDOW

_field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END".format
_low = f"translate(text, '{UPPER}', '{LOWER}')"
#: CRC-32 of a decimal number, bit by bit for a table and byte by byte from it.
_STEPS = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
_CRC = "xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda c, x: xor(steps[xor(c, x) % 256 + 1], c // 256)), 4294967295)"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, leaves: str) -> str:
    """Nodes by level, and what stands around each in its run."""
    return f"""{name} AS (SELECT 0 AS lev, key, pos, n, d FROM {leaves}
    UNION ALL SELECT lev + 1, key, pos // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(d, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY lev, key, pos // {FANOUT}, n),
  {name}_run AS (SELECT lev, key, pos, n, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z
    FROM {name} WINDOW w AS (PARTITION BY lev, key, pos // {FANOUT} ORDER BY pos))"""


def _walk(name: str, tree: str, start: str) -> str:
    """Each document's way up a tree: what its leaf has become, and its siblings so far."""
    return f"""{name} AS (SELECT doc_id, key, 0 AS lev, pos, acc, proof FROM {start}
    UNION ALL SELECT doc_id, key, lev + 1, pos // {FANOUT}, sha256(b || acc || z), proof || b || z FROM {name} JOIN {tree}_run USING (lev, key, pos) WHERE n > 1)"""


MANIFEST = f"""WITH RECURSIVE t AS (SELECT {_STEPS} AS steps),
  l AS (SELECT doc_id, {_leaf('text')} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_leaf(_low)} ELSE {_leaf('text')} END AS acc, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS key,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, leaf AS d, '' AS proof FROM documents, t),
  {_tree('own', 'l')},
  s AS (SELECT key AS source_key, 0 AS key, key AS pos, count(*) OVER () AS n, d FROM own WHERE n = 1),
  {_tree('top', 's')},
  {_walk('way', 'own', 'l')},
  m AS (SELECT doc_id, 0 AS key, w.key AS pos, acc, proof FROM way w JOIN own_run r ON r.lev = w.lev AND r.key = w.key AND r.pos = w.pos WHERE r.n = 1),
  {_walk('over', 'top', 'm')},
  e AS (SELECT doc_id, acc, proof FROM over JOIN top_run USING (lev, key, pos) WHERE n = 1)
  SELECT l.doc_id, l.leaf, s.d AS subroot, r.d AS root, sha256(e.proof) AS proof_sha256, e.acc AS folded_root, e.acc = r.d AS verified FROM l JOIN s ON s.source_key = l.key JOIN e ON e.doc_id = l.doc_id, (SELECT d FROM top WHERE n = 1) r"""


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\\x{{00}}-\\x{{2F}}\\x{{3A}}-\\x{{60}}\\x{{7B}}-\\x{{7F}}]+')"


CONTAMINATION = f"""WITH w AS (SELECT doc_id, {_words('text')} AS words FROM documents),
  b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words('text')} AS words FROM benchmark),
  v AS (SELECT DISTINCT item, n, array_to_string(list_slice(words, i + 1, i + n), ' ') AS win FROM (SELECT item, words, least({WINDOW}, len(words)) AS n, unnest(range(len(words) - least({WINDOW}, len(words)) + 1)) AS i FROM b WHERE len(words) > 0)),
  d AS (SELECT doc_id, i, n, array_to_string(list_slice(words, i + 1, i + n), ' ') AS win FROM (SELECT doc_id, words, n, unnest(range(greatest(len(words) - n + 1, 0))) AS i FROM w, (SELECT DISTINCT n FROM v))),
  h AS (SELECT DISTINCT doc_id, i, n, item FROM d JOIN v USING (n, win)),
  p AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM h) GROUP BY 1),
  g AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
  SELECT w.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM w LEFT JOIN p USING (doc_id) LEFT JOIN g USING (doc_id)"""
