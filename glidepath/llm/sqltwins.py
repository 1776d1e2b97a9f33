"""SQL twins of the operators that SQL can state, for the small tables of the tests."""

from __future__ import annotations

OP13 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


def _value(x: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({x} AS VARCHAR))) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_value(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: CRC-32 by bits, reflected polynomial 0xEDB88320, over the digits of doc_id.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda ch: CAST(ord(ch) AS UBIGINT))), lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: xor(c >> 1, (c & 1) * 3988292384))))"""

OP12 = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, source, {_leaf('text')} AS leaf,
           CASE WHEN {_CRC} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS altered
    FROM documents),
placed AS (
    SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
    FROM leaves),
low AS (
    SELECT 0 AS level, tree, idx, n, leaf AS digest FROM placed
    UNION ALL
    SELECT any_value(level) + 1, tree, idx // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY idx))
    FROM low WHERE n > 1 GROUP BY tree, idx // 3),
subroots AS (SELECT tree, level AS height, digest FROM low WHERE n = 1),
high AS (
    SELECT 0 AS level, tree AS idx, (SELECT count(*) FROM subroots) AS n, digest FROM subroots
    UNION ALL
    SELECT any_value(level) + 1, idx // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY idx))
    FROM high WHERE n > 1 GROUP BY idx // 3),
root AS (SELECT digest AS root FROM high WHERE n = 1),
spots AS (
    SELECT p.doc_id, p.tree, p.idx, p.leaf, p.altered, s.height, s.digest AS subroot, root.root FROM placed p JOIN subroots s USING (tree), root),
steps AS (
    SELECT a.tree, a.idx, l.level AS step, string_agg(l.digest, '' ORDER BY l.idx) FILTER (l.idx < a.idx // CAST(3 ** l.level AS BIGINT)) AS before,
           string_agg(l.digest, '' ORDER BY l.idx) FILTER (l.idx > a.idx // CAST(3 ** l.level AS BIGINT)) AS after
    FROM spots a JOIN low l ON l.tree = a.tree AND l.level < a.height AND l.idx // 3 = a.idx // CAST(3 ** (l.level + 1) AS BIGINT) GROUP BY ALL
    UNION ALL
    SELECT a.tree, a.idx, a.height + h.level, string_agg(h.digest, '' ORDER BY h.idx) FILTER (h.idx < a.tree // CAST(3 ** h.level AS BIGINT)),
           string_agg(h.digest, '' ORDER BY h.idx) FILTER (h.idx > a.tree // CAST(3 ** h.level AS BIGINT))
    FROM spots a JOIN high h ON h.n > 1 AND h.idx // 3 = a.tree // CAST(3 ** (h.level + 1) AS BIGINT) GROUP BY a.tree, a.idx, a.height, h.level),
paths AS (
    SELECT tree, idx, list([coalesce(before, ''), coalesce(after, '')] ORDER BY step) AS path,
           string_agg(coalesce(before, '') || coalesce(after, ''), '' ORDER BY step) AS proof
    FROM steps GROUP BY ALL),
done AS (
    SELECT a.*, sha256(coalesce(p.proof, '')) AS proof_sha256,
           list_reduce(list_prepend([a.altered, ''], coalesce(p.path, [])), lambda acc, step: [sha256(step[1] || acc[1] || step[2]), ''])[1] AS folded_root
    FROM spots a LEFT JOIN paths p USING (tree, idx))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM done
"""
