"""SQL counterparts of the corpus queries that SQL can express."""

from __future__ import annotations

OP7 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE
    WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words
), single AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM single a JOIN single b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM sets LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) ON a = doc_id
"""

def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode({value})) || ':' || {value} END"


def _leaf(n_chars: str) -> str:
    values = ("CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text")
    return f"sha256({' || '.join(map(_field, values))})"


_BYTES = "list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ord(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))"
_BIT = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
_CRC = f"""xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BYTES}),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda x, z: {_BIT})))"""


def _levels(name: str, leaves: str) -> str:
    """All nodes of the trees over `leaves` (tree, pos, n, digest), as a recursive common table."""
    return f"""{name}(l, tree, pos, n, digest) AS (
  SELECT 0, tree, pos, n, digest FROM {leaves}
  UNION ALL
  SELECT l + 1, tree, pos // 2, any_value((n + 1) // 2), sha256(string_agg(digest, '' ORDER BY pos))
  FROM {name} WHERE n > 1 GROUP BY l, tree, pos // 2
)"""


OP12 = rf"""
WITH RECURSIVE made AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf("n_chars")} AS leaf,
    CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("CAST(n_chars AS BIGINT) + 1")} ELSE {_leaf("n_chars")} END AS shown
  FROM documents
), leaves AS (
  SELECT *, leaf AS digest, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY tree) AS n
  FROM made
), {_levels("low", "leaves")}, tops AS (
  SELECT tree AS lang_tree, digest AS subroot, 'top' AS tree, digest,
    row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n
  FROM low WHERE n = 1
), {_levels("high", "tops")}, walk(doc_id, tree, pos, l, digest, siblings) AS (
  SELECT doc_id, tree, pos, 0, shown, '' FROM leaves
  UNION ALL
  SELECT w.doc_id, w.tree, w.pos, w.l + 1,
    sha256(CASE WHEN (w.pos >> w.l) % 2 = 1 THEN s.digest || w.digest ELSE w.digest || coalesce(s.digest, '') END),
    siblings || coalesce(s.digest, '')
  FROM walk w JOIN low me ON me.tree = w.tree AND me.l = w.l AND me.pos = w.pos >> w.l AND me.n > 1
  LEFT JOIN low s ON s.tree = w.tree AND s.l = w.l AND s.pos = xor(w.pos >> w.l, 1)
), ended AS (
  SELECT w.* FROM walk w JOIN low me ON me.tree = w.tree AND me.l = w.l AND me.pos = w.pos >> w.l AND me.n = 1
), climb(tree, leaf_pos, pos, l, digest, siblings) AS (
  SELECT e.tree, e.pos, t.pos, 0, e.digest, e.siblings FROM ended e JOIN tops t ON t.lang_tree = e.tree
  UNION ALL
  SELECT c.tree, c.leaf_pos, c.pos, c.l + 1,
    sha256(CASE WHEN (c.pos >> c.l) % 2 = 1 THEN s.digest || c.digest ELSE c.digest || coalesce(s.digest, '') END),
    siblings || coalesce(s.digest, '')
  FROM climb c JOIN high me ON me.l = c.l AND me.pos = c.pos >> c.l AND me.n > 1
  LEFT JOIN high s ON s.l = c.l AND s.pos = xor(c.pos >> c.l, 1)
), root AS (SELECT l, digest AS root FROM high WHERE n = 1)
SELECT v.doc_id, v.leaf, t.subroot, r.root, sha256(c.siblings) AS proof_sha256, c.digest AS folded_root,
  c.digest = r.root AS verified
FROM leaves v JOIN tops t ON t.lang_tree = v.tree CROSS JOIN root r
JOIN climb c ON c.tree = v.tree AND c.leaf_pos = v.pos AND c.l = r.l
"""

OP13 = r"""
WITH used AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM used a JOIN used b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

ORACLE = {"op7_jaccard_join": OP7, "op12_merkle_manifest": OP12, "op13_hard_negatives": OP13}
