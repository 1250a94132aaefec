"""SQL of the exact contracts of operators 1, 4 and 5, by plain joins over whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"


def _components(nodes: str, node: str) -> str:
    """Smallest node that each one reaches by ``links`` (x, y), itself included: (node, root)."""
    return f"""reached AS (
  SELECT {node} AS x, {node} AS y FROM {nodes}
  UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y
), roots AS (SELECT x AS {node}, min(y) AS component_id FROM reached GROUP BY x)"""


#: Cosine of 0.93 and more between vectors of one label.
EMBEDDING_DEDUP = f"""WITH RECURSIVE usable AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    AND list_cosine_similarity(a.v, b.v) >= 0.93
), {_components("embeddings", "vec_id")}
SELECT vec_id, (SELECT count(*) FROM links WHERE x = e.vec_id)::BIGINT AS n_links, component_id,
  vec_id = component_id AS kept
FROM embeddings e JOIN roots USING (vec_id)"""

#: 85 percent of the distinct word 4-grams of two texts.
NGRAM_JOIN = rf"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), both_have AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM both_have JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * shared >= 85 * (p.n + q.n - shared)
), {_components("documents", "doc_id")}
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents JOIN roots USING (doc_id) LEFT JOIN sizes USING (doc_id)"""

_CUT = rf"[w for w in regexp_split_to_array({_FOLDED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if w <> '']"

#: Words of documents inside windows of ten words of benchmark items.
DECONTAMINATION = f"""WITH items AS (SELECT item_id, {_CUT} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM items WHERE len(w) > 0)
), texts AS (SELECT doc_id, {_CUT} AS w FROM documents),
runs AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS run
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM texts, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
), hits AS (SELECT doc_id, i, size, item_id FROM runs JOIN windows USING (size, run)),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM hits)
  GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
  FROM hits GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""
