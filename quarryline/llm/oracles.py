"""DuckDB SQL for the registered queries that SQL can express."""

from .tool_chat import ORACLE as CHAT

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
w AS (SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 49, 0))) AS p FROM n)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
c AS (SELECT w.doc_id, w.p FROM w JOIN f USING (s) WHERE f.m < w.doc_id),
i AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM c),
g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM i),
s AS (SELECT doc_id, g, min(p) AS a, max(p) + 50 AS b FROM g GROUP BY doc_id, g),
gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi FROM s UNION ALL SELECT n.doc_id, coalesce(max(s.b), 0), any_value(n.n) FROM n LEFT JOIN s USING (doc_id) GROUP BY n.doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * lo + 1 AS BIGINT), CAST(2 * (hi - lo) AS BIGINT)), '' ORDER BY lo, hi) AS k FROM gap JOIN n USING (doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM s GROUP BY doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_bytes, CAST(coalesce(t.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(t.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.k)) AS kept_sha256
FROM n JOIN kept USING (doc_id) LEFT JOIN t USING (doc_id)
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item, w[k + 1 : k + 8] AS s FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 7, 1))) AS k FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT len(s) AS z FROM p),
x AS (SELECT doc_id, k, z, w[k + 1 : k + z] AS s FROM (SELECT doc_id, w, z, unnest(range(0, greatest(len(w) - z + 1, 0))) AS k FROM d, z)),
o AS (SELECT x.doc_id, x.k, x.z, p.item FROM x JOIN p ON x.s = p.s),
hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(k, k + z)) AS j FROM o) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, coalesce(i.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN i USING (doc_id)
"""

SQL = {"op2_suffix_dedup": SUFFIX_DEDUP, "op7_tool_chat": CHAT, "op8_topk": TOP_K, "op9_decontamination": DECONTAMINATION}
