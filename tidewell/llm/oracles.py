"""DuckDB SQL for the queries that SQL can express."""

ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP2 = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS k FROM h, unnest(range(0, n - 99)) t(i)),
g AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
b AS (SELECT h.doc_id, j, substr(x, 2 * j + 1, 2) AS c FROM h, unnest(range(0, n)) t(j)),
m AS (SELECT b.doc_id, j, c, max(g.i) OVER (PARTITION BY b.doc_id ORDER BY j ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM b LEFT JOIN g ON b.doc_id = g.doc_id AND b.j = g.i),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), false) AS starts FROM m),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(c, '' ORDER BY j) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM h LEFT JOIN a USING (doc_id)
"""

OP6 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY sha256(coalesce(text, '')))
"""

OP7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n]+[.!?\n]*|[.!?\n]+') AS s FROM documents),
t AS (SELECT doc_id, i, s[i] AS raw, regexp_extract_all(s[i], '[^ \t\n\r\f]+') AS w FROM d, unnest(range(1, len(s) + 1)) u(i)),
p AS (SELECT doc_id, i, array_to_string(w, ' ') || chr(1) || lead(array_to_string(w, ' ')) OVER g AS k, len(w) + lead(len(w)) OVER g AS n FROM t WINDOW g AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM p WHERE n >= 12),
x AS (SELECT DISTINCT doc_id, i + o AS i FROM r, unnest([0, 1]) u(o) WHERE r > 1),
a AS (SELECT t.doc_id, count(x.i) AS n_removed, coalesce(string_agg(raw, '' ORDER BY t.i) FILTER (x.i IS NULL), '') AS kept_text FROM t LEFT JOIN x ON t.doc_id = x.doc_id AND t.i = x.i GROUP BY t.doc_id)
SELECT d.doc_id, len(s)::BIGINT AS n_sentences, coalesce(n_removed, 0) AS n_removed, coalesce(kept_text, '') AS kept_text FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {ASCII}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), {ASCII}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT item, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) t(i) WHERE len(w) > 0),
p AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM d, (SELECT DISTINCT k FROM q) z, unnest(range(1, len(w) - k + 2)) t(i)),
m AS (SELECT DISTINCT doc_id, i, k, item FROM p JOIN q USING (k, s)),
h AS (SELECT doc_id, count(DISTINCT j) AS n FROM m, unnest(range(i, i + k)) t(j) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(c.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN c ON d.doc_id = c.doc_id
"""

OP13 = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND v.vec_id != q.vec_id AND len(v.e) = len(q.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""
