"""What the queries give, as DuckDB SQL over the same tables, for the operators that SQL can express."""

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The words of the contracts.
BLANK_WORDS, LETTER_WORDS = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(source: str, pattern: str, lower: bool = True) -> str:
    """r (a number for each row), doc_id, ws (the words)."""
    text = f"translate(text, '{ALPHABET}', '{ALPHABET.lower()}')" if lower else "text"
    return f"SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({text}, '{pattern}'), []) AS ws FROM {source}"


LM_SCORES = f"""
WITH w AS ({words("documents", BLANK_WORDS)}),
t AS (SELECT r, p, ws[p] AS b, ws[p - 1] AS a, len(ws) AS n FROM w, unnest(range(1, len(ws) + 1)) AS u(p)),
one AS (SELECT b, count(*) AS c FROM t GROUP BY b), two AS (SELECT a, b, count(*) AS c FROM t WHERE p > 1 GROUP BY a, b),
own1 AS (SELECT r, b, count(*) AS c FROM t GROUP BY r, b), own2 AS (SELECT r, a, b, count(*) AS c FROM t WHERE p > 1 GROUP BY r, a, b),
s AS (SELECT t.r, p, greatest((SELECT count(*) FROM t) - n, 1) AS rest, one.c - own1.c AS cb, before.c - own_before.c AS ca, two.c - own2.c AS cab
 FROM t JOIN one USING (b) JOIN own1 USING (r, b) LEFT JOIN two ON p > 1 AND two.a = t.a AND two.b = t.b LEFT JOIN own2 ON p > 1 AND own2.r = t.r AND own2.a = t.a AND own2.b = t.b
 LEFT JOIN one before ON p > 1 AND before.b = t.a LEFT JOIN own1 own_before ON p > 1 AND own_before.r = t.r AND own_before.b = t.a),
v AS (SELECT r, ln(least(1.0, CASE WHEN p > 1 AND cab > 0 THEN cab / greatest(ca, 1) ELSE CASE WHEN cb > 0 THEN 0.4 * cb ELSE 0.4 * 0.4 END / rest / CASE WHEN p = 1 THEN 0.4 ELSE 1 END END)) AS x FROM s),
told AS (SELECT r, sum(x) AS x FROM v GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(x, 0.0), 3) AS log_score, round(coalesce(x, 0.0) / greatest(len(ws), 1), 3) AS mean_log_score FROM w LEFT JOIN told USING (r)"""

REPEATS = f"""
WITH w AS ({words("documents", BLANK_WORDS, lower=False)}),
win AS (SELECT r, doc_id, p, array_to_string(ws[p:p + 12], ' ') AS win FROM w, unnest(range(1, len(ws) - 11)) AS u(p)),
own AS (SELECT win, min(doc_id) AS first FROM win GROUP BY win),
gone AS (SELECT DISTINCT r, q FROM (SELECT r, unnest(range(p, p + 13)) AS q FROM win JOIN own USING (win) WHERE doc_id > first)),
each AS (SELECT r, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS u(p)),
kept AS (SELECT e.r, string_agg(word, ' ' ORDER BY p) AS kept FROM each e ANTI JOIN gone g ON g.r = e.r AND g.q = e.p GROUP BY e.r), n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r) LEFT JOIN n USING (r)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS ({words("documents", BLANK_WORDS)}),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 3], ' ') AS x FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) AS u(p) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * c >= 80 * (m.n + o.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(id, x) AS (SELECT a, b FROM edge UNION SELECT reach.id, edge.b FROM reach JOIN edge ON edge.a = reach.x),
least AS (SELECT id, min(x) AS x FROM reach GROUP BY id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(x, w.doc_id)) AS component_id, w.doc_id <= coalesce(x, w.doc_id) AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least ON id = w.doc_id"""

DECONTAMINATION = f"""
WITH w AS ({words("documents", LETTER_WORDS)}),
i AS (SELECT CAST(doc_id AS VARCHAR) AS item_id, ws, least(10, len(ws)) AS k FROM ({words("(SELECT item_id AS doc_id, text FROM benchmark WHERE item_id IS NOT NULL)", LETTER_WORDS)}) WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS win FROM i, unnest(range(1, len(ws) - k + 2)) AS u(p)),
dw AS (SELECT r, p, k, array_to_string(ws[p:p + k - 1], ' ') AS win FROM w, (SELECT DISTINCT k FROM iw), unnest(range(1, greatest(len(ws) - k + 2, 1))) AS u(p)),
hit AS (SELECT r, p, k, item_id FROM dw JOIN iw USING (k, win)),
cover AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT r, p, k FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM w LEFT JOIN cover USING (r) LEFT JOIN items USING (r)"""
