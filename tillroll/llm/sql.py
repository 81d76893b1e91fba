"""DuckDB SQL for the queries that SQL can express, written from their contracts by plain grouping and joins."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item, w, least(10, len(w)) AS m, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0),
pat AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS p FROM bw),
dw AS (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d JOIN (SELECT DISTINCT m FROM pat) ON len(w) >= m),
hit AS (SELECT doc_id, i, dw.m, item FROM dw JOIN pat ON dw.m = pat.m AND array_to_string(w[i:i + dw.m - 1], ' ') = pat.p),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS l FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(l), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

EMBEDDING = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS u, vec_id AS v FROM v UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
component AS (SELECT u AS vec_id, min(v) AS component_id FROM reach GROUP BY u),
n AS (SELECT u AS vec_id, count(*) AS n_links FROM links GROUP BY u)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM component LEFT JOIN n USING (vec_id)
"""

REPEATED_BYTES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(generate_series(0, len(h) // 2 - 50)) AS i FROM d WHERE len(h) >= 100)),
f AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, i FROM s JOIN f USING (g) WHERE least < doc_id),
e AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 50 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM e),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, span),
before AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS last FROM spans),
kept AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS head
         FROM before JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def _backoff(order: int = 5, backoff: float = 0.4, min_count: int = 2) -> str:
    grams = " UNION ALL ".join(f"SELECT substr(h, 2 * i + 1, {2 * o}) AS g FROM p WHERE 2 * (i + {o}) <= len(h)" for o in range(1, order + 1))
    levels = ["s1 AS (SELECT g, ln(n / (SELECT CAST(sum(n) AS DOUBLE) FROM c WHERE len(g) = 2)) AS log_s FROM c WHERE len(g) = 2)"]
    for o in range(2, order + 1):
        levels.append(f"""s{o} AS (SELECT c.g, CASE WHEN c.n >= {min_count} THEN ln(c.n / CAST(x.n AS DOUBLE)) ELSE ln({backoff}) + s{o - 1}.log_s END AS log_s
            FROM c JOIN c AS x ON x.g = substr(c.g, 1, {2 * o - 2}) JOIN s{o - 1} ON s{o - 1}.g = substr(c.g, 3) WHERE len(c.g) = {2 * o})""")
    scores = " UNION ALL ".join(f"SELECT * FROM s{o}" for o in range(1, order + 1))
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(generate_series(0, len(h) // 2 - 1)) AS i FROM d WHERE len(h) > 0),
c AS (SELECT g, count(*) AS n FROM ({grams}) GROUP BY g),
{", ".join(levels)},
s AS ({scores}),
here AS (SELECT doc_id, substr(h, 2 * greatest(0, i - {order - 1}) + 1, 2 * least(i + 1, {order})) AS g FROM p),
t AS (SELECT doc_id, sum(log_s) AS sum_log FROM here JOIN s USING (g) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(round(sum_log / (len(h) // 2), 6), 0.0) AS score
FROM d LEFT JOIN t USING (doc_id)
"""


def _host_rules() -> str:
    rules = {"short": "n_words < 50", "repeated": "100 * n_repeat_words > 50 * n_words", "symbols": "10 * n_symbols > n_words",
             "lines": "10 * n_dup_lines > 3 * n_lines", "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words)"}
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE {c}) AS DOUBLE) AS {r}" for r, c in rules.items())
    means = ", ".join(f"sum({r}) / sum(n) AS mu_{r}, sum({r} * {r} / n) - sum({r}) * sum({r}) / sum(n) AS s_{r}" for r in rules)
    noise = lambda r: f"mu_{r} * (1 - mu_{r})"
    room = lambda r: f"({noise(r)} * (total - nn / total - (hosts - 1)))"
    strength = ", ".join(f"1 / least(0.1, greatest(0.001, CASE WHEN {room(r)} <= 0 THEN 0.01 ELSE (s_{r} - {noise(r)} * (hosts - 1)) / {room(r)} END)) - 1 AS m_{r}" for r in rules)
    bad = " OR ".join(f"({r} + mu_{r} * m_{r}) / (n + m_{r}) > 0.5" for r in rules)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
win AS (SELECT rid, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 3)),
rep AS (SELECT rid, count(DISTINCT i + o) AS n FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) x, (VALUES (0), (1), (2)) y(o) WHERE c > 1 GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
m AS (SELECT d.rid, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN w USING (rid) JOIN lines USING (rid) LEFT JOIN rep USING (rid)),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, {counts} FROM m WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT *, {strength} FROM (SELECT CAST(count(*) AS DOUBLE) AS hosts, sum(n) AS total, sum(n * n) AS nn, {means} FROM h)),
v AS (SELECT source, {bad} AS rejected FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(rejected, false) AS kept
FROM m LEFT JOIN v USING (source)
"""


PREFIX_TRIE = """
WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))) AS b FROM o),
heads AS (SELECT c, c - c % 20 AS base, xor(list_reduce(b, lambda a, x: list_reduce(list_prepend(xor(a, x), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
                                                lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 4 AS h FROM ids),
turns AS (SELECT heads.c, 0 AS own, i, role, text FROM heads JOIN o ON o.c = base AND i < h UNION ALL SELECT heads.c, 1, i, role, text FROM heads JOIN o ON o.c = heads.c AND i >= h),
paths AS (SELECT heads.c, coalesce(l, []) AS l FROM heads LEFT JOIN (SELECT c, list({'r': role, 't': text} ORDER BY own, i) AS l FROM turns GROUP BY c) USING (c)),
pre AS (SELECT c, l, d, CASE WHEN d = 0 THEN [] ELSE l[1:d] END AS p FROM (SELECT c, l, unnest(generate_series(0, len(l))) AS d FROM paths)),
node AS (SELECT d, p, min(c) AS conv_id, count(*) AS n, max(len(l)) AS deepest, count(DISTINCT CASE WHEN len(l) > d THEN l[1:d + 1] END) AS children,
                string_agg(CASE WHEN len(l) = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ends,
                CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(p[d].t, '[^\\x20\\x09-\\x0D]+')) END AS saved FROM pre GROUP BY d, p),
tree AS (SELECT a.d, a.p, count(*) FILTER (WHERE b.deepest = b.d) AS leaves, sum(b.saved) AS saved FROM node a JOIN node b ON b.d >= a.d AND (a.d = 0 OR b.p[1:a.d] = a.p) GROUP BY a.d, a.p)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, node.n AS n_convs, node.children AS n_children, leaves AS n_leaves,
       CAST(tree.saved AS BIGINT) AS saved_tokens, sha256(coalesce(node.ends, '')) AS ends_sha256
FROM node JOIN tree ON tree.d = node.d AND tree.p = node.p LEFT JOIN node up ON up.d = node.d - 1 AND up.p = CASE WHEN node.d = 1 THEN [] ELSE node.p[1:node.d - 1] END
"""


ORACLE = {
    "op4_embedding_dedup": EMBEDDING,
    "op5_repeated_bytes": REPEATED_BYTES,
    "op7_lm_score": _backoff(),
    "op9_decontaminate": DECONTAMINATE,
    "op11_prefix_trie": PREFIX_TRIE,
    "op12_host_rules": _host_rules(),
}
