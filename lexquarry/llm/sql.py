r"""DuckDB SQL for the queries of the operators that SQL can express: the results' definition, not their method."""

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
_ALNUM = rf"regexp_extract_all({_LOW.format("coalesce({0}, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = rf"""
WITH u AS (SELECT page_id, regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', ['h', 'p']) AS m FROM pages),
s AS (SELECT page_id, {_LOW.format("coalesce(m.h, '')")} AS host, coalesce(m.p, '') AS path FROM u),
v(action, rule, h, p) AS (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'), ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
f AS (SELECT page_id, arg_max([rule, action], length(rule)) AS best FROM s JOIN v ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1)
SELECT page_id, host, path, best[1] AS rule, coalesce(best[2], 'allow') AS verdict FROM s LEFT JOIN f USING (page_id)
"""

OP2 = f"""
WITH d AS (SELECT doc_id, {_ALNUM.format("text")} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_ALNUM.format("text")} AS w FROM benchmark),
n AS (SELECT item, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM n)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT doc_id, item, k, i FROM dw JOIN bw USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM m)) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format(_LOW.format("text"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS doc_id, a AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP5 = f"""
WITH d AS (SELECT doc_id, {_SPACED.format("text")} AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
x AS (SELECT doc_id, i FROM g JOIN f USING (h) WHERE doc_id > first),
o AS (SELECT doc_id, i, word, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
      FROM (SELECT doc_id, i, word, CASE WHEN x.i IS NULL THEN 0 ELSE 1 END AS hit FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) LEFT JOIN x USING (doc_id, i))),
k AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM o GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

OP13 = """
WITH g AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
e AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) AS v FROM e GROUP BY 1),
h AS (SELECT conv_id, v, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda y: ascii(y)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h FROM o, g),
w AS (SELECT c.conv_id, list_concat(coalesce(b.v[1:c.h], []), c.v[c.h + 1:]) AS v FROM h c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 5),
m AS (SELECT conv_id, d, v[1:d] AS p, len(v) AS n FROM (SELECT conv_id, v, unnest(range(0, len(v) + 1)) AS d FROM w)),
n AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d) AS ends FROM m GROUP BY 1, 2),
k AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
a AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(p[d].x)) END AS own FROM n LEFT JOIN k USING (d, p)),
s AS (SELECT u AS d, p[1:u] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM a) GROUP BY 1, 2)
SELECT a.conv_id, a.d AS depth, up.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves, saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
FROM a JOIN s USING (d, p) LEFT JOIN n up ON up.d = a.d - 1 AND up.p = a.p[1:a.d - 1]
"""

ORACLES = {"op1_url_filters": OP1, "op2_benchmark_decontamination": OP2, "op4_minhash_near_dedup": OP4, "op5_substring_dedup": OP5, "op13_conversation_trie": OP13}
