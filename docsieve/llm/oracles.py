"""DuckDB SQL of the queries that plain SQL can express: links by all pairs, windows by their bytes, spans by splitting."""

from __future__ import annotations

OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), k AS (SELECT doc_id, n, row_number() OVER (ORDER BY doc_id) AS k, x FROM s JOIN n USING (doc_id)
), pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM k a JOIN k b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY 1, 2
), links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (na + nb - shared) UNION SELECT b, a FROM pairs WHERE 100 * shared >= 85 * (na + nb - shared)
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""
OP8_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS x FROM d, unnest(range(0, CAST(length(h) // 2 - 49 AS BIGINT))) AS r(i)
), m AS (SELECT x, min(doc_id) AS least FROM w GROUP BY x HAVING count(*) > 1
), hit AS (SELECT doc_id, i FROM w JOIN m USING (x) WHERE doc_id > least
), mark AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS new FROM hit
), run AS (SELECT doc_id, i, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM mark
), span AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, k
), piece AS (SELECT doc_id, k, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS after FROM span
), kept AS (SELECT doc_id, string_agg(substr(h, 2 * after + 1, 2 * (a - after)), '' ORDER BY k) || substr(any_value(h), 2 * max(b) + 1) AS rest,
  sum(b - a) AS n_removed, count(*) AS n_spans FROM piece JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

# The contract's patterns in RE2's words: letters of the key words in either case, runs with their least length.
_WORDS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''")
_KINDS = [("assign", _ASSIGN, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]{32,}", 0, 32),
          ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1), ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40)]
OP3_SQL = "WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (\n" + "\nUNION ALL ".join(
    f"""SELECT doc_id, '{k}' AS kind, {n} AS rank, {least} AS least, regexp_split_to_array(t, '{p}') AS p, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {g}) AS g FROM t"""
    for n, (k, p, g, least) in enumerate(_KINDS)) + """
), s AS (SELECT doc_id, kind, rank, least, length(g[k]) AS held, length(m[k]) AS size,
  CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM f WHERE len(m) > 0)
), x AS (SELECT doc_id, kind, rank, start, kind || ':' || start || ':' || (start + size) AS span FROM s WHERE held >= least
), a AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans FROM x GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans FROM documents LEFT JOIN a USING (doc_id)
"""

OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents
), w AS (SELECT k, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS docs FROM w GROUP BY ALL
), v AS (SELECT lang, term, sum(n) AS all_n FROM c GROUP BY ALL HAVING sum(docs) >= 10
), s AS (SELECT lang, count(*) AS v, sum(all_n) AS n FROM v GROUP BY lang
), g AS (SELECT DISTINCT lang, source FROM d
), kept AS (SELECT c.lang, source, c.term, c.n FROM c JOIN v USING (lang, term)
), total AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN kept USING (lang, source) GROUP BY ALL
), p AS (SELECT lang, source, term, coalesce(kept.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(kept.n, 0) + 2) // (total.n + 2 * s.v) AS p,
    1 + CAST(1000000000 AS HUGEINT) * (v.all_n + 2) // (s.n + 2 * s.v) AS q
  FROM total JOIN v USING (lang) JOIN s USING (lang) LEFT JOIN kept USING (lang, source, term)
), pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
), terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

# The remainder of a byte under the reversed polynomial, bit by bit; then of each decimal, byte by byte.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END))"
OP12_SQL = rf"""
WITH crc AS (SELECT {_CRC_TABLE} AS crc
), ids AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS family, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b
  FROM conversations WHERE conv_id IS NOT NULL
), h AS (SELECT conv_id, family, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda a, x: xor(crc[(xor(a, x) & 255) + 1], a >> 8))) % 4 AS h FROM ids, crc
), t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations
), l AS (SELECT conv_id, list(length(role) || ':' || role || text ORDER BY pos) AS said, list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY pos) AS words FROM t GROUP BY conv_id
), c AS (SELECT h.conv_id, list_concat(coalesce(f.said, [])[1:h], o.said[h + 1:]) AS said, list_concat(coalesce(f.words, [])[1:h], o.words[h + 1:]) AS words
  FROM h JOIN l o USING (conv_id) LEFT JOIN l f ON f.conv_id = h.family
), p AS (SELECT conv_id, len(said) AS size, unnest(range(0, len(said) + 1)) AS depth, said, words FROM c
), q AS (SELECT conv_id, size, depth, sha256(array_to_string(list_transform(said[1:depth], lambda x: sha256(x)), ',')) AS node,
    CASE WHEN depth > 0 THEN sha256(array_to_string(list_transform(said[1:depth - 1], lambda x: sha256(x)), ',')) END AS up, CASE WHEN depth > 0 THEN words[depth] ELSE 0 END AS words FROM p
), n AS (SELECT node, min(conv_id) AS conv_id, depth, any_value(up) AS up, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256 FROM q GROUP BY node, depth
), k AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up
), m AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * words AS saved FROM n LEFT JOIN k USING (node)
), e AS (SELECT q.node, sum(CAST(m.n_children = 0 AS BIGINT)) AS n_leaves, sum(m.saved) AS saved_tokens
  FROM m JOIN q ON q.conv_id = m.conv_id AND q.depth <= m.depth GROUP BY q.node)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN e USING (node) LEFT JOIN m u ON u.node = m.up
"""

OP13_SQL = """
WITH v AS (SELECT vec_id, min(embedding) AS e FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) GROUP BY vec_id
), usual AS (SELECT len(e) AS n FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1
), u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS size FROM v, usual WHERE len(e) = n
), s AS (SELECT q.vec_id AS query_id, u.vec_id, list_inner_product(q.e, u.e) / (q.size * u.size) AS score FROM u AS q JOIN u ON q.vec_id % 50 = 0 AND q.vec_id <> u.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
