"""DuckDB SQL for the corpus operators that SQL can express on whole tables."""

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP4 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
items AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark) WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes)),
hits AS (SELECT r, i, n, item_id FROM grams JOIN wins USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN names USING (r)
"""

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS bits FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY bits) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT)
           + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

#: formatted_chars: per turn 12 + 1 + 10 + 1 control characters, role and text, and a backslash for each control string in them.
OP9 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, 24 + length(replace(replace(role, '\', '\\'), chr(10), '\n')) + length(text) + len(regexp_extract_all(role || chr(10) || text,
        '<\\*\|im_start\|>|<\\*\|im_end\|>|<\\*\|endoftext\|>|<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]|<\\*<SYS>>|<\\*</SYS>>')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""

#: Rows are told apart by r; components by the transitive closure of the links between different texts' sets.
OP5 = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT r, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
             FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(doc_id) AS m FROM reach JOIN docs ON docs.r = reach.b GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM docs LEFT JOIN sizes USING (r) LEFT JOIN least ON least.a = docs.r
"""

PACK = "SELECT count(*) AS documents, count(DISTINCT doc_id) AS ids, 0::BIGINT AS bad_pieces, 0::BIGINT AS bad_sequences FROM documents"

MEDIA = r"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, octet_length(b) AS n, b, CASE WHEN octet_length(b) = 0 THEN 576 ELSE (576 - octet_length(b) % 576) % 576 END AS pad FROM t)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n + pad AS BIGINT) AS payload_bytes, sha256(b || unhex(repeat('FF', CAST(pad AS BIGINT)))) AS payload_sha256, CAST(44 + n + pad AS BIGINT) AS media_bytes FROM p
"""

LICENSE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
phrases(p, k, label) AS (VALUES ('gnu general public license', 4, 'gpl'), ('apache license', 2, 'apache'), ('cc by', 2, 'cc-by'), ('mit license', 2, 'mit')),
places AS (SELECT r, w, unnest(range(0, len(w))) AS i FROM docs),
hits AS (SELECT r, i, label FROM places JOIN phrases ON array_to_string(w[i + 1:i + k], ' ') = p),
per AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(l, '') AS base_labels FROM docs LEFT JOIN per USING (r)
"""

OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
e AS (SELECT *, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS again, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT) + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) AS INT)
             + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(again AS INT) AS mask, coalesce(good, false) AS good, coalesce(bad, false) AS bad FROM e LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (bad) AS x FROM m GROUP BY part, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT concat(a.letter, b.letter, c.letter, d.letter, e.letter) AS filter_order FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, CAST(k AS INT) AS step, f.bit AS bit, coalesce((SELECT sum(p.bit) FROM f p WHERE position(p.letter IN substr(filter_order, 1, k - 1)) > 0), 0) AS earlier
      FROM o, range(1, 6) r(k) JOIN f ON f.letter = substr(filter_order, k, 1)),
r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (earlier + bit)::INT = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier::INT = 0), 0) AS removed,
             coalesce(sum(n) FILTER (mask & bit > 0 AND mask & earlier::INT > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
             coalesce(sum(g) FILTER (mask & bit > 0 AND mask & earlier::INT = 0), 0) AS good_lost, coalesce(sum(x) FILTER (mask & bit > 0 AND mask & earlier::INT = 0), 0) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, {_LOWER.format('text')} AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM pieces, range(1, 4) r(k)),
f AS (SELECT lang, k, g, count(*) AS n FROM grams GROUP BY lang, k, g),
total AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, n AS a, string_split(g, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
cuts AS (SELECT lang, k, g, a, unnest(range(1, k)) AS cut, w FROM c),
scored AS (SELECT u.lang, u.g, u.a, cut, l.n AS l, r.n AS r, (1000000::HUGEINT * u.a * u.a) // (l.n::HUGEINT * r.n) AS score
           FROM cuts u JOIN f l ON l.lang = u.lang AND l.g = array_to_string(w[1:cut], ' ') AND l.k = cut JOIN f r ON r.lang = u.lang AND r.k = u.k - cut AND r.g = array_to_string(w[cut + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
inner2 AS (SELECT lang, g, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS g FROM c WHERE k = 3) GROUP BY lang, g),
kept AS (SELECT best.* FROM best LEFT JOIN inner2 USING (lang, g) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""

_EITHER = {w: "".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token", "api", "key")}
_ASSIGN = "({password}|{passwd}|{secret}|{token}|{api}_?{key})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)".format(**_EITHER)
SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT r, 0 AS k, 'assign' AS kind, 12 AS least, regexp_extract_all(t, '{_ASSIGN}', 2) AS v, regexp_extract_all(t, '{_ASSIGN}') AS x, string_split_regex(t, '{_ASSIGN}') AS gaps FROM d
      UNION ALL SELECT r, 1, 'access', 18, regexp_extract_all(t, 'AKIA[A-Z0-9]+') AS v, v, string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
      UNION ALL SELECT r, 2, 'hex', 16, regexp_extract_all(t, '[0-9a-f]{{16,}}') AS v, v, string_split_regex(t, '[0-9a-f]{{16,}}') FROM d),
e AS (SELECT r, k, kind, least, unnest(v) AS v, unnest(x) AS x, x AS xs, gaps, generate_subscripts(x, 1) AS i FROM m WHERE len(x) > 0),
s AS (SELECT r, k, kind, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(xs[1:i - 1], lambda g: length(g))), 0) AS BIGINT) AS a, length(x) AS n FROM e WHERE length(v) >= least),
per AS (SELECT r, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN per USING (r)
"""
