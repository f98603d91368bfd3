"""DuckDB twins of those queries that SQL can express."""

OP10 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages
), k AS (
  SELECT page_id, octet_length(encode(body)) AS payload_bytes,
         array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1) for i in range(32)], '') AS payload_digest,
         max(page_id) OVER (PARTITION BY body) AS keeper
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM k
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + 10], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win),
g AS (
  SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)
), hit AS (SELECT g.doc_id, g.i, g.n, win.item FROM g JOIN win ON g.phrase = win.phrase AND g.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""

_LINE_WORDS = _WORDS.replace("coalesce(text, '')", "line")

OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, text FROM documents),
p AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS seq FROM d),
q AS (SELECT doc_id, seq, w FROM (SELECT doc_id, seq, {_LINE_WORDS} AS w FROM p) WHERE len(w) >= 5),
c AS (SELECT w, row_number() OVER () AS id FROM (SELECT DISTINCT w FROM q)),
s AS (SELECT DISTINCT id, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT id, w, unnest(range(len(w) - 4)) AS i FROM c)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
j AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
e AS (SELECT x, y FROM j JOIN n nx ON nx.id = x JOIN n ny ON ny.id = y WHERE k >= 0.8 * (nx.n + ny.n - k)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(id, z) AS (SELECT id, id FROM c UNION SELECT r.id, u.y FROM r JOIN u ON u.x = r.z),
k AS (SELECT id, min(z) AS cluster FROM r GROUP BY id),
o AS (SELECT q.doc_id, q.seq, row_number() OVER (PARTITION BY k.cluster ORDER BY q.doc_id, q.seq) AS place FROM q JOIN c ON q.w = c.w JOIN k ON k.id = c.id),
away AS (SELECT doc_id, seq FROM o WHERE place > 1),
gone AS (SELECT doc_id, list(seq ORDER BY seq) AS seqs FROM away GROUP BY doc_id),
stay AS (SELECT p.doc_id, p.seq, line FROM p ANTI JOIN away ON away.doc_id = p.doc_id AND away.seq = p.seq),
long AS (SELECT doc_id, seq, string_split(regexp_replace(line, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)) AS ss FROM stay WHERE len({_LINE_WORDS}) > 50),
v AS (SELECT doc_id, seq, part, {_WORDS.replace("coalesce(text, '')", "sentence")} AS w FROM (SELECT doc_id, seq, unnest(ss) AS sentence, unnest(range(len(ss))) AS part FROM long)),
t AS (SELECT doc_id, seq, part, row_number() OVER (PARTITION BY w ORDER BY doc_id, seq, part) AS place FROM v WHERE len(w) >= 8),
cut AS (SELECT doc_id, seq, list(part) AS parts FROM t WHERE place > 1 GROUP BY doc_id, seq),
cuts AS (SELECT doc_id, sum(len(parts)) AS n FROM cut GROUP BY doc_id),
short AS (SELECT doc_id, seq, array_to_string([ss[i + 1] for i in range(len(ss)) if NOT list_contains(parts, i)], ' ') AS line FROM long JOIN cut USING (doc_id, seq)),
kept AS (SELECT stay.doc_id, string_agg(coalesce(short.line, stay.line), chr(10) ORDER BY stay.seq) AS body FROM stay LEFT JOIN short USING (doc_id, seq) GROUP BY stay.doc_id)
SELECT d.doc_id, CAST(len(l) AS INTEGER) AS n_paragraphs, CAST(coalesce(len(seqs), 0) + coalesce(cuts.n, 0) AS INTEGER) AS n_removed,
       CAST(coalesce(cuts.n, 0) AS INTEGER) AS n_sentences, coalesce(array_to_string(seqs, ','), '') AS removed,
       sha256(CASE WHEN text IS NOT NULL THEN coalesce(body, '') END) AS kept_sha256
FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id LEFT JOIN cuts ON cuts.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

OP6 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, b[i + 1 : i + 50] AS s FROM (SELECT doc_id, b, unnest(range(n - 49)) AS i FROM d WHERE n >= 50)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
g AS (SELECT w.doc_id, w.i FROM w JOIN m ON w.s = m.s WHERE m.least < w.doc_id),
f AS (SELECT doc_id, i, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) + 50 THEN 1 ELSE 0 END AS opens FROM g),
h AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
r AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM h GROUP BY doc_id, run),
k AS (SELECT doc_id, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es, sum(e - s) AS gone, count(*) AS runs FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(runs, 0) AS n_spans,
       sha256(CASE WHEN ss IS NULL THEN b ELSE unhex(array_to_string([hex(b[CASE WHEN j = 1 THEN 1 ELSE es[j - 1] + 1 END : CASE WHEN j > len(ss) THEN n ELSE ss[j] END]) for j in range(1, len(ss) + 2)], '')) END) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

_CRC32 = """xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], [CAST(ord(substr({0}, CAST(i AS BIGINT), 1)) AS BIGINT) for i in range(1, length({0}) + 1)]),
  lambda a, b: list_reduce(list_concat([xor(a, b)], [CAST(0 AS BIGINT) for k in range(8)]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)))"""

OP11 = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, n, conv_id - conv_id % 100 AS base, {_CRC32.format("CAST(conv_id AS VARCHAR)")} % 6 AS h
  FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)
), b AS (
  SELECT c.conv_id, c.h, least(c.h, coalesce(o.n, 0)) AS m FROM c LEFT JOIN c o ON o.conv_id = c.base
), r AS (
  SELECT c.conv_id, t.i AS depth, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL
  SELECT t.conv_id, t.i - b.h + b.m, t.role, t.text FROM t JOIN b USING (conv_id) WHERE t.i > b.h
), p AS (
  SELECT conv_id, depth, length(text) AS points,
         string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS k
  FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), e AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p
), n AS (
  SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(points) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM e GROUP BY depth, k
), q AS (
  SELECT p.conv_id AS member, p.depth, n.conv_id FROM p JOIN n USING (depth, k)
), f AS (
  SELECT n.*, q.conv_id AS parent_conv_id FROM n LEFT JOIN q ON q.member = n.conv_id AND q.depth = n.depth - 1
), kids AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM f WHERE depth > 0 GROUP BY ALL
), g AS (
  SELECT f.*, coalesce(n_children, 0) AS n_children FROM f LEFT JOIN kids USING (conv_id, depth)
), s AS (
  SELECT q.conv_id, q.depth, count(*) FILTER (g.n_children = 0) AS n_leaves, sum(g.saved) AS saved_tokens
  FROM g JOIN q ON q.member = g.conv_id AND q.depth <= g.depth GROUP BY ALL
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM g JOIN s USING (conv_id, depth)
"""

SQL = {"op11_trie": OP11, "op3_paragraphs": OP3, "op5_decontamination": OP5, "op6_substrings": OP6, "op10_warc": OP10}
