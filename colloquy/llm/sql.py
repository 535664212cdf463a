"""SQL for the operators that it can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * k + 1}, 5))::INTEGER >> {s}) & 31) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0))

LINES = r"""
WITH l AS (SELECT doc_id, unnest(range(0, len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
t AS (SELECT row_number() OVER (ORDER BY doc_id, pos) AS id, doc_id, pos, list_filter(regexp_split_to_array(lower(line), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS v FROM l),
s AS (SELECT id, doc_id, pos, list_distinct(v) AS w, len(list_distinct(v)) AS n FROM t WHERE len(v) >= 5),
u AS (SELECT id, n, unnest(w) AS k FROM s), df AS (SELECT k, count(*) AS df FROM u GROUP BY k),
p AS (SELECT id, n, k FROM u JOIN df USING (k) QUALIFY row_number() OVER (PARTITION BY id ORDER BY df, k) <= n - (75 * n + 99) // 100 + 1),
c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.k = b.k AND a.id < b.id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)),
r AS (SELECT DISTINCT y.doc_id, y.pos FROM c JOIN s x ON x.id = c.a JOIN s y ON y.id = c.b WHERE 175 * len(list_intersect(x.w, y.w)) >= 75 * (x.n + y.n)),
g AS (SELECT doc_id, count(*) AS n_removed, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS removed FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed FROM documents LEFT JOIN g USING (doc_id)"""

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), q AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM q"""

_WORDS = r"regexp_extract_all(" + _LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS win FROM (SELECT item_id, CASE WHEN len(w) < 10 THEN w ELSE w[i:i + 9] END AS x FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM d, sizes, unnest(range(1, len(w) - n + 2)) t(i)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + n)) t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""

NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce({_LOWER.format('text')}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM u a JOIN u b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 75 * (na + nb - c)), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT x, b FROM reach JOIN both_ways ON y = a),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)"""

def _urls() -> str:
    from .urls import LIMIT, RULES, WEIGHTS

    edge = r"[^a-z\x{80}-\x{10FFFF}]"
    hit = lambda t: f"regexp_matches(u, '(^|{edge}){t}({edge}|$)')::BIGINT"
    strict = " + ".join(hit(t) for t, w in WEIGHTS.items() if w >= LIMIT)
    soft = " + ".join(hit(t) for t, w in WEIGHTS.items() if w < LIMIT)
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
WITH p AS (SELECT page_id, {_LOWER.format("coalesce(url, '')")} AS u, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, u, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
s AS (SELECT page_id, host, path, {strict} AS n_strict, {soft} AS n_soft FROM q),
r AS (SELECT * FROM (VALUES {rules}) t(h, b, v)),
m AS (SELECT host, path, arg_max(h || b, length(h || b)) AS rule, arg_max(v, length(h || b)) AS v FROM (SELECT DISTINCT host, path FROM s), r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, b) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN {LIMIT} * n_strict + n_soft >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft FROM s LEFT JOIN m USING (host, path)"""


URLS = _urls()


def _repair() -> str:
    """The edits by a recursive walk over each conversation's rows, a string of cost and edits for each of four states."""
    add = lambda s, c, e: f"(lpad((substr({s}, 1, 9)::INT + {c})::VARCHAR, 9, '0') || substr({s}, 10) || '{e}')"
    ch = r"[^\x20\x09-\x0D]"
    byte = "list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    return rf"""
WITH RECURSIVE t AS (SELECT {byte} AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS b FROM conversations),
n AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS n FROM k, t),
d AS (SELECT conv_id, turn, CASE WHEN n = 4 THEN 'user' ELSE role END AS role, CASE WHEN n = 1 THEN '' WHEN n = 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM n, unnest(range(CASE WHEN n = 3 THEN 2 ELSE 1 END)) WHERE n <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM d),
f AS (SELECT conv_id, turn, role, text, i, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END AS r,
  CASE WHEN NOT regexp_matches(text, '{ch}') THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 3 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 1 ELSE 0 END AS k FROM o),
w AS (SELECT conv_id, i, r, k, lead(r) OVER (PARTITION BY conv_id ORDER BY i) AS nxt FROM f),
st AS (SELECT conv_id, count(*) FILTER (k = 2) AS blank, count(*) FILTER (k = 3) AS duplicate, count(*) FILTER (k = 1) AS truncated, count(*) FILTER (nxt IS NOT NULL AND r || nxt NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM w GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM d GROUP BY conv_id),
dp AS (SELECT conv_id, 0::BIGINT AS i, '000000000' AS v0, NULL::VARCHAR AS v1, NULL::VARCHAR AS v2, NULL::VARCHAR AS v3 FROM st UNION ALL
  SELECT conv_id, i, {add('w0', 2, 'D')}, least({add('w1', 2, 'D')}, CASE WHEN ok AND r = 's' THEN {add('w0', 'late', 'K')} END),
    least({add('w2', 2, 'D')}, CASE WHEN ok THEN {add('m', '1 + late', 'R')} END, CASE WHEN ok AND r = 'u' THEN {add('m', 'late', 'K')} END),
    least({add('w3', 2, 'D')}, CASE WHEN ok THEN {add('w2', '1 + late', 'R')} END, CASE WHEN ok AND r = 'a' THEN {add('w2', 'late', 'K')} END)
  FROM (SELECT *, least(w0, w1, w3) AS m FROM (SELECT *, least(v3, {add('w2', 5, 'I')}) AS w3 FROM
    (SELECT x.conv_id, f.i, f.r, f.k < 2 AS ok, CASE WHEN f.k = 1 THEN 5 ELSE 0 END AS late, v0 AS w0, v1 AS w1, least(v2, {add('v0', 5, 'I')}, {add('v1', 5, 'I')}, {add('v3', 5, 'I')}) AS w2, v3
     FROM dp x JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.i = x.i + 1)))),
e AS (SELECT dp.conv_id, least(v0, v3, {add('v2', 5, 'I')}, {add('v1', 10, 'II')}) AS v FROM dp JOIN st ON st.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.i = st.n),
a AS (SELECT conv_id, j, substr(v, 9 + j, 1) AS c FROM e, unnest(range(1, length(v) - 8)) u(j)),
b AS (SELECT conv_id, j, c, CASE WHEN c <> 'I' THEN count(*) FILTER (c <> 'I') OVER (PARTITION BY conv_id ORDER BY j) END AS i FROM a),
h AS (SELECT b.conv_id, j, c, f.role, f.text, f.r, row_number() OVER (PARTITION BY b.conv_id ORDER BY j) AS p FROM b LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i WHERE c <> 'D'),
h2 AS (SELECT *, max(CASE WHEN p = 1 AND c = 'K' AND r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS s FROM h),
z AS (SELECT conv_id, sha256(string_agg(CASE WHEN c = 'K' THEN role WHEN (p - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN c = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS h FROM h2 GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(substr(v, 1, 9)::BIGINT, 0) AS cost, coalesce(substr(v, 10), '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM ids.conv_id"""


REPAIR = _repair()
