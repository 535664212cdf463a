"""SQL of the bound tables, for the oracle of each query."""

from __future__ import annotations

from ..functions import stem
from ..functions.text import ANYWHERE, CLARIFICATION, DOC_TYPES, HISTORICAL, SEARCH_STOPWORDS, SHORT, STOPWORDS
from ..operators.index import WORDS
from .bindings import STATUSES

AS_OF = "TIMESTAMP '2024-02-15 00:00:00'"
STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"
SEARCH_STOP = "(" + ", ".join(f"'{w}'" for w in SEARCH_STOPWORDS) + ")"


def q(text: str) -> str:
    return text.replace("'", "''")


CTE = {
    "messages": """turns AS (SELECT conv_id, turn, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS tri
            FROM conversations WHERE role IN ('user', 'assistant')),
        trip AS (SELECT conv_id, tri, coalesce(max(CASE WHEN role = 'user' THEN text END), '') AS user_prompt,
            coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, chr(10) ORDER BY turn), '') AS model_response FROM turns WHERE tri > 0 GROUP BY conv_id, tri),
        messages AS (SELECT conv_id * 1000 + sequence AS message_id, conv_id AS conversation_id, sequence, user_prompt, model_response,
            TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(sequence) AS created_at
            FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY tri) AS sequence FROM trip WHERE user_prompt <> '' OR model_response <> ''))""",
    "mentions": """mentions AS (SELECT l_orderkey * 10 + l_linenumber AS rid, l_suppkey AS entity_id, l_orderkey AS message_id, o_custkey AS conversation_id, l_discount AS relevance, l_shipdate AS created_at
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_orderkey * 10 + l_linenumber, o_custkey, l_discount, l_shipdate) = 1)""",
    "parts": """mentions AS (SELECT DISTINCT l_partkey AS entity_id, l_orderkey AS message_id, o_custkey AS conversation_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "entities": """seen AS (SELECT entity_id, count(*) AS n, min(created_at) AS first_seen_at, max(created_at) AS last_seen_at FROM mentions GROUP BY entity_id),
        entities AS (SELECT s_suppkey AS id, s_suppkey % 6 AS entity_type, s_name AS name, coalesce(n, 0) AS mention_count, first_seen_at, last_seen_at, 0.5::DOUBLE AS salience
            FROM supplier LEFT JOIN seen ON s_suppkey = entity_id)""",
    "variants": """variants AS (SELECT id, entity_type, name, mention_count FROM entities UNION ALL SELECT id + (SELECT 1000 * (max(s_suppkey) // 1000 + 1) FROM supplier), entity_type, 'The ' || name, 0 FROM entities WHERE id % 10 = 1
            UNION ALL SELECT id + 2 * (SELECT 1000 * (max(s_suppkey) // 1000 + 1) FROM supplier), entity_type, name || 's', 0 FROM entities WHERE id % 10 = 2 UNION ALL SELECT id + 3 * (SELECT 1000 * (max(s_suppkey) // 1000 + 1) FROM supplier), entity_type, upper(name), 0 FROM entities WHERE id % 10 = 3)""",
    "points": """points AS (SELECT vec_id AS point_id, embedding::DOUBLE[] AS vector, vec_id % 2 AS collection, vec_id % 40 AS conversation_id, vec_id // 3 AS parent_id, (vec_id % 11) / 10.0::DOUBLE AS salience,
            TIMESTAMP '2024-01-01 00:00:00' + to_hours(vec_id) AS created_at, CASE WHEN vec_id % 4 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(vec_id) END AS last_retrieved FROM embeddings)""",
    "hits": """hits AS (SELECT q.point_id AS qid, p.point_id, p.collection, p.conversation_id, p.parent_id, p.salience, p.created_at, list_cosine_similarity(p.vector, q.vector) AS score
            FROM points p JOIN points q ON q.point_id % 50 = 0 AND p.point_id <> q.point_id QUALIFY row_number() OVER (PARTITION BY q.point_id ORDER BY list_cosine_similarity(p.vector, q.vector) DESC, p.point_id) <= 30)""",
    "outbox": """outbox AS (SELECT event_id AS id, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS operation, user_id % 9 AS entity_type, user_id AS entity_id, props AS payload, ts AS created_at FROM events)""",
    "items": f"""items AS (SELECT 'n' || n_nationkey AS id, 'project' AS entity_type, 'top' AS domain, NULL::VARCHAR AS parent_id, n_name AS title, 'in_progress' AS status, 1::BIGINT AS priority FROM nation
            UNION ALL SELECT 'c' || c_custkey, 'feature', c_mktsegment, 'n' || c_nationkey, c_name, [{', '.join(f"'{s}'" for s in STATUSES)}][c_custkey % 8 + 1], (1 + c_custkey % 5)::BIGINT FROM customer)""",
    "tasks": """tasks AS (SELECT o_orderkey AS id, 'order' AS task_type, 'c' || o_custkey AS target_item_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'completed' ELSE 'processing' END AS status,
            substr(o_orderpriority, 1, 1)::BIGINT AS priority, o_orderdate AS created_at FROM orders)""",
    "words": f"""wordlist AS (SELECT message_id, unnest(w) AS k, generate_subscripts(w, 1) AS place FROM (SELECT message_id, list_filter(regexp_extract_all(lower(user_prompt || ' ' || model_response), '[a-z][a-z0-9_]+'), lambda x: length(x) >= 3 AND x NOT IN {STOP}) AS w FROM messages)),
        wordcount AS (SELECT message_id, k, count(*) AS times, min(place) AS place FROM wordlist GROUP BY message_id, k),
        keywords AS (SELECT message_id, list(k ORDER BY k) AS keywords FROM (SELECT * FROM wordcount QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY times DESC, place) <= 5) GROUP BY message_id)""",
    "metadata": """metadata AS (SELECT message_id, CASE WHEN message_id % 5 <> 0 THEN ((message_id * 37) % 101) / 100.0::DOUBLE END AS quality_score, (message_id * 13) % 5000 AS latency_total_ms, coalesce(keywords, []) AS keywords
            FROM messages LEFT JOIN keywords USING (message_id))""",
    "logs": """logs AS (SELECT event_id AS id, ts AS timestamp, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' ELSE 'INFO' END AS level, 'm' || (user_id % 7) AS module, event_type AS message FROM events)""",
    "registry": """registry AS (SELECT source || '/' || doc_id AS file_path, sha256(text) AS content_hash, lang AS ingestion_type, ['ok', 'failed', 'skipped'][doc_id % 3 + 1] AS status, doc_id % 7 AS entity_count FROM documents)""",
    "docterms": """docterms AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM docterms GROUP BY doc_id, term), dl AS (SELECT doc_id, count(*) AS dl FROM docterms GROUP BY doc_id),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)""",
}
NEEDS = {"entities": ["mentions"], "variants": ["entities"], "hits": ["points"], "words": ["messages"], "metadata": ["words"]}


def with_(names: str, body: str) -> str:
    """A query over bound tables, with the tables that those need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names.split():
        add(n)
    return f"WITH {', '.join(CTE[n] for n in order)} {body}" if order else body


def intent_sql(text: str) -> str:
    """name and confidence of the first rule that fits, as a list of two strings."""
    t = rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"
    short = lambda name: rf"length({t}) < 60 AND regexp_matches({t}, '^({q(SHORT[name])})[\s!?.]*$', 'i')"
    has = lambda name: f"regexp_matches({t}, '{q(ANYWHERE[name])}', 'i')"
    return f"""CASE WHEN {t} = '' THEN ['acknowledgment', '0.9'] WHEN regexp_matches({t}, '^/\\w+') THEN ['command', '1'] WHEN {has('emotional')} THEN ['emotional', '0.8']
        WHEN {short('greeting')} THEN ['greeting', '0.95'] WHEN {short('acknowledgment')} THEN ['acknowledgment', '0.9'] WHEN {short('farewell')} THEN ['farewell', '0.9'] WHEN {short('continuation')} THEN ['continuation', '0.85']
        WHEN regexp_matches({t}, '^({q(CLARIFICATION)})', 'i') THEN ['clarification', '0.8'] WHEN {has('meta')} THEN ['meta', '0.8'] WHEN {has('planning')} THEN ['planning', '0.75'] WHEN {has('knowledge')} THEN ['knowledge', '0.75']
        WHEN {has('creative')} THEN ['creative', '0.7'] WHEN length({t}) > 20 THEN ['knowledge', '0.5'] ELSE ['acknowledgment', '0.4'] END"""


DEPTH = "CASE WHEN {0} IN ('knowledge', 'creative', 'planning') THEN 'full' WHEN {0} IN ('continuation', 'clarification', 'meta') THEN 'light' ELSE 'none' END"
PREPASS = "{0} IN ('emotional', 'knowledge', 'creative', 'planning', 'meta')"


def doc_type_case(text: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}', 'i') THEN '{n}'" for n, p in DOC_TYPES) + " ELSE 'general' END"


def historical(text: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '{p}', 'i')" for p in HISTORICAL) + ")"


def status_case(text: str) -> str:
    word = rf"lower(regexp_extract({text}, '(?:to|as|is)\s+(done|complete|finished|shipped|in.?progress|started|blocked|not.?started|planning|review|archived|pending|processing|failed)', 1, 'i'))"
    return f"CASE WHEN {word} = '' THEN NULL WHEN {word} IN ('done', 'complete', 'finished') THEN 'completed' WHEN {word} = 'started' THEN 'in_progress' ELSE replace(replace({word}, ' ', '_'), '-', '_') END"


def stems(source: str) -> str:
    """Tables st0 to st8 and ``stems`` (word, term): the Porter stem of each word of a table ``source`` (word)."""
    rest = lambda suffix: f"left(w, length(w) - {len(suffix)})"
    has = lambda text, pattern: f"regexp_matches({text}, '{pattern}')"

    def rules(step) -> str:
        case = [f"WHEN ends_with(w, '{x}') THEN " + (f"CASE WHEN {has(rest(x), c)} THEN {rest(x)} || '{r}' ELSE w END" if c else f"{rest(x)} || '{r}'") for x, r, c in stem.longest_first(step)]
        return f"CASE {' '.join(case)} ELSE w END"

    cut = f"CASE WHEN ends_with(w, 'eed') THEN NULL WHEN ends_with(w, 'ed') AND {has(rest('ed'), stem.VOWEL)} THEN {rest('ed')} WHEN ends_with(w, 'ing') AND {has(rest('ing'), stem.VOWEL)} THEN {rest('ing')} END"
    mended = f"CASE WHEN {has('c', '(at|bl|iz)$')} THEN c || 'e' WHEN {has('c', stem.DOUBLE)} THEN left(c, length(c) - 1) WHEN {has('c', stem.ONCE)} AND NOT {has('c', stem.TWICE)} AND {has('c', stem.SHORT)} THEN c || 'e' ELSE c END"
    one_b = f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {has(rest('eed'), stem.ONCE)} THEN {rest('d')} ELSE w END WHEN c IS NOT NULL THEN {mended} ELSE w END"
    one_c = f"CASE WHEN {has('w', '[yY]$')} AND {has(rest('y'), stem.VOWEL)} THEN {rest('y')} || 'i' ELSE w END"
    five_a = f"CASE WHEN ends_with(w, 'e') AND ({has(rest('e'), stem.TWICE)} OR ({has(rest('e'), stem.ONCE)} AND NOT {has(rest('e'), stem.SHORT)})) THEN {rest('e')} ELSE w END"
    five_b = f"CASE WHEN ends_with(w, 'll') AND {has('w', stem.TWICE)} THEN {rest('l')} ELSE w END"
    tables = [f"st0 AS (SELECT DISTINCT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM {source})", f"st1 AS (SELECT word, {rules(stem.STEPS[0])} AS w FROM st0)"]
    tables.append(f"st2 AS (SELECT word, {one_b} AS w FROM (SELECT word, w, {cut} AS c FROM st1))")
    for k, x in enumerate((one_c, *map(rules, stem.STEPS[1:]), five_a, five_b), 3):
        tables.append(f"st{k} AS (SELECT word, {x} AS w FROM st{k - 1})")
    return ", ".join([*tables, f"stems AS (SELECT word, CASE WHEN length(word) > 2 THEN lower(w) ELSE word END AS term FROM st{len(tables) - 1})"])


def index_tables(source: str, queries: str, stemmed: bool = True) -> str:
    """Words of ``source`` (doc_id, text) and asked words of ``queries`` (qid, slot, word) with their terms."""
    w = f"iw AS (SELECT doc_id, unnest(x) AS word, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORDS}') AS x FROM {source})), aw AS ({queries}), "
    both = "every AS (SELECT word FROM iw UNION SELECT word FROM aw), " + (stems("every") if stemmed else "stems AS (SELECT word, word AS term FROM every)")
    return w + both + ", it AS (SELECT doc_id, term, pos FROM iw JOIN stems USING (word)), asked AS (SELECT * FROM aw JOIN stems USING (word))"


#: The words that a text asks for (F11): with a qid and a text, the first ``{most}`` of them.
ASKED_TERMS = f"""SELECT qid, slot, unnest(CASE WHEN regexp_matches(w, '^[0-9]+$') THEN list_distinct([w, lpad(w, greatest(4, length(w))::INTEGER, '0'), lpad(w, greatest(5, length(w))::INTEGER, '0')]) ELSE [w] END) AS word FROM (SELECT qid, unnest(x) AS w, generate_subscripts(x, 1) - 1 AS slot
    FROM (SELECT qid, list_filter(regexp_extract_all(lower(text), '{WORDS}'), lambda w: length(w) > 1 AND w NOT IN {SEARCH_STOP})[1:{{most}}] AS x FROM {{source}}))"""
BEST = """, itf AS (SELECT doc_id, term, count(*) AS tf FROM it GROUP BY 1, 2), idl AS (SELECT doc_id, count(*) AS dl FROM it GROUP BY 1), idf AS (SELECT term, count(*) AS df FROM itf GROUP BY 1), need AS (SELECT qid, count(DISTINCT slot) AS need FROM asked GROUP BY qid),
    part AS (SELECT DISTINCT qid, doc_id, term, ln(1 + ((SELECT count(*) FROM idl) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM idl))) AS part FROM asked JOIN itf USING (term) JOIN idf USING (term) JOIN idl USING (doc_id)),
    slots AS (SELECT qid, doc_id, count(DISTINCT slot) AS n FROM asked JOIN itf USING (term) GROUP BY 1, 2), scored AS (SELECT qid, doc_id, sum(part) AS score FROM part JOIN slots USING (qid, doc_id) JOIN need USING (qid) WHERE n = need GROUP BY 1, 2),
    best AS (SELECT qid, doc_id, round(score, 4) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored QUALIFY rank <= 10)"""
