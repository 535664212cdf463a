"""Every query of the engine with its SQL, over the bound tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..operators import chunks, entities as E, graph as G, index as X, ingest as N, intent as I, quality as Q, replies as P, report as M, retrieve as R
from ..sources.shared import new_path, written
from . import bindings as B
from .sql import AS_OF, ASKED_TERMS, BEST, DEPTH, PREPASS, SEARCH_STOP, STOP, doc_type_case, historical, index_tables, intent_sql, status_case, with_

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(tables: str = "", sql: str | None = None):
    """Register a query; ``tables`` names the bound tables that its SQL needs."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_(tables, sql)
        return f

    return add


def docs(s, d) -> DataFrame:
    return B.table(s, d, "documents")


def long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


# Turns, registries and upserts


@query("messages", "SELECT * FROM messages")
def triplets(s, d):
    return B.messages(s, d)


@query("", """WITH turns AS (SELECT conv_id, turn, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS tri FROM conversations WHERE role IN ('user', 'assistant')),
    t AS (SELECT conv_id, tri, max(CASE WHEN role = 'user' THEN text END) AS user_prompt, max_by(text, turn) FILTER (WHERE role = 'assistant') AS model_response FROM turns WHERE tri > 0 GROUP BY conv_id, tri)
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY tri) AS sequence, user_prompt, model_response FROM t WHERE user_prompt IS NOT NULL AND model_response IS NOT NULL""")
def last_response_turns(s, d):
    return N.google_turns(B.table(s, d, "conversations"))


@query("", r"""SELECT doc_id AS id, doc_id::VARCHAR AS title, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS word_count FROM documents WHERE regexp_matches(text, '\S')""")
def document_heads(s, d):
    return N.document_heads(B.documents(s, d))


@query("registry", """, files AS (SELECT source || '/' || doc_id AS file_path, CASE WHEN doc_id % 10 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS content_hash FROM documents), known AS (SELECT * FROM registry WHERE entity_count <> 6)
    SELECT file_path, f.content_hash, CASE WHEN k.file_path IS NULL THEN 'new' WHEN k.content_hash <> f.content_hash OR k.status = 'failed' THEN 'changed' ELSE 'unchanged' END AS state FROM files f LEFT JOIN known k USING (file_path)""")
def registry_delta(s, d):
    files = docs(s, d).select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path"), F.when(F.col("doc_id") % 10 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256)).alias("content_hash"))
    return N.registry_delta(files, B.registry(s, d).filter("entity_count <> 6"))


@query("", r"""SELECT min(doc_id) AS id FROM documents WHERE substr(text, 1, 40) NOT IN (SELECT substr(text, 1, 40) FROM documents WHERE doc_id % 7 = 0) GROUP BY sha256(trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g')))""")
def new_documents(s, d):
    own = B.documents(s, d)
    return N.new_documents(own, own.filter("id % 7 = 0")).select("id")


@query("items", "SELECT id FROM items WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM items WHERE id <> 'n3')")
def orphans(s, d):
    return N.orphans(B.items(s, d).filter("id <> 'n3'")).select("id")


@query("items", """SELECT id, domain, CASE WHEN id LIKE '%5' THEN 'completed' WHEN id LIKE '%6' THEN NULL ELSE status END AS status, CASE WHEN id LIKE '%5' THEN 9 ELSE priority END AS priority FROM items WHERE id NOT LIKE '%7'
    UNION ALL SELECT 'new', NULL, 'planning', 1""")
def patched_items(s, d):
    own = B.items(s, d).select("id", "domain", "status", "priority")
    digit = F.substring("id", -1, 1)
    status = F.when(digit == "5", "completed").when(digit == "6", "__null__")
    made = lambda at: own.filter(digit.isin("5", "6", "7")).select("id", F.lit(None).cast("string").alias("domain"), F.lit("old").alias("status") if at == 1 else status.alias("status"), F.when(digit == "5", 9).cast("long").alias("priority"), F.lit(at).alias("at"), (digit == "7").alias("deleted"))
    more = s.range(1).select(F.lit("new").alias("id"), F.lit(None).cast("string").alias("domain"), F.lit("planning").alias("status"), F.lit(1).cast("long").alias("priority"), F.lit(3).alias("at"), F.lit(False).alias("deleted"))
    return N.apply_patches(own, made(1).union(made(2)).union(more))


@query("logs", f"SELECT count(*) AS kept, min(id) AS first FROM logs WHERE timestamp >= {AS_OF} - INTERVAL 30 DAYS OR level = 'ERROR'")
def expired_logs(s, d):
    return N.expire(B.logs(s, d), "timestamp", B.AS_OF, 30, F.col("level") != "ERROR").agg(F.count("*").alias("kept"), F.min("id").alias("first"))


@query("messages", "SELECT message_id, 0.0::DOUBLE AS quality_score, '' AS labels FROM messages WHERE message_id % 3 <> 0")
def missing_metadata(s, d):
    own = B.messages(s, d)
    return N.missing_metadata(own, own.filter("message_id % 3 = 0"))


@query("messages", """SELECT message_id, CASE WHEN off THEN born ELSE created_at END AS created_at, off AS repaired FROM (SELECT *, created_at::DATE <> born::DATE AS off FROM (SELECT *, TIMESTAMP '2024-01-02 00:00:00' + to_hours(conversation_id - conversation_id % 10) AS born FROM messages))""")
def repaired_dates(s, d):
    own = B.messages(s, d)
    convs = own.select("conversation_id").distinct().withColumn("created_at", F.timestamp_seconds(F.lit(1704153600) + (F.col("conversation_id") - F.col("conversation_id") % 10) * 3600))
    return N.repaired_dates(own, convs)


@query("", """SELECT id, c AS content, n AS replacements, CASE WHEN n = 0 THEN 'zero' WHEN n > 20 THEN 'high' ELSE 'ok' END AS flag FROM (SELECT doc_id AS id, regexp_replace(regexp_replace(text, 'the ', 'THE ', 'g'), 'er[a-z]+ion', 'X', 'g') AS c,
    len(regexp_extract_all(text, 'the ')) + len(regexp_extract_all(regexp_replace(text, 'the ', 'THE ', 'g'), 'er[a-z]+ion')) AS n FROM documents)""")
def rewritten_texts(s, d):
    return N.rewrite(B.documents(s, d), [("the ", "THE "), ("er[a-z]+ion", "X")])


@query("", r"""SELECT hash, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g'))) AS hash FROM documents) GROUP BY hash HAVING count(*) > 1""")
def duplicate_documents(s, d):
    return N.exact_duplicates(B.documents(s, d), T.content_hash(F.col("content")))


@query("", r"""WITH h AS (SELECT doc_id AS id, sha256(trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g'))) AS hash FROM documents) SELECT id, first_id FROM h JOIN (SELECT hash, min(id) AS first_id FROM h GROUP BY hash) USING (hash) WHERE id <> first_id""")
def duplicate_links(s, d):
    return N.duplicate_links(B.documents(s, d), T.content_hash(F.col("content")))


@query("messages", r"""SELECT conversation_id, sha256(trim(regexp_replace(lower(string_agg('U:' || user_prompt || chr(10) || 'A:' || model_response, chr(10) || '---' || chr(10) ORDER BY sequence)), '[ \t\r\n]+', ' ', 'g'))) AS hash FROM messages GROUP BY conversation_id""")
def conversation_hashes(s, d):
    return T.conversation_hash(B.messages(s, d))


@query("messages", r""", twice AS (SELECT conversation_id, sequence, user_prompt, model_response FROM messages UNION ALL SELECT conversation_id + 1000000, sequence, translate(user_prompt, 'aeiou', 'AEIOU'), model_response || ' ' FROM messages WHERE conversation_id % 10 = 3),
    h AS (SELECT conversation_id AS id, sha256(trim(regexp_replace(lower(string_agg('U:' || user_prompt || chr(10) || 'A:' || model_response, chr(10) || '---' || chr(10) ORDER BY sequence)), '[ \t\r\n]+', ' ', 'g'))) AS hash FROM twice GROUP BY conversation_id) SELECT hash, count(*) AS n, min(id) AS first_id FROM h GROUP BY hash HAVING count(*) > 1""")
def duplicate_conversations(s, d):
    """Equal conversations by F2's hash; every tenth one is there twice, in other letters."""
    own = B.messages(s, d).select("conversation_id", "sequence", "user_prompt", "model_response")
    again = own.filter("conversation_id % 10 = 3").select((F.col("conversation_id") + 1_000_000).alias("conversation_id"), "sequence", F.translate("user_prompt", "aeiou", "AEIOU").alias("user_prompt"), F.concat("model_response", F.lit(" ")).alias("model_response"))
    return N.exact_duplicates(T.conversation_hash(own.union(again)).withColumnRenamed("conversation_id", "id"), F.col("hash"))


# Listings and filters


@query("items", "SELECT id, title, status, priority FROM items WHERE status = 'blocked' AND domain = 'BUILDING' ORDER BY priority, id LIMIT 25")
def filtered_items(s, d):
    return M.listing(B.items(s, d), [F.col("priority"), F.col("id")], 25, status="blocked", domain="BUILDING", parent_id=None).select("id", "title", "status", "priority")


@query("registry", "SELECT file_path, status FROM registry WHERE file_path ILIKE '%SRC1/%'")
def files_like(s, d):
    return M.like(B.registry(s, d), "file_path", "SRC1/").select("file_path", "status")


@query("", "SELECT conv_id, turn, role FROM conversations WHERE starts_with(role, 'sys')")
def turns_by_role(s, d):
    return M.roles(B.table(s, d, "conversations"), prefix="sys").select("conv_id", "turn", "role")


@query("", "SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY event_type")
def typed_json(s, d):
    return B.table(s, d, "events").groupBy("event_type").agg(F.sum(M.json_field("props", "$.k", "long")).alias("k"))


@query("items", """SELECT substr(id, 1, 8) AS id, CASE status WHEN 'not_started' THEN 'Not Started' WHEN 'in_progress' THEN 'In Progress' ELSE upper(status[1]) || substr(status, 2) END AS status, title FROM items""")
def displayed_items(s, d):
    return M.display(B.items(s, d))


@query("messages", "SELECT message_id FROM messages WHERE contains(lower(user_prompt), 'thst') OR contains(lower(user_prompt), 'eron') OR contains(lower(model_response), 'thst') OR contains(lower(model_response), 'eron')")
def signal_messages(s, d):
    return M.signals(B.messages(s, d), ["user_prompt", "model_response"], ["thst", "eron"]).select("message_id")


@query("items", "SELECT id, title, status, priority FROM items WHERE status NOT IN ('completed', 'shipped', 'archived') ORDER BY priority, title, id LIMIT 20")
def active_items(s, d):
    return M.active(B.items(s, d)).select("id", "title", "status", "priority")


@query("logs", "SELECT id, level, module, message FROM logs WHERE level = 'ERROR' AND module ILIKE '%3%' AND timestamp >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY timestamp DESC, id DESC LIMIT 100")
def recent_errors(s, d):
    rows = M.like(B.logs(s, d), "module", "3").filter("timestamp >= timestamp'2024-01-10 00:00:00'")
    return M.listing(rows, [F.desc("timestamp"), F.desc("id")], 100, level="ERROR").select("id", "level", "module", "message")


@query("messages", f"""SELECT message_id, len(w) >= 3 AND len(list_filter(w, lambda x: x NOT IN {SEARCH_STOP})) >= 2 AS needed FROM (SELECT message_id, list_filter(regexp_split_to_array(lower(user_prompt), '\\s+'), lambda x: x <> '') AS w FROM messages)""")
def retrieval_gate(s, d):
    return B.messages(s, d).select("message_id", M.needs_retrieval(F.col("user_prompt"), T.SEARCH_STOPWORDS).alias("needed"))


@query("tasks", "SELECT id, status, p AS priority FROM (SELECT *, ['critical', 'high', 'normal', 'low', 'other'][priority] AS p FROM tasks) WHERE status NOT IN ('completed', 'failed', 'cancelled') ORDER BY CASE p WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'normal' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, created_at, id LIMIT 50")
def open_tasks(s, d):
    names = F.array(*map(F.lit, ["critical", "high", "normal", "low", "other"]))
    return M.open_tasks(B.tasks(s, d).withColumn("priority", F.element_at(names, F.col("priority").cast("int"))), 50).select("id", "status", "priority")


@query("messages", "SELECT DISTINCT conversation_id FROM messages WHERE contains(lower(user_prompt), 'eron') OR contains(lower(model_response), 'thst')")
def conversations_of_matches(s, d):
    low = lambda c: F.lower(c)
    return M.conversations_of(B.messages(s, d), F.contains(low("user_prompt"), F.lit("eron")) | F.contains(low("model_response"), F.lit("thst")))


# Joins


@query("messages outbox", "SELECT c.conversation_id, o.id, o.operation FROM (SELECT DISTINCT conversation_id FROM messages) c LEFT JOIN outbox o ON o.entity_id = c.conversation_id AND o.entity_type = 3")
def conversations_with_changes(s, d):
    own = B.messages(s, d).select("conversation_id").distinct()
    rows = B.outbox(s, d).select(F.col("entity_id").alias("conversation_id"), "entity_type", "id", "operation")
    return M.with_children_of(own, rows, "conversation_id", 3).select("conversation_id", "id", "operation")


@query("mentions", "SELECT count(DISTINCT (least(a.entity_id, b.entity_id), greatest(a.entity_id, b.entity_id))) AS pairs FROM mentions a JOIN mentions b ON a.message_id = b.message_id AND a.entity_id <> b.entity_id")
def distinct_pairs(s, d):
    return M.distinct_pairs(G.dealt_pairs(B.mentions(s, d), "message_id", "entity_id"))


@query("hits", "SELECT qid, count(*) AS used, round(avg(score), 6) AS mean_score, round(avg(salience), 6) AS mean_salience FROM hits WHERE point_id % 3 = 0 GROUP BY qid")
def used_means(s, d):
    return M.used_means(_hits(s, d), F.col("point_id") % 3 == 0).select("qid", "used", F.round("mean_score", 6).alias("mean_score"), F.round("mean_salience", 6).alias("mean_salience"))


@query("metadata", "SELECT m.message_id, conversation_id, coalesce(quality_score, 0) AS quality_score, latency_total_ms FROM messages m LEFT JOIN metadata USING (message_id)")
def messages_with_metadata(s, d):
    return B.messages(s, d).join(B.metadata(s, d), "message_id", "left").select("message_id", "conversation_id", F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"), "latency_total_ms")


@query("items tasks", """, n AS (SELECT id FROM items WHERE id IN ('c1', 'c2', 'c3')), rels AS (SELECT id::VARCHAR AS source_id, target_item_id AS target_id FROM tasks)
    SELECT n.id, 'out' AS direction, target_id AS other, 'implements' AS relationship_type FROM rels JOIN n ON source_id = n.id UNION ALL SELECT n.id, 'in', source_id, 'implements' FROM rels JOIN n ON target_id = n.id""")
def edges_touching(s, d):
    return M.edges_touching(B.relationships(s, d), B.items(s, d).filter(F.col("id").isin("c1", "c2", "c3")).select("id"))


@query("mentions entities", "SELECT e.id, e.name, r.recent FROM entities e LEFT JOIN (SELECT entity_id AS id, list(message_id ORDER BY n) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, message_id DESC) AS n FROM mentions) WHERE n <= 20 GROUP BY entity_id) r USING (id)")
def entity_with_mentions(s, d):
    child = B.mentions(s, d).withColumnRenamed("entity_id", "id")
    return M.with_recent_children(B.entities(s, d), child, "id", [F.desc("created_at"), F.desc("message_id")], "message_id").select("id", "name", "recent")


@query("items", "SELECT DISTINCT p.id, p.title FROM items p JOIN items c ON c.parent_id = p.id")
def parent_items(s, d):
    return M.parents(B.items(s, d))


# Aggregates and windows


@query("items", "SELECT 'status' AS metric, status AS value, count(*) AS n FROM items GROUP BY status UNION ALL SELECT 'domain', domain, count(*) FROM items GROUP BY domain UNION ALL SELECT 'kind', entity_type, count(*) FROM items GROUP BY entity_type")
def item_counts(s, d):
    return M.count_by(B.items(s, d), status="status", domain="domain", kind="entity_type")


@query("", """SELECT c.conv_id, coalesce(turns, 0) AS turns, last_turn, coalesce(chars, 0)::BIGINT AS chars, coalesce(tokens, 0)::BIGINT AS tokens FROM (SELECT conv_id FROM conversations UNION SELECT -1 - doc_id FROM documents) c
    LEFT JOIN (SELECT conv_id, count(*) AS turns, max(turn) AS last_turn, sum(length(text)) AS chars, sum(ceil(length(text) / 4)) AS tokens FROM conversations GROUP BY conv_id) t ON t.conv_id = c.conv_id""")
def conversation_rollup(s, d):
    own = B.table(s, d, "conversations")
    return M.conversation_rollup(own, own.select("conv_id").union(docs(s, d).select((-1 - F.col("doc_id")).alias("conv_id"))).distinct())


@query("registry", "SELECT ingestion_type, min(entity_count) AS least, max(entity_count) AS most, round(avg(entity_count), 6) AS mean, sum(entity_count)::BIGINT AS total, count(*) FILTER (WHERE status = 'failed') AS failed FROM registry GROUP BY ingestion_type")
def registry_totals(s, d):
    return B.registry(s, d).groupBy("ingestion_type").agg(F.min("entity_count").alias("least"), F.max("entity_count").alias("most"), F.round(F.avg("entity_count"), 6).alias("mean"), F.sum("entity_count").alias("total"), F.count_if(F.col("status") == "failed").alias("failed"))


@query("docterms", "SELECT term, df FROM df")
def document_frequency(s, d):
    return M.document_frequency(docs(s, d), T.tokens(F.col("text"), "[a-z]{3,}"))


@query("docterms", "SELECT term, df FROM df WHERE df >= greatest(5, floor((SELECT count(*) FROM documents) * 0.2)) ORDER BY df DESC, term LIMIT 500")
def batch_stopwords(s, d):
    own = docs(s, d)
    return M.batch_stopwords(M.document_frequency(own, T.tokens(F.col("text"), "[a-z]{3,}")), own.count(), 0.2)


@query("metadata", "SELECT keyword, count(*) AS n FROM (SELECT unnest(keywords) AS keyword FROM (SELECT * FROM metadata WHERE quality_score IS NOT NULL ORDER BY message_id DESC LIMIT 50)) GROUP BY keyword ORDER BY n DESC, keyword LIMIT 5")
def introspection(s, d):
    return M.introspection(B.metadata(s, d))


@query("metadata", """, last AS (SELECT *, CASE WHEN message_id % 2 = 0 THEN 'because ' || message_id END AS rationale FROM metadata WHERE quality_score IS NOT NULL ORDER BY message_id DESC LIMIT 50)
    SELECT count(*) AS rows, round(avg(quality_score), 6) AS mean_score, (SELECT string_agg(rationale, ';' ORDER BY message_id DESC) FROM (SELECT * FROM last WHERE rationale IS NOT NULL ORDER BY message_id DESC LIMIT 3)) AS rationales,
        (SELECT string_agg(keyword, ';' ORDER BY n DESC, keyword) FROM (SELECT keyword, count(*) AS n FROM (SELECT unnest(keywords) AS keyword FROM last) GROUP BY keyword ORDER BY n DESC, keyword LIMIT 5)) AS keywords FROM last""")
def introspection_summary(s, d):
    meta = B.metadata(s, d).withColumn("rationale", F.when(F.col("message_id") % 2 == 0, F.concat(F.lit("because "), F.col("message_id").cast("string"))))
    joined = [F.array_join(c, ";").alias(c) for c in ("rationales", "keywords")]
    return M.introspection_summary(meta).select("rows", F.round("mean_score", 6).alias("mean_score"), *joined)


@query("", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def last_turns(s, d):
    return M.last_n(B.table(s, d, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role")


@query("", "SELECT conv_id, turn AS old_turn, coalesce((SELECT max(turn) FROM conversations c WHERE c.conv_id = a.conv_id AND c.turn < 3), 0) + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn FROM conversations a WHERE turn >= 3")
def next_sequence(s, d):
    own = B.table(s, d, "conversations")
    return M.next_sequence(own.filter("turn < 3"), own.filter("turn >= 3").select("conv_id", F.col("turn").alias("old_turn")), "conv_id", "turn", "old_turn").select("conv_id", "old_turn", *long("turn"))


@query("messages", "SELECT message_id, previous FROM (SELECT message_id, lag(message_id) OVER (PARTITION BY conversation_id ORDER BY sequence) AS previous FROM messages) WHERE previous IS NOT NULL")
def follows_edges(s, d):
    return G.follows(B.messages(s, d))


@query("logs", "SELECT module, id, level FROM logs QUALIFY row_number() OVER (PARTITION BY module ORDER BY id DESC) = 1")
def latest_log(s, d):
    return M.latest_by(B.logs(s, d), "module", "id").select("module", "id", "level")


@query("", """SELECT event_id, minutes, CASE WHEN minutes IS NULL THEN 'first' WHEN minutes < 5 THEN 'now' WHEN minutes < 30 THEN 'soon' WHEN minutes < 120 THEN 'later' WHEN minutes < 480 THEN 'day' ELSE 'long' END AS band
    FROM (SELECT event_id, floor((epoch(ts)::BIGINT - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT) / 60)::BIGINT AS minutes FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events))""")
def elapsed_bands(s, d):
    rows = B.table(s, d, "events").withColumn("ts", F.date_trunc("second", "ts"))
    return M.elapsed_bands(rows, "user_id", "ts", "event_id", [5, 30, 120, 480], ["now", "soon", "later", "day", "long"]).select("event_id", *long("minutes"), "band")


_DRAWN = "(SELECT id, content, -ln((('0x' || substr(md5(id || ':{seed}'), 1, 8))::BIGINT + 0.5) / 4294967296) / weight AS key FROM {rows} WHERE weight > 0 QUALIFY row_number() OVER (ORDER BY key, id) <= 3)"


def _drawn(k: int, kind: str, rows: str) -> str:
    return f"SELECT (row_number() OVER (ORDER BY key, id) - 1) * 4 + {k} AS turn, '{kind}' AS kind, id, substr(content, 1, 1200) AS content FROM " + _DRAWN.format(seed=11 + k, rows=rows)


_KINDS = (
    ("fragment", "(SELECT point_id AS id, salience AS weight, 'point ' || point_id AS content FROM points WHERE collection = 0 AND salience >= 0.65)"),
    ("document", "(SELECT doc_id AS id, 1.0::DOUBLE AS weight, text AS content FROM documents WHERE length(text) > 80)"),
    ("exchange", "(SELECT message_id AS id, quality_score AS weight, substr(user_prompt, 1, 400) || chr(10) || chr(10) || substr(model_response, 1, 600) AS content FROM metadata JOIN messages USING (message_id) WHERE quality_score >= 0.7 AND user_prompt <> '' AND model_response <> '')"),
    ("source", "(SELECT point_id AS id, salience AS weight, 'point ' || point_id AS content FROM points WHERE collection = 1 AND salience >= 0.6)"),
)


@query("points metadata", " UNION ALL ".join(_drawn(k, kind, rows) for k, (kind, rows) in enumerate(_KINDS)))
def surfaced_memories(s, d):
    """K5: what comes up in twelve turns, of four kinds in rotation."""
    pts = B.points(s, d).select(F.col("point_id").alias("id"), F.col("salience").alias("weight"), F.concat(F.lit("point "), F.col("point_id").cast("string")).alias("content"), "collection")
    said = F.concat(F.substring("user_prompt", 1, 400), F.lit("\n\n"), F.substring("model_response", 1, 600))
    both = B.metadata(s, d).filter("quality_score >= 0.7").join(B.messages(s, d).filter("user_prompt <> '' and model_response <> ''").hint("merge"), "message_id")
    kinds = {
        "fragment": pts.filter("collection = 0 and weight >= 0.65"),
        "document": docs(s, d).filter("length(text) > 80").select(F.col("doc_id").alias("id"), F.lit(1.0).alias("weight"), F.col("text").alias("content")),
        "exchange": both.select(F.col("message_id").alias("id"), F.col("quality_score").alias("weight"), said.alias("content")),
        "source": pts.filter("collection = 1 and weight >= 0.6"),
    }
    return M.surfaced(kinds, 12, 11)


# Text functions


@query("", r"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g'))) AS hash FROM documents")
def content_hashes(s, d):
    return docs(s, d).select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query("messages", "SELECT message_id, substr('Q: ' || user_prompt || chr(10) || 'A: ' || model_response, 1, 20000) AS text FROM messages")
def composed_messages(s, d):
    return B.messages(s, d).select("message_id", T.compose_qa(F.col("user_prompt"), F.col("model_response")).alias("text"))


@query("messages", r"""SELECT message_id, substr(substr(t, 4, instr(t, chr(10) || 'A: ') - 4), 1, 200) AS prompt, substr(substr(t, instr(t, chr(10) || 'A: ') + 4), 1, 200) AS response FROM (SELECT message_id, 'Q: ' || user_prompt || chr(10) || 'A: ' || model_response AS t FROM messages)""")
def split_messages(s, d):
    own = B.messages(s, d).select("message_id", T.compose_qa(F.col("user_prompt"), F.col("model_response")).alias("t"))
    prompt, response = T.split_qa(F.col("t"))
    return own.select("message_id", prompt.alias("prompt"), response.alias("response"))


@query("", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents")
def cleaned_texts(s, d):
    return docs(s, d).select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query("words", "SELECT message_id AS id, k AS keyword, times, row_number() OVER (PARTITION BY message_id ORDER BY times DESC, w.place) AS place FROM wordcount w QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY times DESC, w.place) <= 10")
def message_keywords(s, d):
    own = B.messages(s, d).select(F.col("message_id").alias("id"), F.concat_ws(" ", "user_prompt", "model_response").alias("text"))
    return T.keywords(own, 10).select("id", "keyword", "times", *long("place"))


@query("messages", f"SELECT message_id, CASE WHEN dd < 0 THEN '' WHEN dd = 0 THEN 'today' WHEN dd = 1 THEN 'yesterday' WHEN dd < 7 THEN dd || ' days ago' WHEN dd < 14 THEN '1 week ago' WHEN dd < 30 THEN (dd // 7) || ' weeks ago' WHEN dd < 60 THEN '1 month ago' ELSE (dd // 30) || ' months ago' END AS ago FROM (SELECT message_id, floor((epoch({AS_OF}) - epoch(created_at)) / 86400)::BIGINT AS dd FROM messages)")
def relative_times(s, d):
    return B.messages(s, d).select("message_id", T.relative_time(F.col("created_at"), B.AS_OF).alias("ago"))


@query("messages", f"SELECT message_id, i[1] AS intent, i[2]::DOUBLE AS confidence, {DEPTH.format('i[1]')} AS depth, {PREPASS.format('i[1]')} AS prepass, historical FROM (SELECT message_id, {intent_sql('user_prompt')} AS i, {historical('user_prompt')} AS historical FROM messages)")
def message_intents(s, d):
    p = F.col("user_prompt")
    return B.messages(s, d).select("message_id", T.route(p).alias("r"), T.is_historical(p).alias("historical")).select("message_id", "r.*", "historical")


@query("", f"SELECT doc_id, {doc_type_case('text')} AS doc_type FROM documents")
def document_types(s, d):
    return docs(s, d).select("doc_id", T.doc_type(F.col("text")).alias("doc_type"))


@query("entities variants", "SELECT id, trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS name FROM variants")
def normal_names(s, d):
    return B.entities(s, d, True).select("id", T.normal_name(F.col("name")).alias("name"))


@query("", """SELECT event_id, CASE WHEN h BETWEEN 5 AND 7 THEN 'early morning' WHEN h BETWEEN 8 AND 11 THEN 'morning' WHEN h BETWEEN 12 AND 16 THEN 'afternoon' WHEN h BETWEEN 17 AND 20 THEN 'evening' ELSE 'night' END AS part,
    CASE WHEN h BETWEEN 5 AND 11 THEN 'Good morning' WHEN h BETWEEN 12 AND 16 THEN 'Good afternoon' ELSE 'Good evening' END AS greeting,
    CASE WHEN m IN (12, 1, 2) THEN 'winter' WHEN m < 6 THEN 'spring' WHEN m < 9 THEN 'summer' ELSE 'fall' END AS season, round(2 * half, 6) AS daylight, round(noon - half, 6) AS sunrise, round(noon + half, 6) AS sunset,
    [-2, 3, 16, 30, 43, 53, 58, 55, 44, 31, 17, 2][m] AS low, [17, 23, 36, 53, 67, 76, 82, 80, 69, 55, 36, 21][m] AS high
    FROM (SELECT *, degrees(acos(-tan(radians(52.5)) * tan(radians(23.45 * sin(radians(360.0 / 365 * (dy - 81))))))) / 15 AS half, 12 + (1.0 * 15 - 13.4) / 15 AS noon FROM (SELECT event_id, hour(ts) AS h, month(ts) AS m, dayofyear(ts) AS dy FROM events))""")
def event_seasons(s, d):
    t = F.col("ts")
    rise, fall = T.sunrise_sunset(t, 52.5, 13.4, 1.0)
    low, high = T.climate(t)
    plain = [T.time_of_day(t).alias("part"), T.greeting(t).alias("greeting"), T.season(t, 52.5).alias("season"), low.alias("low"), high.alias("high")]
    hours = [F.round(c, 6).alias(n) for n, c in (("daylight", T.daylight_hours(t, 52.5)), ("sunrise", rise), ("sunset", fall))]
    return B.table(s, d, "events").select("event_id", *plain, *hours)


@query("messages", f"SELECT message_id, {status_case('user_prompt')} AS status FROM messages")
def status_phrases(s, d):
    return B.messages(s, d).select("message_id", T.status_enum(F.col("user_prompt")).alias("status"))


@query("messages", "SELECT message_id, CASE WHEN length(user_prompt) + length(model_response) > 0 THEN floor(1000 * length(user_prompt) / (length(user_prompt) + length(model_response)))::BIGINT ELSE 0 END AS tokens FROM messages")
def token_split(s, d):
    return B.messages(s, d).select("message_id", T.split_tokens(F.lit(1000), F.col("user_prompt"), F.col("model_response")).cast("long").alias("tokens"))


@query("messages", r"""SELECT message_id, CASE WHEN model_response = '' THEN 0.0 ELSE greatest(0.0, least(1.0, round(0.5 + CASE WHEN n < 10 THEN -0.15 WHEN n > 100 THEN 0.1 ELSE 0 END - CASE WHEN np > 20 AND n / np < 0.3 THEN 0.1 ELSE 0 END
    - CASE WHEN n > 20 AND coalesce(repeated, 0) > 3 THEN 0.15 ELSE 0 END - CASE WHEN phrases >= 2 THEN 0.1 ELSE 0 END, 3))) END::DOUBLE AS score
    FROM (SELECT *, len(w) AS n, CASE WHEN user_prompt = '' THEN 1 ELSE len(list_filter(regexp_split_to_array(user_prompt, '\s+'), lambda x: x <> '')) END AS np, len(list_filter(['i hope this helps', 'let me know if', 'feel free to', 'i''d be happy to', 'is there anything else'], lambda p: contains(lower(model_response), p))) AS phrases
        FROM (SELECT *, list_filter(regexp_split_to_array(lower(model_response), '\s+'), lambda x: x <> '') AS w FROM messages)) m
    LEFT JOIN (SELECT message_id, count(*) AS repeated FROM (SELECT message_id, run FROM (SELECT message_id, array_to_string(w[i:i + 3], ' ') AS run FROM (SELECT message_id, list_filter(regexp_split_to_array(lower(model_response), '\s+'), lambda x: x <> '') AS w FROM messages), unnest(range(1, len(w) - 2)) t(i)) GROUP BY 1, 2 HAVING count(*) > 2) GROUP BY 1) USING (message_id)""")
def quality_scores(s, d):
    return B.messages(s, d).select("message_id", T.quality_score(F.col("user_prompt"), F.col("model_response")).alias("score"))


@query("", "SELECT o_orderkey, date_sub('year', o_orderdate::DATE, DATE '2024-02-15')::INTEGER AS years FROM orders")
def whole_years(s, d):
    return B.table(s, d, "orders").select("o_orderkey", T.age_years(F.col("o_orderdate"), "2024-02-15").alias("years"))


# Retrieval

TERMS = [(1, "the"), (1, "ing"), (2, "ion"), (2, "that"), (3, "and"), (3, "with"), (3, "for")]


@query("docterms", "SELECT qid, doc_id, round(sum(ln(1 + ((SELECT count(*) FROM dl) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dl)))), 4) AS score FROM (VALUES (1, 'the'), (1, 'ing'), (2, 'ion'), (2, 'that'), (3, 'and'), (3, 'with'), (3, 'for')) q(qid, term) JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id) GROUP BY qid, doc_id HAVING count(*) = CASE WHEN qid = 3 THEN 3 ELSE 2 END")
def keyword_search(s, d):
    return R.bm25(docs(s, d), s.createDataFrame(TERMS, "qid int, term string")).select("qid", "doc_id", F.round("score", 4).alias("score"))


@query("", "SELECT qid, doc_id FROM documents JOIN (VALUES (1, ' of the '), (2, ' in the ')) q(qid, p) ON contains(' ' || array_to_string(regexp_extract_all(lower(text), '[a-z]+'), ' ') || ' ', p)")
def phrase_search(s, d):
    return R.phrase_search(docs(s, d), s.createDataFrame([(1, "of the"), (2, "in the")], "qid int, phrase string"))


def _index(s, rows: DataFrame, stem: bool = True) -> X.Index:
    """An index of rows (doc_id, text), in the shared folder."""
    return X.build(rows, new_path(s, "index"), stem=stem)


def _asked(rows: DataFrame, most: int = 3, which: str = "doc_id % 50 = 0") -> DataFrame:
    """What every fiftieth row asks for: the first words of its text that a search counts."""
    return X.terms_of(rows.filter(which).select(F.col("doc_id").alias("qid"), "text"), T.SEARCH_STOPWORDS, most)


def _ranked(found: DataFrame) -> DataFrame:
    return found.select("qid", "doc_id", *long("rank"), F.round("score", 4).alias("score"))


def _message_texts(s, d) -> DataFrame:
    return B.messages(s, d).select(F.col("message_id").alias("doc_id"), F.concat_ws(" ", "user_prompt", "model_response").alias("text"))


#: Message ids are conversation * 1000 + place: the first message of every fiftieth conversation.
_FIRST = "doc_id % 50000 = 1"
_OWN = "own AS (SELECT {0} AS doc_id, {1} AS text FROM {2}), qs AS (SELECT doc_id AS qid, text FROM own WHERE doc_id % 50 = 0), "
_MESSAGES = _OWN.format("message_id", "user_prompt || ' ' || model_response", "messages").replace("doc_id % 50 = 0", _FIRST)


@query("", "WITH " + _OWN.format("doc_id", "text", "documents") + index_tables("own", ASKED_TERMS.format(most=3, source="qs")) + BEST + " SELECT qid, doc_id, rank, score FROM best")
def indexed_documents(s, d):
    """R1, R3, R4 over documents, through a kept index of stems."""
    rows = docs(s, d).select("doc_id", "text")
    return _ranked(_index(s, rows).search(_asked(rows), 10))


@query("messages", ", " + _MESSAGES + index_tables("own", ASKED_TERMS.format(most=3, source="qs")) + BEST + " SELECT qid, doc_id, rank, score FROM best")
def indexed_messages(s, d):
    """R1, R3, R4 over messages."""
    rows = _message_texts(s, d)
    return _ranked(_index(s, rows).search(_asked(rows, 3, _FIRST), 10))


@query("variants", ", " + _OWN.format("id", "name", "variants") + index_tables("own", ASKED_TERMS.format(most=3, source="qs"), False) + BEST + " SELECT qid, doc_id, rank, score FROM best")
def indexed_entities(s, d):
    """R1 over entities, whose index keeps words as they are."""
    rows = B.entities(s, d, True).select(F.col("id").alias("doc_id"), F.col("name").alias("text"))
    return _ranked(_index(s, rows, stem=False).search(_asked(rows), 10))


@query()
def indexed_everywhere(s, d):
    """Messages, chunks of documents, documents and entities, for the first message of every fiftieth conversation."""
    parts = chunks.chunk(B.documents(s, d).select("id", "content")).select((F.col("id") * 100_000 + F.col("chunk_index")).alias("doc_id"), F.col("chunk_text").alias("text"))
    names = B.entities(s, d, True).select(F.col("id").alias("doc_id"), F.col("name").alias("text"))
    own = {"messages": _index(s, _message_texts(s, d)), "chunks": _index(s, parts), "documents": _index(s, docs(s, d).select("doc_id", "text")), "entities": _index(s, names, stem=False)}
    return X.everywhere(own, written(_asked(_message_texts(s, d), 2, _FIRST), "asked"))


@query("", "WITH " + _OWN.format("doc_id", "text", "documents") + index_tables("own", "SELECT doc_id AS qid, pos - 1 AS slot, word FROM iw WHERE doc_id % 50 = 0 AND pos <= 2") + """, need AS (SELECT qid, count(*) AS need FROM asked GROUP BY qid)
    SELECT DISTINCT qid, doc_id FROM (SELECT qid, doc_id, pos - slot AS start, count(*) AS n FROM asked JOIN it USING (term) GROUP BY 1, 2, 3) JOIN need USING (qid) WHERE n = need""")
def indexed_phrases(s, d):
    """R2: documents that hold the first two words of every fiftieth document in a row, by their stems."""
    rows = docs(s, d).select("doc_id", "text")
    first = F.array_join(F.slice(X.words(F.col("text")), 1, 2), " ")
    return _index(s, rows).phrases(rows.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), first.alias("phrase")))


@query("", "WITH " + _OWN.format("doc_id", "CASE WHEN doc_id % 10 = 3 THEN text || ' zusatz' ELSE text END", "documents WHERE doc_id % 10 <> 2") + index_tables("own", ASKED_TERMS.format(most=2, source="qs")) + BEST + " SELECT qid, doc_id, rank, score FROM best")
def indexed_after_update(s, d):
    """R4 by delta: an index of nine documents in ten, then new, changed and deleted ones in a segment of their own."""
    rows, digit = docs(s, d).select("doc_id", "text"), F.col("doc_id") % 10
    now = rows.filter(digit != 2).withColumn("text", F.when(digit == 3, F.concat("text", F.lit(" zusatz"))).otherwise(F.col("text")))
    index = _index(s, rows.filter(digit != 0))
    states = rows.select("doc_id", F.when(digit == 0, "new").when(digit == 2, "deleted").when(digit == 3, "changed").otherwise("unchanged").alias("state"))
    return _ranked(X.update(index, now, states, 1).search(_asked(now, 2), 10))


def _queries(s, d) -> DataFrame:
    return B.points(s, d).filter("point_id % 50 = 0").select(F.col("point_id").alias("qid"), "vector")


def _hits(s, d, k: int = 30) -> DataFrame:
    return R.vector_search(B.points(s, d), _queries(s, d), k)


@query("hits", "SELECT qid, point_id, round(score, 4) AS score FROM hits QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, point_id) <= 10")
def vector_search(s, d):
    return _hits(s, d, 10).select("qid", "point_id", F.round("score", 4).alias("score"))


@query("points", "SELECT q.point_id AS qid, p.point_id, round(list_cosine_similarity(p.vector, q.vector), 4) AS score FROM points p JOIN points q ON q.point_id % 50 = 0 AND p.point_id <> q.point_id WHERE p.collection = 1 AND p.salience BETWEEN 0.3 AND 0.8 QUALIFY row_number() OVER (PARTITION BY q.point_id ORDER BY list_cosine_similarity(p.vector, q.vector) DESC, p.point_id) <= 5")
def filtered_vector_search(s, d):
    rows = B.points(s, d).filter("collection = 1 and salience between 0.3 and 0.8")
    return R.vector_search(rows, _queries(s, d), 5).select("qid", "point_id", F.round("score", 4).alias("score"))


@query("points", "SELECT qid, point_id, collection, round(score, 4) AS score FROM (SELECT * FROM (SELECT q.point_id AS qid, p.point_id, p.collection, list_cosine_similarity(p.vector, q.vector) AS score FROM points p JOIN points q ON q.point_id % 50 = 0 AND p.point_id <> q.point_id) QUALIFY row_number() OVER (PARTITION BY qid, collection ORDER BY score DESC, point_id) <= 5) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, point_id) <= 6")
def search_all_collections(s, d):
    own = B.points(s, d)
    each = [R.vector_search(own.filter(F.col("collection") == c), _queries(s, d), 5).drop("rank") for c in (0, 1)]
    return R.top_k(each[0].union(each[1]), ["qid"], [F.desc("score"), F.col("point_id")], 6).select("qid", "point_id", "collection", F.round("score", 4).alias("score"))


@query("hits", """, first AS (SELECT qid, point_id, 0 AS source, score FROM hits WHERE salience > 0.5 UNION ALL SELECT qid, point_id, 1, score FROM hits) SELECT qid, point_id, min(source)::INTEGER AS source FROM first GROUP BY qid, point_id""")
def hybrid_merge(s, d):
    hits = _hits(s, d).select("qid", "point_id", "score", "salience")
    return R.first_wins([hits.filter("salience > 0.5"), hits], ["qid", "point_id"]).select("qid", "point_id", "source")


@query("hits mentions", """, pairs AS (SELECT a.entity_id AS a, b.entity_id AS b, count(DISTINCT a.message_id)::DOUBLE AS weight FROM mentions a JOIN mentions b ON a.message_id = b.message_id AND a.entity_id < b.entity_id GROUP BY 1, 2 HAVING count(*) >= 2),
    two AS (SELECT a, b, weight FROM pairs UNION ALL SELECT b, a, weight FROM pairs),
    best AS (SELECT qid, conversation_id FROM (SELECT qid, conversation_id, avg(score) AS m FROM hits GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(m, 9) DESC, conversation_id) <= 3),
    near AS (SELECT qid, b AS conversation_id, max(weight) AS w FROM (SELECT qid, a, b, weight FROM best JOIN two ON conversation_id = a QUALIFY row_number() OVER (PARTITION BY qid, a ORDER BY weight DESC, b) <= 10) GROUP BY 1, 2)
    SELECT h.qid, h.point_id, coalesce(0.001 * w, 0.0)::DOUBLE AS graph_boost, round(h.score + coalesce(0.001 * w, 0.0), 4) AS score FROM hits h LEFT JOIN (SELECT * FROM near WHERE NOT EXISTS (SELECT 1 FROM best WHERE best.qid = near.qid AND best.conversation_id = near.conversation_id)) n ON n.qid = h.qid AND n.conversation_id = h.conversation_id""")
def graph_affinity(s, d):
    edges = G.cooccurrence(B.mentions(s, d), "message_id").select("a", "b", F.col("weight").cast("double").alias("weight"))
    return R.graph_affinity(_hits(s, d), edges, 0.001).select("qid", "point_id", "graph_boost", F.round("score", 4).alias("score"))


def _selected(s, d) -> DataFrame:
    hits = _hits(s, d).drop("rank")
    scored = hits.withColumn("decayed", R.temporal_decay(F.col("score"), F.col("created_at"), B.AS_OF))
    return scored.withColumn("score", R.composite(F.col("decayed"), F.col("salience"))).withColumn("n_chars", 30 + (F.col("point_id") * 7) % 300)


_SCORED = f""", scored AS (SELECT qid, point_id, parent_id, salience, score * (0.15 + 0.85 * exp(-greatest(0, floor((epoch({AS_OF}) - epoch(created_at)) / 86400)) / 14.0)) AS decayed, 30 + (point_id * 7) % 300 AS n_chars FROM hits),
    final AS (SELECT *, CASE WHEN salience = 0 OR salience = 0.5 THEN decayed ELSE decayed * (0.5 + salience) END AS score FROM scored),
    ranked AS (SELECT *, n_chars >= 50 AND score > 0.05 AS ok, row_number() OVER (PARTITION BY qid, n_chars >= 50 AND score > 0.05, parent_id ORDER BY score DESC, point_id) AS pr FROM final),
    counted AS (SELECT *, coalesce(sum(CASE WHEN ok AND pr <= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY score DESC, point_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked)"""


@query("hits", _SCORED + """ SELECT qid, point_id, round(score, 4) AS score, CASE WHEN n_chars < 50 THEN 'short' WHEN score <= 0.05 THEN 'score' WHEN before >= 6 THEN 'over max' WHEN pr > 1 THEN 'diversity' END AS reason FROM counted""")
def selected_context(s, d):
    return R.select_context(_selected(s, d), 0.05, 6, 1).select("qid", "point_id", F.round("score", 4).alias("score"), "reason")


@query("hits", _SCORED + """ SELECT qid, point_id, round(score, 4) AS score FROM counted WHERE n_chars >= 50 AND score > 0.05 AND before < 6 AND pr <= 1""")
def retrieve(s, d):
    """The flagship: vector hits, decay, salience and selection in one plan."""
    return R.select_context(_selected(s, d), 0.05, 6, 1).filter("reason is null").select("qid", "point_id", F.round("score", 4).alias("score"))


@query("hits", "SELECT qid, point_id, round(score, 4) AS score FROM (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, point_id) <= 5) WHERE score > 0.05 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, point_id) <= 3")
def light_context(s, d):
    return R.light_context(_hits(s, d).drop("rank"), 0.05).select("qid", "point_id", F.round("score", 4).alias("score"))


@query("words", """, k AS (SELECT message_id, list(k) AS w FROM (SELECT * FROM wordcount QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY times DESC, place) <= 15) GROUP BY message_id)
    SELECT a.message_id, round(len(list_intersect(a.w, b.w)) / len(a.w), 6) AS usage FROM k a JOIN k b ON b.message_id = a.message_id + 1""")
def usage_signals(s, d):
    own = B.messages(s, d).select(F.col("message_id").alias("id"), F.concat_ws(" ", "user_prompt", "model_response").alias("text"))
    k = T.keywords(own, 15).groupBy("id").agg(F.collect_list("keyword").alias("w"))
    nxt = k.select((F.col("id") - 1).alias("id"), F.col("w").alias("v"))
    return k.join(nxt.hint("merge"), "id").select(F.col("id").alias("message_id"), F.round(R.usage_signal(F.col("w"), F.col("v")), 6).alias("usage"))


@query("hits", "SELECT qid, point_id, coalesce(r, 0.0)::DOUBLE AS rerank FROM (SELECT qid, point_id, CASE WHEN point_id % 2 = 0 THEN (point_id * 7 % 100) / 100.0 END AS r FROM hits) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY coalesce(r, 0.0) DESC, point_id) <= 8")
def reranked(s, d):
    hits = _hits(s, d)
    scores = hits.filter("point_id % 2 = 0").select("qid", "point_id", (F.col("point_id") * 7 % 100 / 100).alias("rerank"))
    return R.rerank(hits, scores, 8).select("qid", "point_id", "rerank")


@query("hits", """, u AS (SELECT point_id, list(((qid // 50) * 7 % 11) / 10.0::DOUBLE ORDER BY qid) AS u, any_value(salience)::DOUBLE AS s FROM hits GROUP BY point_id)
    SELECT point_id, round(list_reduce(list_prepend(s, u), lambda s, u: CASE WHEN u > 0.3 THEN least(1.0, s + 0.03 * u) WHEN u < 0.1 THEN greatest(0.1, s - 0.01) ELSE s END), 9) AS salience, round(list_reduce(list_prepend(s, u), lambda s, u: least(1.0, s + 0.05 * u)), 9) AS reranked FROM u""")
def salience_feedback(s, d):
    """Salience of each found point after its usages, and after rerank scores, in the order of the queries."""
    used = _hits(s, d).groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("qid", (F.floor(F.col("qid") / 50) * 7 % 11 / 10).alias("u")))).alias("u"), F.first("salience").alias("s"))
    u = F.transform("u", lambda x: x["u"])
    return used.select("point_id", F.round(R.salience_fold(F.col("s"), u), 9).alias("salience"), F.round(R.rerank_feedback(F.col("s"), u), 9).alias("reranked"))


@query("mentions messages", """, w AS (SELECT * FROM (VALUES (1, 3), (1, 4), (2, 5)) w(qid, entity_id)), own AS (SELECT rid, message_id AS m, entity_id, (message_id % (SELECT count(*) FROM messages)) AS k FROM mentions), nm AS (SELECT *, row_number() OVER (ORDER BY message_id) - 1 AS k FROM messages),
    x AS (SELECT qid, own.entity_id, nm.message_id, created_at, CASE WHEN length(model_response) > 0 THEN model_response ELSE user_prompt END AS text FROM own JOIN w USING (entity_id) JOIN nm USING (k)),
    y AS (SELECT DISTINCT qid, entity_id, message_id, created_at, text FROM x WHERE length(text) >= 20), z AS (SELECT DISTINCT qid, message_id, created_at, text FROM (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY qid, entity_id ORDER BY created_at DESC, message_id DESC) <= 5))
    SELECT qid, message_id, text, 0.7::DOUBLE AS score FROM z QUALIFY row_number() OVER (PARTITION BY qid ORDER BY created_at DESC, message_id DESC) <= 10""")
def entity_sources(s, d):
    own = B.messages(s, d)
    n = own.count()
    place = N.numbered(own.select("message_id"), "message_id", "k").select(F.col("k").cast("int").alias("k"), F.col("message_id").alias("m"))
    seen = B.mentions(s, d).withColumn("k", (F.col("message_id") % n).cast("int")).join(place, "k").select("entity_id", F.col("m").alias("message_id")).distinct()
    return R.entity_sources(seen, own, s.createDataFrame([(1, 3), (1, 4), (2, 5)], "qid int, entity_id long"))


# Graph

_PAIRS = ", e AS (SELECT a.entity_id AS a, b.entity_id AS b, count(DISTINCT a.{0}) AS weight FROM mentions a JOIN mentions b ON a.{0} = b.{0} AND a.entity_id < b.entity_id GROUP BY 1, 2 HAVING count(DISTINCT a.{0}) >= {1})"


@query("parts", _PAIRS.format("message_id", 2) + " SELECT a, b, weight FROM e")
def message_cooccurrence(s, d):
    return G.cooccurrence(B.mentions(s, d, "l_partkey"), "message_id")


@query("parts", ", e AS (SELECT a.entity_id AS a, b.entity_id AS b, count(*) AS weight FROM (SELECT DISTINCT entity_id, conversation_id FROM mentions) a JOIN (SELECT DISTINCT entity_id, conversation_id FROM mentions) b ON a.conversation_id = b.conversation_id AND a.entity_id < b.entity_id GROUP BY 1, 2 HAVING count(*) >= 3) SELECT a, b, weight FROM e")
def conversation_cooccurrence(s, d):
    return G.cooccurrence(B.mentions(s, d, "l_partkey"), "conversation_id", 3)


@query("parts", _PAIRS.format("message_id", 2) + ", t AS (SELECT a AS id, b AS other, weight FROM e UNION ALL SELECT b, a, weight FROM e) SELECT id, other, weight, row_number() OVER (PARTITION BY id ORDER BY weight DESC, other)::INTEGER AS rank FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY weight DESC, other) <= 5")
def entity_neighbours(s, d):
    return G.neighbours(message_cooccurrence(s, d), 5)


@query("parts", _PAIRS.format("message_id", 2) + " SELECT id, count(*) AS degree FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY id")
def degree_centrality(s, d):
    return G.degree(message_cooccurrence(s, d))


@query()
def betweenness_centrality(s, d):
    return G.betweenness(G.cooccurrence(B.mentions(s, d, "l_partkey"), "message_id")).select("id", F.round("betweenness", 6).alias("betweenness"))


@query("metadata", """, w AS (SELECT message_id, conversation_id, unnest(keywords) AS k FROM metadata JOIN messages USING (message_id) WHERE quality_score > 0.5), n AS (SELECT message_id, count(*) AS n FROM w GROUP BY message_id)
    SELECT a, b, round(s / (x.n + y.n - s), 6) AS jaccard, shared FROM (SELECT p.message_id AS a, q.message_id AS b, count(*) AS s, string_agg(p.k, ',' ORDER BY p.k) AS shared FROM w p JOIN w q ON p.k = q.k AND p.message_id < q.message_id AND p.conversation_id <> q.conversation_id GROUP BY 1, 2) JOIN n x ON x.message_id = a JOIN n y ON y.message_id = b WHERE s / (x.n + y.n - s) >= 0.3""")
def similar_messages(s, d):
    rows = B.metadata(s, d).join(B.messages(s, d).select("message_id", "conversation_id"), "message_id")
    return G.keyword_similarity(rows).select("a", "b", F.round("jaccard", 6).alias("jaccard"), F.array_join("shared", ",").alias("shared"))


@query("points", """, f AS (SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, point_id) <= 3), u AS (SELECT conversation_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM f),
    m AS (SELECT conversation_id, list(x ORDER BY i) AS v FROM (SELECT conversation_id, i, avg(x) AS x FROM u GROUP BY 1, 2) GROUP BY 1),
    h AS (SELECT m.conversation_id, p.conversation_id AS other, p.point_id, list_cosine_similarity(p.vector, m.v) AS score FROM m, points p QUALIFY row_number() OVER (PARTITION BY m.conversation_id ORDER BY list_cosine_similarity(p.vector, m.v) DESC, p.point_id) <= 30)
    SELECT conversation_id, other, round(avg(score), 4) AS weight FROM h WHERE conversation_id <> other GROUP BY 1, 2 HAVING avg(score) >= 0.25 QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY avg(score) DESC, other) <= 5""")
def similar_conversations(s, d):
    return G.conversation_similarity(B.points(s, d), 0.25).select("conversation_id", "other", F.round("weight", 4).alias("weight"))


@query("messages items tasks", """, edges AS (SELECT DISTINCT * FROM (SELECT 'Message' AS src_label, message_id::VARCHAR AS src, 'BELONGS_TO' AS rel, 'Conversation' AS dst_label, conversation_id::VARCHAR AS dst FROM messages
    UNION ALL SELECT 'Message', message_id::VARCHAR, 'FOLLOWS', 'Message', (lag(message_id) OVER (PARTITION BY conversation_id ORDER BY sequence))::VARCHAR FROM messages
    UNION ALL SELECT 'Item', id, 'IN_DOMAIN', 'Domain', domain FROM items UNION ALL SELECT 'Item', id, 'PART_OF', 'Item', parent_id FROM items
    UNION ALL SELECT 'Task', id::VARCHAR, 'TARGETS_ITEM', 'Item', target_item_id FROM tasks UNION ALL SELECT 'Task', id::VARCHAR, 'IMPLEMENTS', 'Item', target_item_id FROM tasks) WHERE src IS NOT NULL AND dst IS NOT NULL),
    nodes AS (SELECT DISTINCT * FROM (SELECT 'Message' AS label, message_id::VARCHAR AS id FROM messages UNION ALL SELECT 'Conversation', conversation_id::VARCHAR FROM messages UNION ALL SELECT 'Item', id FROM items UNION ALL SELECT 'Task', id::VARCHAR FROM tasks UNION ALL SELECT 'Domain', domain FROM items))
    SELECT 'node' AS metric, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'edge', rel, count(*) FROM edges GROUP BY rel""")
def graph_statistics(s, d):
    return G.statistics(*G.project(B.messages(s, d), B.items(s, d), B.tasks(s, d), B.relationships(s, d)))


@query("items tasks", "SELECT t.id::VARCHAR AS n0, i.id AS n1, i.parent_id AS n2 FROM tasks t JOIN items i ON i.id = t.target_item_id WHERE i.parent_id IS NOT NULL")
def task_paths(s, d):
    _, edges = G.project(B.messages(s, d), B.items(s, d), B.tasks(s, d), B.relationships(s, d))
    return G.match_path(edges, ["TARGETS_ITEM", "PART_OF"])


@query("messages", "SELECT DISTINCT conversation_id, speaker, 'PARTICIPATED_IN' AS rel FROM (SELECT conversation_id, 'user' AS speaker FROM messages WHERE length(user_prompt) > 0 UNION ALL SELECT conversation_id, CASE WHEN conversation_id % 2 = 0 THEN 'claude' ELSE 'gemini' END FROM messages WHERE length(model_response) > 0)")
def participants(s, d):
    return G.participants(B.messages(s, d), F.when(F.col("conversation_id") % 2 == 0, "claude").otherwise("gemini"))


@query("hits", "SELECT qid AS src, 'INFORMED_BY' AS rel, CASE WHEN collection = 0 THEN 'Message' ELSE 'Document' END AS dst_label, point_id AS dst, round(score, 4) AS score FROM hits")
def provenance_edges(s, d):
    return G.provenance(_hits(s, d)).withColumn("score", F.round("score", 4))


@query()
def insight_clusters(s, d):
    own = B.points(s, d)
    quality = own.select("point_id", ((F.col("point_id") * 37) % 101 / 100).alias("quality"))
    seeds = G.best_seeds(own, quality)
    hits = R.vector_search(own, seeds, 10).join(seeds.select("qid", "seed_conversation").hint("merge"), "qid")
    return G.clusters(hits, quality, 0.3).select("seed", F.array_join("members", ",").alias("members"), F.round("score", 6).alias("score"))


@query("mentions", ", own AS (SELECT entity_id AS id, count(DISTINCT conversation_id) AS conversations, round(avg((message_id % 11) / 10.0), 6) AS mean_salience FROM mentions GROUP BY 1), deg AS (SELECT entity_id AS id, count(*) AS degree FROM mentions GROUP BY 1) SELECT id, degree, conversations, mean_salience FROM deg LEFT JOIN own USING (id)")
def enriched_entities(s, d):
    seen = B.mentions(s, d)
    salience = seen.select("message_id").distinct().withColumn("salience", F.col("message_id") % 11 / 10)
    degree = seen.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("degree"))
    return G.enrich(degree, seen, salience).withColumn("mean_salience", F.round("mean_salience", 6))


# Entities


@query("mentions", "SELECT 'part' AS entity_type, 'e' || (entity_id % 50) AS key, 'E' || (entity_id % 50) AS name, min(created_at) AS first_seen_at, max(created_at) AS last_seen_at, count(DISTINCT message_id) AS mention_count, string_agg(DISTINCT 'd' || (entity_id % 2), ' | ' ORDER BY 'd' || (entity_id % 2)) AS description FROM mentions GROUP BY entity_id % 50")
def resolved_entities(s, d):
    rows = B.mentions(s, d).select(F.lit("part").alias("entity_type"), F.concat(F.lit("E"), (F.col("entity_id") % 50).cast("string")).alias("name"), F.concat(F.lit("d"), (F.col("entity_id") % 2).cast("string")).alias("description"), "message_id", "created_at")
    return E.resolve(rows)


@query("variants", """, v AS (SELECT *, lower(trim(name)) AS low FROM variants), p AS (SELECT x.id AS x, y.id AS y, x.mention_count AS mx, y.mention_count AS my, 'article' AS rule, 0 AS place FROM v x JOIN v y ON x.entity_type = y.entity_type AND 'the ' || x.low = y.low
    UNION ALL SELECT x.id, y.id, x.mention_count, y.mention_count, 'plural', 1 FROM v x JOIN v y ON x.entity_type = y.entity_type AND x.low || 's' = y.low UNION ALL SELECT x.id, y.id, x.mention_count, y.mention_count, 'case', 2 FROM v x JOIN v y ON x.entity_type = y.entity_type AND x.low = y.low AND x.id <> y.id)
    SELECT canonical_id, duplicate_id, arg_min(rule, place) AS rule FROM (SELECT CASE WHEN mx > my OR (mx = my AND x < y) THEN x ELSE y END AS canonical_id, CASE WHEN mx > my OR (mx = my AND x < y) THEN y ELSE x END AS duplicate_id, rule, place FROM p) GROUP BY 1, 2""")
def duplicate_entities(s, d):
    return E.duplicates(B.entities(s, d, True))


@query("mentions", "SELECT entity_id - entity_id % 4 AS entity_id, message_id, min(rid) AS rowid FROM mentions GROUP BY 1, 2")
def merged_mentions(s, d):
    own = B.entities(s, d)
    chain = own.filter("id % 4 > 0").select(F.col("id").alias("duplicate_id"), (F.col("id") - 1).alias("canonical_id"))
    return E.merge(own, B.mentions(s, d), E.canonical_map(chain))[1]


@query("entities", f"""SELECT id, salience, CASE WHEN abs(salience - 0.5) < 0.001 THEN 'same' WHEN salience < 0.5 THEN 'decayed' ELSE 'boosted' END AS change FROM (SELECT id, round(least(1.0, 0.5 * greatest(0.15, 45.0 / (45 + coalesce(greatest(0, floor((epoch({AS_OF}) - epoch(last_seen_at)) / 86400)), 0))) + least(0.15, mention_count * 0.005)), 3)::DOUBLE AS salience FROM entities)""")
def entity_decay(s, d):
    return E.decay(B.entities(s, d), B.AS_OF)


@query("entities", "SELECT entity_type, count(*) AS n, sum(mention_count)::BIGINT AS mentions, max_by(name, (mention_count, name)) AS top FROM entities GROUP BY entity_type")
def entity_statistics(s, d):
    return E.statistics(B.entities(s, d))


@query("metadata", "SELECT message_id, quality_score FROM metadata WHERE quality_score >= 0.3 AND message_id % 4 <> 0 ORDER BY quality_score DESC, message_id LIMIT 20")
def extraction_queue(s, d):
    own = B.metadata(s, d).select("message_id", "quality_score")
    return E.extraction_queue(own, own.filter("message_id % 4 = 0"))


@query("variants", """, p AS (SELECT upper(name) AS alias, CASE WHEN id % 2 = 0 THEN name ELSE name || ' Ltd' END AS name FROM variants WHERE id < 1000)
    SELECT id AS alias_id, p.name, 'edge' AS part FROM variants v JOIN p ON lower(v.name) = lower(p.alias) UNION ALL SELECT NULL, name, 'missing' FROM (SELECT DISTINCT name FROM p WHERE lower(name) NOT IN (SELECT lower(name) FROM variants))""")
def alias_edges(s, d):
    """E5: edges from entities to the full names of their aliases, and full names that no entity has."""
    own = B.entities(s, d, True)
    pairs = own.filter("id < 1000").select(F.upper("name").alias("alias"), F.when(F.col("id") % 2 == 0, F.col("name")).otherwise(F.concat("name", F.lit(" Ltd"))).alias("name"))
    edges, missing = E.aliases(own, pairs)
    return edges.select("alias_id", "name", F.lit("edge").alias("part")).unionByName(missing.select("name", F.lit("missing").alias("part")), allowMissingColumns=True)


@query("", """WITH t AS (SELECT doc_id, lower(substr(text, 1, 60)) AS t FROM documents WHERE doc_id % 3 = 0), i AS (SELECT doc_id, substr(text, 1, 1 + doc_id::INTEGER % 45) AS title, (doc_id % 10) / 10.0 AS confidence FROM documents WHERE text <> '')
    SELECT doc_id, title FROM i WHERE confidence >= 0.4 AND NOT EXISTS (SELECT 1 FROM t WHERE contains(t.t, lower(substr(i.title, 1, 40))))""")
def fresh_insights(s, d):
    """Titles cut from documents that stand in no title of every third document."""
    own = docs(s, d)
    made = own.filter("text <> ''").select("doc_id", F.substring(F.col("text"), F.lit(1), (1 + F.col("doc_id") % 45).cast("int")).alias("title"), (F.col("doc_id") % 10 / 10).alias("confidence"))
    return G.write_back(made, own.filter("doc_id % 3 = 0").select(F.substring("text", 1, 60).alias("title"))).select("doc_id", "title")


@query("mentions", f""", e AS (SELECT DISTINCT entity_id AS src, 'NEXT' AS rel, entity_id + 1 AS dst FROM mentions UNION SELECT DISTINCT entity_id, 'LIKES', entity_id + 7 FROM mentions)
    SELECT DISTINCT src - src % 4 AS src, rel, dst - dst % 4 AS dst FROM e WHERE dst <= (SELECT max(s_suppkey) FROM supplier) AND src - src % 4 <> dst - dst % 4 AND src >= 4""")
def merged_entity_edges(s, d):
    """Edges of suppliers, four of which are one: re-pointed, each once, none on itself."""
    own = B.entities(s, d)
    seen, top = B.mentions(s, d).select("entity_id").distinct(), own.agg(F.max("id")).first()[0]
    edges = seen.select(F.col("entity_id").alias("src"), F.lit("NEXT").alias("rel"), (F.col("entity_id") + 1).alias("dst")).union(seen.select("entity_id", F.lit("LIKES"), F.col("entity_id") + 7)).filter(F.col("dst") <= top)
    chain = own.filter("id % 4 > 0 and id > 4").select(F.col("id").alias("duplicate_id"), (F.col("id") - 1).alias("canonical_id"))
    return E.merged_edges(edges.filter("src >= 4"), E.canonical_map(chain))


@query("entities", """, m AS (SELECT s_suppkey AS message_id, s_suppkey % 6 AS entity_type, CASE WHEN s_suppkey % 3 = 0 THEN upper(s_name) ELSE ' ' || s_name END AS name, 'd' || (s_suppkey % 2) AS description, TIMESTAMP '2024-01-01' + to_hours(s_suppkey::INTEGER) AS created_at FROM supplier CROSS JOIN range(2)),
    x AS (SELECT entity_type, lower(trim(name)) AS key, count(*) AS n, min(created_at) AS first, max(created_at) AS last, min(description) AS said FROM m GROUP BY 1, 2), o AS (SELECT *, lower(trim(name)) AS key FROM entities WHERE id % 2 = 0)
    SELECT coalesce(o.entity_type, x.entity_type) AS entity_type, coalesce(o.key, x.key) AS key, o.id IS NULL AS fresh, (coalesce(mention_count, 0) + coalesce(n, 0))::BIGINT AS mention_count, least(first_seen_at, first) AS first_seen_at, greatest(last_seen_at, last) AS last_seen_at, CASE WHEN o.id IS NULL OR o.id % 4 <> 0 THEN said WHEN said = 'd0' THEN 'D0' ELSE 'D0 | ' || said END AS description
    FROM o FULL JOIN x ON o.entity_type = x.entity_type AND o.key = x.key""")
def persisted_entities(s, d):
    """Extracted names met with the entities of even ids."""
    sup, k = B.table(s, d, "supplier"), F.col("s_suppkey")
    name = F.when(k % 3 == 0, F.upper("s_name")).otherwise(F.concat(F.lit(" "), "s_name"))
    rows = sup.select((k % 6).alias("entity_type"), name.alias("name"), F.concat(F.lit("d"), (k % 2).cast("string")).alias("description"), k.alias("message_id"), F.lit(2.0).alias("relevance"), F.lit("s").alias("snippet"), B.after(k).alias("created_at"))
    old = B.entities(s, d).filter("id % 2 = 0").withColumn("description", F.when(F.col("id") % 4 == 0, "D0").otherwise(""))
    done, _ = E.persist(old, rows.union(rows))
    return done.select("entity_type", F.lower(F.trim("name")).alias("key"), (F.col("id") >= 1 << 62).alias("fresh"), *long("mention_count"), "first_seen_at", "last_seen_at", "description")


def _names(s, d) -> DataFrame:
    """Entities for linking: the longer words of documents, each with its number of documents."""
    words = docs(s, d).select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), 0))).alias("name"))
    counts = words.groupBy("name").agg(F.count("*").alias("mention_count"))
    return written(counts.select(F.xxhash64("name").alias("id"), F.lit("word").alias("entity_type"), "name", "mention_count"), "names")


@query()
def linked_entities(s, d):
    """The words of documents that messages name."""
    names = _names(s, d)
    index = _index(s, names.select(F.col("id").alias("doc_id"), F.col("name").alias("text")), stem=False)
    asked = B.messages(s, d).select("message_id", F.concat(F.lit("Of "), F.initcap("user_prompt")).alias("text"))
    found = E.link(asked, names, index).join(names.select(F.col("id").alias("entity_id"), "name").hint("merge"), "entity_id")
    return found.select("message_id", "name", F.round("score", 6).alias("score"), *long("place"))


@query("entities mentions", """, r AS (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY mention_count DESC, id) AS rank FROM entities), b AS (SELECT entity_type AS qid, rank, h || '(no description)' || chr(10) || chr(10) AS block, h || '(no description)...' || chr(10) || chr(10) AS short
        FROM (SELECT *, '**' || name || '** (' || entity_type || ', referenced ' || mention_count || ' times):' || chr(10) AS h FROM r)),
    e AS (SELECT *, 18 + sum(length(block)) OVER (PARTITION BY qid ORDER BY rank) AS fin FROM b), o AS (SELECT *, count(*) FILTER (fin > 600) OVER (PARTITION BY qid ORDER BY rank) AS overs FROM e)
    SELECT qid, chr(10) || '## Known Context' || chr(10) || string_agg(CASE WHEN fin <= 600 THEN block ELSE short END, '' ORDER BY rank) AS context FROM o WHERE fin <= 600 OR (overs = 1 AND fin - length(block) + length(short) <= 600) GROUP BY qid""")
def entity_contexts(s, d):
    """A block of context for each type of entity."""
    rank = F.row_number().over(R.Window.partitionBy("entity_type").orderBy(F.desc("mention_count"), "id"))
    own = B.entities(s, d).select(F.col("entity_type").alias("qid"), rank.alias("rank"), "name", "entity_type", "mention_count", F.lit("").alias("description"), F.array().cast("array<string>").alias("snippets"))
    return E.context_block(own, 600)


# Quality and lifecycle


def _of_messages(points: DataFrame) -> DataFrame:
    """Points with the message whose chunks they are: four parents for each conversation, in their order."""
    return points.withColumn("message_id", F.floor(F.col("parent_id") / 4) * 1000 + F.col("parent_id") % 4 + 1)



@query("metadata points", """SELECT point_id, CASE WHEN q IS NULL THEN s ELSE greatest(round(greatest(0.0, least(1.0, coalesce(e, CASE WHEN q < 0.15 THEN s * 0.3 WHEN q < 0.4 THEN s * 0.7 WHEN q > 0.7 THEN s + 0.1 ELSE s END))), 4),
    CASE WHEN q >= 0.9 THEN 0.9 WHEN q >= 0.8 THEN 0.7 WHEN q >= 0.7 THEN 0.6 WHEN q >= 0.5 THEN 0.3 ELSE 0.0 END) END::DOUBLE AS salience
    FROM (SELECT point_id, salience::DOUBLE AS s, quality_score AS q, CASE WHEN m.message_id % 9 = 0 THEN latency_total_ms / 5000 END AS e FROM points p LEFT JOIN metadata m ON m.message_id = p.parent_id // 4 * 1000 + p.parent_id % 4 + 1)""")
def propagated_salience(s, d):
    own = B.metadata(s, d).withColumn("salience_score", F.when(F.col("message_id") % 9 == 0, F.col("latency_total_ms") / 5000))
    return Q.propagate_salience(_of_messages(B.points(s, d)).select("point_id", "salience", "message_id"), own)


@query("metadata points", f"""SELECT m.message_id FROM metadata m JOIN messages USING (message_id) JOIN (SELECT message_id FROM (SELECT n.message_id, p.salience, CASE WHEN p.parent_id % 2 = 1 THEN p.last_retrieved END AS last_retrieved FROM points p JOIN messages n ON n.message_id = p.parent_id // 4 * 1000 + p.parent_id % 4 + 1) GROUP BY message_id HAVING bool_and(salience < 0.9 AND last_retrieved IS NULL)) l USING (message_id)
    WHERE quality_score < 0.5 AND created_at < {AS_OF} - INTERVAL 7 DAYS""")
def prunable_messages(s, d):
    own = B.messages(s, d)
    pts = _of_messages(B.points(s, d)).join(own.select("message_id").hint("merge"), "message_id").select("message_id", "salience", F.when(F.col("parent_id") % 2 == 1, F.col("last_retrieved")).alias("last_retrieved"))
    return Q.prunable(pts, B.metadata(s, d), own, B.AS_OF, quality=0.5, salience=0.9)


@query("metadata", f"SELECT message_id, ({intent_sql('user_prompt')})[1] AS intent FROM messages JOIN metadata USING (message_id) WHERE quality_score >= 0.6 AND message_id > 5000 AND length(user_prompt) > 0 AND length(model_response) > 0")
def mining_queue(s, d):
    return Q.mining_queue(B.messages(s, d), B.metadata(s, d), 5000)


@query("messages", "SELECT conversation_id, string_agg('[' || sequence || '] ' || substr(user_prompt, 1, 800) || ' / ' || substr(model_response, 1, 800) || CASE WHEN sequence = 2 THEN ' <<<' ELSE '' END, chr(10) ORDER BY sequence) AS thread FROM messages GROUP BY conversation_id")
def message_threads(s, d):
    own = B.messages(s, d)
    return Q.format_threads(own, own.filter("sequence = 2"))


_QUALITY = ORACLE["quality_scores"].partition("SELECT message_id, CASE WHEN model_response")


@query("metadata", ", scores AS (SELECT message_id, CASE WHEN model_response" + _QUALITY[2] + """), kw AS (SELECT message_id, string_agg(k, ',' ORDER BY times DESC, place) AS keywords FROM (SELECT * FROM wordcount QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY times DESC, place) <= 10) GROUP BY message_id)
    SELECT message_id, score AS quality_score, coalesce(kw.keywords, '') AS keywords FROM metadata JOIN scores USING (message_id) LEFT JOIN kw USING (message_id) WHERE message_id % 3 = 0 OR quality_score IS NULL""")
def scored_messages(s, d):
    meta = B.metadata(s, d).withColumn("quality_score", F.when(F.col("message_id") % 3 > 0, F.col("quality_score")))
    return Q.score_unscored(B.messages(s, d), meta).select("message_id", "quality_score", F.array_join("keywords", ",").alias("keywords"))


def _replies(s, d, kind: str, body) -> DataFrame:
    """Replies about messages: ``body`` as JSON, in a fence for odd ids, cut off for every seventh one."""
    own, m = B.messages(s, d), F.col("message_id")
    text = F.to_json(body)
    raw = F.when(m % 7 == 0, F.substring(text, 1, 20)).when(m % 2 == 1, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).otherwise(text)
    return own.select(m.alias("id"), F.lit(kind).alias("kind"), raw.alias("raw"))


@query("messages", """SELECT message_id AS id, round((message_id * 37 % 131) / 100.0, 3)::DOUBLE AS salience_score, round((message_id * 11 % 97) / 97.0::DOUBLE, 3) AS quality_score, substr(model_response, 1, 500) AS rationale, substr(user_prompt, 1, 1) AS first_topic FROM messages WHERE message_id % 7 <> 0 AND message_id * 37 % 131 <= 100""")
def evaluated_replies(s, d):
    """evaluations, of which some are cut off and some out of range."""
    m = F.col("message_id")
    body = F.struct((m * 37 % 131 / 100).alias("salience_score"), (m * 11 % 97 / 97).alias("quality_score"), F.col("model_response").alias("quality_reasoning"), F.array(F.substring("user_prompt", 1, 1)).alias("topics"))
    good, _ = P.validated(_replies(s, d, "eval", body), "eval")
    return good.select("id", "salience_score", "quality_score", "rationale", F.col("topics")[0].alias("first_topic"))


@query("messages", """SELECT message_id AS id, round(least(1.0, (message_id % 13) / 10.0), 2)::DOUBLE AS naturalness_score, 0.0::DOUBLE AS tool_awareness_score, round(0.4 * round(least(1.0, (message_id % 13) / 10.0), 2) + 0.35 * 0.6, 2)::DOUBLE AS overall_score, CASE WHEN message_id % 3 = 0 THEN 'report_mode' ELSE '' END AS flags FROM messages WHERE message_id % 7 <> 0 AND message_id % 13 <> 5""")
def turn_signals(s, d):
    """signals of turns, with scores over 1, one missing, and flags that are none."""
    m = F.col("message_id")
    body = F.struct((m % 13 / 10).alias("naturalness_score"), F.lit(0.6).alias("attunement_score"), F.array(F.when(m % 3 == 0, "report_mode").otherwise("other")).alias("drift_flags"))
    good, _ = P.validated(_replies(s, d, "turn", body).filter("id % 13 <> 5"), "turn")
    return good.select("id", "naturalness_score", "tool_awareness_score", "overall_score", F.array_join("drift_flags", ",").alias("flags"))


@query("messages", """SELECT message_id AS id, place, CASE place WHEN 0 THEN 'person' ELSE 'concept' END AS entity_type, substr(user_prompt, 1, 5) || place AS name, CASE place WHEN 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS relevance FROM messages, (VALUES (0), (2)) p(place) WHERE message_id % 7 <> 0 AND user_prompt <> '' AND substr(user_prompt, 1, 1) <> ' '""")
def reply_entities(s, d):
    """entities of replies: one of a type there is not, relevance over 1 or missing."""
    one = lambda kind, k, r: F.struct(F.lit(kind).alias("entity_type"), F.concat(F.substring("user_prompt", 1, 5), F.lit(k)).alias("name"), F.lit(r).cast("double").alias("relevance"))
    body = F.struct(F.array(one("person", "0", 3.0), one("planet", "1", 0.2), one("concept", "2", None)).alias("entities"))
    rows = _replies(s, d, "entity", body).join(B.messages(s, d).filter("user_prompt <> '' and left(user_prompt, 1) <> ' '").select(F.col("message_id").alias("id")).hint("merge"), "id", "left_semi")
    return P.entities(rows)[0].select("id", *long("place"), "entity_type", "name", "relevance").withColumn("place", F.col("place").cast("int"))


# Chunks


@query("", "SELECT doc_id, length(text) > 3000 AS needed FROM documents")
def chunking_needed(s, d):
    return docs(s, d).select("doc_id", chunks.needs_chunking(F.col("text")).alias("needed"))


@query()
def document_chunks(s, d):
    return chunks.chunk(B.documents(s, d).select("id", "content"))


@query()
def message_chunks(s, d):
    return chunks.chunk_messages(B.messages(s, d), 500, 400, 50, 40)


@query("", r"SELECT count(*) AS documents, count(*) FILTER (WHERE length(text) <= 3000) AS whole, sum(CASE WHEN length(text) <= 3000 THEN length(text) END)::BIGINT AS chars FROM documents WHERE regexp_matches(text, '\S')")
def chunk_coverage(s, d):
    """Every document with a text has chunks, and those up to the threshold are whole in one."""
    rows = B.documents(s, d)
    own = chunks.chunk(rows.select("id", "content")).join(rows.select("id", F.length("content").alias("n")).hint("merge"), "id")
    one = (F.col("n") <= 3000) & (F.col("char_start") == 0) & (F.col("char_end") == F.col("n")) & (F.col("chunk_total") == 1)
    return own.agg(F.countDistinct("id").alias("documents"), F.count_if(one).alias("whole"), F.sum(F.when(one, F.col("n"))).cast("long").alias("chars"))


# Intent state


@query()
def intent_hypotheses(s, d):
    return I.hypotheses(B.messages(s, d)).withColumn("confidence", F.round("confidence", 6))


@query()
def intent_gates(s, d):
    return I.gates(I.hypotheses(B.messages(s, d)))


@query()
def intent_retrospectives(s, d):
    return I.retrospectives(I.hypotheses(B.messages(s, d)), 2)


@query()
def recommended_actions(s, d):
    return I.recommend_actions(B.messages(s, d), B.items(s, d))


# Streams, as batches


@query("outbox", "SELECT entity_type, entity_id, payload, id FROM (SELECT * FROM outbox QUALIFY row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY id DESC) = 1) WHERE operation <> 'DELETE'")
def cdc_snapshot(s, d):
    from ..streaming.feeds import live, merged

    feed = B.outbox(s, d)
    return live(merged(merged(None, feed.filter("id < 5000")), feed.filter("id >= 4000")))


@query("items", "SELECT id, CASE WHEN id LIKE '%1' THEN 'DELETE' WHEN id LIKE '%2' THEN 'INSERT' ELSE 'UPDATE' END AS operation FROM items WHERE id LIKE '%1' OR id LIKE '%2' OR id LIKE '%3'")
def snapshot_diff(s, d):
    from ..streaming.feeds import diff_snapshots

    own = B.items(s, d).select("id", "title", "status")
    digit = F.substring("id", -1, 1)
    return diff_snapshots(own.filter(digit != "2"), own.filter(digit != "1").withColumn("title", F.when(digit == "3", "changed").otherwise(F.col("title"))), "id").select("id", "operation")


@query("mentions", ", t AS (SELECT DISTINCT entity_id FROM mentions WHERE rid > (SELECT max(rid) - 500 FROM mentions)) SELECT entity_id, count(*) AS n FROM mentions JOIN t USING (entity_id) GROUP BY entity_id")
def recounted_since(s, d):
    from ..streaming.feeds import process_since

    seen = B.mentions(s, d)
    rows, _ = process_since(seen, seen.agg(F.max("rowid")).first()[0] - 500)
    return rows.groupBy("entity_id").agg(F.count("*").alias("n"))


# Monitoring


@query("items tasks", """, k AS (SELECT parent_id AS id, count(*) AS children, count(*) FILTER (WHERE status = 'shipped') AS shipped, count(*) FILTER (WHERE status = 'in_progress') AS in_progress FROM items WHERE parent_id IS NOT NULL GROUP BY 1),
    t AS (SELECT i.parent_id AS id, count(*) AS tasks, count(*) FILTER (WHERE t.status = 'completed') AS completed FROM tasks t JOIN items i ON i.id = t.target_item_id GROUP BY 1) SELECT id, children, shipped, in_progress, coalesce(tasks, 0) AS tasks, coalesce(completed, 0) AS completed FROM k LEFT JOIN t USING (id)""")
def sprint_view(s, d):
    return M.sprint_view(B.items(s, d), B.tasks(s, d))


_BOARD = """SELECT c AS "column", count(*) AS n, count(*) FILTER (WHERE shown) AS shown, max(age) FILTER (WHERE shown) AS oldest FROM (SELECT c, c <> 'Done' OR updated_at >= TIMESTAMP '{as_of}' - INTERVAL 14 DAYS AS shown, greatest(0, floor((epoch(TIMESTAMP '{as_of}') - epoch(created_at)) / 86400))::BIGINT AS age
    FROM (SELECT *, CASE {case} END AS c FROM {rows}) WHERE c IS NOT NULL) GROUP BY c"""


def _columns(columns: dict[str, list[str]]) -> str:
    return " ".join("WHEN status IN (" + ", ".join(f"'{x}'" for x in statuses) + f") THEN '{title}'" for title, statuses in columns.items())


@query("tasks", _BOARD.format(as_of="1998-08-01 00:00:00", case=_columns(M.TASK_COLUMNS), rows="(SELECT status, created_at, created_at + to_days((id % 90)::INTEGER) AS updated_at FROM tasks)"))
def task_board(s, d):
    own = B.tasks(s, d).withColumn("updated_at", F.timestamp_seconds(F.unix_timestamp("created_at") + F.col("id") % 90 * 86400))
    return M.board(own, M.TASK_COLUMNS, "1998-08-01")


@query("items", _BOARD.format(as_of="2024-02-15 00:00:00", case=_columns(M.ITEM_COLUMNS), rows="(SELECT status, TIMESTAMP '2023-11-01' + to_days((length(title) + priority * 7)::INTEGER) AS created_at, TIMESTAMP '2024-01-01' + to_days((substr(id, 2)::BIGINT % 50)::INTEGER) AS updated_at FROM items WHERE entity_type NOT IN ('project', 'book', 'chapter'))"))
def item_board(s, d):
    day = lambda start, n: F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + n * 86400)
    own = B.items(s, d).withColumn("created_at", day("2023-11-01", F.length("title") + F.col("priority") * 7)).withColumn("updated_at", day("2024-01-01", F.substring("id", 2, 20).cast("long") % 50))
    return M.board(own, M.ITEM_COLUMNS, B.AS_OF)


@query("metadata", "SELECT count(*) AS messages, count(quality_score) AS scored, count(*) FILTER (WHERE len(keywords) > 0) AS keyworded, count(*) FILTER (WHERE length(model_response) > 500) AS chunked FROM messages JOIN metadata USING (message_id)")
def coverage(s, d):
    own = B.messages(s, d)
    return M.coverage(own, B.metadata(s, d), own.filter("length(model_response) > 500").select("message_id"))


@query("metadata points", """, m AS (SELECT count(*) AS n FROM messages WHERE message_id NOT IN (SELECT message_id FROM metadata WHERE quality_score IS NOT NULL)), r AS (SELECT event_type AS name, count(*) AS n FROM events GROUP BY 1),
    f AS (SELECT 'warning' AS level, 'cycles producing 0 output: ' || (SELECT string_agg(x, ', ' ORDER BY i) FROM (VALUES (0, 'purchase'), (1, 'dream'), (2, 'error'), (3, 'decay')) c(i, x) WHERE x NOT IN (SELECT name FROM r)) AS message
    UNION ALL SELECT 'warning', 'collection ' || chr(39) || c || chr(39) || ' has 0 points' FROM (VALUES (0), (1), (2)) v(c) WHERE c NOT IN (SELECT collection FROM points)
    UNION ALL SELECT 'warning', 'graph has 0 nodes' WHERE (SELECT count(*) FROM messages) = 0 UNION ALL SELECT 'warning', n || ' messages missing metadata' FROM m WHERE n > 0)
    SELECT * FROM f WHERE message IS NOT NULL UNION ALL SELECT 'ok', 'All systems healthy' WHERE NOT EXISTS (SELECT * FROM f WHERE message IS NOT NULL)""")
def coverage_alerts(s, d):
    own, runs = B.messages(s, d), B.table(s, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    meta = B.metadata(s, d).filter("quality_score is not null")
    return M.alerts(own, meta, B.points(s, d), own.select("message_id"), runs, [0, 1, 2], ["purchase", "dream", "error", "decay"])


@query("registry", "SELECT 'enough' AS gate, CASE WHEN count(*) >= 100 THEN 'PASS' ELSE 'FAIL' END AS result FROM registry UNION ALL SELECT 'hashed', CASE WHEN count(*) = count(content_hash) THEN 'PASS' ELSE 'FAIL' END FROM registry UNION ALL SELECT 'ok 90 %', CASE WHEN count(*) FILTER (WHERE status = 'ok') * 10 >= count(*) * 9 THEN 'PASS' ELSE 'FAIL' END FROM registry")
def ingest_gates(s, d):
    n = F.count("*")
    return M.gate_report(B.registry(s, d), {"enough": n >= 100, "hashed": n == F.count("content_hash"), "ok 90 %": F.count_if(F.col("status") == "ok") * 10 >= n * 9})


@query("metadata", "SELECT conversation_id, count(*) AS turns, round(avg(latency_total_ms), 6) AS mean_latency, round(avg(quality_score), 6) AS mean_quality, max(sequence) AS last_turn, arg_max(latency_total_ms, sequence) AS last_latency FROM messages JOIN metadata USING (message_id) GROUP BY conversation_id")
def turn_metrics(s, d):
    return M.turn_metrics(B.messages(s, d), B.metadata(s, d))


@query("logs", "SELECT module, count(*) AS runs, count(*) FILTER (WHERE level = 'ERROR') AS errors, max(id) AS latest FROM logs GROUP BY module")
def run_counters(s, d):
    return M.run_counters(B.logs(s, d))


@query("points messages", """SELECT message_id AS id, conversation_id, coalesce(CASE WHEN message_id % 5 <> 0 THEN ((message_id * 37) % 101) / 100.0 END, 0.5)::DOUBLE AS salience FROM messages WHERE message_id % 3 <> 0""")
def embed_payloads(s, d):
    own = B.messages(s, d)
    done = own.filter("message_id % 3 = 0").select(F.col("message_id").alias("id"), F.lit(0).alias("chunk_index"))
    parts = chunks.chunk_messages(own, 1 << 30)  # every message in one chunk
    return R.to_embed(parts, own, B.metadata(s, d), done).select("id", "conversation_id", "salience")


@query()
def chunk_payloads(s, d):
    """R8 whole: every chunk of every message, less the first chunks of each third message, which have their points."""
    own = B.messages(s, d)
    parts = chunks.chunk_messages(own, 500, 400, 50, 40)
    done = parts.filter("id % 3 = 0 and chunk_index = 0").select("id", "chunk_index")
    return R.to_embed(parts, own, B.metadata(s, d), done)
