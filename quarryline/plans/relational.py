"""Reads, writes, statistics and job tracking over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import analytics as A
from ..operators import tables as T
from ..streaming import jobs as J
from .registry import query
from .retrieval import _MSG, citations, messages

_AS_OF = "TIMESTAMP '2024-01-30 00:00:00'"
_JOBS = """j AS (SELECT event_id AS job_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'processing' ELSE 'completed' END AS status, ts AS created_at, ts + INTERVAL 1 MINUTE * (event_id % 7) AS started_at, CASE WHEN event_id % 5 <> 0 THEN ts + INTERVAL 1 MINUTE * (event_id % 7) + INTERVAL 1 SECOND * (event_id % 100) END AS completed_at, user_id, event_type, props FROM events)"""


def as_of():
    return F.lit("2024-01-30 00:00:00").cast("timestamp")


def jobs(t):
    e = F.col("event_type")
    status = F.when(e == "error", "failed").when(e == "purchase", "completed").when(e == "signup", "pending").when(e == "click", "processing").otherwise("completed")
    start = F.timestamp_add("MINUTE", F.col("event_id") % 7, F.col("ts"))
    return t.events.select(F.col("event_id").alias("job_id"), status.alias("status"), F.col("ts").alias("created_at"), start.alias("started_at"), F.when(F.col("event_id") % 5 != 0, F.timestamp_add("SECOND", F.col("event_id") % 100, start)).alias("completed_at"), "user_id", "event_type", "props")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 1000 AND o_totalprice <= 200000 AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_predicates(t):
    o = T.filtered(t.orders, o_orderstatus="O", o_orderpriority="all")
    o = T.within(T.within(o, "o_totalprice", 1000, 200000), "o_orderdate", before=F.lit("1997-01-01").cast("timestamp"))
    return T.among(o, "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%1_%' OR p_brand ILIKE '%brand#1%'")
def ilike_any(t):
    return t.part.where(T.like_any("1_", "p_name") | T.like_any("brand#1", "p_brand")).select("p_partkey", "p_name")


_P = "p AS (SELECT source, list_sort(list_distinct(list(lang))) AS langs FROM documents GROUP BY source)"


def source_langs(t):
    return t.documents.groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("langs"))


@query(f"WITH {_P} SELECT source, list_contains(langs, 'de') AS has_de, list_has_all(langs, ['en', 'fr']) AS has_both, list_has_any(langs, ['es', 'xx']) AS overlaps FROM p")
def array_predicates(t):
    c = F.col("langs")
    return source_langs(t).select("source", F.array_contains(c, "de").alias("has_de"), T.holds_all(c, ["en", "fr"]).alias("has_both"), T.overlaps(c, ["es", "xx"]).alias("overlaps"))


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR l.toxic IS NULL")
def missing_any(t):
    return T.missing_any(t.documents.select("doc_id").join(t.labels, "doc_id", "left"), "quality", "toxic")


@query("SELECT doc_id, lang, source, count(*) OVER () AS total, 20 + 10 < count(*) OVER () AS has_more FROM documents WHERE lang = 'fr' ORDER BY doc_id DESC LIMIT 10 OFFSET 20")
def documents_filter_page(t):
    return T.page(T.filtered(t.documents, lang="fr").select("doc_id", "lang", "source"), 20, 10, F.desc("doc_id"))


@query(f"WITH {_JOBS} SELECT job_id, status, created_at, count(*) OVER () AS total, 50 + 25 < count(*) OVER () AS has_more FROM j WHERE status = 'failed' ORDER BY created_at DESC NULLS FIRST, job_id LIMIT 25 OFFSET 50")
def jobs_page(t):
    return T.page(T.filtered(jobs(t), status="failed").select("job_id", "status", "created_at"), 50, 25, T.newest_first("created_at"), "job_id")


@query(f"WITH {_JOBS} SELECT job_id, status, CASE WHEN event_type = 'signup' THEN json_extract_string(props, '$.k') END AS doc_id FROM j WHERE status IN ('pending', 'processing') ORDER BY created_at DESC NULLS FIRST, job_id LIMIT 50")
def active_jobs(t):
    j = jobs(t).withColumn("job_type", F.when(F.col("event_type") == "signup", "reingest").otherwise("url")).withColumn("result_data", F.lit("{}")).withColumn("input_data", F.regexp_replace("props", '"k"', '"docId"'))
    return A.active_jobs(j).select("job_id", "status", "doc_id")


@query(f"WITH {_JOBS} SELECT job_id, epoch_us(coalesce(completed_at, {_AS_OF})) // 1000 - epoch_us(started_at) // 1000 AS ms FROM j")
def job_duration(t):
    return jobs(t).select("job_id", A.job_millis(F.col("started_at"), F.col("completed_at"), as_of()).alias("ms"))


@query(f"WITH {_JOBS} SELECT DISTINCT user_id FROM j WHERE status = 'pending' AND user_id NOT IN (SELECT user_id FROM j WHERE status = 'processing' AND created_at >= TIMESTAMP '2024-01-20')")
def completed_since_last_poll(t):
    j = jobs(t)
    return T.gone_since(j.where("status = 'pending'").select("user_id").distinct(), j.where("status = 'processing' and created_at >= timestamp '2024-01-20'"), "user_id")


@query(f"WITH {_JOBS} SELECT count(*) AS total, count(*) FILTER (status IN ('pending', 'processing')) AS pending, count(*) FILTER (status = 'failed') AS failed FROM j WHERE created_at >= {_AS_OF} - INTERVAL 24 HOURS")
def dashboard_jobs_24h(t):
    return A.job_counts(jobs(t), as_of())


@query("SELECT count(*) AS total, count(*) FILTER (toxic = 1) AS failed, count(*) FILTER (toxic = 0 AND quality = 1) AS ingested, count(*) FILTER (toxic = 0 AND quality = 0) AS extracted FROM labels")
def dashboard_doc_status(t):
    s = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "ingested").otherwise("extracted")
    return A.status_counts(t.labels.withColumn("ingestion_status", s))


@query(f"WITH {_JOBS} SELECT status, count(*) AS n, count(*) FILTER (status = 'processing' AND started_at < {_AS_OF} - INTERVAL 10 MINUTES) AS stuck, count(*) FILTER ((status = 'completed' AND created_at < {_AS_OF} - INTERVAL 24 HOURS) OR (status = 'failed' AND created_at < {_AS_OF} - INTERVAL 7 DAYS)) AS expired FROM j GROUP BY status")
def queue_state(t):
    return A.queue_state(jobs(t), as_of())


@query(f"WITH {_JOBS} SELECT user_id AS job_id, arg_max(status, job_id) AS status, min(created_at) AS created_at, max(job_id) AS ts FROM j GROUP BY user_id")
def job_state_machine(t):
    u = jobs(t).select(F.col("user_id").alias("job_id"), "status", F.lit("").alias("progress"), F.col("job_id").alias("ts"), "created_at")
    s = J.job_state(u).select("job_id", "status", F.col("updated_at").alias("ts"))
    return s.join(u.groupBy("job_id").agg(F.min("created_at").alias("created_at")), "job_id")


@query(f"WITH {_JOBS} SELECT user_id AS job_id, CASE WHEN count(*) FILTER (status <> 'failed') = 0 THEN 'failed' ELSE 'completed' END AS status FROM j GROUP BY user_id")
def batch_outcome(t):
    return A.batch_status(jobs(t).select(F.col("user_id").alias("job_id"), (F.col("status") != "failed").alias("ok")))


@query("SELECT c_custkey, c_name, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS first_order, (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS chunk_count FROM customer")
def documents_with_counts(t):
    files = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("file_id"))
    items = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")
    return T.with_children(t.customer.select("c_custkey", "c_name"), "c_custkey", files, items).select("c_custkey", "c_name", F.col("file.file_id").alias("first_order"), "chunk_count")


@query("SELECT c_custkey, n, keys FROM customer JOIN (SELECT o_custkey, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def nested_children(t):
    o = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    n = T.nested(t.customer.select("c_custkey"), o, "c_custkey", "orders", "o_orderkey", inner=True)
    return n.select("c_custkey", F.size("orders").cast("long").alias("n"), F.array_join(F.transform("orders", lambda x: x["o_orderkey"].cast("string")), ",").alias("keys"))


@query("SELECT c_custkey, coalesce(n_name, 'david') AS persona FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON n_nationkey = c_nationkey")
def persona_lookup(t):
    n = t.nation.where("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("persona"))
    return T.lookup(t.customer, n, "c_nationkey", "persona", "david").select("c_custkey", "persona")


@query("SELECT lang AS persona, count(*) AS docs, string_agg(DISTINCT source, ',' ORDER BY source) AS types FROM documents GROUP BY lang")
def distinct_persona_types(t):
    return A.types_per_persona(t.documents.select(F.array("lang").alias("personas"), F.col("source").alias("type")))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def conversation_history_last_n(t):
    return T.last_messages(t.conversations.select("conv_id", "turn", "role"), "conv_id", "turn")


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_message(t):
    return T.last_user_message(t.conversations, "conv_id", "turn")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM conversations")
def carry_forward(t):
    c = t.conversations.select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("asked"))
    return T.carried(c, "conv_id", "turn", "asked")


_UP = "t AS (SELECT doc_id, lang, 1 AS v FROM documents), n AS (SELECT doc_id, upper(lang) AS lang, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 2 END AS v FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id + 1000000, lang, 1 FROM documents WHERE doc_id % 5 = 0)"


def _old_and_new(t):
    old = t.documents.select("doc_id", "lang", F.lit(1).alias("v"))
    new = t.documents.where("doc_id % 2 = 0").select("doc_id", F.upper("lang").alias("lang"), F.when(F.col("doc_id") % 4 == 0, 0).otherwise(2).alias("v"))
    return old, new.unionByName(t.documents.where("doc_id % 5 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), "lang", F.lit(1).alias("v")))


@query(f"WITH {_UP} SELECT doc_id, arg_max(lang, v) AS lang, max(v) AS v FROM (SELECT * FROM t UNION ALL SELECT * FROM n) GROUP BY doc_id")
def upsert_latest(t):
    return T.upserted(*_old_and_new(t), "doc_id", "v")


@query(f"WITH {_UP} SELECT * FROM t UNION ALL SELECT * FROM n WHERE doc_id NOT IN (SELECT doc_id FROM t)")
def insert_if_absent(t):
    return T.inserted_if_absent(*_old_and_new(t), "doc_id")


@query(f"WITH {_UP} SELECT * FROM t WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n")
def replace_rows(t):
    return T.replaced(*_old_and_new(t), "doc_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 3 = 0)")
def cascade_delete(t):
    gone = t.orders.where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return T.cascaded(t.lineitem, gone, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_where(t):
    return T.updated(t.orders.select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "F", o_orderstatus=F.lit("closed"))


@query("SELECT doc_id, coalesce(quality, (n_chars % 2)::INT) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def backfill(t):
    d = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return T.backfilled(d, t.documents.select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality")), "doc_id", "quality")


@query("SELECT doc_id, sha256(text) AS content_hash, strlen(text) AS file_size FROM documents")
def content_hash(t):
    return T.with_hash(t.documents, "text").select("doc_id", "content_hash", F.col("file_size").cast("long").alias("file_size"))


@query("SELECT event_type, count(*) AS total, count(*) FILTER (ts >= DATE '2024-01-20') AS today, count(*) FILTER (ts >= TIMESTAMP '2024-01-13 12:00:00') AS this_week, count(*) FILTER (ts >= TIMESTAMP '2024-01-20 11:00:00') AS last_hour FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY event_type")
def activity_metrics(t):
    return A.activity(t.events, "ts", F.lit("2024-01-20 12:00:00").cast("timestamp"), "event_type")


@query("WITH d AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events), r AS (SELECT user_id, d - (row_number() OVER (PARTITION BY user_id ORDER BY d))::INT AS run FROM d) SELECT user_id, max(n) AS streak_days FROM (SELECT user_id, run, count(*) AS n FROM r GROUP BY ALL) GROUP BY user_id")
def activity_streak(t):
    return A.longest_streak(t.events, "user_id", "ts")


@query("SELECT s_suppkey AS entity_id FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_linenumber = 1) AND s_suppkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 AND l_linenumber = 1)")
def orphan_entities(t):
    edges = t.lineitem.where("l_quantity > 49 and l_linenumber = 1").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return A.orphans(t.supplier.select(F.col("s_suppkey").alias("entity_id")), edges)


@query("SELECT p_brand AS kind, count(*) AS entities, round(avg(p_retailprice), 4) AS avg_confidence, sum(p_size)::BIGINT AS mentions FROM part GROUP BY p_brand")
def graph_stats(t):
    e = t.part.select(F.col("p_brand").alias("kind"), F.col("p_retailprice").alias("confidence"), F.col("p_size").alias("mentions"))
    return A.graph_stats(e).withColumn("avg_confidence", F.round("avg_confidence", 4))


@query("SELECT conv_id AS conversation_id, count(*) AS expired FROM conversations WHERE turn > 3 GROUP BY conv_id")
def expired_sources(t):
    return A.expired_sources(t.conversations.select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("turns_inactive")), 3)


@query("SELECT event_type AS model, count(*) AS runs, round(avg(CASE WHEN event_id % 4 <> 0 THEN value END), 4) AS avg_ms, count(*) FILTER (event_id % 4 <> 0) AS succeeded FROM events GROUP BY event_type")
def model_averages(t):
    r = t.events.select(F.col("event_type").alias("model"), F.col("value").alias("ms"), (F.col("event_id") % 4 != 0).alias("ok"))
    return A.model_averages(r).withColumn("avg_ms", F.round("avg_ms", 4))


@query("SELECT date_trunc('hour', ts) AS since, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(t):
    return J.windowed_counts(t.events)


_W = f"WITH {_MSG}, x AS (SELECT *, CASE WHEN role = 'assistant' AND message_id % 4 <> 0 THEN (message_id % 100) / 100.0::DOUBLE END AS rag_weight FROM m), n AS (SELECT message_id, count(*) AS n_citations FROM ct GROUP BY message_id), y AS (SELECT * FROM x LEFT JOIN n USING (message_id))"


def weighted(t):
    return messages(t).withColumn("rag_weight", F.when((F.col("role") == "assistant") & (F.col("message_id") % 4 != 0), F.col("message_id") % 100 / 100.0))


def conversations(t):
    return t.conversations.groupBy(F.col("conv_id").alias("conversation_id")).agg(F.max("turn").alias("created_at")).withColumn("persona", F.concat(F.lit("p"), (F.col("conversation_id") % 4).cast("string")))


_STATS = "SELECT 'p' || (conversation_id % 4) AS persona, count(DISTINCT conversation_id) AS conversations, round(avg(rag_weight), 6) AS avg_weight, sum(coalesce(n_citations, 0))::BIGINT AS citations, count(*) FILTER (role = 'assistant' AND rag_weight < 0.4) AS low_weights, count(*) FILTER (role = 'assistant') AS answers FROM y GROUP BY 1"


@query(f"{_W} {_STATS}")
def persona_stats(t):
    return A.persona_stats(conversations(t), weighted(t), citations(t)).select("persona", "conversations", F.round("avg_weight", 6).alias("avg_weight"), "citations", "low_weights", "answers")


@query(f"{_W}, s AS ({_STATS}) SELECT persona, round(CASE WHEN answers > 0 THEN 100.0::DOUBLE * citations / answers ELSE 0 END, 6) AS citation_rate, floor((1 - coalesce(avg_weight, 0)) * 100 + 0.5)::BIGINT AS gap_score FROM s")
def citation_rate(t):
    return A.persona_stats(conversations(t), weighted(t), citations(t)).select("persona", F.round("citation_rate", 6).alias("citation_rate"), "gap_score")


_LOW = f"{_W}, c AS (SELECT conversation_id, max(created_at) AS created_at FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100), l AS (SELECT conversation_id, c.created_at, avg(rag_weight) AS w, sum(coalesce(n_citations, 0))::BIGINT AS citations, bool_or(rag_weight < 0.4) AS low FROM c JOIN y USING (conversation_id) GROUP BY ALL), r AS (SELECT * FROM l WHERE low ORDER BY w NULLS LAST, conversation_id LIMIT 50)"


@query(f"{_LOW} SELECT conversation_id, round(w, 6) AS avg_weight, citations FROM r")
def low_weight_conversations(t):
    return A.low_weight_report(conversations(t), weighted(t), citations(t)).select("conversation_id", F.round("avg_weight", 6).alias("avg_weight"), "citations")


@query(f"{_LOW} SELECT conversation_id, message_id, row_number() OVER (ORDER BY w NULLS LAST, conversation_id, message_id) AS n FROM r JOIN m USING (conversation_id) WHERE role = 'user' AND length(trim(text)) >= 10 AND NOT regexp_matches(lower(text), 'solve|calculate|compute \\d+|^(hello|hi|hey|who are you|how are you)|^(why do you|what do you think|do you believe)') QUALIFY n <= 50")
def failed_queries(t):
    low = A.low_weight_report(conversations(t), weighted(t), citations(t))
    return A.failed_queries(low, messages(t)).select("conversation_id", "message_id", "n")


@query("SELECT doc_id, count(*) AS chunks, floor(sum(l) / count(*) + 0.5)::BIGINT AS avg_tokens, sum(l)::BIGINT AS tokens FROM (SELECT doc_id, ceil(length(unnest(string_split(text, chr(10)))) / 4)::BIGINT AS l FROM documents) GROUP BY doc_id")
def document_stats(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    return A.document_stats(lines.select("doc_id", X.token_estimate(F.col("x")).alias("token_count")))


@query("SELECT count(*) AS n, round(avg(l), 6) AS avg_tokens, min(l) AS min_tokens, max(l) AS max_tokens, count(*) FILTER (l < 100) AS too_small, count(*) FILTER (l > 1500) AS too_large, count(*) FILTER (lang = 'es') AS no_path FROM (SELECT lang, ceil(length(text) / 4)::BIGINT AS l FROM documents)")
def chunk_quality(t):
    c = t.documents.select(X.token_estimate(F.col("text")).alias("token_count"), F.when(F.col("lang") != "es", F.col("lang")).alias("section_path"))
    return A.chunk_quality(c).withColumn("avg_tokens", F.round("avg_tokens", 6))


@query("SELECT count(*) AS processed, count(*) FILTER (quality = 1 AND toxic = 0) AS ingested, count(*) FILTER (toxic = 1) AS failed, count(*) FILTER (quality = 0 AND toxic = 0) AS skipped, coalesce(sum(CASE WHEN quality = 1 AND toxic = 0 THEN doc_id % 9 END), 0)::BIGINT AS chunks, coalesce(sum(CASE WHEN quality = 1 AND toxic = 0 THEN doc_id END), 0)::BIGINT AS tokens FROM labels")
def ingestion_totals(t):
    s = F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "ingested").otherwise("skipped")
    return A.ingestion_totals(t.labels.select(s.alias("status"), (F.col("doc_id") % 9).alias("chunks"), F.col("doc_id").alias("tokens")))


@query("SELECT l_orderkey AS doc_id, round(CASE WHEN sum(l_quantity) = 0 THEN 0 ELSE sum(l_extendedprice) / sum(l_quantity) END, 4) AS retention, max(l_linenumber) AS pages FROM lineitem GROUP BY l_orderkey")
def retention_ratio(t):
    c = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_extendedprice").alias("formatted_chars"), F.col("l_quantity").alias("original_chars"), F.col("l_linenumber").alias("page_end"))
    return A.retention(c).withColumn("retention", F.round("retention", 4))


@query("SELECT count(url) - count(DISTINCT lower(url)) AS duplicates FROM (SELECT regexp_extract(url, '^[^?#]+', 0) AS url FROM pages)")
def duplicate_urls(t):
    return A.duplicate_urls(t.pages.select(F.regexp_extract("url", "^[^?#]+", 0).alias("url")))


@query("SELECT count(*) FILTER (length(text) < 10) AS missing, coalesce(count(*) FILTER (regexp_matches(lower(text), 'this chunk|this section|this document')) / count(*) > 0.5, false) AS mostly_generic FROM (SELECT regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents)")
def context_quality(t):
    return A.context_quality(t.documents.select(F.col("text").alias("context")))


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 40")
def dynamic_sort(t):
    return T.sorted_by(t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority"), "o_orderpriority", True, "o_orderkey").limit(40)
