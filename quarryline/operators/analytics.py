"""Grounding scores and the statistics over them (sections 2.7 and 2.10 C)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

LOW = 0.4  # weights below count as low


def rag_weight(text: Column, context: Column, avg_score: Column) -> Column:  # A15, A16
    """struct(rag_weight, citation_presence, factual_density, token_overlap, search_quality)."""
    presence, density = X.citation_presence(text), X.factual_density(text)["density"]
    overlap = X.ngram_containment(X.ngrams(X.tokens(text)), X.ngrams(X.tokens(X.context_text(context))))
    quality = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(avg_score, F.lit(0.0))))
    weight = X.round_half_up(0.60 * presence + 0.25 * density + 0.10 * overlap + 0.05 * quality, 2)
    return F.struct(weight.alias("rag_weight"), presence.alias("citation_presence"), density.alias("factual_density"), overlap.alias("token_overlap"), quality.alias("search_quality"))


def stored_weight(w: Column) -> Column:  # Q6: a weight of 0 is stored as null
    return F.nullif(w, F.lit(0.0))


def citations_per_message(citations: DataFrame) -> DataFrame:
    return citations.groupBy("message_id").agg(F.count("*").alias("n_citations"))


def persona_stats(conversations: DataFrame, messages: DataFrame, citations: DataFrame) -> DataFrame:  # A1, A2, A26, J3, Q7
    """Per persona: conversations that have messages, mean weight over those there are, citations, low weights, citation rate."""
    m = messages.join(citations_per_message(citations), "message_id", "left")
    answers = F.col("role") == "assistant"
    per = m.groupBy("conversation_id").agg(
        F.sum(F.when(answers, F.col("rag_weight"))).alias("w"), F.count(F.when(answers, F.col("rag_weight"))).alias("nw"),
        F.sum(F.coalesce("n_citations", F.lit(0))).alias("c"), F.count_if(answers & (F.col("rag_weight") < LOW)).alias("low"), F.count_if(answers).alias("a"),
    )
    out = conversations.select("conversation_id", "persona").join(per, "conversation_id").groupBy("persona").agg(
        F.count("*").alias("conversations"), (F.sum("w") / F.nullif(F.sum("nw"), F.lit(0))).alias("avg_weight"), F.sum("c").alias("citations"), F.sum("low").alias("low_weights"), F.sum("a").alias("answers")
    )
    rate = F.when(F.col("answers") > 0, 100.0 * F.col("citations") / F.col("answers")).otherwise(0.0)
    return out.withColumn("citation_rate", rate).withColumn("gap_score", F.floor((1 - F.coalesce("avg_weight", F.lit(0.0))) * 100 + F.lit(0.5)).cast("long"))


def conversation_weights(messages: DataFrame, citations: DataFrame) -> DataFrame:  # A3
    """Weights (0 to 1) are added exactly, as multiples of 2^-60, and rounded once, so that means, and what is ordered by them, don't change with the order of messages."""
    m = messages.join(citations_per_message(citations), "message_id", "left")
    total = F.sum((F.col("rag_weight") * F.lit(2.0**60)).cast("long").cast("decimal(20,0)")).cast("double") / F.lit(2.0**60)
    mean = F.try_divide(total, F.count("rag_weight"))
    return m.groupBy("conversation_id").agg(mean.alias("avg_weight"), F.sum(F.coalesce("n_citations", F.lit(0))).alias("citations"), F.coalesce(F.bool_or(F.col("rag_weight") < LOW), F.lit(False)).alias("has_low"))


def low_weight_report(conversations: DataFrame, messages: DataFrame, citations: DataFrame, newest: int = 100, most: int = 50) -> DataFrame:  # A4, S4
    """The limit on conversations comes before the filter, as the reference has it."""
    recent = conversations.orderBy(F.col("created_at").desc_nulls_first(), "conversation_id").limit(newest)
    weights = conversation_weights(messages.join(recent.select("conversation_id"), "conversation_id", "left_semi"), citations)
    return recent.join(weights, "conversation_id").where("has_low").orderBy(F.col("avg_weight").asc_nulls_last(), "conversation_id").limit(most)


def failed_queries(low: DataFrame, messages: DataFrame, most: int = 50) -> DataFrame:  # C4
    """Numbered user messages of low conversations that aren't off topic. low: conversation_id, avg_weight."""
    q = messages.where("role = 'user'").join(low.select("conversation_id", "avg_weight"), "conversation_id").where(~X.is_off_topic(F.col("text")))
    first = q.orderBy(F.col("avg_weight").asc_nulls_last(), "conversation_id", "message_id").limit(most)
    n = F.row_number().over(Window.orderBy(F.col("avg_weight").asc_nulls_last(), "conversation_id", "message_id"))
    return first.withColumn("n", n)


def status_counts(docs: DataFrame, column: str = "ingestion_status") -> DataFrame:  # A5
    return docs.agg(F.count("*").alias("total"), *(F.count_if(F.col(column) == s).alias(s) for s in ("extracted", "ingested", "failed")))


def job_counts(jobs: DataFrame, as_of: Column) -> DataFrame:  # A6, P10
    recent = jobs.where(F.col("created_at") >= as_of - F.expr("INTERVAL 24 HOURS"))
    return recent.agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("pending", "processing")).alias("pending"), F.count_if(F.col("status") == "failed").alias("failed"))


def types_per_persona(docs: DataFrame) -> DataFrame:  # A9, A10
    return docs.select(F.explode("personas").alias("persona"), "type").groupBy("persona").agg(F.count("*").alias("docs"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


def document_stats(chunks: DataFrame) -> DataFrame:  # A11
    n = F.count("*")
    return chunks.groupBy("doc_id").agg(n.alias("chunks"), X.round_half_up(F.sum("token_count") / n).cast("long").alias("avg_tokens"), F.sum("token_count").alias("tokens"))


def chunk_quality(chunks: DataFrame) -> DataFrame:  # A12
    t = F.col("token_count")
    return chunks.agg(
        F.count("*").alias("n"), F.avg(t).alias("avg_tokens"), F.min(t).alias("min_tokens"), F.max(t).alias("max_tokens"),
        F.count_if(t < 100).alias("too_small"), F.count_if(t > 1500).alias("too_large"), F.count_if(F.coalesce("section_path", F.lit("")) == "").alias("no_path"),
    )


def ingestion_totals(results: DataFrame) -> DataFrame:  # A13, A14
    ok = F.col("status") == "ingested"
    return results.agg(F.count("*").alias("processed"), F.count_if(ok).alias("ingested"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.coalesce(F.sum(F.when(ok, F.col("chunks"))), F.lit(0)).alias("chunks"), F.coalesce(F.sum(F.when(ok, F.col("tokens"))), F.lit(0)).alias("tokens"))


def retention(chunks: DataFrame) -> DataFrame:  # A17
    return chunks.groupBy("doc_id").agg(F.coalesce(F.try_divide(F.sum("formatted_chars"), F.sum("original_chars")), F.lit(0.0)).alias("retention"), F.max("page_end").alias("pages"))


def duplicate_urls(urls: DataFrame, url: str = "url") -> DataFrame:  # A18
    return urls.agg((F.count(url) - F.countDistinct(F.lower(url))).alias("duplicates"))


def context_quality(contexts: DataFrame) -> DataFrame:  # A19
    c = F.col("context")
    generic = F.lower(c).rlike("this chunk|this section|this document")
    return contexts.agg(F.count_if(c.isNull() | (F.length(X.trimmed(c)) < 10)).alias("missing"), F.coalesce(F.try_divide(F.count_if(generic), F.count("*")) > 0.5, F.lit(False)).alias("mostly_generic"))


def queue_state(jobs: DataFrame, as_of: Column) -> DataFrame:  # A20, ST8's retention
    stuck = (F.col("status") == "processing") & (F.col("started_at") < as_of - F.expr("INTERVAL 10 MINUTES"))
    old = ((F.col("status") == "completed") & (F.col("created_at") < as_of - F.expr("INTERVAL 24 HOURS"))) | ((F.col("status") == "failed") & (F.col("created_at") < as_of - F.expr("INTERVAL 7 DAYS")))
    return jobs.groupBy("status").agg(F.count("*").alias("n"), F.count_if(stuck).alias("stuck"), F.count_if(old).alias("expired"))


def model_averages(runs: DataFrame) -> DataFrame:  # A21
    return runs.groupBy("model").agg(F.count("*").alias("runs"), F.avg(F.when(F.col("ok"), F.col("ms"))).alias("avg_ms"), F.count_if("ok").alias("succeeded"))


def activity(events: DataFrame, ts: str, as_of: Column, key: str) -> DataFrame:  # A22
    age = lambda i: F.col(ts) >= as_of - F.expr(f"INTERVAL {i}")
    return events.where(F.col(ts) <= as_of).groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col(ts) >= F.date_trunc("day", as_of)).alias("today"), F.count_if(age("7 DAYS")).alias("this_week"), F.count_if(age("1 HOUR")).alias("last_hour"))


def longest_streak(events: DataFrame, user: str, ts: str) -> DataFrame:  # A23
    """Longest run of days in a row: days less their rank are equal within a run."""
    days = events.select(user, F.to_date(ts).alias("d")).distinct()
    run = F.date_sub("d", F.row_number().over(Window.partitionBy(user).orderBy("d")))
    return days.withColumn("run", run).groupBy(user, "run").agg(F.count("*").alias("n")).groupBy(user).agg(F.max("n").alias("streak_days"))


def graph_stats(entities: DataFrame, kind: str = "kind") -> DataFrame:  # A24
    return entities.groupBy(kind).agg(F.count("*").alias("entities"), F.avg("confidence").alias("avg_confidence"), F.sum("mentions").alias("mentions"))


def orphans(entities: DataFrame, edges: DataFrame) -> DataFrame:  # A24
    ends = edges.select(F.explode(F.array("src", "dst")).alias("entity_id")).distinct()
    return entities.join(ends, "entity_id", "left_anti")


def expired_sources(sources: DataFrame, ttl: int) -> DataFrame:  # A25
    return sources.where(F.col("turns_inactive") > ttl).groupBy("conversation_id").agg(F.count("*").alias("expired"))


def active_jobs(jobs: DataFrame, most: int = 50) -> DataFrame:  # P17, S3
    ids = F.coalesce(F.get(F.from_json(F.get_json_object("result_data", "$.docIds"), "array<string>"), F.lit(0)), F.get_json_object("result_data", "$.docId"), F.when(F.col("job_type") == "reingest", F.get_json_object("input_data", "$.docId")))
    return jobs.where(F.col("status").isin("pending", "processing")).withColumn("doc_id", ids).orderBy(F.col("created_at").desc_nulls_first(), "job_id").limit(most)


def job_fields(jobs: DataFrame, *fields: str) -> DataFrame:  # P16: fields of the result's JSON as columns
    return jobs.select("job_id", *(F.get_json_object("result_data", f"$.{f}").alias(f) for f in fields))


def job_millis(started: Column, completed: Column, as_of: Column) -> Column:
    return F.unix_millis(F.coalesce(completed, as_of).cast("timestamp")) - F.unix_millis(started.cast("timestamp"))


def batch_status(items: DataFrame, all_must_fail: bool = True) -> DataFrame:  # ST10
    return items.groupBy("job_id").agg(F.when(F.lit(all_must_fail) & (F.count_if("ok") == 0), "failed").otherwise("completed").alias("status"))


_CITATION = r"\[\^([^:\]]+):([^\]]+)\]"


def citation_list(messages: DataFrame, text: str = "text") -> DataFrame:  # C1, W6
    """(message_id, number, doc_id, section_path): different citations by first appearance. Array functions only: no row leaves its task."""
    raw = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(_CITATION), F.lit(0)))
    one = messages.select("message_id", F.posexplode(raw).alias("i", "raw"))
    return one.select("message_id", (F.col("i") + 1).alias("number"), X.trimmed(F.regexp_extract("raw", _CITATION, 1)).alias("doc_id"), X.trimmed(F.regexp_extract("raw", _CITATION, 2)).alias("section_path"))


def numbered_citations(text: Column) -> Column:  # C1: the text with links
    keys = r"\[\^([^:\]]+:[^\]]+)\]"
    return X.numbered(text, keys, lambda n: F.concat(F.lit("<sup>["), n, F.lit("](#citation-"), n, F.lit(")</sup>")))


def citation_rows(messages: DataFrame, refs: DataFrame, text: str = "text") -> DataFrame:  # C2, J11
    """Citations that can be stored: ref (doc_N) becomes the document_id it stood for; others are dropped."""
    c = citation_list(messages, text)
    marker = F.concat(F.lit("[^"), F.col("doc_id"), F.lit(":"), F.col("section_path"), F.lit("]"))
    return c.withColumn("marker", marker).withColumnRenamed("doc_id", "ref").join(refs, "ref").select("message_id", "document_id", "marker", F.col("number").alias("citation_order"))
