"""Grounding analytics over conversations; citations are added to the texts by a rule, as the tables have none."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import analytics as A
from .registry import query

_CITED = "k AS (SELECT conv_id * 4294967296 + turn AS message_id, conv_id, turn, role, text, text || '. In 2024 The System [^doc_' || (conv_id % 5 + 1) || ':Intro]. See [^doc_' || (turn % 3 + 1) || ':Part > Two] and [^doc_' || (conv_id % 5 + 1) || ':Intro].' AS answer FROM conversations WHERE role = 'assistant')"


def answers(t):
    n = lambda c, m: (F.col(c) % m + 1).cast("string")
    answer = F.concat("text", F.lit(". In 2024 The System [^doc_"), n("conv_id", 5), F.lit(":Intro]. See [^doc_"), n("turn", 3), F.lit(":Part > Two] and [^doc_"), n("conv_id", 5), F.lit(":Intro]."))
    return t.conversations.where("role = 'assistant'").select((F.col("conv_id") * 4294967296 + F.col("turn")).alias("message_id"), "conv_id", "turn", "role", "text", answer.alias("answer"))


@query("SELECT conv_id, turn, len(list_filter(string_split_regex(regexp_replace(lower(text), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda t: t <> '')) AS n_tokens FROM conversations")
def tokenise(t):
    return t.conversations.select("conv_id", "turn", F.size(X.tokens(F.col("text"))).alias("n_tokens"))


_GRAMS = """g AS (SELECT conv_id, turn, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) ELSE [] END AS g FROM (SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(lower(text), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda t: t <> '') AS w FROM conversations))"""


@query(f"WITH {_GRAMS} SELECT a.conv_id, a.turn, round(CASE WHEN len(a.g) > 0 AND len(b.g) > 0 THEN len(list_intersect(a.g, b.g))::DOUBLE / len(a.g) ELSE 0 END, 6) AS overlap FROM g a JOIN g b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1")
def trigram_overlap(t):
    g = t.conversations.select("conv_id", "turn", X.ngrams(X.tokens(F.col("text"))).alias("g"))
    before = g.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("g").alias("b"))
    return g.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.ngram_containment(F.col("g"), F.col("b")), 6).alias("overlap"))


_SENTENCES = "list_filter(list_transform(string_split_regex({0}, '[.!?]+(?:\\s+|$)'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"
_FACTUAL = "NOT (starts_with(lower(s), 'let me ') OR starts_with(lower(s), 'i ') OR starts_with(lower(s), 'to ') OR starts_with(lower(s), 'for example') OR starts_with(lower(s), 'generally') OR starts_with(lower(s), 'typically') OR contains(s, '?')) AND (regexp_matches(s, '[0-9]|[A-Z][a-z]|[A-Z][A-Z]') OR regexp_matches(lower(s), 'january|february|march|april|may|june|july|august|september|october|november|december|today|yesterday'))"
_DENSITY = f"{_CITED}, s AS (SELECT message_id, answer, {_SENTENCES.format('answer')} AS s FROM k), f AS (SELECT message_id, answer, s, list_filter(s, lambda s: {_FACTUAL}) AS f FROM s), d AS (SELECT message_id, len(s) AS total, len(f) AS factual, len(list_filter(f, lambda x: regexp_matches(x, '\\[\\^doc_\\d+:[^\\]]+\\]'))) AS cited FROM f)"


@query(f"WITH {_DENSITY} SELECT message_id, total, factual, cited, round(CASE WHEN total = 0 THEN 0 WHEN factual = 0 THEN 1 ELSE cited::DOUBLE / factual END, 6) AS density FROM d")
def sentence_factual_density(t):
    return answers(t).select("message_id", X.factual_density(F.col("answer")).alias("d")).select("message_id", "d.total", "d.factual", "d.cited", F.round("d.density", 6).alias("density"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS presence FROM conversations")
def citation_presence(t):
    text = F.concat("text", F.when(F.col("turn") % 2 == 1, " [^doc_3:A > B]").otherwise(" [^doc:x] [doc_1]"))
    return t.conversations.select("conv_id", "turn", X.citation_presence(text).alias("presence"))


_GRAMS_OF = "CASE WHEN len({0}) >= 3 THEN list_distinct(list_transform(range(1, len({0}) - 1), lambda i: array_to_string({0}[i:i + 2], ' '))) ELSE [] END"
_TOKENS_OF = "list_filter(string_split_regex(regexp_replace(lower({0}), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda t: t <> '')"
_CONTEXT = "regexp_replace(regexp_replace(regexp_replace('[Reference: ^doc_1:x]' || chr(10) || 'Document: ' || p.role || chr(10) || '---' || chr(10) || p.text, '\\[Reference:.*?\\]', '', 'g'), '(?m)^(Document|Section|Source):.*$', '', 'g'), '(?m)^---$', '', 'g')"


@query(
    f"""WITH {_DENSITY}, w AS (SELECT message_id, {_TOKENS_OF.format("answer")} AS a, {_TOKENS_OF.format("coalesce(" + _CONTEXT + ", '')")} AS c, coalesce((length(p.text) % 10) / 10.0::DOUBLE, 0) AS q FROM k LEFT JOIN conversations p ON p.conv_id = k.conv_id AND p.turn = k.turn - 1),
o AS (SELECT message_id, q, {_GRAMS_OF.format("a")} AS a, {_GRAMS_OF.format("c")} AS c FROM w)
SELECT message_id, floor((0.60::DOUBLE * 1.0::DOUBLE + 0.25::DOUBLE * CASE WHEN total = 0 THEN 0 WHEN factual = 0 THEN 1 ELSE cited::DOUBLE / factual END + 0.10::DOUBLE * CASE WHEN len(a) > 0 AND len(c) > 0 THEN len(list_intersect(a, c))::DOUBLE / len(a) ELSE 0 END + 0.05::DOUBLE * q) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS rag_weight FROM d JOIN o USING (message_id)"""
)
def rag_weight(t):
    """The context of an answer is the message before it; its search score follows from that message's length."""
    before = t.conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("before_role"), F.col("text").alias("before"))
    context = F.coalesce(F.concat(F.lit("[Reference: ^doc_1:x]\nDocument: "), "before_role", F.lit("\n---\n"), "before"), F.lit(""))
    w = A.rag_weight(F.col("answer"), context, F.coalesce(F.length("before") % 10 / 10.0, F.lit(0.0)))
    return answers(t).join(before, ["conv_id", "turn"], "left").select("message_id", w["rag_weight"].alias("rag_weight"))


@query("SELECT conv_id, turn, CASE WHEN w >= 0.7 THEN 'high' WHEN w >= 0.4 THEN 'medium' ELSE 'low' END AS category FROM (SELECT conv_id, turn, ((conv_id + turn) % 10) / 10.0::DOUBLE AS w FROM conversations)")
def rag_weight_category(t):
    return t.conversations.select("conv_id", "turn", X.weight_category((F.col("conv_id") + F.col("turn")) % 10 / 10.0).alias("category"))


@query(f"WITH {_CITED} SELECT message_id, text || '. In 2024 The System <sup>[1](#citation-1)</sup>. See <sup>[2](#citation-2)</sup> and <sup>[1](#citation-1)</sup>.' AS content FROM k")
def citation_numbering(t):
    return answers(t).select("message_id", A.numbered_citations(F.col("answer")).alias("content"))


@query(f"WITH {_CITED} SELECT message_id, 'D' || (conv_id % 5 + 1) AS document_id, '[^doc_' || (conv_id % 5 + 1) || ':Intro]' AS marker, 1 AS citation_order FROM k WHERE conv_id % 5 + 1 < 5 UNION ALL SELECT message_id, 'D' || (turn % 3 + 1), '[^doc_' || (turn % 3 + 1) || ':Part > Two]', 2 FROM k")
def citation_rows(t):
    refs = t.spark.range(1, 5).select(F.concat(F.lit("doc_"), F.col("id").cast("string")).alias("ref"), F.concat(F.lit("D"), F.col("id").cast("string")).alias("document_id"))
    return A.citation_rows(answers(t), refs, "answer")


@query(f"WITH {_CITED} SELECT message_id, 'doc_' || (conv_id % 5 + 1) || ':Intro,doc_' || (turn % 3 + 1) || ':Part > Two,doc_' || (conv_id % 5 + 1) || ':Intro' AS ids FROM k")
def citation_extract(t):
    return answers(t).select("message_id", F.array_join(X.citation_ids(F.col("answer")), ",").alias("ids"))


@query("SELECT doc_id, '#' || regexp_replace(regexp_replace(regexp_replace(lower(text), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g') AS anchor FROM documents")
def section_anchor(t):
    return t.documents.select("doc_id", X.section_anchor(F.col("text")).alias("anchor"))


@query("SELECT page_id, regexp_replace(url, '#.*', '') || '#part-two' AS link, '[' || (page_id % 5) || '] ' || CASE WHEN page_id % 2 = 0 THEN 'T' ELSE 'D' || page_id END || ', §Part > Two' AS label FROM pages")
def citation_links(t):
    path = F.lit("Part > Two")
    return t.pages.select("page_id", X.citation_url(F.col("url"), path).alias("link"), X.citation_label(F.col("page_id") % 5, F.when(F.col("page_id") % 2 == 0, "T").otherwise(""), F.concat(F.lit("D"), F.col("page_id").cast("string")), path).alias("label"))


_Q = "q AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'How does it ' WHEN 1 THEN 'What is 2+2 ' WHEN 2 THEN 'how do I resolve ' WHEN 3 THEN 'and ' WHEN 4 THEN 'Thanks ' ELSE '' END || text AS q FROM conversations)"


def asked(t):
    k = F.col("turn") % 6
    opening = F.when(k == 0, "How does it ").when(k == 1, "What is 2+2 ").when(k == 2, "how do I resolve ").when(k == 3, "and ").when(k == 4, "Thanks ").otherwise("")
    return t.conversations.select("conv_id", "turn", F.concat(opening, F.col("text")).alias("q"))


@query(f"""WITH {_Q} SELECT conv_id, turn, turn > 0 AND (regexp_matches(lower(q), '\\b(it|its|that|this|these|those|them|they|he|she|his|her)\\b') OR regexp_matches(lower(q), '^(how|why|what|when|where)\\s+(does|is|are|was|were|do)\\b|^(tell me|explain|describe|compare)\\s+(more|that|this|it)\\b') OR regexp_matches(lower(q), '\\b(also|additionally|furthermore|moreover)\\b|^(and|but|or|so)\\s|\\b(what about|how about)\\b')) AS flag FROM q""")
def needs_reformulation(t):
    return asked(t).select("conv_id", "turn", X.needs_reformulation(F.col("q"), F.col("turn") > 0).alias("flag"))


@query(f"""WITH {_Q}, z AS (SELECT conv_id, turn, regexp_replace(q, '^\\s+|\\s+$', '', 'g') AS q FROM q) SELECT conv_id, turn, length(q) < 10 OR regexp_matches(lower(q), 'what is \\d+[\\+\\-\\*\\/]\\d+|solve|calculate|compute \\d+') OR regexp_matches(lower(q), '^(hello|hi|hey|who are you|what''s your name|how are you)') OR regexp_matches(lower(q), '(favorite|favourite|like to|do you (enjoy|like)) (color|food|person|physicist|research|topic)|^(why do you|what do you think|do you believe)') OR regexp_matches(lower(q), '^(thanks|thank you|ok|okay|sure|yes|no|maybe)$') AS flag FROM z""")
def off_topic_flag(t):
    return asked(t).select("conv_id", "turn", X.is_off_topic(F.col("q")).alias("flag"))


@query("SELECT conv_id, turn, coalesce(nullif(left(regexp_replace(string_split_regex(text, '[.!?]')[1], '^\\s+|\\s+$', '', 'g'), 100), ''), 'New conversation') AS title FROM conversations")
def conversation_title(t):
    return t.conversations.select("conv_id", "turn", X.conversation_title(F.col("text")).alias("title"))


@query()
def slack_markdown(t):
    """Look-behind isn't in the oracle's regular expressions; tests hold it against values worked out by hand."""
    md = F.concat(F.lit("# Head\n**bold** and `code`\n- item\n> quote\n"), F.col("answer"))
    return answers(t).select("message_id", X.slack_markdown(md).alias("text"))
