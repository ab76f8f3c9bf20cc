"""Text rules, validators, readers and small table operators over whole table texts; markup the tables lack is put round the texts."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import analytics as A
from ..operators import chunking as C
from ..operators import extract as E
from ..operators import search as S
from ..operators import sections as H
from ..operators import tables as T
from ..sources import files
from ..sources.scratch import shared_dir
from ..streaming import jobs as J
from .extraction import normal
from .registry import query
from .relational import _JOBS, jobs
from .structure import _L, _MD, marked

_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def _lit(*parts):
    return F.concat(*(F.lit(p) if i % 2 == 0 else F.col(p).cast("string") for i, p in enumerate(parts)))


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def not_null(t):
    return T.present(t.documents.select("doc_id").join(t.labels, "doc_id", "left"), "quality").select("doc_id", "quality")


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user'")
def own_rows(t):
    return T.owned(t.conversations, "role", "user").select("conv_id", "turn")


@query("SELECT doc_id FROM documents WHERE (contains(lower(source), 'e') OR contains(lower(doc_id::VARCHAR), 'e') OR contains(lower(lang), 'e')) AND lang = 'en' AND source IS NOT NULL AND n_chars // 1000 = 0")
def client_filter(t):
    d = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.array("lang").alias("tags"), F.array("lang").alias("personas"), (F.col("n_chars") / 1000).cast("long").alias("chunk_count"))
    return d.where(T.matches_client_filter("E", persona="en", empty_only=True)).select("doc_id")


@query("SELECT event_id AS job_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.title') AS title FROM events")
def job_fields(t):
    return A.job_fields(t.events.select(F.col("event_id").alias("job_id"), F.col("props").alias("result_data")), "k", "title")


@query("SELECT count(*) AS total FROM documents WHERE lang = 'fr'")
def exact_count(t):
    return T.counted(T.filtered(t.documents, lang="fr"))


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY coalesce(quality, 1), doc_id DESC LIMIT 100")
def sorted_by_weight(t):
    return T.by_weight(t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left"), "quality", F.desc("doc_id")).limit(100)


@query("WITH l AS (SELECT doc_id, i, string_split(x, chr(10))[i] AS line FROM (SELECT doc_id, x, unnest(range(1, len(string_split(x, chr(10))) + 1)) AS i FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN text || chr(10) || text ELSE text END AS x FROM documents))), d AS (SELECT doc_id, line, min(i) AS i, count(*) AS n FROM l GROUP BY doc_id, line), s AS (SELECT doc_id, count(*) < sum(n) * 0.8 AS many, string_agg(line, chr(10) ORDER BY i) AS text FROM d GROUP BY doc_id) SELECT doc_id, CASE WHEN many THEN s.text WHEN lang = 'en' THEN d.text || chr(10) || d.text ELSE d.text END AS text FROM s JOIN documents d USING (doc_id)")
def distinct_lines(t):
    twice = F.when(F.col("lang") == "en", F.concat("text", F.lit("\n"), "text")).otherwise(F.col("text"))
    return t.documents.select("doc_id", X.distinct_lines(twice).alias("text"))


@query("WITH b AS (SELECT doc_id, 2 AS kind, i AS n, string_split(text, chr(10))[i] AS text FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)), u AS (SELECT doc_id, 0 AS kind, 0 AS n, 'Document: ' || source || chr(10) || 'Type: ' || lang AS text FROM documents UNION ALL SELECT doc_id, 1, 0, CASE WHEN lang = 'en' THEN 'Abstract: ' || text END FROM documents UNION ALL SELECT * FROM b) SELECT doc_id, ['metadata', 'summary', 'body'][kind + 1] AS kind, row_number() OVER (PARTITION BY doc_id ORDER BY kind, n) - 1 AS chunk_index, text FROM u WHERE text IS NOT NULL")
def united_chunks(t):
    none = F.lit(None).cast("string")
    strings = F.array().cast("array<string>")
    meta = C.metadata_chunk(F.col("source"), F.col("lang"), none, strings, F.array().cast("array<struct<name:string,role:string>>"), F.create_map().cast("map<string,string>"))
    summary = C.summary_chunk(none, F.when(F.col("lang") == "en", F.col("text")), strings)
    return C.united(t.documents.select("doc_id", meta.alias("text")), t.documents.select("doc_id", summary.alias("text")), t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text")))


_JOINED = "f.lv <= s.level AND NOT ({0}) AND ceil(length(f.c) / 4) + ceil(length(s.content) / 4) < CASE WHEN s.title = 'Abstract' THEN 100 ELSE 800 END".format("s.title = 'Abstract'")


@query(
    f"""WITH RECURSIVE {_MD.replace("'### In ' || lang", "'### Abstract'")}, {_L},
s AS (SELECT h.doc_id, row_number() OVER (PARTITION BY h.doc_id ORDER BY h.i) AS k, length(hashes) AS level, title, coalesce((SELECT regexp_replace(string_agg(line, chr(10) ORDER BY l.i), '^\\s+|\\s+$', '', 'g') FROM l WHERE l.doc_id = h.doc_id AND l.i > h.i AND (h.nxt IS NULL OR l.i < h.nxt)), '') AS content FROM h),
f(doc_id, k, lv, c, g) AS (SELECT doc_id, k, level, content, 0 FROM s WHERE k = 1 UNION ALL SELECT s.doc_id, s.k, CASE WHEN {_JOINED} THEN f.lv ELSE s.level END, CASE WHEN {_JOINED} THEN f.c || chr(10) || chr(10) || s.content ELSE s.content END, CASE WHEN {_JOINED} THEN g ELSE g + 1 END FROM f JOIN s ON s.doc_id = f.doc_id AND s.k = f.k + 1)
SELECT doc_id, g AS n, arg_max(length(c), k) AS chars FROM f GROUP BY doc_id, g"""
)
def merged_sections(t):
    """As of a paper, so the abstract stays by itself."""
    md = F.regexp_replace(F.col("text"), r"\n### In [a-z]+\n", "\n### Abstract\n")
    s = marked(t).select("doc_id", H.sections_of(md).alias("s"))
    return s.select("doc_id", F.posexplode(C.sections_merged(F.col("s"), structure=F.lit("paper"))).alias("n", "x")).select("doc_id", "n", F.length("x.content").alias("chars"))


@query("SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '\\s', '', 'g') <> '')) AS sentences FROM documents")
def sentences_kept(t):
    return t.documents.select("doc_id", F.size(X.sentences_with_marks(F.col("text"))).alias("sentences"))


@query("SELECT doc_id, " + _TRIM.format("regexp_replace(regexp_replace(regexp_replace('[Reference: ^doc_' || doc_id || ':x]' || chr(10) || 'Document: ' || source || chr(10) || '---' || chr(10) || text, '\\[Reference:.*?\\]', '', 'g'), '(?m)^(Document|Section|Source):.*$', '', 'g'), '(?m)^---$', '', 'g')") + " AS text FROM documents")
def context_cleaned(t):
    return t.documents.select("doc_id", X.context_text(F.concat(_lit("[Reference: ^doc_", "doc_id", ":x]\nDocument: ", "source", "\n---\n"), F.col("text"))).alias("text"))


_CLEAN = _TRIM.format("regexp_replace(regexp_replace(text, '(\\w+)-\\s*\\n\\s*(\\w+)', '\\1\\2', 'g'), '\\s+', ' ', 'g')")


@query(f"SELECT doc_id, {normal('m')} || chr(10) AS md FROM (SELECT doc_id, CASE WHEN regexp_matches(c, '(?m)^#{{1,6}}\\s+|\\[.+\\]\\(.+\\)') THEN c WHEN c <> '' AND length(c) < 60 AND regexp_matches(c, '^[A-Z]') AND NOT ends_with(c, '.') THEN '## ' || c || chr(10) ELSE c || chr(10) END AS m FROM (SELECT doc_id, {_CLEAN} AS c FROM documents))")
def processed_markdown(t):
    return t.documents.select("doc_id", H.processed_markdown(F.col("text")).alias("md"))


@query("SELECT doc_id, nullif(regexp_extract('/data/personas/' || lang || '/RAG/' || source, '/personas/([^/]+)/', 1), '') AS persona FROM documents")
def persona_paths(t):
    return t.documents.select("doc_id", X.persona_from_path(_lit("/data/personas/", "lang", "/RAG/", "source")).alias("persona"))


@query("SELECT doc_id, 'https://site.org/' || source || '?q=' || doc_id AS first, 'https://link.org/' || doc_id AS second FROM documents")
def source_urls(t):
    first = F.concat(_lit("head\nSource: https://site.org/", "source", "?q=", "doc_id", "\n"), F.col("text"))
    second = F.concat(F.col("text"), _lit("\n[Original page](https://link.org/", "doc_id", ")"))
    return t.documents.select("doc_id", X.source_url_of(first).alias("first"), X.source_url_of_links(second).alias("second"))


@query("SELECT page_id, lower(CASE WHEN p = '' THEN h ELSE h || '-' || p END) AS id FROM (SELECT page_id, replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', ''), '.', '-') AS h, left(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '^/|/$', '', 'g'), '[^a-zA-Z0-9]+', '-', 'g'), 50) AS p FROM pages)")
def url_ids(t):
    return t.pages.select("page_id", X.id_from_url(F.col("url")).alias("id"))


@query("SELECT p_partkey, 'US' || (10000000 + p_partkey) || 'B2' AS patent, 'US' || (10000000 + p_partkey) || 'B2' AS file_patent, '2405.' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') AS arxiv, 'https://patents.google.com/patent/US' || (10000000 + p_partkey) || 'B2' AS url FROM part")
def patent_names(t):
    n = (F.col("p_partkey") + 10000000).cast("string")
    arxiv = F.concat(F.lit("paper-2405."), F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0"), F.lit(".pdf"))
    spaced = F.concat(F.lit("us "), F.substring(n, 1, 2), F.lit(","), F.substring(n, 3, 9), F.lit(" b2"))
    name = F.concat(F.lit("us"), n, F.lit("b2"))
    return t.part.select("p_partkey", X.patent_number(spaced).alias("patent"), X.patent_of_filename(F.concat(name, F.lit(".pdf"))).alias("file_patent"), X.arxiv_of_filename(arxiv).alias("arxiv"), S.patent_url(name).alias("url"))


@query("SELECT c_custkey, c_name || ';' || 'N' || c_nationkey AS authors FROM customer")
def author_lists(t):
    return t.customer.select("c_custkey", F.array_join(X.authors(F.concat("c_name", F.lit(", Jan 5, 2021 and N"), F.col("c_nationkey").cast("string"))), ";").alias("authors"))


@query("SELECT doc_id, replace(replace(replace(replace(text || '\"' || source, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r') AS text FROM documents")
def yaml_escaped(t):
    return t.documents.select("doc_id", X.yaml_escape(F.concat("text", F.lit('"'), "source")).alias("text"))


@query("SELECT doc_id, " + _TRIM.format("regexp_replace(text || ' <@U1A> ' || text, '<@[A-Z0-9]+>', '', 'g')") + " AS text FROM documents")
def mentions_stripped(t):
    return t.documents.select("doc_id", X.strip_mentions(F.concat("text", F.lit(" <@U1A> "), "text")).alias("text"))


@query("SELECT doc_id, '$' || text || '$ and ' || chr(10) || '$$' || chr(10) || text || chr(10) || '$$' || chr(10) AS text FROM documents")
def latex_rewritten(t):
    return t.documents.select("doc_id", X.latex_delimiters(F.concat(F.lit("\\("), "text", F.lit("\\) and \\["), "text", F.lit("\\]"))).alias("text"))


@query("SELECT conv_id, string_agg('[' || turn || '] ' || text || CASE WHEN role = 'user' THEN ' - http://x/' || turn ELSE '' END, chr(10) ORDER BY turn) AS sources FROM conversations GROUP BY conv_id")
def sources_lists(t):
    c = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("number"), F.col("text").alias("title"), F.when(F.col("role") == "user", F.concat(F.lit("http://x/"), F.col("turn").cast("string"))).alias("url")))).alias("c"))
    return c.select("conv_id", X.sources_list(F.col("c")).alias("sources"))


@query("SELECT doc_id, '{\"lang\": \"' || lang || '\", \"n\": ' || n_chars || '}' AS json FROM documents")
def json_repaired(t):
    return t.documents.select("doc_id", X.json_in(_lit('text ```json\n{"lang": "', "lang", '", "n": ', "n_chars", ", }\n``` more")).alias("json"))


@query("SELECT doc_id, " + _TRIM.format("regexp_replace(regexp_replace(text || chr(9) || '  ' || text || chr(10) || chr(10) || chr(10) || chr(10) || text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')") + " AS text FROM documents")
def sections_cleaned(t):
    return t.documents.select("doc_id", X.clean_section(F.concat("text", F.lit("\t  "), "text", F.lit("\n\n\n\n"), "text")).alias("text"))


@query("SELECT doc_id, left(string_split_regex(text, '[.!?]\\s')[1], 200) AS summary FROM documents")
def summary_fallback(t):
    return t.documents.select("doc_id", X.summary_fallback(F.col("text")).alias("summary"))


@query("SELECT doc_id, '**Key Terms**: ' || lang || ',' || source || chr(10) || chr(10) || text AS replaced, '**Also Known As**: ' || lang || chr(10) || chr(10) || text AS added FROM documents")
def term_lines(t):
    given = F.concat(F.lit("**Key Terms**: old, older\n\n"), "text")
    return t.documents.select("doc_id", X.with_line(given, "Key Terms", X.merged_terms(F.col("lang"), F.col("source"))).alias("replaced"), X.with_line(F.col("text"), "Also Known As", F.col("lang")).alias("added"))


@query("SELECT doc_id, " + _TRIM.format("left(" + _TRIM.format("text") + ", 500)") + " AS abstract, '1. a ' || lang || ' part|2. the part of claim 1' AS claims FROM documents")
def abstract_and_claims(t):
    s = H.sections_of(F.concat(F.lit("# T\n## Abstract\n"), "text", F.lit("\n## Claims\n1. a "), "lang", F.lit(" part\n2. the part of claim 1\n")))
    return t.documents.select("doc_id", s.alias("s")).select("doc_id", H.abstract_of(F.col("s")).alias("abstract"), F.array_join(H.first_claims(F.col("s")), "|").alias("claims"))


_LONG = """b AS (SELECT page_id, '<meta name="DC.title" content="T"><section itemprop="abstract"><div>' || url || '</div></section><section ' AS front, '<heading>Part</heading>' || html AS part, 700000 // (23 + length(html)) + 2 AS n FROM pages),
l AS (SELECT page_id, length(front) + 23 + n * length(part) + length(_CLAIMS) AS whole, length(part) AS part, n - 1 AS parts, (300000 - 23) // length(part) AS m0, 300000 // length(part) AS m FROM b),
g AS (SELECT *, CASE WHEN parts <= m0 THEN 1 ELSE 1 + ceil((parts - m0) / m)::BIGINT END AS groups FROM l)"""
_CLAIMS = '</section><section itemprop="claims">' + "".join(f'<div class="claim" num="{i}">Part {i}.</div>' for i in range(1, 6)) + "</section>"

PAGES_A_TASK = 32  # what a task has in memory of its long pages at once


def long_pages(t):
    """Each page as the parts of a description of 700,000 characters and more, behind an abstract and before five claims."""
    front = F.concat(F.lit('<meta name="DC.title" content="T"><section itemprop="abstract"><div>'), "url", F.lit("</div></section><section "))
    part = F.concat(F.lit("<heading>Part</heading>"), "html")
    body = F.repeat(part, F.expr("cast(700000 div (23 + length(html)) + 2 as int)"))
    # each short row becomes a long one, so rows are dealt to all cores before, those too that a cluster has yet to start, and few to a task
    dealt = t.pages.repartition(max(4 * t.spark.sparkContext.defaultParallelism, 96, t.pages.count() // PAGES_A_TASK))
    return dealt.select("page_id", F.concat(front, F.lit('itemprop="description">'), body, F.lit(_CLAIMS)).alias("html"))


@query(f"WITH {_LONG.replace('_CLAIMS', chr(39) + _CLAIMS + chr(39))} SELECT page_id, 200000 AS first, whole, groups + 2 AS windows, 5 AS claims, groups * 50000 + 23 + parts * part AS described FROM g")
def page_windows(t):
    """Pages of several windows: header and abstract, the description in groups of its parts behind the page's first characters, and the claims, once. Windows are measured where they are made."""

    @F.arrow_udf("struct<windows: int, claims: int, described: int>")
    def measured(pages: pa.Array) -> pa.Array:
        rows = [{"windows": len(w), "claims": sum(x.count('class="claim"') for x in w), "described": sum(map(len, w[1:-1]))} for w in (x.as_py() for x in pages)]
        return pa.array(rows, pa.struct([(k, pa.int32()) for k in ("windows", "claims", "described")]))

    html = F.col("html")
    w = long_pages(t).select("page_id", F.length(E.first_window(html)).alias("first"), F.length(html).alias("whole"), measured(E.html_windows(html)).alias("w"))
    return w.select("page_id", "first", "whole", "w.windows", "w.claims", "w.described")


_PAGE = "'<meta name=\"DC.title\" content=\"T ' || page_id || '\">'"


@query("SELECT page_id, 'T ' || page_id AS title, url AS abstract, 'US' || (1000000 + page_id) || 'A1' AS publication, '2020-01-02' AS filing, '2040-01-02' AS expiration, 'Ann Lee;Acme ' || page_id AS people, 'EP' || (2000000 + page_id) || 'B1' AS family FROM pages")
def patent_page(t):
    n = F.col("page_id").cast("string")
    number, other = F.concat(F.lit("US"), (F.col("page_id") + 1000000).cast("string"), F.lit("A1")), F.concat(F.lit("EP"), (F.col("page_id") + 2000000).cast("string"), F.lit("B1"))
    html = F.concat(
        F.lit('<meta name="DC.title" content="T '), n, F.lit('"><meta name="DC.contributor" scheme="inventor" content="Ann Lee"><dd itemprop="publicationNumber">'), number,
        F.lit('</dd><dd itemprop="assigneeCurrent">Acme '), n, F.lit('</dd><time itemprop="filingDate" datetime="2020-01-02">x</time><time itemprop="expiration" datetime="2040-01-02">x</time><section itemprop="abstract"><div>'),
        F.col("url"), F.lit("</div></section><p>"), other, F.lit(" "), number, F.lit("</p>"),
    )
    p = t.pages.select("page_id", E.patent_parts(html).alias("p"), E.patent_metadata(html).alias("m"), E.patent_family(html, number).alias("f"))
    people = F.array_join(F.transform("m.actors", lambda a: a["name"]), ";")
    return p.select("page_id", "p.title", "p.abstract", F.col("m.publication_number").alias("publication"), "m.filing", "m.expiration", people.alias("people"), F.array_join("f", ",").alias("family"))


@query("SELECT doc_id, '2405.' || lpad((doc_id % 100000)::VARCHAR, 5, '0') AS arxiv_id, '10.1234/x' || doc_id AS doi, '2025-01-21' AS submitted FROM documents")
def paper_metadata(t):
    text = F.concat(F.col("text"), _lit("\nDOI: 10.1234/x", "doc_id", " \nv2 [21 Jan 2025]\n"))
    name = F.concat(F.lit("2405."), F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0"), F.lit(".pdf"))
    return t.documents.select("doc_id", E.paper_metadata(text, name).alias("m")).select("doc_id", "m.arxiv_id", "m.doi", "m.submitted")


@query("SELECT doc_id, 'f' || chr(10) || '**Key Terms**: ' || lang || ', ' || source || chr(10) || chr(10) || text AS document, '# ' || source || chr(10) || chr(10) || '**Authors**: Ann, ' || lang || chr(10) || chr(10) || '**Source**: http://x/' || doc_id || chr(10) || chr(10) || text AS article FROM documents")
def assembled_documents(t):
    return t.documents.select(
        "doc_id", E.assembled(F.lit("f"), F.array("lang", "source"), F.col("text")).alias("document"), E.article(F.col("source"), F.array(F.lit("Ann"), F.col("lang")), _lit("http://x/", "doc_id"), F.col("text")).alias("article")
    )


@query("SELECT doc_id, concat_ws(';', CASE WHEN lang = 'fr' THEN 'missing title' END, CASE WHEN " + _TRIM.format("text") + " = '' THEN 'missing summary' END, CASE WHEN length(text) < 100 THEN 'content too short' END) AS problems FROM documents")
def document_problems(t):
    return t.documents.select("doc_id", F.array_join(E.document_problems(F.when(F.col("lang") != "fr", F.col("source")), F.col("text"), F.col("text")), ";").alias("problems"))


@query("SELECT source, concat_ws(';', CASE WHEN n > 0 THEN 'Found ' || n || ' duplicate URLs' END, CASE WHEN m > 50 THEN 'Large batch detected: ' || m END) AS problems FROM (SELECT source, count(*) - count(DISTINCT lang) AS n, count(*) AS m FROM documents GROUP BY source)")
def url_list_problems(t):
    """A list for each source, of one address a document that its language alone tells apart. Lists are as long as a source has documents."""
    lists = t.documents.groupBy("source").agg(F.array_join(F.collect_list(F.concat(F.lit("- http://x/"), "lang")), "\n").alias("list"))
    return lists.select("source", F.array_join(E.url_list_problems(F.col("list")), ";").alias("problems"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 'extracted' ELSE 'ingested' END ELSE 'pending' END AS status FROM labels")
def reingest_marks(t):
    return t.labels.select("doc_id", E.reingest_status(F.when(F.col("quality") == 1, "ingested").otherwise("pending"), F.col("toxic") == 1).alias("status"))


@query("SELECT doc_id, lang || ':' || 'a,b c,' || source AS first, '## Voice' || chr(10) || lang || chr(10) || chr(10) || '## Scope' || chr(10) || source AS prompt FROM documents")
def persona_topics(t):
    md = _lit("# P\n## Scope\n", "source", "\n## Other\nx\n## Voice\n", "lang", "\n## Topics\n### Topic 1: ", "lang", '\n**Aliases**: a, "b c", ', "source", "\n### Topic 2: z\n")
    topic = F.get(E.topics(md), F.lit(0))
    flat = F.array_join(S.flat_aliases(F.array(topic)), ",")
    return t.documents.select("doc_id", F.concat(topic["id"], F.lit(":"), flat).alias("first"), E.selected_sections(md, ["Voice", "Scope"]).alias("prompt"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN '2.0' ELSE '1.0.0' END AS version, '2024-05-06' AS last_updated, CASE WHEN lang = 'fr' THEN 0.5::DOUBLE ELSE 0.35::DOUBLE END AS vector_threshold FROM documents")
def persona_defaults(t):
    none = F.lit(None)
    config = F.struct(F.when(F.col("lang") == "en", "2.0").alias("version"), none.cast("string").alias("last_updated"), F.struct(F.when(F.col("lang") == "fr", 0.5).alias("vector_threshold")).alias("search"))
    return t.documents.select("doc_id", E.persona_defaults(config, F.lit("2024-05-06").cast("date")).alias("d")).select("doc_id", "d.version", "d.last_updated", "d.vector_threshold")


@query("SELECT doc_id, concat_ws(',', 'a', lang, CASE WHEN source <> lang AND source <> 'a' THEN source END) AS actors FROM documents WHERE lang <> 'a'")
def merged_actors(t):
    actor = lambda n: F.struct(n.alias("name"), F.lit("r").alias("role"))
    both = T.merged_by_name(F.array(actor(F.lit("a")), actor(F.col("lang"))), F.array(actor(F.lit("a")), actor(F.col("source"))))
    return t.documents.select("doc_id", F.array_join(F.transform(both, lambda x: x["name"]), ",").alias("actors"))


@query("SELECT p_partkey, p_size || 'A' AS label FROM part ORDER BY p_size, p_partkey LIMIT 200")
def figures_in_order(t):
    label = F.concat(F.col("p_size").cast("string"), F.lit("A"))
    return t.part.select("p_partkey", label.alias("label")).orderBy(T.figure_order(F.col("label")), "p_partkey").limit(200)


@query("SELECT r_regionkey, r_name FROM region WHERE r_name = 'ASIA'")
def single_row(t):
    return T.single(t.region.where("r_name = 'ASIA'").select("r_regionkey", "r_name"))


@query("SELECT doc_id, length(text)::DOUBLE AS a, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS b FROM documents")
def embedded(t):
    """With an embedder that counts characters, as models are given as functions."""
    out = S.embed(t.documents.select("doc_id", "text"), lambda texts: [[float(len(x)), float(x.count("e"))] for x in texts])
    return out.select("doc_id", F.get("embedding", F.lit(0)).cast("double").alias("a"), F.get("embedding", F.lit(1)).cast("double").alias("b"))


@query(f"WITH {_JOBS}, s AS (SELECT user_id AS job_id, max(job_id) AS ts FROM j WHERE created_at < TIMESTAMP '2024-01-20' GROUP BY user_id) SELECT j.user_id AS job_id, j.status, j.job_id AS ts, j.status IN ('completed', 'failed') AS is_last FROM j LEFT JOIN s ON s.job_id = j.user_id WHERE s.ts IS NULL OR j.job_id > s.ts")
def progress_subscribed(t):
    u = jobs(t).select(F.col("user_id").alias("job_id"), "status", F.col("job_id").alias("ts"), "created_at")
    snapshot = u.where("created_at < timestamp '2024-01-20'").groupBy("job_id").agg(F.max("ts").alias("updated_at"), F.max_by("status", "ts").alias("status"))
    return J.subscribe(snapshot, u.drop("created_at"))


def _folder(t, name):
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT source, sum(strlen(text) + 1)::BIGINT AS bytes, 'text' AS file_type FROM documents GROUP BY source")
def files_scanned(t):
    """The texts as files, one folder a source; read back as files in folders below."""
    path = _folder(t, "files")
    t.documents.select("text", "source").write.partitionBy("source").text(path)
    source = F.regexp_extract("path", "source=([^/]*)/", 1)
    return files.scan(t.spark, path, glob="*.txt").groupBy(source.alias("source"), "file_type").agg(F.sum("length").alias("bytes"))


@query("SELECT lang, sum(length(text) + 1)::BIGINT AS chars FROM documents GROUP BY lang")
def files_as_text(t):
    path = _folder(t, "texts")
    t.documents.select("text", "lang").write.partitionBy("lang").text(path)
    return files.plain_text(t.spark, path).groupBy(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang")).agg(F.sum(F.length("text")).alias("chars"))


@query("SELECT lang, 2 * count(*) AS n FROM documents GROUP BY lang")
def rows_appended(t):
    path = _folder(t, "rows")
    for _ in range(2):
        files.append(t.documents.select("doc_id", "lang"), path)
    return t.spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang, CASE WHEN lang IN ('en', 'fr') THEN 'new' ELSE 'old' END AS v FROM documents")
def partitions_replaced(t):
    path = _folder(t, "partitions")
    files.replace_partitions(t.documents.select("doc_id", F.lit("old").alias("v"), "lang"), path, "lang")
    files.replace_partitions(t.documents.where("lang in ('en', 'fr')").select("doc_id", F.lit("new").alias("v"), "lang"), path, "lang")
    return t.spark.read.parquet(path).select("doc_id", "lang", "v")


@query("SELECT doc_id, text FROM documents WHERE doc_id = 7")
def row_downloaded(t):
    """One document is asked for, by its key."""
    d = t.documents.select("doc_id", "text")
    return t.spark.createDataFrame(files.download(d, "doc_id", 7), d.schema)


@query("SELECT lang, sum(length(text) + 1)::BIGINT AS chars, 'text' AS file_type FROM documents GROUP BY lang")
def files_migrated(t):
    path, to = _folder(t, "local"), _folder(t, "store")
    t.documents.select("text", "lang").write.partitionBy("lang").text(path)
    files.migrate(t.spark, path, to)
    return t.spark.read.parquet(to).groupBy(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang"), "file_type").agg(F.sum(F.length("text")).alias("chars"))
