"""Hybrid search and its parts: documents stand for chunks, their source for the document, embeddings of the same id for theirs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import ann as N
from ..operators import lexical as L
from ..operators import search as S
from ..sources.kept import kept
from .registry import Tables, query

TERMS = ["the", "idiot", "erin", "que", "der"]
QUERY = "the idiot erin que der"
CONVERSATION = 3  # the one in which the query is asked
_TERMS = ", ".join(f"'{t}'" for t in TERMS)

_V = """q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
vs AS (SELECT doc_id AS chunk_id, source AS doc_id, round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 6) AS score FROM documents JOIN embeddings ON vec_id = doc_id, q),
v AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM vs WHERE score >= 0.05 QUALIFY rank <= 20)"""
_B = f"""w AS (SELECT doc_id AS chunk_id, source AS doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda t: t <> '') AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
tf AS (SELECT term, chunk_id, doc_id, len, count(*) AS tf FROM (SELECT chunk_id, doc_id, len(w) AS len, unnest(w) AS term FROM w) WHERE term IN ({_TERMS}) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bs AS (SELECT chunk_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * len / mean))), 6) AS score FROM tf JOIN dfs USING (term), st GROUP BY chunk_id, doc_id),
b AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id, chunk_id) AS rank FROM bs WHERE score >= 0.1 QUALIFY rank <= 20)"""
_R = """r AS (SELECT chunk_id, coalesce(v.doc_id, b.doc_id) AS doc_id, round(coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 6) AS score, v.score AS vector_score, b.score AS bm25_score, coalesce(v.rank, b.rank + 1099511627776) AS ins FROM v FULL JOIN b USING (chunk_id))"""


def chunks(t: Tables):
    return t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), "text")


def vector_list(t: Tables):
    q = t.embeddings.where("vec_id = 0").select("embedding").first()[0]  # the query: one row
    docs = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"))
    # joined before the best are taken, as vectors may lack a chunk; the threshold is applied below the join
    mine = t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding").join(docs, "chunk_id")
    return S.vector_top(mine, q, threshold=0.05).select("chunk_id", "doc_id", "score", "rank")


def lexical_index(t: Tables) -> str:
    """The postings of a folder's documents, written once for each state of the table's files."""
    return kept(t.spark, "postings", f"{t.folder}/documents.parquet", lambda path: S.lexical_index(chunks(t), path))


def lexical_list(t: Tables):
    return S.bm25_top(S.bm25_of_index(t.spark, lexical_index(t), TERMS))


def fused(t: Tables):
    return S.rrf(*S.settled_together(lambda: vector_list(t), lambda: lexical_list(t)))


@query(f"WITH {_V} SELECT chunk_id, doc_id, score, rank FROM v")
def vector_topk(t):
    return vector_list(t)


@query(f"WITH {_B} SELECT chunk_id, doc_id, score, rank FROM b")
def bm25_topk(t):
    return lexical_list(t)


@query(f"WITH {_V}, {_B}, {_R} SELECT * FROM r")
def rrf_fusion(t):
    return fused(t)


_CHANGED = """final AS (SELECT doc_id AS chunk_id, source AS doc_id, CASE WHEN source = 'src5' THEN text || ' idiot erin' ELSE text END AS text FROM documents WHERE source <> 'src3' OR lang = 'en'
UNION ALL SELECT -1 - (conv_id * 4294967296 + turn), 'conversation', text FROM conversations), """ + _B.replace("doc_id AS chunk_id, source AS doc_id", "chunk_id, doc_id").replace("FROM documents", "FROM final")


def changed_index(t: Tables) -> str:
    """An index of all documents; then one source goes, another changes and the conversations come; then a part of what went comes back."""

    def build(path: str) -> None:
        every = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), "text", "lang")
        L.create(every.drop("lang"), path)
        longer = every.where("doc_id = 'src5'").withColumn("text", F.concat("text", F.lit(" idiot erin"))).drop("lang")
        talk = messages(t).select((-1 - F.col("message_id")).alias("chunk_id"), F.lit("conversation").alias("doc_id"), "text")
        L.change(t.spark, path, longer.unionByName(talk), every.where("doc_id = 'src3'").select("chunk_id"))
        L.change(t.spark, path, every.where("doc_id = 'src3' and lang = 'en'").drop("lang"))

    return kept(t.spark, "postings-changed", f"{t.folder}/documents.parquet", build)


@query(f"WITH {_CHANGED} SELECT chunk_id, doc_id, score, rank FROM b")
def bm25_after_changes(t):
    return S.bm25_top(L.scores(t.spark, changed_index(t), TERMS))


@query(f"WITH {_CHANGED} SELECT (SELECT count(*) FROM w) AS n, round((SELECT avg(len(w)) FROM w), 6) AS mean, term, df FROM dfs")
def lexical_statistics(t):
    """Corpus size, mean length and the terms' document counts after the changes."""
    path = changed_index(t)
    df = L.live_postings(t.spark, path, TERMS).groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(L.corpus(t.spark, path)).select("n", F.round("mean", 6).alias("mean"))).select("n", "mean", "term", "df")


_MSG = "m AS (SELECT conv_id * 4294967296 + turn AS message_id, conv_id AS conversation_id, role, turn AS created_at, text FROM conversations), ct AS (SELECT message_id, length(text) % 11 AS document_id FROM m WHERE contains(text, ','))"


def messages(t):
    return t.conversations.select((F.col("conv_id") * 4294967296 + F.col("turn")).alias("message_id"), F.col("conv_id").alias("conversation_id"), "role", F.col("turn").alias("created_at"), "text")


def citations(t):
    """A message with a comma cites one of eleven documents, by its length."""
    return messages(t).where(F.contains("text", F.lit(","))).select("message_id", (F.length("text") % 11).cast("long").alias("document_id"))


_CITED = f"{_MSG}, ra AS (SELECT * FROM m WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, message_id DESC) <= 2), c AS (SELECT DISTINCT source AS document_id FROM ra JOIN ct USING (message_id) JOIN documents ON doc_id = document_id WHERE conversation_id = {CONVERSATION})"


def cited(t):
    """Sources of the documents that the conversation at hand cited last."""
    ids = S.recently_cited(messages(t).where(F.col("conversation_id") == CONVERSATION), citations(t)).select(F.col("document_id").alias("doc_id"))
    return t.documents.select("doc_id", "source").join(ids.distinct(), "doc_id").select(F.col("source").alias("document_id")).distinct()


@query(f"WITH {_V}, {_B}, {_R}, {_CITED} SELECT chunk_id, doc_id, CASE WHEN doc_id IN (SELECT document_id FROM c) THEN round(score * 1.15::DOUBLE, 6) ELSE score END AS score, ins FROM r")
def citation_boost(t):
    return S.citation_boost(fused(t), cited(t)).select("chunk_id", "doc_id", "score", "ins")


_TAGS = "g AS (SELECT source AS doc_id, list_distinct(list(lang)) AS tags FROM documents GROUP BY source)"


def tags(t):
    return t.documents.groupBy(F.col("source").alias("doc_id")).agg(F.collect_set("lang").alias("tags"))


@query(f"WITH {_V}, {_B}, {_R}, {_TAGS} SELECT chunk_id, doc_id, CASE WHEN hit THEN round(score * 1.075::DOUBLE, 6) ELSE score END AS score, CASE WHEN hit THEN true END AS tag_boosted FROM (SELECT r.*, len(list_filter(tags, lambda x: contains('{QUERY}', x) OR contains('alias of es', x))) > 0 AS hit FROM r JOIN g USING (doc_id))")
def tag_boost(t):
    return S.tag_boost(fused(t), tags(t), QUERY, ["Alias of ES"]).select("chunk_id", "doc_id", "score", "tag_boosted")


@query(f"WITH {_V}, {_B}, {_R} SELECT chunk_id, doc_id, score, ins FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ins) <= 1")
def dedup_per_doc(t):
    return S.cap_per_document(fused(t), 1).select("chunk_id", "doc_id", "score", "ins")


@query(
    f"""WITH {_V}, {_B}, {_R}, {_CITED}, {_TAGS},
x AS (SELECT chunk_id, doc_id, CASE WHEN doc_id IN (SELECT document_id FROM c) THEN round(score * 1.15::DOUBLE, 6) ELSE score END AS score, ins FROM r),
y AS (SELECT chunk_id, x.doc_id, CASE WHEN len(list_filter(tags, lambda x: contains('{QUERY}', x) OR contains('alias of es', x))) > 0 THEN round(score * 1.075::DOUBLE, 6) ELSE score END AS score, ins FROM x JOIN g ON g.doc_id = x.doc_id),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ins) <= 3)
SELECT chunk_id, doc_id, score, row_number() OVER (ORDER BY score DESC, ins) AS rank FROM z QUALIFY rank <= 12"""
)
def hybrid_search(t):
    # what two messages cite is as bounded as a ranked list
    vector, lexical, recent = S.settled_together(lambda: vector_list(t), lambda: lexical_list(t), lambda: cited(t))
    return S.hybrid(vector, lexical, recent, tags(t), QUERY, ["Alias of ES"]).select("chunk_id", "doc_id", "score", "rank")


@query(f"WITH {_V}, {_B}, {_R} SELECT doc_id, count(*) AS n, arg_min(score, ins) AS first_score FROM r GROUP BY doc_id")
def results_by_document(t):
    return S.by_document(fused(t).withColumnRenamed("ins", "rank"))


@query(f"WITH {_B} SELECT w.chunk_id, w.doc_id, greatest(coalesce(score, 0), 0.01::DOUBLE) AS score FROM w LEFT JOIN bs ON bs.chunk_id = w.chunk_id WHERE list_has_any(w.w, ['idiot', 'moron']) UNION ALL SELECT chunk_id, doc_id, score FROM bs WHERE chunk_id NOT IN (SELECT chunk_id FROM w WHERE list_has_any(w, ['idiot', 'moron']))")
def metadata_keyword_boost(t):
    return S.metadata_boost(S.bm25_scores(chunks(t), TERMS), chunks(t), ["idiot", "moron", "all"])


@query(f"WITH {_MSG}, r AS (SELECT * FROM m WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC, message_id DESC) <= 2) SELECT DISTINCT conversation_id, document_id FROM r JOIN ct USING (message_id)")
def recently_cited_docs(t):
    return S.recently_cited(messages(t), citations(t))


@query(f"WITH {_V} SELECT v.chunk_id, 'doc_' || rank AS ref, CASE WHEN v.chunk_id % 2 = 0 THEN 'Main Content' ELSE 'Section ' || rank END AS section FROM v")
def context_refs(t):
    v = vector_list(t).withColumn("doc_title", F.col("doc_id")).withColumn("section_path", F.when(F.col("chunk_id") % 2 == 0, "").otherwise(F.concat(F.lit("Section "), F.col("rank").cast("string"))))
    return S.context_refs(v).select("chunk_id", "ref", "section")


@query(f"WITH {_V}, x AS (SELECT rank, '[Reference: ^doc_' || rank || ':Main Content]' || chr(10) || 'Document: ' || v.doc_id || chr(10) || 'Section: Main Content' || chr(10) || chr(10) || text AS b FROM v JOIN documents d ON d.doc_id = v.chunk_id) SELECT string_agg(b, chr(10) || chr(10) ORDER BY rank) AS context FROM x")
def context_assembly(t):
    v = vector_list(t).join(t.documents.select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id")
    return S.context_text(v.withColumn("doc_title", F.col("doc_id")).withColumn("section_path", F.lit("")))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, len(embedding) AS dims, len(list_filter(embedding, lambda x: x > 0)) AS positive FROM embeddings")
def vector_norms(t):
    return t.embeddings.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.size("embedding").alias("dims"), F.size(F.filter(V.binary_quantized(F.col("embedding")), lambda x: x)).alias("positive"))


@query("SELECT vec_id, unnest(range(0, len(embedding))) AS i, round(unnest(embedding::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS x FROM embeddings")
def vectors_normalized(t):
    return t.embeddings.select("vec_id", F.posexplode(V.normalized(F.col("embedding"))).alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("SELECT label, i, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY label, i")
def vector_centroid(t):
    return S.centroid(t.embeddings, "label").select("label", F.posexplode(F.transform("centroid", lambda x: F.round(x, 6))).alias("i", "mean")).withColumn("i", F.col("i").cast("long"))


@query("SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS is_valid FROM embeddings")
def vector_validate(t):
    return t.embeddings.select("vec_id", V.is_valid(F.col("embedding"), 64).alias("is_valid"))


@query("SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def vector_text_round_trip(t):
    return t.embeddings.select("vec_id", F.round(F.aggregate(V.from_text(V.to_text(F.col("embedding"))), F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("SELECT label, ceil(sum(n_chars) / count(*))::BIGINT AS tokens_each, round(sum(n_chars) / 1e6 * 0.13::DOUBLE, 6) AS cost FROM embeddings JOIN documents ON vec_id = doc_id GROUP BY label")
def embedding_cost(t):
    d = t.embeddings.select("label", F.col("vec_id").alias("doc_id")).join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return d.groupBy("label").agg(V.tokens_each(F.sum("n_chars"), F.count("*")).alias("tokens_each"), F.round(V.cost(F.sum("n_chars"), 0.13), 6).alias("cost"))


@query(
    """WITH g AS (SELECT p_partkey, p_name, list_distinct(list_transform(range(1, len('  ' || lower(p_name) || ' ') - 1), lambda i: substr('  ' || lower(p_name) || ' ', i, 3))) AS g FROM part),
h AS (SELECT list_distinct(list_transform(range(1, len('  part 1 ') - 1), lambda i: substr('  part 1 ', i, 3))) AS h)
SELECT p_partkey, round(len(list_intersect(g, h))::DOUBLE / len(list_distinct(list_concat(g, h))), 6) AS similarity FROM g, h"""
)
def trigram_similarity(t):
    return t.part.select("p_partkey", F.round(X.trigram_similarity(F.col("p_name"), F.lit("part 1")), 6).alias("similarity"))


@query()
def lsh_buckets(t):
    """Sizes of random-hyperplane buckets (an approximate index, so rows only)."""
    c = t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding")
    return S.lsh_candidates(c, 64).groupBy("bucket").agg(F.count("*").alias("n"))


def inverted_file(t: Tables) -> N.InvertedFile:
    v = t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding")
    return N.open_index(t.spark, kept(t.spark, "inverted-file", f"{t.folder}/embeddings.parquet", lambda path: N.write_index(v, path, 64)))


def _asked(t: Tables):
    return t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query()
def ivf_topk(t):
    """The ten nearest of each hundredth vector among all, by the inverted file: approximate, so its recall is tested instead."""
    return N.search_all(t.spark, inverted_file(t), _asked(t))


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS chunk_id, round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 6) AS score FROM embeddings, q WHERE vec_id <> query_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM s QUALIFY rank <= 10"""
)
def ivf_every_list(t):
    """The same with all lists probed, which is exact."""
    index = inverted_file(t)
    return N.search_all(t.spark, index, _asked(t), probes=len(index.centroids))


_GRAMS = "list_distinct(list_transform(range(1, len('  ' || lower({0}) || ' ') - 1), lambda i: substr('  ' || lower({0}) || ' ', i, 3)))"


def _trigrams(t: Tables, table: str, key: str, text: str) -> str:
    rows = getattr(t, table).select(F.col(key).alias("id"), F.col(text).alias("text"))
    return kept(t.spark, f"trigrams-{table}", f"{t.folder}/{table}.parquet", lambda path: L.trigram_index(rows, path))


@query(
    f"""WITH g AS (SELECT page_id AS id, {_GRAMS.format("url")} AS g FROM pages), p AS (SELECT q.id AS query_id, g.id, len(list_intersect(g.g, q.g))::DOUBLE / len(list_distinct(list_concat(g.g, q.g))) AS s FROM g, g q WHERE q.id % 100 = 0)
SELECT query_id, id, round(s, 6) AS similarity FROM p WHERE s >= 0.45::DOUBLE"""
)
def trigram_join(t):
    """Page addresses that are similar to each hundredth one."""
    asked = t.pages.where("page_id % 100 = 0").select(F.col("page_id").alias("query_id"), F.col("url").alias("text"))
    return L.trigram_matches(t.spark, _trigrams(t, "pages", "page_id", "url"), asked, 0.45)


@query(
    f"""WITH g AS (SELECT p_partkey, {_GRAMS.format("p_name")} AS g FROM part), q AS (SELECT {_GRAMS.format("'small rings'")} AS q), p AS (SELECT p_partkey, len(list_intersect(g, q))::DOUBLE / len(list_distinct(list_concat(g, q))) AS s FROM g, q)
SELECT p_partkey AS id, round(s, 6) AS similarity FROM p WHERE s >= 0.3::DOUBLE"""
)
def trigram_search(t):
    return L.trigram_search(t.spark, _trigrams(t, "part", "p_partkey", "p_name"), "small rings", 0.3)
