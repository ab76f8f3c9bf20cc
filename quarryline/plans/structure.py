"""Sections, blocks and chunks. Headings are added to the texts by a rule, as the tables have none."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import analytics as A
from ..operators import chunking as C
from ..operators import sections as S
from .registry import query

_MD = "md AS (SELECT doc_id, 'before' || chr(10) || '# Doc ' || doc_id || chr(10) || text || chr(10) || '## From ' || source || chr(10) || text || chr(10) || '### In ' || lang || chr(10) || text || chr(10) || '## Part B' || chr(10) || text AS md FROM documents)"


def marked(t):
    text = F.col("text")
    parts = [F.lit("before\n# Doc "), F.col("doc_id").cast("string"), F.lit("\n"), text, F.lit("\n## From "), F.col("source"), F.lit("\n"), text, F.lit("\n### In "), F.col("lang"), F.lit("\n"), text, F.lit("\n## Part B\n"), text]
    return t.documents.select("doc_id", F.concat(*parts).alias("text"))


_L = "l AS (SELECT doc_id, i, string_split(md, chr(10))[i] AS line FROM (SELECT doc_id, md, unnest(range(1, len(string_split(md, chr(10))) + 1)) AS i FROM md)), h AS (SELECT doc_id, i, regexp_extract(line, '^(#{1,6})\\s+(.+)$', 1) AS hashes, regexp_extract(line, '^(#{1,6})\\s+(.+)$', 2) AS title, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM l WHERE regexp_matches(line, '^#{1,6}\\s+.+$'))"


@query(
    f"WITH {_MD}, {_L}, n AS (SELECT doc_id, max(i) AS n FROM l GROUP BY doc_id), s AS (SELECT h.doc_id, row_number() OVER (PARTITION BY h.doc_id ORDER BY h.i) - 1 AS section_no, length(hashes) AS level, title, h.i - 1 AS start_line, coalesce(nxt - 1, n) - 1 AS end_line, h.i, nxt FROM h JOIN n USING (doc_id)) SELECT s.doc_id, section_no, level, title, start_line, end_line, coalesce(c.n_chars, 0) AS n_chars FROM s LEFT JOIN (SELECT s.doc_id, s.i, length(regexp_replace(string_agg(line, chr(10) ORDER BY l.i), '^\\s+|\\s+$', '', 'g')) AS n_chars FROM s JOIN l ON l.doc_id = s.doc_id AND l.i > s.i AND (s.nxt IS NULL OR l.i < s.nxt) GROUP BY s.doc_id, s.i) c ON c.doc_id = s.doc_id AND c.i = s.i"
)
def extract_sections(t):
    return S.sections(marked(t)).select("doc_id", "section_no", "level", "title", "start_line", "end_line", F.length("content").alias("n_chars"))


@query(
    f"""WITH {_MD}, {_L}, s AS (SELECT doc_id, i, length(hashes) AS level, regexp_replace(title, '^\\s+|\\s+$', '', 'g') AS title, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM h),
u AS (SELECT s.doc_id, s.i, a.i AS pos, a.title, a.level, min(b.level) AS least FROM s JOIN s a ON a.doc_id = s.doc_id AND a.i <= s.i JOIN s b ON b.doc_id = s.doc_id AND b.i > a.i AND b.i <= s.i GROUP BY ALL UNION ALL SELECT doc_id, i, i AS pos, title, level, 99 FROM s),
p AS (SELECT doc_id, i, list(title ORDER BY pos) AS path FROM u WHERE level < least GROUP BY doc_id, i),
r AS (SELECT doc_id, arg_min(title, i) AS first, arg_min(level, i) = min(level) AS top FROM s GROUP BY doc_id)
SELECT doc_id, array_to_string(CASE WHEN len(path) > 1 AND top AND path[1] = first THEN path[2:] ELSE path END, ' > ') AS path FROM p JOIN r USING (doc_id)"""
)
def section_paths(t):
    return S.sections(marked(t)).select("doc_id", "path")


_TYPE = "CASE WHEN regexp_matches(line, '^[A-Z][A-Z\\s]{3,}$|^\\d+\\.\\s+[A-Z]|^[IVXLCDM]+\\.\\s+[A-Z]') THEN 'heading' WHEN regexp_matches(line, '^[-•*]\\s+|^\\d+[.)]\\s+|^[a-z][.)]\\s+') THEN 'list' WHEN regexp_matches(line, '\\s{3,}|\\t|\\|') THEN 'table' WHEN regexp_matches(line, '^(function|class|def|const|let|var|if|for|while)\\s') OR (regexp_matches(line, '[{}();]') AND regexp_matches(line, '\\s{2,}')) THEN 'code' ELSE 'paragraph' END"
_LINES = "SELECT doc_id, i - 1 AS line_no, regexp_replace(CASE i % 5 WHEN 1 THEN '- ' WHEN 2 THEN '1. ' WHEN 3 THEN 'if ' ELSE '' END || line, '^\\s+|\\s+$', '', 'g') AS line FROM (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"


def _sign(n):
    """Put before line n, as the texts have neither lists nor code."""
    return F.when(n % 5 == 1, "- ").when(n % 5 == 2, "1. ").when(n % 5 == 3, "if ").otherwise("")


@query(
    f"SELECT doc_id, line_no, {_TYPE} AS type FROM ({_LINES})"
)
def line_types(t):
    lines = S.lines(t.documents).withColumn("line", X.trimmed(F.concat(_sign(F.col("line_no") + 1), F.col("line"))))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), X.line_type(F.col("line")).alias("type"))


@query(
    f"""WITH x AS (SELECT doc_id, line_no AS i, CASE WHEN line = '' THEN NULL ELSE {_TYPE} END AS t FROM ({_LINES})),
y AS (SELECT *, sum(CASE WHEN t IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM x))
SELECT doc_id, min(i) AS start_line, max(i) AS end_line, any_value(t) AS type, count(*) AS n_lines FROM y WHERE t IS NOT NULL GROUP BY doc_id, g"""
)
def text_blocks(t):
    text = F.array_join(F.transform(F.split("text", "\n"), lambda line, i: F.concat(_sign(i + 1), line)), "\n")
    b = t.documents.select("doc_id", F.explode(S.blocks_of(text)).alias("b"))
    return b.select("doc_id", F.col("b.start_line").cast("long").alias("start_line"), F.col("b.end_line").cast("long").alias("end_line"), "b.type", F.size(F.split("b.content", "\n")).cast("long").alias("n_lines"))


_PAGES = "s AS (SELECT doc_id, p, {0} AS n, {1} AS h FROM (SELECT doc_id, length(substr(text, (p - 1) * c + 1, c)) AS size, p FROM (SELECT doc_id, text, ceil(length(text) / 8)::BIGINT AS c, unnest(range(1, 9)) AS p FROM documents)))"


def _packing(size: str, heading: str, split: str, after: str) -> str:
    """SQL that packs eight pieces a document step by step."""
    return f"""WITH RECURSIVE {_PAGES.format(size, heading)},
f(doc_id, p, n, k, first) AS (SELECT doc_id, 0, 0, 0, true FROM documents UNION ALL
  SELECT f.doc_id, s.p, CASE WHEN {after} THEN 0 ELSE z END, CASE WHEN {split} AND f.n > 0 THEN f.k + 1 ELSE f.k END + CASE WHEN {after} THEN 1 ELSE 0 END, false
  FROM (SELECT f.*, s.n AS size, s.h, CASE WHEN {split} AND f.n > 0 THEN s.n ELSE f.n + s.n END AS z, s.p AS sp FROM f JOIN s ON s.doc_id = f.doc_id AND s.p = f.p + 1) f JOIN s ON s.doc_id = f.doc_id AND s.p = f.sp)
SELECT doc_id, max(k) + max(CASE WHEN p = 8 AND n > 0 THEN 1 ELSE 0 END) AS chunks FROM f GROUP BY doc_id"""


def _pieces(t, heading_every=0):
    """(doc_id, blocks): the text in eight equal slices, of which every third may pass for a heading."""
    kind = lambda p: F.when(p["page_number"] % heading_every == 0, "heading").otherwise("paragraph") if heading_every else F.lit("paragraph")
    pages = C.page_slices(F.col("text"), F.lit(8))
    return t.documents.select("doc_id", F.transform(pages, lambda p: F.struct(p["text"].alias("content"), kind(p).alias("type"), p["page_number"].alias("page"))).alias("blocks"))


@query(_packing("11 + length(p::VARCHAR) + size", "false", "f.n + s.n > 3000", "z >= 1800"))
def page_packing(t):
    return t.documents.select("doc_id", F.size(C.pages_packed(C.page_slices(F.col("text"), F.lit(8)))).cast("long").alias("chunks"))


@query(_packing("size", "false", "f.n + s.n > 3000", "z >= 1800"))
def block_packing(t):
    return _pieces(t).select("doc_id", F.size(C.blocks_packed(F.col("blocks"))).cast("long").alias("chunks"))


@query(_packing("size", "p % 3 = 0", "(f.n + s.n > 3000 OR (f.n >= 2400 AND s.h))", "false"))
def smart_packing(t):
    return _pieces(t, 3).select("doc_id", F.size(C.smart_packed(F.col("blocks"))).cast("long").alias("chunks"))


@query("SELECT doc_id, i AS page_number, substr(text, (i - 1) * c + 1, c) AS text FROM (SELECT doc_id, text, unnest(range(1, 4)) AS i, ceil(length(text) / 3)::BIGINT AS c FROM documents)")
def page_slices(t):
    p = t.documents.select("doc_id", F.explode(C.page_slices(F.col("text"), F.lit(3))).alias("p"))
    return p.select("doc_id", F.col("p.page_number").cast("long").alias("page_number"), "p.text")


@query("SELECT doc_id, ceil(length(text) / 4)::BIGINT AS tokens FROM documents")
def token_estimate(t):
    return t.documents.select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, 1 AS blocks, text || chr(10) || '[CODE_BLOCK_0]' || chr(10) || text || chr(10) || '[CODE_BLOCK_1]' AS cleaned, lang AS language, text AS code FROM documents")
def code_blocks(t):
    """One fence round the text, and one that isn't closed: what follows is lost."""
    text = F.concat("text", F.lit("\n```"), "lang", F.lit("\n"), "text", F.lit("\n```\n"), "text", F.lit("\n```open\n"), "text")
    d = t.documents.select("doc_id", S.code_blocks(text).alias("b"), S.without_code(text).alias("cleaned"))
    return d.select("doc_id", F.size("b").alias("blocks"), "cleaned", F.get("b", F.lit(0))["language"].alias("language"), F.get("b", F.lit(0))["code"].alias("code"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'patent' WHEN lang = 'fr' THEN 'paper' ELSE 'generic' END AS structure FROM documents")
def structure_type(t):
    titles = F.when(F.col("lang") == "fr", F.array(F.lit("Abstract"), F.lit("Our Methods"))).otherwise(F.array(F.lit("Intro"), F.lit("Results")))
    return t.documents.select("doc_id", S.structure_type(F.when(F.col("lang") == "en", "patent").otherwise("other"), titles).alias("structure"))


@query()
def token_chunks(t):
    """Chunks of structured documents (SQL has no fold over text, so rows only; a test holds them against a plain loop)."""
    return C.document_chunks(marked(t), structure=F.lit("paper")).select("doc_id", "chunk_index", "section_path", "token_count")


@query()
def chunk_statistics(t):
    return A.document_stats(token_chunks(t))


@query("SELECT conv_id, turn, 'Document: T' || chr(10) || 'Type: ' || role || chr(10) || 'Tags: a, b' || chr(10) || 'People: N (r)' || chr(10) || 'Identifiers: k: ' || turn AS chunk FROM conversations")
def metadata_chunk(t):
    c = C.metadata_chunk(F.lit("T"), F.col("role"), F.lit(None).cast("string"), F.array(F.lit("a"), F.lit("b")), F.array(F.struct(F.lit("N").alias("name"), F.lit("r").alias("role"))), F.create_map(F.lit("k"), F.col("turn").cast("string")))
    return t.conversations.select("conv_id", "turn", c.alias("chunk"))
