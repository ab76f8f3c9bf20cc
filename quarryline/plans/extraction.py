"""Fields from pages, URLs and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import extract as E
from ..operators import sections as S
from ..operators import yaml as Y
from .registry import query

_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_ENT = "replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '\"'), '&#39;', '''')"


def _r(x: str, *steps: tuple[str, str, str]) -> str:
    for p, to, flags in steps:
        x = f"regexp_replace({x}, '{p}', '{to}', '{flags}')"
    return x


@query("SELECT page_id, " + _TRIM.format(_r(_ENT.format(_r("html", ("<script\\b.*?</script>", "", "gis"), ("<style\\b.*?</style>", "", "gis"))), ("<[^>]+>", " ", "g"), ("\\s+", " ", "g"))) + " AS text FROM pages")
def html_to_text(t):
    return t.pages.select("page_id", X.html_file_text(F.col("html")).alias("text"))


_BLOCK = _r("html", ("<script.*?</script>", "", "gis"), ("<style.*?</style>", "", "gis"), ("<br\\s*/?>", "\n", "gi"), ("</p>", "\n\n", "gi"), ("<li[^>]*>", "\n- ", "gi"), ("<[^>]+>", "", "g"))
_BLOCK = f"replace(replace(replace(replace(replace(replace({_BLOCK}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''')"


@query("SELECT page_id, " + _TRIM.format(_r(_BLOCK, ("\\n{3,}", "\n\n", "g"))) + " AS text FROM pages")
def html_to_blocks(t):
    return t.pages.select("page_id", X.html_block_text(F.col("html")).alias("text"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS domain FROM pages")
def url_domain(t):
    return t.pages.select("page_id", X.domain(F.col("url")).alias("domain"))


_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"


@query(f"SELECT page_id, left(regexp_replace(lower(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') || regexp_replace(replace({_PATH}, '/', '-'), '^-|-$', '', 'g')), '[^a-z0-9.-]', '-', 'g'), 100) AS identifier FROM pages")
def url_identifier(t):
    return t.pages.select("page_id", X.identifier(F.col("url")).alias("identifier"))


_URL = "u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'US' || (1000000 + page_id) || 'B2' WHEN 1 THEN 'arxiv:2405.' || (10000 + page_id) WHEN 2 THEN 'https://arxiv.org/abs/2405.' || (10000 + page_id) WHEN 3 THEN ' https://patents.google.com/patent/us' || (1000000 + page_id) || '/en' ELSE url END AS url FROM pages)"


def urls(t):
    k, n = F.col("page_id") % 5, F.col("page_id")
    s = lambda a, x, b="": F.concat(F.lit(a), x.cast("string"), F.lit(b))
    return t.pages.select("page_id", F.when(k == 0, s("US", n + 1000000, "B2")).when(k == 1, s("arxiv:2405.", n + 10000)).when(k == 2, s("https://arxiv.org/abs/2405.", n + 10000)).when(k == 3, s(" https://patents.google.com/patent/us", n + 1000000, "/en")).otherwise(F.col("url")).alias("url"))


@query(f"WITH {_URL} SELECT page_id, CASE WHEN page_id % 5 IN (0, 3) THEN 'patent' WHEN page_id % 5 IN (1, 2) THEN 'arxiv' ELSE 'generic' END AS type, CASE page_id % 5 WHEN 0 THEN url WHEN 3 THEN 'us' || (1000000 + page_id) WHEN 4 THEN NULL ELSE '2405.' || (10000 + page_id) END AS identifier, CASE page_id % 5 WHEN 0 THEN 'https://patents.google.com/patent/' || url WHEN 3 THEN 'https://patents.google.com/patent/us' || (1000000 + page_id) WHEN 4 THEN url ELSE 'https://arxiv.org/html/2405.' || (10000 + page_id) END AS extractor_url FROM u")
def url_routing(t):
    return urls(t).select("page_id", X.url_analysis(F.col("url")).alias("a")).select("page_id", "a.type", "a.identifier", "a.extractor_url")


@query("SELECT page_id, page_id % 3 = 0 AS known, page_id % 4 = 0 OR length(html) < 1000 AS signs FROM pages")
def paywall_flags(t):
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://www.Medium.com/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    html = F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit("Become a member"))).otherwise(F.col("html"))
    return t.pages.select("page_id", X.is_paywall_domain(url).alias("known"), X.has_paywall_signs(html).alias("signs"))


_WORDS = "\\n**Key Terms**: "
_TERMS = "list_concat(['first ' || lang, 'second'], [source], list_transform(list_filter(regexp_extract_all(md, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b'), lambda x: length(x) >= 6), lambda x: lower(x)), regexp_extract_all(md, '\\b[A-Z]{2,6}\\b'))"


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct({_TERMS})), ',') AS terms FROM (SELECT doc_id, lang, source, '**Key Terms**: first ' || lang || ', second' || chr(10) || '**Also Known As**: ' || source || chr(10) || chr(10) || text AS md FROM documents)")
def key_terms(t):
    """The two lists are put before the text; phrases and acronyms come from all of it."""
    md = F.concat(F.lit("**Key Terms**: first "), "lang", F.lit(", second\n**Also Known As**: "), "source", F.lit("\n\n"), "text")
    return t.documents.select("doc_id", F.array_join(F.array_sort(X.key_terms(md)), ",").alias("terms"))


@query("SELECT doc_id, lang || ',N' || doc_id % 3 || ',k1' AS tags FROM documents")
def auto_tags(t):
    md = F.concat(F.lit("**Also Known As**: N"), (F.col("doc_id") % 3).cast("string"), F.lit("\n\n**Key Terms**: k1, "), F.col("lang"), F.lit("\n\nbody"))
    return t.documents.select("doc_id", F.array_join(X.auto_tags(F.array("lang"), md), ",").alias("tags"))


_FILES = "['us123-x.pdf', '2405.10314.md', 'release-note-1.2.3.md', 'spec_2024_01_02.docx', 'lif.html', 'blog post.txt', 'press.md', 'FAQ 20240102', 'memo.MD', 'slides-2024-03-04']"


_CONTENT = "CASE lang WHEN 'en' THEN 'FOR IMMEDIATE RELEASE' || chr(10) WHEN 'fr' THEN 'Q: why' || chr(10) || 'A: so' || chr(10) ELSE 'Q: only' || chr(10) END || text || CASE WHEN source < 'src2' THEN chr(10) || 'Date: 2023-04-05' ELSE '' END"


@query(
    f"""WITH d AS (SELECT doc_id, (doc_id % 10 + 1)::INT AS k, {_FILES}[doc_id % 10 + 1] AS f, {_CONTENT} AS c FROM documents)
SELECT doc_id, f, coalesce([NULL, NULL, 'press', 'spec', NULL, 'blog', 'press', 'faq', 'tech_memo', 'slide'][k], CASE WHEN contains(c, 'FOR IMMEDIATE RELEASE') THEN 'press' WHEN contains(c, 'Q: ') AND contains(c, 'A: ') THEN 'faq' ELSE 'other' END) AS by_text,
['patent', 'arxiv', 'release_notes', 'spec', 'technical_note', 'blog', 'press', 'faq', 'other', 'other'][k] AS by_name, ['pdf', 'markdown', 'markdown', 'docx', 'html', 'text', 'markdown', 'unknown', 'markdown', 'unknown'][k] AS file_type,
coalesce([NULL, NULL, NULL, '2024-01-02', NULL, NULL, NULL, '2024-01-02', NULL, '2024-03-04'][k], nullif(regexp_extract(c, '(?i)date:\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '')) AS date FROM d"""
)
def doc_type_detect(t):
    """File names by a rule, and whole texts behind the lines that contents are told by."""
    names = ["us123-x.pdf", "2405.10314.md", "release-note-1.2.3.md", "spec_2024_01_02.docx", "lif.html", "blog post.txt", "press.md", "FAQ 20240102", "memo.MD", "slides-2024-03-04"]
    f = F.get(F.array(*map(F.lit, names)), (F.col("doc_id") % 10).cast("int"))
    head = F.when(F.col("lang") == "en", "FOR IMMEDIATE RELEASE\n").when(F.col("lang") == "fr", "Q: why\nA: so\n").otherwise("Q: only\n")
    c = F.concat(head, "text", F.when(F.col("source") < "src2", "\nDate: 2023-04-05").otherwise(""))
    return t.documents.select("doc_id", f.alias("f"), X.doc_type(f, c).alias("by_text"), X.doc_type_of_name(f).alias("by_name"), X.file_type(f).alias("file_type"), X.date_of(f, c).alias("date"))


@query("SELECT page_id, regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def slugs(t):
    return t.pages.select("page_id", X.slug(F.col("url")).alias("slug"))


@query("SELECT page_id, trim(regexp_extract(html, '<h1>(.*?)</h1>', 1)) AS title FROM pages")
def page_title(t):
    return t.pages.select("page_id", X.title_of(F.concat(F.lit("intro\n# "), F.regexp_extract("html", "<h1>(.*?)</h1>", 1), F.lit("\n## x"))).alias("title"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders")
def iso_dates(t):
    """Dates of orders as they are written in papers and patents; pending ones have none."""
    day, k = lambda form: F.date_format("o_orderdate", form), F.col("o_orderkey") % 3
    said = F.when(k == 0, day("d MMM yyyy")).when(k == 1, day("MMM. d, yyyy")).otherwise(day("MMMM dd, yyyy"))
    return t.orders.select("o_orderkey", X.iso_date(F.when(F.col("o_orderstatus") == "P", "in 30 days").otherwise(F.concat(F.lit("on "), said, F.lit(" at noon")))).alias("date"))


@query(
    "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'O' THEN strftime(o_orderdate, '%Y-%m-%d') END, CASE WHEN o_orderpriority = '3-MEDIUM' THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate - INTERVAL 30 DAY, '%Y-%m-%d') END, CASE WHEN o_totalprice > 100000 THEN strftime(o_orderdate, '%Y') END) AS date FROM orders"
)
def coalesce_dates(t):
    day = lambda held, shift: F.when(held, F.date_format(F.date_add("o_orderdate", shift), "yyyy-MM-dd")).otherwise("")
    dates = F.create_map(F.lit("filing"), day(F.col("o_orderkey") % 2 == 0, -30), F.lit("published"), day(F.col("o_orderpriority") == "3-MEDIUM", 30), F.lit("created"), day(F.col("o_orderstatus") == "O", 0))
    return t.orders.select("o_orderkey", E.primary_date(dates, F.when(F.col("o_totalprice") > 100000, F.date_format("o_orderdate", "yyyy")).otherwise("")).alias("date"))


@query("SELECT page_id, url, 'k1;k2' AS terms, 'Name ' || page_id AS aka, 'Sec' AS section FROM pages")
def url_list(t):
    text = F.concat(F.lit("# Head\n> note\n## Sec\n- "), F.col("url"), F.lit(" | k1, k2 | aka: Name "), F.col("page_id").cast("string"), F.lit("\n<!-- c -->\n"))
    x = t.pages.select("page_id", F.explode(E.url_items(text)).alias("x"))
    return x.select("page_id", "x.url", F.array_join("x.key_terms", ";").alias("terms"), F.col("x.also_known_as").alias("aka"), "x.section")


@query(
    "SELECT page_id, i AS number, CASE WHEN i > 1 THEN i - 1 END AS depends_on, CASE WHEN i = 1 THEN 'A device' ELSE 'The device of claim ' || (i - 1) END || ' at ' || url || ' there' AS text FROM (SELECT page_id, url, unnest(range(1, (page_id % 5 + 2)::BIGINT))::INT AS i FROM pages)"
)
def patent_claims(t):
    """One to five claims a page, each on the one before it, that name the page's address."""
    i = lambda n: n.cast("string")
    claim = lambda n: F.concat(F.lit("<p>"), i(n), F.lit(". "), F.when(n == 1, "A device").otherwise(F.concat(F.lit("The device of claim "), i(n - 1))), F.lit(" at "), F.col("url"), F.lit(" there</p>"))
    html = F.concat(F.lit('<section itemprop="claims">'), F.array_join(F.transform(F.sequence(F.lit(1), (F.col("page_id") % 5 + 1).cast("int")), claim), ""), F.lit("</section>"))
    return t.pages.select("page_id", F.explode(E.claims(html)).alias("c")).select("page_id", "c.number", "c.depends_on", "c.text")


@query("SELECT page_id, unnest(['3A', '3B', '4']) AS figure FROM pages")
def patent_drawings(t):
    html = F.concat(F.lit('<heading>BRIEF DESCRIPTION OF THE DRAWINGS</heading><div class="description-paragraph"> <figref>FIGS. 3A and 3B</figref> show '), F.col("page_id").cast("string"), F.lit('</div><div class="description-paragraph"><figref>FIG. 4</figref> is</div><heading>X</heading>'))
    return t.pages.select("page_id", F.explode(E.drawings(html)).alias("d")).select("page_id", "d.figure")


@query(
    "SELECT o_orderkey, 'US' || (1000000 + o_orderkey) AS patent_number, strftime(o_orderdate, '%Y-%m-%d') AS filing, (year(o_orderdate) + 20) || strftime(o_orderdate, '-%m-%d') AS expiration, c_name || ';Bo Ray;' || c_mktsegment AS people FROM orders JOIN customer ON o_custkey = c_custkey"
)
def patent_metadata(t):
    """Orders as front pages of patents: filed on their day, by their customer, for its segment."""
    text = F.concat(F.lit("US "), (F.col("o_orderkey") + 1000000).cast("string"), F.lit(" B2\nFiled: "), F.date_format("o_orderdate", "MMM. d, yyyy"), F.lit("\nInventors: "), "c_name", F.lit(", Oslo; Bo Ray, Rome\nAssignee: "), "c_mktsegment", F.lit(", Inc\n"))
    m = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", E.patent_text_metadata(text, F.lit("x")).alias("m"))
    return m.select("o_orderkey", "m.patent_number", "m.filing", "m.expiration", F.array_join(F.transform("m.actors", lambda a: a["name"]), ";").alias("people"))


@query("SELECT doc_id, '---' || chr(10) || 'id: d' || doc_id || chr(10) || 'title: \"T \\\"' || lang || '\\\"\"' || chr(10) || 'type: ' || lang || chr(10) || 'personas: [a, b]' || chr(10) || '---' || chr(10) AS front FROM documents")
def frontmatter_write(t):
    none = F.lit(None).cast("string")
    return t.documents.select("doc_id", E.frontmatter(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.concat(F.lit('T "'), F.col("lang"), F.lit('"')), F.col("lang"), none, none, F.array(F.lit("a"), F.lit("b")), none, none).alias("front"))


@query("SELECT doc_id, 'd' || doc_id AS id, lang || ': ' || source AS title, regexp_replace(text, '^\\s*\\n', '') AS body FROM documents")
def frontmatter_read(t):
    md = F.concat(F.lit("---\nid: d"), F.col("doc_id").cast("string"), F.lit('\ntitle: "'), "lang", F.lit(": "), "source", F.lit('"\n---\n'), "text")
    m = E.flat_yaml(X.frontmatter_block(md))
    return t.documents.select("doc_id", m["id"].alias("id"), m["title"].alias("title"), X.strip_frontmatter(md).alias("body"))


@query("SELECT doc_id, '## A' || chr(10) || t || chr(10) || t || chr(10) || chr(10) || '## B' || chr(10) || t AS text FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)")
def stitch_chunks(t):
    text = X.trimmed(F.col("text"))
    parts = F.array(F.concat(F.lit("[Page 1]\n## A\n"), text, F.lit("\n[continues]")), F.concat(F.lit("[Page 2] "), text), F.concat(F.lit("## B\n"), text))
    return t.documents.select("doc_id", E.stitched(parts).alias("text"))


def normal(text: str) -> str:
    """SQL of the Markdown rewrites over an expression."""
    return _r(
        text,
        ("\\r\\n?", "\n", "g"), ("\\n{3,}", "\n\n", "g"), ("([^\\n])\\n(#{1,6}\\s)", "\\1\n\n\\2", "g"), ("(#{1,6}\\s[^\\n]+)\\n([^\\n#])", "\\1\n\n\\2", "g"),
        ("(?m)^(#{1,6})([^\\s#])", "\\1 \\2", "g"), ("(?m)^[*\\-+]\\s*", "- ", "g"), ("(?m)^(\\d+\\.)\\s*", "\\1 ", "g"), ("(?m)[^\\S\\n]+$", "", "g"), ("^\\s+|\\s+$", "", "g"),
    )


_NORMAL = normal("text || chr(10) || '##Head' || chr(13) || chr(10) || '*item  ' || chr(10) || chr(10) || chr(10) || chr(10) || '3.end' || chr(10)")


@query(f"SELECT doc_id, {_NORMAL} || chr(10) AS md FROM documents")
def normalize_markdown(t):
    return t.documents.select("doc_id", X.normalize_markdown(F.concat("text", F.lit("\n##Head\r\n*item  \n\n\n\n3.end\n"))).alias("md"))


@query("SELECT doc_id, " + _TRIM.format(_r("text", ("(\\w+)-\\s*\\n\\s*(\\w+)", "\\1\\2", "g"), ("\\s+", " ", "g"))) + " AS text FROM documents")
def clean_text(t):
    return t.documents.select("doc_id", X.clean_extracted(F.col("text")).alias("text"))


@query("SELECT doc_id, regexp_replace(text || '-' || chr(10) || text, '(?i)([a-z])-\\s*\\n\\s*([a-z])', '\\1\\2', 'g') AS text FROM documents")
def join_hyphens(t):
    return t.documents.select("doc_id", X.join_hyphenated(F.concat("text", F.lit("-\n"), "text")).alias("text"))


@query("SELECT c_custkey, upper(left(c_name, 1)) AS initials, left(c_name, 5) || CASE WHEN length(c_name) > 5 THEN '...' ELSE '' END AS short FROM customer")
def labels_short(t):
    return t.customer.select("c_custkey", X.initials(F.col("c_name"), F.lit("zz")).alias("initials"), X.truncated(F.col("c_name"), 5).alias("short"))


_LINE = "regexp_replace(line, '^\\s+|\\s+$', '', 'g')"


@query(
    f"""WITH l AS (SELECT doc_id, i, {_LINE} AS x FROM (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split('Heading' || chr(10) || chr(10) || text || chr(10) || 'Note on ' || lang || chr(10) || chr(10) || text, chr(10)) AS ls FROM documents)))),
h AS (SELECT *, x <> '' AND length(x) < 60 AND regexp_matches(x, '^[A-Z]') AND coalesce(lead(x) OVER w, '') = '' AND NOT ends_with(x, '.') AS h FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT *, coalesce(lag(x <> '' AND NOT h) OVER (PARTITION BY doc_id ORDER BY i), false) AS inside FROM h),
o AS (SELECT doc_id, i, CASE WHEN x = '' THEN CASE WHEN inside THEN '' END WHEN h THEN chr(10) || '## ' || x || chr(10) WHEN inside THEN x ELSE chr(10) || x END AS o FROM p)
SELECT doc_id, regexp_replace(string_agg(o, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') || chr(10) AS md FROM o GROUP BY doc_id"""
)
def text_to_markdown(t):
    raw = F.concat(F.lit("Heading\n\n"), "text", F.lit("\nNote on "), "lang", F.lit("\n\n"), "text")
    return t.documents.select("doc_id", S.text_to_markdown(raw).alias("md"))


def _fronts(t):
    """Metadata of a document: its first line as title, structured dates for one language, identifiers with quotes and backslashes for another."""
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    none = F.array().cast("array<struct<key:string,value:string>>")
    first = F.get(F.split("text", "\n"), F.lit(0))
    return F.struct(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), first.alias("title"), F.when(F.col("lang") == "en", "paper").alias("type"),
        F.when(F.col("lang") == "en", F.array(pair("published", F.lit("2024-02-03")), pair("created", F.lit("2024-01-02")))).otherwise(none).alias("dates"), F.lit("2023-05-06").alias("date"),
        F.when(F.col("lang") == "fr", F.array(pair("doi", F.concat(F.lit('10.1/"'), "source", F.lit('"\\x'))))).otherwise(none).alias("identifiers"), F.concat(F.lit("https://x.org/"), "source").alias("source_url"),
        F.array("source", F.lit("b")).alias("personas"), F.substring("text", -80, 80).alias("summary"), F.lit(None).cast("string").alias("license"),
    )


_ESC = "'\"' || replace(replace(replace({0}, '\\', '\\\\'), '\"', '\\\"'), chr(10), ' ') || '\"'"
_FRONT = f"""f AS (SELECT doc_id, lang, source, string_split(text, chr(10))[1] AS t, substr(text, greatest(length(text) - 79, 1)) AS summary FROM documents),
w AS (SELECT doc_id, '---' || chr(10) || 'id: d' || doc_id || chr(10) || 'title: ' || {_ESC.format("CASE WHEN length(t) > 200 THEN left(t, 197) || '...' ELSE t END")} || chr(10) || CASE WHEN lang = 'en' THEN 'type: paper' || chr(10) || 'dates:' || chr(10) || '  created: \"2024-01-02\"' || chr(10) || '  published: \"2024-02-03\"' ELSE 'date: 2023-05-06' END || chr(10)
|| CASE WHEN lang = 'fr' THEN 'identifiers:' || chr(10) || '  doi: ' || {_ESC.format("'10.1/\"' || source || '\"\\x'")} ELSE 'source_url: https://x.org/' || source END || chr(10) || 'personas: [' || source || ', b]' || chr(10) || CASE WHEN summary <> '' THEN 'summary: ' || {_ESC.format("summary")} || chr(10) ELSE '' END || '---' || chr(10) AS front FROM f)"""


@query(f"WITH {_FRONT} SELECT doc_id, front FROM w")
def frontmatter_nested(t):
    return t.documents.select("doc_id", Y.written_front(_fronts(t)).alias("front"))


@query(f"WITH {_FRONT} SELECT w.doc_id, 'd' || w.doc_id AS id, replace(CASE WHEN length(t) > 200 THEN left(t, 197) || '...' ELSE t END, chr(10), ' ') AS title, CASE WHEN lang = 'en' THEN '2024-01-02' END AS created, CASE WHEN lang = 'fr' THEN '10.1/\"' || source || '\"\\x' END AS doi, source || '|b' AS personas, true AS again FROM w JOIN f USING (doc_id)")
def frontmatter_round_trip(t):
    """Written, read, and written again: the same block."""
    a = t.documents.select("doc_id", Y.written_front(_fronts(t)).alias("front"))
    b = a.select("doc_id", "front", Y.read_front(F.concat("front", F.lit("body"))).alias("m"))
    value = lambda xs, k: F.get(F.filter(xs, lambda e: e["key"] == k), F.lit(0))["value"]
    return b.select("doc_id", "m.id", "m.title", value(F.col("m.dates"), "created").alias("created"), value(F.col("m.identifiers"), "doi").alias("doi"), F.array_join("m.personas", "|").alias("personas"), (Y.written_front(F.col("m")) == F.col("front")).alias("again"))


@query("SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:15] AS terms FROM (SELECT doc_id, list_concat(regexp_extract_all(o, '([A-Z][a-z]+(?:\\s+[A-Za-z][a-z]+)*)\\s*\\([A-Z]{2,6}\\)', 1), regexp_extract_all(o, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+){1,3}\\b'), regexp_extract_all(o, '\\b[A-Z]{2,6}\\b')) AS l FROM (SELECT doc_id, left(text, 500) AS o FROM documents))")
def key_terms_fallback(t):
    return t.documents.select("doc_id", X.key_terms_fallback(F.col("text")).alias("terms"))


@query("SELECT doc_id, lang AS type, source, 'manual' AS title FROM documents")
def merged_frontmatter(t):
    pair = lambda **x: F.create_map(*(c for k, v in x.items() for c in (F.lit(k), v)))
    m = E.merged_metadata(pair(title=F.lit("manual"), type=F.col("lang")), pair(title=F.lit("found"), source=F.col("source")))
    return t.documents.select("doc_id", m["type"].alias("type"), m["source"].alias("source"), m["title"].alias("title"))


@query("SELECT doc_id, lang IN ('en', 'fr') AS is_uuid FROM (SELECT doc_id, lang, md5(text) AS h FROM documents)")
def uuid_shapes(t):
    """A text's digest in the shape of a UUID, in capitals for one language; for the other languages a sign short or with one too many."""
    h = F.md5("text")
    shaped = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4))), F.substring(h, 21, 12))
    made = F.when(F.col("lang") == "en", shaped).when(F.col("lang") == "fr", F.upper(shaped)).when(F.col("lang") == "de", F.left(shaped, F.lit(35))).otherwise(F.concat(shaped, F.lit("0")))
    return t.documents.select("doc_id", X.is_uuid(made).alias("is_uuid"))


@query(
    f"""WITH l AS (SELECT doc_id, i, {_TRIM.format("s[i]")} AS x FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '([A-Za-z])-\\n([A-Za-z])', '\\1\\2', 'g'), chr(10)) AS s FROM documents))),
n AS (SELECT *, coalesce(lead(x) OVER (PARTITION BY doc_id ORDER BY i), '') AS nxt FROM l),
g AS (SELECT *, coalesce(sum((x = '' OR nxt = '' OR regexp_matches(x, '[.!?]$') OR regexp_matches(nxt, '^[A-Z0-9]') OR length(x) < 50)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM n),
p AS (SELECT doc_id, g, string_agg(x, ' ' ORDER BY i) AS p FROM g GROUP BY doc_id, g)
SELECT doc_id, string_agg(p, chr(10) ORDER BY g) AS text FROM p GROUP BY doc_id"""
)
def pages_rebuilt(t):
    return t.documents.select("doc_id", S.normalized_page(F.col("text"))["text"].alias("text"))


@query(
    "SELECT doc_id, '# D' || doc_id || chr(10) || chr(10) || '**Authors**: ' || source || ', Ann' || chr(10) || CASE WHEN lang = 'en' THEN '**arXiv**: 2401.0' || (1000 + doc_id % 1000) || chr(10) ELSE '' END || '**Date**: 2024-01-02' || chr(10) || chr(10) || '## Abstract' || chr(10) || chr(10) || left(text, 300) || chr(10) || chr(10) || text AS md FROM documents"
)
def arxiv_articles(t):
    number = F.when(F.col("lang") == "en", F.concat(F.lit("2401.0"), (F.col("doc_id") % 1000 + 1000).cast("string")))
    return t.documents.select("doc_id", E.arxiv_article(F.concat(F.lit("D"), F.col("doc_id").cast("string")), F.array("source", F.lit("Ann")), number, F.lit("2024-01-02"), F.left("text", F.lit(300)), F.col("text")).alias("md"))


_NUMBER = "'US' || (1000000 + page_id)"
_BODY = _TRIM.format(_r(_BLOCK.replace("html", _TRIM.format("html"), 1), ("\\n{3,}", "\n\n", "g")))


def patent_pages(t):
    """Each page as a patent's background, behind microdata and before drawings and two claims; a third of them without an assignee, another without drawings."""
    n, odd = F.col("page_id").cast("string"), F.col("page_id") % 3
    return t.pages.select("page_id", F.concat(F.lit("US"), (F.col("page_id") + 1000000).cast("string")).alias("number"), F.concat(
        F.lit('<meta name="DC.title" content="T '), n, F.lit('"><meta name="DC.contributor" scheme="inventor" content="Ann Lee"><meta name="DC.contributor" scheme="inventor" content="Bo"><dd itemprop="applicationNumber">'), n,
        F.when(odd == 0, "</dd>").otherwise('</dd><dd itemprop="assigneeOriginal">Acme</dd>'), F.lit('<time itemprop="filingDate" datetime="2020-01-02">x</time><section itemprop="abstract"><div>'), "url", F.lit(". More</div></section><heading>BACKGROUND</heading>"), "html",
        F.lit("<heading>BRIEF DESCRIPTION OF THE DRAWINGS</heading>"), F.when(odd == 1, "").otherwise('<div class="description-paragraph"><figref>FIGS. 1A and 2</figref> shows it</div>'), F.lit("<heading>X</heading>"),
        F.lit('<div id="CLM-1" num="00001" class="claim"><div>1. A thing.</div></div><div id="CLM-2" num="00002" class="claim"><div>2. A thing of claim 1, '), n, F.lit("</div></div>"),
    ).alias("html"))


@query(
    f"""WITH p AS (SELECT page_id, {_NUMBER} AS n, url, {_BODY} AS body, page_id % 3 AS odd, chr(10) AS e FROM pages)
SELECT page_id, '---' || e || 'id: us' || (1000000 + page_id) || e || 'title: T ' || page_id || e || 'type: patent' || e || 'personas: [a, b]' || e || 'summary: ' || url || e || 'identifiers:' || e || '  patent_number: "' || n || '"' || e || '  application_number: "' || page_id || '"' || e
|| 'dates:' || e || '  filing: "2020-01-02"' || e || 'actors:' || e || '  - name: "Ann Lee"' || e || '    role: "inventor"' || e || '  - name: "Bo"' || e || '    role: "inventor"' || e || CASE WHEN odd = 0 THEN '' ELSE '  - name: "Acme"' || e || '    role: "original_assignee"' || e END || '---' || e || e
|| '# T ' || page_id || e || e || '**Patent Number**: ' || n || '  ' || e || '**Application Number**: ' || page_id || '  ' || e || '**Inventors**: Ann Lee, Bo  ' || e || CASE WHEN odd = 0 THEN '' ELSE '**Original Assignee**: Acme  ' || e END || '**Filing Date**: 2020-01-02' || e || e
|| '## Abstract' || e || e || e || url || '. More' || e || e || CASE WHEN body = '' THEN '' ELSE '## Background of the Invention' || e || e || e || body || e || e END
|| CASE WHEN odd = 1 THEN '' ELSE '## Drawings' || e || e || e || 'The patent includes the following figures:' || e || e || '- **Figure 1A**: shows it' || e || '- **Figure 2**: shows it' || e || e END
|| '## Claims' || e || e || e || '1. A thing.' || e || e || '2. A thing of claim 1, ' || page_id AS md FROM p"""
)
def patent_html_articles(t):
    html, personas = F.col("html"), F.array(F.lit("a"), F.lit("b"))
    found = patent_pages(t).withColumns({"p": E.patent_parts(html), "m": E.patent_metadata(html), "d": E.drawings(html), "c": E.claims(html)})
    shown = F.when(F.col("page_id") % 3 == 1, F.filter("d", lambda x: x["description"].isNotNull())).otherwise(F.col("d"))  # figures that the page itself names aren't this patent's
    return found.select("page_id", E.patent_html_article(F.col("number"), F.col("p"), F.col("m"), shown, F.col("c"), personas).alias("md"))


@query("WITH d AS (SELECT event_id, ts, date_diff('day', ts::DATE, (SELECT max(ts)::DATE FROM events)) AS n FROM events) SELECT event_id, CASE WHEN n = 0 THEN 'Today' WHEN n = 1 THEN 'Yesterday' WHEN n < 7 THEN n || ' days ago' ELSE strftime(ts, '%Y-%m-%d') END AS day FROM d")
def relative_days(t):
    """Days as seen from the last event's."""
    last = t.events.agg(F.max("ts").alias("last"))  # one row
    return t.events.join(F.broadcast(last)).select("event_id", X.relative_day(F.col("ts"), F.col("last")).alias("day"))


_OWN = normal("CASE WHEN lang = 'en' THEN '' ELSE '# Own' || chr(10) || chr(10) END || text")


@query(f"SELECT doc_id, CASE WHEN starts_with(n, '# ') THEN n ELSE '# T' || chr(10) || chr(10) || n END AS md FROM (SELECT doc_id, {_OWN} || chr(10) AS n FROM documents)")
def raw_articles(t):
    """Texts of one language without a heading, the others with their own."""
    own = F.concat(F.when(F.col("lang") == "en", "").otherwise("# Own\n\n"), "text")
    return t.documents.select("doc_id", E.raw_article(F.lit("T"), own).alias("md"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'no heading' WHEN lang = 'fr' THEN 'no frontmatter' WHEN lang = 'de' THEN 'no title,no personas' ELSE '' END AS problems FROM documents WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' AND NOT regexp_matches(text, '^---\\s*\\n') AND NOT regexp_matches(text, '(?m)^#{1,6} \\S')")
def assembled_problems(t):
    """Assembled documents, each language with another fault; texts that have headings themselves are no case of it."""
    front = F.when(F.col("lang") == "fr", "").when(F.col("lang") == "de", '---\nid: x\ntitle: ""\npersonas: []\n---\n').otherwise('---\nid: x\ntitle: "T"\npersonas: [a]\n---\n')
    docs = t.documents.where((X.trimmed(F.col("text")) != "") & ~F.col("text").rlike(r"^---\s*\n") & ~F.col("text").rlike(r"(?md)^#{1,6} \S"))
    return docs.select("doc_id", F.array_join(E.assembled_problems(F.concat(front, F.when(F.col("lang") == "en", "").otherwise("# H\n\n"), "text")), ",").alias("problems"))


@query("SELECT page_id, concat_ws(',', CASE WHEN NOT regexp_matches(lower(url), '\\.(pdf|html|htm|md|markdown|txt|text|docx|doc)$') THEN 'unknown file type' END, CASE WHEN length(html) > 20000 THEN 'file too large' END) AS problems FROM pages")
def upload_problems(t):
    return t.pages.select("page_id", F.array_join(E.upload_problems(F.col("url"), F.length("html"), 20000), ",").alias("problems"))
