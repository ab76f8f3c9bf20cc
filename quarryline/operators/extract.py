"""Structured fields from patent pages, papers, lists and formatted pieces (section 2.10, T13 to T36, IO11 to IO13)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.folds import bound, folded


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """The trimmed group of the first match, or null."""
    return F.nullif(X.trimmed(F.regexp_extract(text, pattern, group)), F.lit(""))


def every(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


# --- patent pages -------------------------------------------------------------------------------

_DEPENDS = r"(?i)(?:according to|as claimed in|of)\s+claim\s+(\d+)"


def _claim(number: Column, text: Column) -> Column:
    on = F.nullif(F.regexp_extract(text, _DEPENDS, 1), F.lit("")).cast("int")
    return F.struct(number.cast("int").alias("number"), text.alias("text"), on.isNotNull().alias("is_dependent"), on.alias("depends_on"))


def claims_of_text(text: Column) -> Column:  # T19
    found = every(X.html_block_text(text), r"(?s)\d+\.\s+.*?(?=\d+\.\s+|\z)", 0)
    return F.transform(found, lambda c: _claim(F.regexp_extract(c, r"^(\d+)", 1), X.trimmed(F.regexp_replace(c, r"^\d+\.\s+", ""))))


def claims(html: Column) -> Column:  # T19: from claim elements, else from the claims section
    pattern = r'(?is)<div\s+id="CLM-\d+"\s+num="\d+"\s+class="claim"[^>]*>.*?</div>\s*</div>'
    own = F.transform(every(html, pattern, 0), lambda c: _claim(F.regexp_extract(c, r'(?i)num="(\d+)"', 1), F.regexp_replace(X.html_block_text(c), r"^\d+\.\s*", "")))
    section = F.coalesce(first(html, r'(?is)itemprop="claims"[^>]*>(.*?)</(?:section|div)>'), first(html, r"(?is)<claim-statement>The invention claimed is:</claim-statement>(.*?)(?:</claims>|\z)"), F.lit(""))
    return F.when(F.size(own) > 0, own).otherwise(claims_of_text(section))


def drawings(html: Column) -> Column:  # T20, S7: array of struct(figure, description)
    part = F.regexp_extract(html, r"(?is)<heading[^>]*>BRIEF DESCRIPTION OF THE DRAWINGS</heading>(.*?)(?:<heading|\z)", 1)
    divs = every(part, r'(?is)<div[^>]*class="description-paragraph"[^>]*>\s*<figref[^>]*>FIGS?\.?\s+[^<]+</figref>.*?</div>', 0)
    described = F.flatten(
        F.transform(
            divs,
            lambda d: F.transform(
                F.split(X.trimmed(F.regexp_extract(d, r"(?i)<figref[^>]*>FIGS?\.?\s+([^<]+)</figref>", 1)), r"\s+(?:and|&)\s+"),
                lambda f: F.struct(X.trimmed(f).alias("figure"), X.trimmed(X.rewrite(F.regexp_replace(d, r"(?is)^.*?</figref>", ""), ("<[^>]+>", " "), (r"\s+", " "))).alias("description")),
            ),
        )
    )
    labels = F.array_distinct(every(html, r"(?i)(?:FIG\.|Figure)\s*(\d+[A-Z]*)"))
    by_number = F.array_sort(F.transform(labels, lambda f: F.struct(F.regexp_extract(f, r"^\d+", 0).cast("int").alias("n"), F.array_position(labels, f).alias("i"), f.alias("figure"))))
    bare = F.transform(by_number, lambda x: F.struct(x["figure"].alias("figure"), F.lit(None).cast("string").alias("description")))
    return F.when(F.size(described) > 0, described).otherwise(bare)


def patent_family(html: Column, own: Column) -> Column:  # T21
    return F.filter(F.array_distinct(every(html, r"\b((?:US|EP|WO|JP|CN|KR|TW)\d{6,}[A-Z]\d?)\b")), lambda p: p != own)


# Headings of a description, in order.
DESCRIPTION_HEADINGS = ["TECHNICAL FIELD", "FIELD", "BACKGROUND", "SUMMARY", "BRIEF DESCRIPTION OF THE DRAWINGS", "DETAILED DESCRIPTION", "DESCRIPTION OF EMBODIMENTS", "CROSS-REFERENCE TO RELATED APPLICATIONS"]


def patent_parts(html: Column) -> Column:  # T18: struct(title, abstract, description: map heading -> text)
    title = F.coalesce(first(html, r'(?i)<meta\s+name="DC\.title"\s+content="([^"]+)"'), first(html, r'(?is)itemprop="title"[^>]*>([^<]+)<'), first(html, r"(?is)<title>([^<]+)</title>"))
    abstract = X.html_block_text(F.coalesce(first(html, r'(?is)itemprop="abstract"[^>]*>(.*?)</(?:section|div)>'), first(html, r"(?is)<abstract[^>]*>(.*?)</abstract>")))
    part = lambda h: X.html_block_text(first(html, rf"(?is)<heading[^>]*>\s*{h}[^<]*</heading>(.*?)(?:<heading|</description>|\z)"))
    entries = F.filter(F.array(*(F.struct(F.lit(h).alias("key"), part(h).alias("value")) for h in DESCRIPTION_HEADINGS)), lambda e: e["value"].isNotNull())
    return F.struct(title.alias("title"), abstract.alias("abstract"), F.map_from_entries(entries).alias("description"))


def patent_metadata(html: Column) -> Column:  # T22, T23: struct of identifiers, dates and actors from microdata
    item = lambda p: first(html, rf'(?i)itemprop="{p}"[^>]*>([^<]+)<')
    date = lambda p: first(html, rf'(?i)itemprop="{p}"[^>]*datetime="([^"]+)"')
    actor = lambda name, role: F.when(name.isNotNull(), F.struct(name.alias("name"), F.lit(role).alias("role")))
    inventors = F.transform(every(html, r'(?i)<meta\s+name="DC\.contributor"\s+scheme="inventor"\s+content="([^"]+)"'), lambda n: F.struct(X.trimmed(n).alias("name"), F.lit("inventor").alias("role")))
    return F.struct(
        item("publicationNumber").alias("publication_number"), item("applicationNumber").alias("application_number"), date("priorityDate").alias("priority"), date("filingDate").alias("filing"),
        date("publicationDate").alias("publication"), date("grantDate").alias("granted"), first(html, r'(?is)itemprop="expiration"[^>]*datetime="([^"]+)"').alias("expiration"),
        F.concat(inventors, F.array_compact(F.array(actor(item("assigneeCurrent"), "current_assignee"), actor(item("assigneeOriginal"), "original_assignee")))).alias("actors"),
    )


# as the JVM has it: letters of any case are ASCII ones
_HEADING = re.compile(r"<(?i:heading)[^>]*>[^<]+</(?i:heading)>", re.ASCII)
_CLAIMS = re.compile(r'<(?i:section)[^>]*(?i:itemprop="claims")', re.ASCII)


def _groups(text: str, most: int) -> list[str]:
    """Texts of neighbouring parts (each from a heading to the next), within most where a part is; text after the last heading is lost."""
    out, begin = [], 0
    while True:
        end = text.rfind("<", begin + 1, begin + most + 1)
        while end > 0 and not _HEADING.match(text, end):
            end = text.rfind("<", begin + 1, end)
        if end < 0:
            after = _HEADING.search(text, begin + most + 1)
            if after is None:
                break
            end = after.start()
        out.append(text[begin:end])
        begin = end
    # a first part that is too long leaves an empty group before it
    return ["", *out] if out and len(out[0]) > most else out


def _windows(html: str | None, most: int, header: int) -> list[str | None]:
    if html is None or len(html) <= most:
        return [html]
    a, d, claims = html.find('itemprop="abstract"'), html.find('itemprop="description"'), _CLAIMS.search(html)
    c, head = claims.start() if claims else -1, html[:header]
    text = html[d:c] if d > 0 and c > 0 else ""
    described = _groups(text, most) if len(text) > most else [text] if text else []
    return [html[: max(d if d > 0 else c, 0)] if a > 0 else head, *(head + t for t in described), *([head + html[c:]] if c > 0 else [])]


def html_windows(html: Column, most: int = 300_000, header: int = 50_000) -> Column:  # T13 with Q15
    """The page itself if it fits; else what comes before the description, the description in groups of headings, and the claims, the last two behind the page's first characters.

    Cuts are offsets in characters, which the JVM's strings would be counted for from their beginning each
    time; so a batch of pages goes through Python, whose strings are cut and searched in place. A group
    is found by looking back from as far as it may reach.
    """

    @F.arrow_udf("array<string>")
    def windows(pages: pa.Array) -> pa.Array:
        return pa.array([_windows(x.as_py(), most, header) for x in pages], pa.list_(pa.string()))

    return windows(F.make_valid_utf8(html))  # Python takes no other strings


def first_window(html: Column, most: int = 200_000) -> Column:  # T14
    return F.substring(html, 1, most)


# --- metadata in plain text ---------------------------------------------------------------------


def paper_metadata(text: Column, filename: Column) -> Column:  # T24, T26, T36
    name = first(text, r"(?m)(?:^|\n)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\s*\n\s*[^\n]*?(?:University|Institute|Lab|Inc|Corp)[^\n]*?\s*\n")
    people = F.filter(F.transform(F.split(F.coalesce(name, F.lit("")), r",|\sand\s|\n"), X.trimmed), lambda n: n.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\z"))
    return F.struct(
        F.coalesce(first(filename, r"(\d{4}\.\d{4,5})"), first(text, r"(?i)arXiv:(\d{4}\.\d{4,5})")).alias("arxiv_id"),
        F.coalesce(first(text, r"(?i)DOI:\s*(10\.\d+/\S+)"), first(text, r"(10\.\d+/arXiv\.\d+\.\d+)")).alias("doi"),
        X.iso_date(first(text, r"(?i)v\d+\s*\[(\d+\s+\w+\s+\d{4})\]")).alias("submitted"),
        F.transform(people, lambda n: F.struct(n.alias("name"), F.lit("author").alias("role"))).alias("actors"),
    )


def patent_text_metadata(text: Column, filename: Column) -> Column:  # T24, T26, T36
    number = F.coalesce(first(filename, r"(?i)US(\d+)"), first(text, r"(?i)US\s*(\d+)\s*B[12]"))
    filing = X.iso_date(first(text, r"(?i)Filed:\s*(\w+\.?\s+\d+,\s+\d{4})"))
    inventors = F.filter(F.transform(F.split(F.coalesce(first(text, r"(?i)Inventors?:\s*([^\n]+(?:\n[^\n]+)*?)(?=\n\n|\nAssignee|\nAppl)"), F.lit("")), r";|\sand\s"), lambda x: X.trimmed(F.regexp_extract(x, "^([^,]*)", 1))), lambda x: x != "")
    assignee = first(text, r"(?i)Assignee:\s*([^,\n]+)")
    return F.struct(
        F.concat(F.lit("US"), number).alias("patent_number"),
        F.regexp_replace(first(text, r"(?i)Application No[.:]?\s*([\d,/]+)"), ",", "").alias("application_number"),
        filing.alias("filing"),
        X.iso_date(first(text, r"(?i)Date of Patent:\s*(\w+\.?\s+\d+,\s+\d{4})")).alias("granted"),
        F.concat((F.left(filing, F.lit(4)).cast("int") + 20).cast("string"), F.substring(filing, 5, 6)).alias("expiration"),  # the year alone moves, 29 February stays
        F.concat(F.transform(inventors, lambda n: F.struct(n.alias("name"), F.lit("inventor").alias("role"))), F.when(assignee.isNotNull(), F.array(F.struct(assignee.alias("name"), F.lit("assignee").alias("role")))).otherwise(F.array().cast("array<struct<name:string,role:string>>"))).alias("actors"),
    )


def primary_date(dates: Column, legacy: Column) -> Column:  # T31
    return F.coalesce(*(F.nullif(F.try_element_at(dates, F.lit(k)), F.lit("")) for k in ("created", "published", "filing")), F.nullif(legacy, F.lit("")))


def reingest_status(status: Column, changed: Column) -> Column:  # T32
    return F.when((status == "ingested") & changed, "extracted").otherwise(status)


# --- lists, topics, frontmatter -----------------------------------------------------------------


_ITEM = "struct<url:string,key_terms:array<string>,also_known_as:string,section:string>"


def url_items(content: Column) -> Column:  # IO13: array of struct(url, key_terms, also_known_as, section)
    def row(parts: Column, section: Column) -> Column:
        aka = F.get(F.filter(parts, lambda p: F.lower(p).startswith("aka:")), F.lit(0))
        second = F.get(parts, F.lit(1))
        terms = F.when(F.coalesce(second, F.lit("")).rlike("(?i)^(?!aka:).") , F.filter(F.transform(F.split(second, ","), X.trimmed), lambda t: t != ""))
        return F.struct(F.get(parts, F.lit(0)).alias("url"), terms.alias("key_terms"), X.trimmed(F.regexp_replace(aka, r"(?i)^aka:\s*", "")).alias("also_known_as"), section.alias("section")).cast(_ITEM)

    def item(section: Column, x: Column, i: Column) -> Column:
        none = F.array().cast(f"array<{_ITEM}>")
        parts = F.transform(F.split(X.trimmed(F.regexp_replace(x, r"^[-*]\s+", "")), r"\|"), X.trimmed)
        return F.when(x.startswith("-"), bound(parts, lambda p: F.when(F.get(p, F.lit(0)) != "", F.array(row(p, section))).otherwise(none))).otherwise(none)

    # the state is the last heading's text
    heading = lambda section, x, i: F.when(x.startswith("##"), X.trimmed(F.regexp_replace(x, r"^##\s+", ""))).otherwise(section)
    return F.when(content.isNotNull(), folded(F.transform(F.split(content, "\n"), X.trimmed), F.lit(None).cast("string"), heading, item, _ITEM))


def url_list_problems(content: Column) -> Column:  # T30
    def of(urls: Column) -> Column:
        again = F.size(urls) - F.size(F.array_distinct(urls))
        found = bound(again, lambda n: F.when(n > 0, F.concat(F.lit("Found "), n.cast("string"), F.lit(" duplicate URLs"))))
        return F.array_compact(F.array(F.when(X.trimmed(content) == "", "URL list is empty").when(F.size(urls) == 0, "No valid URLs found in the list"), found, F.when(F.size(urls) > 50, F.concat(F.lit("Large batch detected: "), F.size(urls).cast("string")))))

    return bound(F.transform(url_items(content), lambda x: F.lower(x["url"])), of)


def document_problems(title: Column, summary: Column, body: Column) -> Column:  # T30
    return F.array_compact(F.array(F.when(F.coalesce(X.trimmed(title), F.lit("")) == "", "missing title"), F.when(F.coalesce(X.trimmed(summary), F.lit("")) == "", "missing summary"), F.when(F.length(F.coalesce(body, F.lit(""))) < 100, "content too short")))


def topics(md: Column) -> Column:  # T33: array of struct(id, aliases)
    found = every(md, r"(?s)###\s+Topic\s+\d+:.*?(?=###\s|\n##\s|\z)", 0)
    aliases = lambda t: F.transform(every(F.regexp_extract(t, r"\*\*Aliases\*\*:\s*([^\n]*)", 1), r'"[^"]+"|[^,\s]+', 0), lambda a: F.regexp_replace(a, '"', ""))
    return F.transform(found, lambda t: F.struct(X.trimmed(F.regexp_extract(t, r"###\s+Topic\s+\d+:\s*([^\n]+)", 1)).alias("id"), aliases(t).alias("aliases")))


def selected_sections(md: Column, names: list[str]) -> Column:  # T34
    return F.concat_ws("\n\n", *(first(md, rf"(?s)(?:\A|\n)(##\s+{n}\s*\n.*?)(?=\n##\s|\z)") for n in names))


def persona_defaults(config: Column, updated: Column) -> Column:  # T35
    return F.struct(F.coalesce(config["version"], F.lit("1.0.0")).alias("version"), F.coalesce(config["last_updated"], F.date_format(updated, "yyyy-MM-dd")).alias("last_updated"), F.coalesce(config["search"]["vector_threshold"], F.lit(0.35)).alias("vector_threshold"))


def flat_yaml(block: Column) -> Column:  # IO11: a map of the top-level ``key: value`` lines, quotes taken off
    pairs = every(block, r"(?md)^[A-Za-z_][\w-]*:[ \t]*\S.*$", 0)
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda p: F.regexp_extract(p, r"^([^:]+):", 1))), lambda k: F.struct(k.alias("key"), F.regexp_replace(X.trimmed(F.regexp_replace(F.try_element_at(F.filter(pairs, lambda p: F.regexp_extract(p, r"^([^:]+):", 1) == k), F.lit(-1)), r"^[^:]+:", "")), r'^"(.*)"$', "$1").alias("value"))))


def frontmatter(id_: Column, title: Column, type_: Column, date: Column, source_url: Column, personas: Column, summary: Column, license_: Column) -> Column:  # IO12
    quoted = X.rewrite(title, ('"', r'\\"'), ("\n", " "))
    short = F.when(F.length(quoted) > 200, F.concat(F.substring(quoted, 1, 197), F.lit("..."))).otherwise(quoted)
    line = lambda name, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{name}: "), v))
    return F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("id: "), id_), F.concat(F.lit('title: "'), short, F.lit('"')), line("type", type_), line("date", date), line("source_url", source_url),
        F.concat(F.lit("personas: ["), F.array_join(personas, ", "), F.lit("]")), F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit('summary: "'), X.rewrite(summary, ('"', r'\\"'), ("\n", " ")), F.lit('"'))), line("license", license_), F.lit("---"), F.lit(""),
    )


def merged_metadata(manual: Column, found: Column) -> Column:  # X33: manual entries win
    return F.map_from_entries(F.concat(F.map_entries(manual), F.filter(F.map_entries(found), lambda e: ~F.map_contains_key(manual, e["key"]))))


def stitched(chunks: Column) -> Column:  # T27: formatted pieces in order -> one text
    strings = "array<string>"
    clean = F.transform(chunks, lambda c: X.trimmed(F.regexp_replace(c, r"\[Page \d+\]", "")))

    def put(a: Column, c: Column) -> Column:
        last = F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(""))
        head = F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
        goes_on = last.endswith("[continues]")
        kept = F.when(goes_on, F.regexp_replace(last, r"\s*\[continues\]\s*\z", "")).otherwise(last)
        tail = F.regexp_extract(kept, r"(#{1,3}\s+[^\n]+)\z", 1)
        own = F.regexp_extract(c, r"^(#{1,3}\s+[^\n]+)", 1)
        rest = F.when((tail != "") & (X.trimmed(tail) == X.trimmed(own)), X.trimmed(c.substr(F.length(own) + 1, F.lit(2147483647)))).otherwise(c)
        before = F.when(F.size(a) > 0, F.concat(head, F.array(kept))).otherwise(a)
        return F.when(goes_on & (c != "") & ~c.rlike(r"^#{1,3}\s"), F.concat(head, F.array(F.concat(kept, F.lit("\n"), c)))).when(X.trimmed(rest) != "", F.concat(before, F.array(rest))).otherwise(before).cast(strings)

    return F.array_join(F.aggregate(clean, F.array().cast(strings), put), "\n\n")


def assembled(front: Column, terms: Column, body: Column) -> Column:  # T28, T29
    return F.concat_ws("\n", front, F.when(F.size(terms) > 0, F.concat(F.lit("**Key Terms**: "), F.array_join(terms, ", "), F.lit("\n"))), body)


def article(title: Column, authors: Column, url: Column, body: Column) -> Column:  # T29
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), F.when(F.size(authors) > 0, F.concat(F.lit("**Authors**: "), F.array_join(authors, ", "))), F.concat(F.lit("**Source**: "), url), body)


def patent_article(title: Column, abstract: Column, claims_: Column) -> Column:  # T29
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), F.concat(F.lit("## Abstract\n\n"), abstract), F.when(F.size(claims_) > 0, F.concat(F.lit("## Claims\n\n"), F.array_join(F.transform(claims_, lambda c: F.concat(c["number"].cast("string"), F.lit(". "), c["text"])), "\n\n"))))


def contextual(context: Column, chunk: Column) -> Column:
    """The text to embed: the context, or a stock phrase for it, before the chunk."""
    return F.concat(F.coalesce(F.nullif(X.trimmed(context), F.lit("")), F.lit("This chunk is from the document.")), F.lit("\n\n"), chunk)


def extracted(docs: DataFrame, text: str, **fields: Column) -> DataFrame:
    """docs with the fields added: extraction is a projection, so any number of fields costs one scan."""
    return docs.withColumns(fields)


# --- formatters and validators ------------------------------------------------------------------


def arxiv_article(title: Column, authors: Column, arxiv_id: Column, date: Column, abstract: Column, body: Column) -> Column:  # T29
    """A paper's Markdown: title, a block of what is known of it, the abstract, the text. Empty parts are left out."""
    text = lambda c: F.coalesce(c, F.lit("")) != ""
    known = F.concat_ws("\n", F.when(F.size(authors) > 0, F.concat(F.lit("**Authors**: "), F.array_join(authors, ", "))), F.when(text(arxiv_id), F.concat(F.lit("**arXiv**: "), arxiv_id)), F.when(text(date), F.concat(F.lit("**Date**: "), date)))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), F.nullif(known, F.lit("")), F.when(text(abstract), F.concat(F.lit("## Abstract\n\n"), abstract)), F.when(text(body), body))


# Labels of what is known of a patent, in order.
PATENT_LABELS = {
    "patent_number": "Patent Number", "publication_number": "Publication Number", "application_number": "Application Number", "inventors": "Inventors", "current_assignee": "Current Assignee",
    "original_assignee": "Original Assignee", "priority": "Priority Date", "filing": "Filing Date", "publication": "Publication Date", "granted": "Grant Date", "expiration": "Expiration Date",
}
# Headings that a patent's description is given under, by those of the page, in order.
PATENT_HEADINGS = {"BACKGROUND": "Background of the Invention", "SUMMARY": "Summary of the Invention", "DETAILED DESCRIPTION": "Detailed Description"}


def patent_html_article(number: Column, parts: Column, meta: Column, drawings_: Column, claims_: Column, personas: Column, summary: Column | None = None, terms: Column | None = None, aliases: Column | None = None) -> Column:  # T29
    """A patent page's Markdown behind its frontmatter: what ``patent_parts``, ``patent_metadata``, ``drawings`` and ``claims`` found, each part left out where it is null or empty.

    A page without a title has its number's; without a summary its abstract's first sentence is one. Key
    terms and other names have a block of their own where a summary is given.
    """
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    under = lambda heading, c: F.when(some(c), F.concat(F.lit(f"## {heading}\n\n\n"), c))
    block = lambda head, *lines: bound(F.concat_ws("\n", *lines), lambda x: F.when(x != "", F.concat(F.lit(f"{head}\n"), x)))
    names = lambda role: F.transform(F.filter(meta["actors"], lambda a: a["role"] == role), lambda a: a["name"])
    one = lambda role: F.get(names(role), F.lit(0))
    title = F.coalesce(F.nullif(parts["title"], F.lit("")), number)
    fields = {
        "patent_number": number, **{k: meta[k] for k in ("publication_number", "application_number", "priority", "filing", "publication", "granted", "expiration")},
        "inventors": F.array_join(names("inventor"), ", "), "current_assignee": one("current_assignee"), "original_assignee": F.when(~one("original_assignee").eqNullSafe(one("current_assignee")), one("original_assignee")),
    }
    entry = lambda name: F.when(some(fields[name]), F.concat(F.lit(f'  {name}: "'), fields[name], F.lit('"')))
    people = F.array_join(F.transform(F.coalesce(meta["actors"], F.array().cast("array<struct<name:string,role:string>>")), lambda a: F.concat(F.lit('  - name: "'), a["name"], F.lit('"\n    role: "'), a["role"], F.lit('"'))), "\n")
    short = F.coalesce(F.nullif(summary, F.lit("")) if summary is not None else F.lit(None).cast("string"), F.nullif(F.get(F.split(F.coalesce(parts["abstract"], F.lit("")), r"[.!?]\s", 2), F.lit(0)), F.lit("")))
    front = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("id: "), F.regexp_replace(F.lower(number), "[^a-z0-9]", "")), F.concat(F.lit("title: "), title), F.lit("type: patent"), F.concat(F.lit("personas: ["), F.array_join(personas, ", "), F.lit("]")),
        F.concat(F.lit("summary: "), short), block("identifiers:", *map(entry, ("patent_number", "publication_number", "application_number"))), block("dates:", *map(entry, ("priority", "filing", "publication", "granted", "expiration"))), block("actors:", F.nullif(people, F.lit(""))), F.lit("---"),
    )
    joined = lambda c: F.array_join(c, ", ") if c is not None else F.lit("")
    known = None if summary is None else F.when(some(summary), F.concat_ws("\n", F.when(some(joined(terms)), F.concat(F.lit("**Key Terms**: "), joined(terms))), F.concat(F.lit("**Also Known As**: "), F.coalesce(joined(aliases), F.lit("")))))
    info = F.concat_ws("  \n", *(F.when(some(fields[k]), F.concat(F.lit(f"**{label}**: "), fields[k])) for k, label in PATENT_LABELS.items()))
    described = [under(to, F.try_element_at(parts["description"], F.lit(of))) for of, to in PATENT_HEADINGS.items()]
    figure = lambda d: F.when(some(d["description"]), F.concat(F.lit("- **Figure "), d["figure"], F.lit("**: "), d["description"])).otherwise(F.concat(F.lit("- Figure "), d["figure"]))
    figures = F.when(F.size(drawings_) > 0, F.concat(F.lit("The patent includes the following figures:\n\n"), F.array_join(F.transform(drawings_, figure), "\n")))
    listed = F.array_join(F.transform(claims_, lambda c: F.concat(c["number"].cast("string"), F.lit(". "), c["text"])), "\n\n")
    return F.concat_ws("\n\n", front, *([known] if known is not None else []), F.concat(F.lit("# "), title), info, under("Abstract", parts["abstract"]), *described, under("Drawings", figures), under("Claims", listed))


def raw_article(title: Column, text: Column) -> Column:  # T29
    """Plain Markdown as it is, with a heading of its own if it begins with none."""
    body = X.normalize_markdown(text)
    return F.when(X.trimmed(body).startswith("# "), body).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), body))


def assembled_problems(document: Column) -> Column:  # T30
    """array<string>: what is wrong with an assembled document; empty if nothing is."""
    block, body = X.frontmatter_block(document), X.trimmed(X.strip_frontmatter(document))
    return F.array_compact(F.array(
        F.when(block == "", "no frontmatter"),
        F.when((block != "") & ~block.rlike(r"(?md)^id: *\S"), "no id"),
        F.when((block != "") & ~block.rlike(r'(?md)^title: *"?[^"\s]'), "no title"),
        F.when((block != "") & ~block.rlike(r"(?md)^personas: *\[ *[^\]\s]"), "no personas"),
        F.when(body == "", "no body"),
        F.when((body != "") & ~body.rlike(r"(?md)^#{1,6} \S"), "no heading"),
    ))


def upload_problems(path: Column, bytes_: Column, most: int = 50 << 20) -> Column:  # T30
    """array<string>: what keeps a file from being taken."""
    return F.array_compact(F.array(F.when(X.file_type(path) == "unknown", "unknown file type"), F.when(bytes_ <= 0, "empty file"), F.when(bytes_ > most, "file too large"), F.when(~path.rlike(r"^[^\x00-\x1f]*\z"), "control characters in the name")))
