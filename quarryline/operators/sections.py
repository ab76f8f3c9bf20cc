"""Lines, blocks, sections and their paths (section 2.10, T1 to T6, and X13, X20, X22, X23).

Line structure is folded inside arrays, one document at a time, so documents aren't shuffled. A frame
with one row a line (``lines``) is there for windowed work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.folds import bound, folded

_SECTION = "struct<level:int,title:string,content:string,start_line:int,end_line:int>"


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def sections_of(md: Column, heading: str = r"^(#{1,6})\s+(.+)$") -> Column:  # T1, T2: array of sections; text before the first heading is dropped (Q3)
    """Each line is appended to the section that is open; the sections are joined at the end, so a long section costs no repeated copying of text."""
    each_ = F.transform(F.split(md, "\n"), lambda line, i: F.struct(i.alias("i"), line.alias("line"), line.rlike(heading).alias("h")))

    def section(each: Column, starts: Column, x: Column, k: Column) -> Column:
        end = F.coalesce(F.get(starts, k + 1)["i"], F.size(each))
        body = F.array_join(F.transform(F.slice(each, x["i"] + 2, end - x["i"] - 1), lambda y: y["line"]), "\n")
        return F.struct(F.length(F.regexp_extract(x["line"], heading, 1)).alias("level"), X.trimmed(F.regexp_extract(x["line"], heading, 2)).alias("title"), X.trimmed(body).alias("content"), x["i"].alias("start_line"), (end - 1).alias("end_line"))

    return X.bound(each_, lambda each: X.bound(F.filter(each, lambda x: x["h"]), lambda starts: F.transform(starts, lambda x, k: section(each, starts, x, k))))


def paths_of(sections: Column) -> Column:  # T3, T6, W7: of each section the titles of those it stands in, joined; the document's root is left out
    """One pass: the stack holds the open sections of ever larger level, so it is never deeper than there are levels."""
    kind = "struct<level:int,title:string>"

    def step(stack: Column, s: Column, _: Column) -> Column:
        return F.concat(F.filter(stack, lambda x: x["level"] < s["level"]), F.array(F.struct(s["level"].alias("level"), s["title"].alias("title"))))

    def titles(stack: Column, s: Column, i: Column) -> Column:
        return F.array(F.transform(step(stack, s, i), lambda x: x["title"]))

    stacks = folded(sections, F.array().cast(f"array<{kind}>"), step, titles, "array<string>")
    first = F.get(sections, F.lit(0))
    root = F.when(first["level"] == F.array_min(F.transform(sections, lambda s: s["level"])), first["title"])
    return bound(root, lambda r: F.transform(stacks, lambda p: F.array_join(F.when((F.size(p) > 1) & F.coalesce(F.get(p, F.lit(0)) == r, F.lit(False)), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p), " > ")))


def sections(docs: DataFrame, text: str = "text", heading: str = r"^(#{1,6})\s+(.+)$") -> DataFrame:  # T1, T3
    """(doc_id, section_no, level, title, content, start_line, end_line, path)."""
    arrays = docs.select("doc_id", sections_of(F.col(text), heading).alias("s"))
    # outer: for a plain one the optimizer adds tests of the array, and each would make it anew; let: its two uses, too
    both = bound(F.col("s"), lambda s: F.arrays_zip(s.alias("x"), paths_of(s).alias("path")))
    return arrays.select("doc_id", F.posexplode_outer(both).alias("section_no", "y")).where("section_no is not null").select("doc_id", "section_no", "y.x.*", "y.path")


def code_blocks(text: Column) -> Column:  # T4: array of struct(language, code, start_line, end_line); an unclosed fence gives none
    each_ = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("i"), line.alias("line")))

    def block(each: Column, fences: Column, k: Column) -> Column:
        a, b = F.get(fences, k), F.get(fences, k + 1)
        code = F.array_join(F.transform(F.slice(each, a["i"] + 2, b["i"] - a["i"] - 1), lambda y: y["line"]), "\n")
        return F.struct(X.trimmed(X.trimmed(a["line"]).substr(F.lit(4), F.length(a["line"]))).alias("language"), code.alias("code"), a["i"].alias("start_line"), b["i"].alias("end_line"))

    def blocks(each: Column, fences: Column) -> Column:
        pairs = F.when(F.size(fences) >= 2, F.sequence(F.lit(0), F.size(fences) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
        return F.transform(pairs, lambda k: block(each, fences, k))

    return X.bound(each_, lambda each: X.bound(F.filter(each, lambda x: X.trimmed(x["line"]).startswith("```")), lambda fences: blocks(each, fences)))


def prose_lines(text: Column) -> Column:  # T4
    """Lines outside code fences, with [CODE_BLOCK_i] for each block, as an array; what follows an unclosed fence is lost."""

    def prose(ls: Column, fences: Column) -> Column:
        opening = F.filter(F.transform(fences, lambda f, k: F.when(k % 2 == 0, f)), lambda f: f.isNotNull())
        since = lambda k: F.when(k == 0, 0).otherwise(F.coalesce(F.get(fences, 2 * k - 1) + 1, F.size(ls)))  # noqa: E731  where prose goes on
        before = F.transform(opening, lambda f, k: F.concat(F.slice(ls, since(k) + 1, f - since(k)), F.array(F.concat(F.lit("[CODE_BLOCK_"), k.cast("string"), F.lit("]")))))
        rest = since(F.size(opening))
        return F.concat(F.flatten(before), F.slice(ls, rest + 1, F.size(ls) - rest))

    at = lambda ls: F.filter(F.transform(ls, lambda line, i: F.when(X.trimmed(line).startswith("```"), i)), lambda i: i.isNotNull())
    return bound(F.split(text, "\n"), lambda ls: bound(at(ls), lambda fences: prose(ls, fences)))


def without_code(text: Column) -> Column:  # T4
    return F.array_join(prose_lines(text), "\n")


def blocks_of(text: Column) -> Column:  # X22: array of struct(type, content, start_line, end_line) of neighbouring lines of one type
    marked_ = F.transform(F.split(text, "\n"), lambda line, i: F.struct(i.alias("i"), line.alias("line"), F.when(X.trimmed(line) != "", X.line_type(X.trimmed(line))).alias("t")))

    def block(marked: Column, changes: Column, i: Column, k: Column) -> Column:
        t = F.get(marked, i)["t"]
        n = F.coalesce(F.get(changes, k + 1), F.size(marked)) - i
        return F.struct(t.alias("type"), F.array_join(F.transform(F.slice(marked, i + 1, n), lambda y: y["line"]), "\n").alias("content"), i.alias("start_line"), (i + n - 1).alias("end_line"))

    def blocks(marked: Column) -> Column:
        changes = F.filter(F.transform(marked, lambda x, i: F.when((i == 0) | ~x["t"].eqNullSafe(F.get(marked, i - 1)["t"]), i)), lambda i: i.isNotNull())
        every = X.bound(changes, lambda c: F.transform(c, lambda i, k: block(marked, c, i, k)))
        return F.filter(every, lambda b: b["type"].isNotNull())

    return X.bound(marked_, blocks)


def merged_paragraphs(blocks: Column) -> Column:  # X23
    """Runs of neighbouring paragraphs become one: where a run begins is known from two neighbours, so each run is cut out once."""
    starts = F.filter(F.transform(blocks, lambda b, i: F.when((i == 0) | (b["type"] != "paragraph") | (F.get(blocks, i - 1)["type"] != "paragraph"), i)), lambda i: i.isNotNull())

    def run(begin: Column, i: Column, k: Column) -> Column:
        n = F.coalesce(F.get(begin, k + 1), F.size(blocks)) - i
        first, last = F.get(blocks, i), F.get(blocks, i + n - 1)
        text = F.array_join(F.transform(F.slice(blocks, i + 1, n), lambda b: b["content"]), "\n\n")
        return F.struct(first["type"].alias("type"), text.alias("content"), first["start_line"].alias("start_line"), last["end_line"].alias("end_line"))

    return X.bound(starts, lambda begin: F.transform(begin, lambda i, k: run(begin, i, k)))


def rebuilt_paragraphs(text: Column) -> Column:  # X20
    """A line goes on in the next one unless it ends a sentence, is short, or the next begins with a capital or a digit; an empty line stands by itself."""
    ends = lambda ls: F.transform(ls, lambda x, i: F.struct(x.alias("x"), ((x == "") | x.rlike(r"[.!?]\z") | F.coalesce(F.get(ls, i + 1), F.lit("")).rlike("^[A-Z0-9]|^\\z") | (F.length(x) < 50)).alias("ends")))
    each = X.bound(F.transform(F.split(text, "\n"), X.trimmed), ends)

    def joined(es: Column) -> Column:
        last = F.filter(F.transform(es, lambda e, i: F.when(e["ends"] | (i == F.size(es) - 1), i)), lambda i: i.isNotNull())

        def paragraph(at: Column, i: Column, k: Column) -> Column:
            begin = F.coalesce(F.get(at, k - 1), F.lit(-1)) + 1
            return F.array_join(F.transform(F.slice(es, begin + 1, i - begin + 1), lambda e: e["x"]), " ")

        return X.bound(last, lambda at: F.transform(at, lambda i, k: paragraph(at, i, k)))

    return F.array_join(X.bound(each, joined), "\n")


def normalized_page(text: Column) -> Column:  # X24: struct(text, blocks)
    return X.bound(rebuilt_paragraphs(X.join_hyphenated(text)), lambda t: F.struct(t.alias("text"), blocks_of(t).alias("blocks")))


def text_to_markdown(text: Column) -> Column:  # X13
    heads = lambda ls: F.transform(ls, lambda x, i: F.struct(x.alias("x"), ((x != "") & (F.length(x) < 60) & x.rlike("^[A-Z]") & (F.coalesce(F.get(ls, i + 1), F.lit("")) == "") & ~x.endswith(".")).alias("h")))
    each = X.bound(F.transform(F.split(text, "\n"), X.trimmed), heads)

    def marked(es: Column) -> Column:
        inside = lambda i: (i > 0) & F.coalesce((F.get(es, i - 1)["x"] != "") & ~F.get(es, i - 1)["h"], F.lit(False))  # noqa: E731  in a paragraph
        return F.transform(es, lambda e, i: F.when(e["x"] == "", F.when(inside(i), F.lit(""))).when(e["h"], F.concat(F.lit("\n## "), e["x"], F.lit("\n"))).when(inside(i), e["x"]).otherwise(F.concat(F.lit("\n"), e["x"])))

    return F.concat(X.trimmed(F.array_join(F.array_compact(bound(each, marked)), "\n")), F.lit("\n"))


def processed_markdown(raw: Column) -> Column:  # X14
    t = X.clean_extracted(raw)
    marked = t.rlike(r"(?md)^#{1,6}\s+|\[.+\]\(.+\)")
    return X.normalize_markdown(F.when(marked, t).otherwise(text_to_markdown(t)))


# What titles show a paper.
ACADEMIC = ["abstract", "method", "result", "conclusion"]


def structure_type(doc_type: Column, titles: Column) -> Column:  # T15
    low = F.transform(titles, F.lower)

    def holds(word: str) -> Column:
        return F.exists(low, lambda t: F.contains(t, F.lit(word))).cast("int")

    n = sum((holds(w) for w in ACADEMIC), F.lit(0))
    return F.when(doc_type.isin("patent", "arxiv"), doc_type).when(doc_type.isin("paper", "article") | (n >= 2), "paper").when(doc_type.isin("technical_memo", "tech_memo"), "technical_memo").otherwise("generic")


def abstract_of(sections_: Column) -> Column:  # T16
    return X.trimmed(F.substring(F.get(F.filter(sections_, lambda s: F.lower(X.trimmed(s["title"])) == "abstract"), F.lit(0))["content"], 1, 500))


def first_claims(sections_: Column, n: int = 3) -> Column:  # T16
    content = F.get(F.filter(sections_, lambda s: F.lower(X.trimmed(s["title"])).rlike(r"^claims?\z")), F.lit(0))["content"]
    return F.transform(F.slice(F.regexp_extract_all(content, F.lit(r"(?ms)^\d+\.\s+.+?(?=^\d+\.|\z)"), F.lit(0)), 1, n), X.trimmed)


# Headings by structure that matter, whether their sections are never merged, and their own least tokens.
_ABSTRACT = (r"(?i)^#{1,3}\s*Abstract\s*\z", True, 100)
_PAPER = [
    _ABSTRACT,
    (r"(?i)^#{1,3}\s*Introduction\s*\z", False, None),
    (r"(?i)^#{1,3}\s*(Methods?|Methodology|Materials\s*and\s*Methods)\s*\z", True, 200),
    (r"(?i)^#{1,3}\s*Results\s*\z", True, 200),
    (r"(?i)^#{1,3}\s*Discussion\s*\z", False, None),
    (r"(?i)^#{1,3}\s*Conclusions?\s*\z", True, 150),
    (r"(?i)^#{1,3}\s*References\s*\z", False, None),
]
SECTION_RULES = {
    "patent": [
        _ABSTRACT,
        (r"(?i)^#{1,3}\s*(Claims?|What is claimed)\s*\z", True, 200),
        (r"(?i)^#{1,3}\s*Summary\s*(of\s*(the\s*)?Invention)?\s*\z", True, 150),
        (r"(?i)^#{1,3}\s*Technical\s*Field\s*\z", False, None),
        (r"(?i)^#{1,3}\s*Background(\s*of\s*(the\s*)?Invention)?\s*\z", False, None),
        (r"(?i)^#{1,3}\s*Brief\s*Description\s*(of\s*(the\s*)?Drawings)?\s*\z", False, None),
        (r"(?i)^#{1,3}\s*Detailed\s*Description\s*\z", False, None),
    ],
    "paper": _PAPER,
    "arxiv": [*_PAPER, (r"(?i)^#{1,3}\s*Related\s*Work\s*\z", False, None), (r"(?i)^#{1,3}\s*Experiments?\s*\z", True, 200)],
}


def section_rule(structure: Column, heading: Column, least: int) -> Column:  # T17: struct(critical, least)
    """By the first rule that fits. Rules want a heading's # marks: a bare title fits none (Q1)."""
    rule = lambda critical, n: F.struct(F.lit(critical).alias("critical"), F.lit(least if n is None else n).alias("least"))
    out = rule(False, None)
    for kind, rules in SECTION_RULES.items():
        for pattern, critical, n in reversed(rules):
            out = F.when((structure == kind) & heading.rlike(pattern), rule(critical, n)).otherwise(out)
    return out
