"""Chunkers: folds over one document's pieces (section 2.10, T5, T7 to T12, IO8).

A packing that resets as it goes isn't a window frame. The packers fold over an array inside the row, so
documents aren't shuffled and everything stays in the JVM; folds keep their state small (``folds``), so
a document's time is about in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.folds import bound, folded
from .sections import code_blocks, prose_lines, section_rule, sections_of, structure_type

MIN_CHARS, TARGET_CHARS, MAX_CHARS = 1800, 2400, 3000
MIN_TOKENS, MAX_TOKENS, OVERLAP = 800, 1200, 0.175

_SPAN = "struct<first:int,n:int>"


def packed(pieces: Column, most: int = MAX_CHARS, least: int | None = MIN_CHARS, target: int | None = None) -> Column:
    """Pack pieces (struct(text, page, is_heading)) in order into array<struct<content, n, first, last, pieces>>.

    A chunk is closed before a piece that would take it over `most`; after a piece if it has `least`
    then; with target, also before a heading once it has target. The fold keeps where the open chunk
    began and its size, and gives the closed chunks' places; their texts are cut out afterwards.
    """
    state = lambda first, n: F.struct(first.cast("int").alias("first"), n.cast("int").alias("n"))

    def cuts(a: Column, p: Column, i: Column) -> tuple[Column, Column, Column]:
        """(closed before this piece, size with it, closed after it)."""
        size = F.length(p["text"])
        full = a["n"] + size > most
        if target is not None:
            full = full | ((a["n"] >= target) & p["is_heading"])
        before = full & (i > a["first"])
        n = F.when(before, 0).otherwise(a["n"]) + size
        return before, n, F.lit(False) if least is None else n >= least

    def step(a: Column, p: Column, i: Column) -> Column:
        before, n, after = cuts(a, p, i)
        return F.when(after, state(i + 1, F.lit(0))).otherwise(state(F.when(before, i).otherwise(a["first"]), n))

    def closed(a: Column, p: Column, i: Column) -> Column:
        before, _, after = cuts(a, p, i)
        span = lambda first, n: F.struct(first.cast("int").alias("first"), n.cast("int").alias("n"))
        return F.array_compact(F.array(F.when(before, span(a["first"], i - a["first"])), F.when(after, bound(F.when(before, i).otherwise(a["first"]), lambda f: span(f, i + 1 - f)))))

    def row(ps: Column, s: Column) -> Column:
        mine = F.slice(ps, s["first"] + 1, s["n"])
        n = F.aggregate(mine, F.lit(0), lambda a, p: a + F.length(p["text"]))
        content = X.trimmed(F.array_join(F.transform(mine, lambda p: p["text"]), "\n\n"))
        return F.struct(content.alias("content"), n.alias("n"), F.get(ps, s["first"])["page"].alias("first"), F.get(ps, s["first"] + s["n"] - 1)["page"].alias("last"), s["n"].alias("pieces"))

    def every(ps: Column) -> Column:
        spans = folded(ps, state(F.lit(0), F.lit(0)), step, closed, _SPAN)
        after = lambda ss: F.coalesce(F.get(ss, F.size(ss) - 1)["first"] + F.get(ss, F.size(ss) - 1)["n"], F.lit(0))
        rest = lambda ss: F.when(after(ss) < F.size(ps), F.array(F.struct(after(ss).alias("first"), (F.size(ps) - after(ss)).alias("n")))).otherwise(F.array().cast(f"array<{_SPAN}>"))
        return bound(spans, lambda ss: F.transform(F.concat(ss, rest(ss)), lambda s: row(ps, s)))

    return bound(pieces, every)


def page_pieces(pages: Column) -> Column:
    """Of an array of struct(page_number, text)."""
    return F.transform(pages, lambda p: F.struct(F.concat(F.lit("\n\n[Page "), p["page_number"].cast("string"), F.lit("]\n\n"), p["text"]).alias("text"), p["page_number"].cast("int").alias("page"), F.lit(False).alias("is_heading")))


def block_pieces(blocks: Column) -> Column:
    """Of an array of struct(type, content, page)."""
    return F.transform(blocks, lambda b: F.struct(b["content"].alias("text"), b["page"].cast("int").alias("page"), (b["type"] == "heading").alias("is_heading")))


def pages_packed(pages: Column) -> Column:  # T10
    return packed(page_pieces(pages))


def blocks_packed(blocks: Column) -> Column:  # T11
    return packed(block_pieces(blocks))


def smart_packed(blocks: Column) -> Column:  # T12
    return packed(block_pieces(blocks), least=None, target=TARGET_CHARS)


def page_slices(text: Column, n_pages: Column) -> Column:  # IO8: equal slices, not real pages
    size = F.ceil(F.length(text) / F.greatest(n_pages, F.lit(1))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(n_pages, F.lit(1)) - 1), lambda i: F.struct((i + 1).alias("page_number"), text.substr(i * size + 1, size).alias("text")))


def sections_merged(sections: Column, least: int = MIN_TOKENS, structure: Column | None = None, count: Callable[[Column], Column] = X.token_estimate) -> Column:  # T5
    """Small neighbours that aren't of a higher rank join. With a structure, critical sections don't, and a section's own rule says what is small."""

    def joins(a: Column, s: Column) -> Column:
        heading = F.concat(F.repeat(F.lit("#"), s["level"]), F.lit(" "), s["title"])
        rule = section_rule(structure, heading, least) if structure is not None else F.struct(F.lit(False).alias("critical"), F.lit(least).alias("least"))
        return bound(rule, lambda r: F.coalesce((a["first"] >= 0) & ~r["critical"] & (count(a["content"]) + count(s["content"]) < r["least"]) & (s["level"] >= a["level"]), F.lit(False)))

    def step(a: Column, s: Column, i: Column) -> Column:
        whole = F.struct(a["first"].alias("first"), a["level"].alias("level"), F.concat(a["content"], F.lit("\n\n"), s["content"]).alias("content"))
        return F.when(joins(a, s), whole).otherwise(F.struct(i.alias("first"), s["level"].alias("level"), s["content"].alias("content")))

    def begins(a: Column, s: Column, i: Column) -> Column:
        return F.when(joins(a, s), F.array().cast("array<int>")).otherwise(F.array(i))

    def row(ss: Column, starts: Column, i: Column, k: Column) -> Column:
        n = F.coalesce(F.get(starts, k + 1), F.size(ss)) - i
        first, last = F.get(ss, i), F.get(ss, i + n - 1)
        content = F.array_join(F.transform(F.slice(ss, i + 1, n), lambda x: x["content"]), "\n\n")
        return F.struct(first["level"].alias("level"), first["title"].alias("title"), content.alias("content"), first["start_line"].alias("start_line"), last["end_line"].alias("end_line"))

    zero = F.struct(F.lit(-1).alias("first"), F.lit(0).alias("level"), F.lit("").alias("content"))
    return bound(sections, lambda ss: bound(folded(ss, zero, step, begins, "int"), lambda starts: F.transform(starts, lambda i, k: row(ss, starts, i, k))))


def trailing_sentences(text: Column, most: int, count: Callable[[Column], Column] = X.token_estimate) -> Column:  # T8: as many last sentences as fit, one at least
    back = F.reverse(X.sentences_with_marks(text))
    kept = F.aggregate(
        back,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("out")),
        lambda a, s: X.bound(count(s).cast("long"), lambda k: F.when(a["over"] | ((a["n"] + k > most) & (F.size(a["out"]) > 0)), F.struct(a["n"].alias("n"), F.lit(True).alias("over"), a["out"].alias("out"))).otherwise(
            F.struct((a["n"] + k).alias("n"), F.lit(False).alias("over"), F.concat(a["out"], F.array(s)).alias("out"))
        )),
    )
    return F.array_join(F.reverse(kept["out"]), " ")


_CHUNK = "struct<k:int,before:string,first:int,size:int,n:bigint,code:boolean>"


def chunks_of(sections: Column, least: int = MIN_TOKENS, most: int = MAX_TOKENS, overlap: float = OVERLAP, count: Callable[[Column], Column] = X.token_estimate) -> Column:  # T7, T8, with Q2
    """array<struct<path, text, n>> of an array of struct(path, content), by one fold over all sections' lines.

    Lines fill a chunk until the next one would take it over `most`, once it has `least`; a new chunk
    begins with the last sentences of the one before; code blocks become chunks of their own after
    their section's prose. count: the token counter (X57), Column to Column; by default a quarter of the
    characters. The fold's state is where the open chunk began, its tokens and what it carries over, so
    a line costs the same however long the text is; texts are cut out by place.
    """
    n_of = lambda s: count(s).cast("long")
    carried, none = int(most * overlap), F.lit("")
    block = lambda content, b: F.concat(X.trimmed(F.substring(F.array_join(F.slice(F.split(content, "\n"), 1, 3), "\n"), 1, 200)), F.lit("...\n\n```"), b["language"], F.lit("\n"), b["code"], F.lit("\n```"))
    tail = lambda s: F.when(s == "", none).otherwise(trailing_sentences(s, carried, count))
    marked = lambda s: F.contains(s, F.lit("[CODE_BLOCK_"))

    def codes(s: Column) -> Column:
        content = F.coalesce(s["content"], none)
        return F.transform(code_blocks(content), lambda b: block(content, b))

    def lines(s: Column, k: Column, mine: Column) -> Column:
        """A section's lines of prose, and a mark of its end with what its last code block carries over."""
        item = lambda line, n, carry: F.struct(k.alias("k"), line.alias("line"), n.alias("n"), carry.alias("carry"))
        null = F.lit(None).cast("string")
        last = F.get(mine, F.size(mine) - 1)
        end = item(null, F.lit(0).cast("long"), F.when(F.size(mine) > 0, F.when(marked(last), none).otherwise(tail(last))))
        return F.concat(F.transform(prose_lines(F.coalesce(s["content"], none)), lambda x: item(x, n_of(F.concat(x, F.lit("\n"))), null)), F.array(end))

    def text_of(items: Column, before: Column, first: Column, size: Column) -> Column:
        body = F.transform(F.slice(items, first + 1, size), lambda x: x["line"])
        return X.trimmed(F.array_join(F.when(before != "", F.concat(F.array(before), body)).otherwise(body), "\n"))

    def fold(items: Column) -> Column:
        opened = lambda before, first: F.struct(before.alias("before"), first.cast("int").alias("first"), F.when(before == "", F.lit(0).cast("long")).otherwise(n_of(before)).alias("n"))
        state = lambda o, k, carry: F.struct(o["before"].alias("before"), o["first"].alias("first"), (o["n"] + k).alias("n"), carry.alias("carry"))
        full = lambda a, x: (a["n"] + x["n"] > most) & (a["n"] >= least)
        mine = lambda a, i: text_of(items, a["before"], a["first"], i - a["first"])

        def step(a: Column, x: Column, i: Column) -> Column:
            grown = F.struct(a["before"].alias("before"), a["first"].alias("first"), (a["n"] + x["n"]).alias("n"), a["carry"].alias("carry"))
            cut = lambda text: bound(opened(tail(text), i), lambda o: state(o, x["n"], a["carry"]))
            ended = lambda text: bound(F.coalesce(x["carry"], F.when(text == "", a["carry"]).when(marked(text), none).otherwise(tail(text))), lambda c: bound(opened(c, i + 1), lambda o: state(o, F.lit(0).cast("long"), c)))
            return F.when(x["line"].isNull(), bound(mine(a, i), ended)).when(full(a, x), bound(mine(a, i), cut)).otherwise(grown)

        def closed(a: Column, x: Column, i: Column) -> Column:
            span = F.struct(x["k"].alias("k"), a["before"].alias("before"), a["first"].alias("first"), (i - a["first"]).alias("size"), a["n"].alias("n"), F.lit(False).alias("code"))
            code = F.struct(x["k"].alias("k"), none.alias("before"), F.lit(0).alias("first"), F.lit(0).alias("size"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("code"))
            nothing = F.array().cast(f"array<{_CHUNK}>")
            prose = F.when(mine(a, i) != "", F.array(span)).otherwise(nothing)
            return F.when(x["line"].isNull(), F.concat(prose, F.when(x["carry"].isNotNull(), F.array(code)).otherwise(nothing))).when(full(a, x), prose).otherwise(nothing)

        zero = F.struct(none.alias("before"), F.lit(0).alias("first"), F.lit(0).cast("long").alias("n"), none.alias("carry"))
        return folded(items, zero, step, closed, _CHUNK)

    def chunks(ss: Column, blocks: Column, items: Column) -> Column:
        chunk = lambda k, text, n: F.struct(F.get(ss, k)["path"].alias("path"), text.alias("text"), n.alias("n"))
        return F.flatten(F.transform(fold(items), lambda c: F.when(c["code"], F.transform(F.get(blocks, c["k"]), lambda b: chunk(c["k"], b, n_of(b)))).otherwise(F.array(chunk(c["k"], text_of(items, c["before"], c["first"], c["size"]), c["n"])))))

    flat = lambda ss, blocks: F.flatten(F.transform(ss, lambda s, k: lines(s, k, F.get(blocks, k))))
    return bound(sections, lambda ss: bound(F.transform(ss, codes), lambda blocks: bound(flat(ss, blocks), lambda items: chunks(ss, blocks, items))))


def token_chunks(sections: DataFrame, least: int = MIN_TOKENS, most: int = MAX_TOKENS, overlap: float = OVERLAP, count: Callable[[Column], Column] = X.token_estimate) -> DataFrame:  # T7, T8
    """(doc_id, chunk_index, section_path, text, token_count) from (doc_id, sections: array<struct<path, content>>)."""
    # outer: for a plain one the optimizer adds tests of the array, and each would fold it anew
    c = sections.select("doc_id", F.posexplode_outer(chunks_of(F.col("sections"), least, most, overlap, count)).alias("chunk_index", "c"))
    return c.where("chunk_index is not null").select("doc_id", "chunk_index", F.col("c.path").alias("section_path"), "c.text", F.col("c.n").cast("int").alias("token_count"))


def document_chunks(docs: DataFrame, text: str = "text", structure: Column | None = None, least: int = MIN_TOKENS, most: int = MAX_TOKENS, count: Callable[[Column], Column] = X.token_estimate) -> DataFrame:  # T5, T7, T15, T17
    """Sections, merged by the rules of the document's structure, and their chunks. structure: by default that which the sections' titles show."""
    s = docs.select("*", sections_of(F.col(text)).alias("_s"))
    kind = structure if structure is not None else structure_type(F.lit("generic"), F.transform("_s", lambda x: x["title"]))
    merged = F.transform(sections_merged(F.col("_s"), least, kind, count), lambda x: F.struct(x["title"].alias("path"), x["content"].alias("content")))
    return token_chunks(s.select("doc_id", merged.alias("sections")), least, most, OVERLAP, count)


def united(metadata: DataFrame, summary: DataFrame, body: DataFrame) -> DataFrame:  # U3
    """(doc_id, kind, chunk_index, text): a document's metadata chunk, its summary if there is one, then its body chunks. body: doc_id, n, text."""
    own = [df.select("doc_id", F.lit(k).alias("kind"), F.lit(0).cast("long").alias("n"), "text") for k, df in enumerate((metadata, summary))]
    rows = own[0].unionByName(own[1]).unionByName(body.select("doc_id", F.lit(2).alias("kind"), F.col("n").cast("long").alias("n"), "text")).where("text is not null")
    names = F.array(F.lit("metadata"), F.lit("summary"), F.lit("body"))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("kind", "n")) - 1
    return rows.select("doc_id", F.get(names, F.col("kind")).alias("kind"), index.alias("chunk_index"), "text")


def metadata_chunk(title: Column, type_: Column, date: Column, tags: Column, actors: Column, identifiers: Column) -> Column:  # T9
    part = lambda name, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{name}: "), v))
    entries = F.array_join(F.transform(F.array_sort(F.map_entries(identifiers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
    return F.concat_ws("\n", part("Document", title), part("Type", type_), part("Date", date), part("Tags", F.array_join(tags, ", ")), part("People", F.array_join(F.transform(actors, lambda a: F.concat(a["name"], F.lit(" ("), a["role"], F.lit(")"))), ", ")), part("Identifiers", entries))


def summary_chunk(summary: Column, abstract: Column, claims: Column) -> Column:  # T9: null if there is nothing to sum up
    part = lambda name, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{name}: "), v))
    return F.nullif(F.concat_ws("\n\n", part("Summary", summary), part("Abstract", abstract), part("Claims", F.array_join(claims, "\n"))), F.lit(""))
