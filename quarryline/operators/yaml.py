"""Nested YAML frontmatter in Columns (IO11, IO12): block maps and lists by indentation, block scalars, flow lists, quoting.

A block is read to entries (path, value) in order, with paths such as ``dates.created`` and
``actors[0].name``. One fold over its lines keeps the stack of open keys, which is as deep as the nesting.
Anchors, tags, flow maps and several documents aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.folds import bound, folded

_OPEN = "struct<indent:int,path:string,items:int>"
_ENTRY = "struct<path:string,value:string,style:string>"
_KEY = r"""^("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s"'#\-\[\]{},:][^:#]*?|-[^\s:][^:]*?)\s*:(?:\s+|\z)"""


def scalar(s: Column) -> Column:
    """A flow scalar's value: quotes and escapes go, a comment after a plain one, too; null and ~ are null."""
    plain = X.trimmed(F.regexp_replace(s, r"(^|\s)#.*\z", ""))
    double = F.replace(F.replace(F.replace(F.replace(F.regexp_extract(s, r'^"((?:[^"\\]|\\.)*)"', 1), F.lit("\\\\"), F.lit("\x00")), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\x00"), F.lit("\\"))
    single = F.replace(F.regexp_extract(s, r"^'((?:[^']|'')*)'", 1), F.lit("''"), F.lit("'"))
    return F.when(s.startswith('"'), double).when(s.startswith("'"), single).when(plain.isin("null", "~", ""), F.lit(None)).otherwise(plain)


def entries(block: Column) -> Column:
    """array<struct<path, value>> of a block, in order. Keys without anything below them have null."""
    lines = F.transform(F.split(block, "\n"), lambda x: bound(F.length(F.regexp_extract(x, "^ *", 0)), lambda n: F.struct(n.alias("indent"), F.regexp_replace(F.substr(x, n + 1), r"[\s]+\z", "").alias("text"), x.alias("raw"))))
    # "- key: v" is an item and, where its text stands, a key
    item = lambda x: x["text"].rlike(r"^-(\s|\z)")

    def unfolded(x: Column) -> Column:
        inner = F.regexp_extract(x["text"], r"^-\s*(.*)$", 1)
        at = x["indent"] + F.length(F.regexp_extract(x["text"], r"^-\s*", 0))
        part = lambda kind, n, t: F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("indent"), t.alias("text"), x["raw"].alias("raw"))
        deeper = F.when(inner.rlike(_KEY), F.array(part("item", x["indent"], F.lit("")), part("line", at, inner))).otherwise(F.array(part("item", x["indent"], inner)))
        return F.when(item(x), deeper).otherwise(F.array(part("line", x["indent"], x["text"])))

    def closed(a: Column, x: Column) -> Column:
        """The stack without what ends before x: keys as deep or deeper; an item ends what stands deeper, and a list's key may stand where its items do."""
        return F.filter(a["stack"], lambda s: F.when(x["kind"] == "item", (s["indent"] < x["indent"]) | ((s["indent"] == x["indent"]) & (s["items"] >= -1) & ~s["path"].rlike(r"\]\z"))).otherwise(s["indent"] < x["indent"]))

    top = lambda stack: F.get(stack, F.size(stack) - 1)
    path_of = lambda stack: F.coalesce(top(stack)["path"], F.lit(""))
    blank = lambda x: (x["text"] == "") & (x["kind"] == "line")
    in_scalar = lambda a, x: (a["style"] != "") & (blank(x) | (x["indent"] > a["block"]))
    skip = lambda x: blank(x) | x["text"].startswith("#")
    style_of = lambda v: F.regexp_extract(v, r"^([|>])[-+]?\s*(?:#.*)?\z", 1)

    def parsed(a: Column, x: Column, f) -> Column:
        """f(stack with this line's key on it, its path, its value as written)."""
        key = F.regexp_extract(x["text"], _KEY, 1)
        value = F.when(x["kind"] == "item", x["text"]).otherwise(F.regexp_replace(x["text"], _KEY, ""))

        def with_stack(stack: Column) -> Column:
            above = path_of(stack)
            n = F.coalesce(top(stack)["items"], F.lit(-1)) + 1
            path = F.when(x["kind"] == "item", F.concat(above, F.lit("["), n.cast("string"), F.lit("]"))).when(above == "", scalar(key)).otherwise(F.concat(above, F.lit("."), scalar(key)))
            counted = F.when((x["kind"] == "item") & (F.size(stack) > 0), F.concat(F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0))), F.array(F.struct(top(stack)["indent"].alias("indent"), above.alias("path"), n.alias("items"))))).otherwise(stack)
            return bound(path, lambda p: f(F.concat(counted, F.array(F.struct(x["indent"].alias("indent"), p.alias("path"), F.lit(-1).alias("items")))), p, value))

        return bound(closed(a, x), with_stack)

    def step(a: Column, x: Column, _: Column) -> Column:
        kept = F.struct(a["stack"].alias("stack"), a["style"].alias("style"), a["block"].alias("block"))
        plain = F.struct(a["stack"].alias("stack"), F.lit("").alias("style"), F.lit(0).alias("block"))
        new = parsed(a, x, lambda stack, path, v: F.struct(stack.alias("stack"), style_of(v).alias("style"), x["indent"].alias("block")))
        return F.when(in_scalar(a, x), kept).when(skip(x), plain).otherwise(new)

    def out(a: Column, x: Column, _: Column) -> Column:
        entry = lambda p, v, s: F.struct(p.alias("path"), v.alias("value"), s.alias("style"))
        nothing = F.array().cast(f"array<{_ENTRY}>")
        more = F.array(entry(path_of(a["stack"]), x["raw"], a["style"]))

        def of(stack: Column, path: Column, v: Column) -> Column:
            flow = F.regexp_extract_all(F.regexp_extract(v, r"^\[(.*)\]", 1), F.lit(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,]+)\s*(?:,|\z)"""), F.lit(1))
            listed = F.transform(flow, lambda e, i: entry(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), scalar(X.trimmed(e)), F.lit("")))
            return F.when(style_of(v) != "", nothing).when(v.startswith("["), listed).when((v == "") & (x["kind"] == "item"), nothing).otherwise(F.array(entry(path, scalar(v), F.lit(""))))

        return F.when(in_scalar(a, x), more).when(skip(x), nothing).otherwise(parsed(a, x, of))

    zero = F.struct(F.array().cast(f"array<{_OPEN}>").alias("stack"), F.lit("").alias("style"), F.lit(0).alias("block"))
    every = folded(F.flatten(F.transform(lines, unfolded)), zero, step, out, _ENTRY)

    def grouped(es: Column) -> Column:
        """A block scalar's lines as one value; a key that others go below is none itself."""
        starts = F.filter(F.transform(es, lambda e, i: F.when((e["style"] == "") | (i == 0) | (F.get(es, i - 1)["path"] != e["path"]) | (F.get(es, i - 1)["style"] == ""), i)), lambda i: i.isNotNull())

        def one(at: Column, i: Column, k: Column) -> Column:
            n = F.coalesce(F.get(at, k + 1), F.size(es)) - i
            first = F.get(es, i)
            indent = F.length(F.regexp_extract(first["value"], "^ *", 0))
            ls = F.transform(F.slice(es, i + 1, n), lambda e: F.substr(e["value"], indent + 1))
            text = F.regexp_replace(F.when(first["style"] == "|", F.array_join(ls, "\n")).otherwise(F.array_join(ls, " ")), r"\s+\z", "")
            return F.struct(first["path"].alias("path"), F.when(first["style"] == "", first["value"]).otherwise(text).alias("value"))

        return bound(starts, lambda at: F.transform(at, lambda i, k: one(at, i, k)))

    below = lambda es: F.filter(es, lambda e, i: e["value"].isNotNull() | ~F.coalesce(F.get(es, i + 1)["path"].startswith(F.concat(e["path"], F.lit("."))) | F.get(es, i + 1)["path"].startswith(F.concat(e["path"], F.lit("["))), F.lit(False)))
    return bound(bound(every, grouped), below)


def field(es: Column, path: str) -> Column:
    """The value at a path; the last one, where a key comes twice."""
    return F.try_element_at(F.transform(F.filter(es, lambda e: e["path"] == path), lambda e: e["value"]), F.lit(-1))


def listed(es: Column, path: str) -> Column:
    """The values of a list of scalars, in order."""
    return F.transform(F.filter(es, lambda e: e["path"].rlike(rf"^{path}\[\d+\]\z")), lambda e: e["value"])


def mapped(es: Column, path: str) -> Column:
    """array<struct<key, value>> of a map of scalars, in order; keys without a value are left out."""
    mine = F.filter(es, lambda e: e["path"].startswith(f"{path}.") & e["value"].isNotNull())
    return F.transform(mine, lambda e: F.struct(F.substring(e["path"], len(path) + 2, 2147483647).alias("key"), e["value"].alias("value")))


# --- writing -------------------------------------------------------------------------------------

#: The order of structured dates.
DATES = ("created", "published", "updated")


def _quoted(s: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" ")), F.lit('"'))


def written_front(meta: Column) -> Column:  # IO12
    """A frontmatter block of struct(id, title, type, dates: array<struct<key, value>>, date, identifiers: same, source_url, personas: array, summary, license).

    Structured dates and identifiers are preferred to the single ones; empty fields are left out.
    """
    text = lambda c: F.coalesce(c, F.lit("")) != ""
    line = lambda name, c: F.when(text(c), F.concat(F.lit(f"{name}: "), c))
    pair = lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), _quoted(e["value"]))
    title = F.when(F.length(meta["title"]) > 200, F.concat(F.substring(meta["title"], 1, 197), F.lit("..."))).otherwise(meta["title"])
    named = lambda n: F.filter(meta["dates"], lambda e: (e["key"] == n) & text(e["value"]))
    dates = F.flatten(F.array(*(F.transform(named(n), pair) for n in DATES)))
    ids = F.transform(F.filter(meta["identifiers"], lambda e: text(e["value"])), pair)
    below = lambda name, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"{name}:\n"), F.array_join(xs, "\n")))
    return F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("id: "), meta["id"]), F.concat(F.lit("title: "), _quoted(title)), line("type", meta["type"]), F.coalesce(below("dates", dates), line("date", meta["date"])),
        F.coalesce(below("identifiers", ids), line("source_url", meta["source_url"])), F.concat(F.lit("personas: ["), F.array_join(meta["personas"], ", "), F.lit("]")),
        F.when(text(meta["summary"]), F.concat(F.lit("summary: "), _quoted(meta["summary"]))), line("license", meta["license"]), F.lit("---"), F.lit(""),
    )


def read_front(md: Column) -> Column:  # IO11
    """What ``written_front`` takes, from a document's frontmatter."""

    def of(es: Column) -> Column:
        scalars = [field(es, n).alias(n) for n in ("id", "title", "type")]
        return F.struct(*scalars, mapped(es, "dates").alias("dates"), field(es, "date").alias("date"), mapped(es, "identifiers").alias("identifiers"), field(es, "source_url").alias("source_url"), listed(es, "personas").alias("personas"), field(es, "summary").alias("summary"), field(es, "license").alias("license"))

    return bound(entries(X.frontmatter_block(md)), of)
