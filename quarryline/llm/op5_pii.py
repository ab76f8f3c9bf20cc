"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Fixed patterns find emails, IP addresses, card and phone numbers, and credentials of a few public
formats (kind ``secret``). These are the seeds. The words around them are lexical patterns: two or three
words before, the word before and the word after, or the one word before if it ends in a sign such as a
colon, or if the seed's word begins with one such as a quotation mark; words are lower-cased and their
numbers are all alike. What stands in the patterns of at least SUPPORT different seeds is counted over all
texts, with digits or without; patterns of which seeds fill less than FLOOR of the places aren't looked at
further. A pattern is as sure as the share of its different fillers that are believed. A filler is believed as the surest pattern
before it and the surest pattern around it allow (noisy-or of the two), and a few rounds of this over the
pattern-instance graph leave sure patterns. What stands in them is reported as kind ``id``, word by word
and without signs at its ends: of an identifier of several words, those that stand in a sure pattern
themselves.

Patterns and fillers are known by 64-bit hashes. A table of _BITS places, whatever the corpus, keeps most
words that stand in no pattern out of the join that tells the patterns apart.

Defined results: a null text is empty and has no spans; repeated rows get the same spans; null
doc_ids are kept; an empty table gives none; offsets are code points, ends exclusive. Other columns,
of any name, pass through ``personal_data``, but for those named like its results, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from .shared import boxed, quoted, spread, written

#: Kinds in the order in which they are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "secret", "id")
BASE = 4
SUPPORT, FLOOR, SURE, ROUNDS = 3, 0.2, 0.8, 3
# Possessive repeats and the look-behinds keep the search linear on long runs. They don't change what
# matches: a match that can't begin where its run begins can't begin later in that run either, unless
# the match before ended inside the run (\G).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    # fixed values: formats of public credentials (access key ids, personal access tokens, hexadecimal keys)
    "secret": r"(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|[0-9a-f]{32}(?:[0-9a-f]{8})?(?:[0-9a-f]{24})?)(?![A-Za-z0-9])",
}
#: Words of a text that one row holds while they are looked at.
SLICE = 500
#: Steps of a running sum that are added up at once.
STRIDE = 512
#: Characters in one block of a text, so that a place in it is found without a walk from the beginning.
BLOCK = 1000
#: Stands for each character of a seed; none that is interchanged.
MARK = "\uffff"
_GUARDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]", "secret": r"A[KS]IA[0-9A-Z]|gh[opsu]_|[0-9a-f]{32}"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_SIGNS = "\"'(<[{=:#"
_LEAD, _TRAIL = "[\"'(<\\[{=:#]", "[.,;:!?)\\]}>\"']"
_SPAN = "array<struct<s:bigint,k:int,e:bigint>>"


def running(values: Column, zero: Column, join: Callable[[Column, Column], Column], f: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """f(at), where at(i) joins the first i values: the strides before are joined beforehand, so at(i) costs a stride at most."""
    over = lambda xs, start: F.aggregate(xs, start, join)
    strides = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / STRIDE).cast("int")), lambda b: over(F.slice(v, b * STRIDE + 1, STRIDE), zero))
    before = lambda t: F.transform(F.sequence(F.lit(0), F.size(t)), lambda b: over(F.slice(t, F.lit(1), b), zero))

    def at(v: Column, p: Column) -> Callable[[Column], Column]:
        return lambda i: over(F.slice(v, F.floor(i / STRIDE).cast("int") * STRIDE + 1, (i % STRIDE).cast("int")), F.get(p, F.floor(i / STRIDE).cast("int")))

    return let(values, lambda v: let(let(strides(v), before), lambda p: f(at(v, p))))


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}+"), F.lit(0))


def _cut(blocks: Column, s: Column, e: Column) -> Column:
    """The characters from s to e of the text in blocks."""
    first = F.floor(s / BLOCK).cast("int")
    some = F.array_join(F.slice(blocks, first + 1, F.floor(e / BLOCK).cast("int") - first + 1), "")
    return F.when(e > s, F.substring(some, (s - first * BLOCK + 1).cast("int"), (e - s).cast("int"))).otherwise("")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))),
        F.lit(0),
        lambda a, i: a + F.when(i % 2 == 1, F.coalesce(d.substr(i, F.lit(1)).try_cast("int"), F.lit(0))).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.coalesce(d.substr(i, F.lit(1)).try_cast("int"), F.lit(0)) + 1)),
    )
    return F.when(F.length(d).between(12, 19), total % 10 == 0).otherwise(F.lit(False))


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
    "secret": lambda m: ~m.rlike("^[0-9]+$"),
}


def _spans_of(text: Column, kind: str) -> Column:
    """array<struct<s, k, e>> of the valid matches of one kind, in their order."""
    k = KINDS.index(kind)
    none = F.array().cast(_SPAN)
    gaps = lambda: F.transform(F.split(text, PATTERNS[kind], -1), lambda g: F.length(g).cast("bigint"))

    def placed(m: Column) -> Column:
        sizes = F.zip_with(gaps(), m, lambda g, x: F.coalesce(g, F.lit(0)) + F.coalesce(F.length(x), F.lit(0)).cast("bigint"))
        ends = running(sizes, F.lit(0).cast("bigint"), lambda a, b: a + b, lambda at: F.transform(m, lambda x, i: F.when(_VALID[kind](x), F.struct((at(i + 1) - F.length(x)).alias("s"), F.lit(k).alias("k"), at(i + 1).alias("e")))))
        return F.when(F.size(m) > 0, F.array_compact(ends)).otherwise(none)

    may = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(_GUARDS[kind])
    return F.coalesce(F.when(may, let(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), placed)), none)


def scanned(documents: DataFrame, text: str = "text") -> DataFrame:
    """(id, doc: the row itself, text without null, seeds: spans by start, then kind)."""
    whole = boxed(spread(documents), []).withColumn("text", F.coalesce(F.col("doc").getField(text), F.lit("")))
    each = whole.select("doc", "text", *(_spans_of(F.col("text"), kind).alias(kind) for kind in PATTERNS))
    return each.select(F.monotonically_increasing_id().alias("id"), "doc", F.array_sort(F.concat(*PATTERNS)).alias("seeds"))


def _open_ends(spans: Column, f: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """f(at), where at(i) is the greatest end of the first i spans."""
    return running(F.transform(spans, lambda x: x["e"]), F.lit(0).cast("bigint"), lambda a, b: F.greatest(a, b), f)


def replaced(text: Column, spans: Column, what: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """The text with what(blocks, span, from, part of an earlier one) in the place of each span; spans are sorted by start."""

    def of(b: Column) -> Column:
        def pieces(at: Callable[[Column], Column]) -> Column:
            one = F.transform(spans, lambda x, i: let(at(i), lambda m: F.concat(_cut(b, m, x["s"]), what(b, x, F.greatest(m, x["s"]), x["s"] < m))))
            return F.concat(F.array_join(one, ""), _cut(b, at(F.size(spans)), F.length(text).cast("bigint")))

        return _open_ends(spans, pieces)

    return F.when(F.size(spans) > 0, let(_blocks(text), of)).otherwise(text)


def _blotted(text: Column, seeds: Column) -> Column:
    """The text with the non-space characters of seeds replaced by MARK: words keep their places."""
    clean = F.when(F.contains(text, F.lit(MARK)), F.replace(text, F.lit(MARK), F.lit("?"))).otherwise(text)
    return let(clean, lambda t: replaced(t, seeds, lambda b, x, a, _: F.when(x["e"] > a, F.regexp_replace(_cut(b, a, x["e"]), r"\S", MARK)).otherwise("")))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by <KIND>; where spans overlap, the one that begins first is named and all they cover goes."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    return replaced(text, spans, lambda b, x, a, inside: F.when(inside, "").otherwise(F.element_at(names, x["k"] + 1)))


def _words(seen: DataFrame, original: bool = False) -> DataFrame:
    """(id, i, w, far, mid, near, next): each word of the marked text in lower case, and the words around it with their numbers alike.

    Texts go in slices of SLICE words, so no row carries a whole text for each of its words. With
    original, also the word and the three after it as they were, and whether they belong to one seed.
    """
    cut = lambda t: F.regexp_extract_all(t, F.lit(rf"\S++(?:\s++\S++){{0,{SLICE - 1}}}+"), F.lit(0))
    split = lambda t: F.split(t, r"\s+")
    tail = lambda b: F.reverse(F.regexp_extract(F.reverse(b), r"^\S++(?:\s++\S++){0,2}+", 0))
    part = lambda bs: F.transform(bs, lambda b, k: F.struct(b.alias("here"), F.coalesce(tail(F.get(bs, k - 1)), F.lit("")).alias("before"), F.coalesce(F.regexp_extract(F.get(bs, k + 1), r"^\S++", 0), F.lit("")).alias("after")))
    rows = seen.select("id", F.posexplode(let(cut(F.lower(_blotted(F.col("text"), F.col("seeds")))), part)).alias("k", "x"), *([cut(F.lower("text")).alias("o")] if original else []))
    alike = lambda t: let(F.regexp_replace(t, "[0-9]+", "0"), lambda x: F.when(F.contains(x, F.lit(MARK)), F.regexp_replace(x, f"{MARK}+", MARK)).otherwise(x))
    none = F.array().cast("array<string>")
    before = let(F.when(F.col("x.before") != "", split(alike(F.col("x.before")))).otherwise(none), lambda b: F.concat(F.array_repeat(F.lit(""), F.lit(3) - F.size(b)), b))
    around = F.concat(before, split(alike(F.col("x.here"))), F.array(alike(F.col("x.after"))))
    names = ["w", "far", "mid", "near", "next"]
    from_ = lambda c, n: F.slice(c, n, SLICE + 9)
    columns = ["id", "k", split(F.col("x.here")).alias("w"), around.alias("c")]
    if original:
        columns.append(split(F.get("o", F.col("k"))).alias("o"))
    flat = rows.select(*columns)
    zipped = [F.col("w"), F.col("c"), from_("c", 2), from_("c", 3), from_("c", 5)]
    if original:
        names += [f"w{n}" for n in (1, 2, 3)] + [f"o{n}" for n in range(4)]
        zipped += [from_("w", n + 1) for n in (1, 2, 3)] + [from_("o", n + 1) for n in range(4)]
    each = flat.select("id", "k", F.posexplode(F.arrays_zip(*(c.alias(n) for c, n in zip(zipped, names, strict=True)))).alias("j", "x"))
    return each.where("x.w is not null").select("id", (F.col("k") * SLICE + F.col("j")).alias("i"), "x.*")


def _patterns() -> tuple[Column, ...]:
    """Hashes of the patterns that a word of ``_words`` stands in; null where there is none."""
    sign = lambda c: F.instr(F.lit(_SIGNS), c) > 0
    lead = F.when(sign(F.substring("w", 1, 1)), F.regexp_extract("w", f"^{_LEAD}+", 0)).otherwise("")
    near = F.col("near") != ""
    return (
        F.when(near & (sign(F.substring("w", 1, 1)) | sign(F.substring("near", -1, 1))), F.xxhash64(F.lit(1), "near", lead)),
        F.when(F.col("mid") != "", F.xxhash64(F.lit(2), "mid", "near", lead)),
        F.when(F.col("far") != "", F.xxhash64(F.lit(3), "far", "mid", "near", lead)),
        F.when(near & (F.col("next") != ""), F.xxhash64(F.lit(4), "near", lead, "next")),
    )


def _core(word: Column) -> Column:
    return F.regexp_replace(word, f"^{_LEAD}+|{_TRAIL}+$", "")


def _placed() -> Column:
    return F.filter(F.array(*(F.struct(h.alias("pattern"), F.lit(k == 3).alias("around")) for k, h in enumerate(_patterns()))), lambda x: x["pattern"].isNotNull())


def _seeds(seen: DataFrame) -> DataFrame:
    """(pattern, around, value, places): each seed under the patterns around it, and how often; a seed is known by its first four words."""
    marked = lambda c: F.coalesce(F.contains(c, F.lit(MARK)), F.lit(False))
    w = _words(seen.where("size(seeds) > 0"), original=True).where(marked("w") & ~marked("near"))
    more, on = [F.col("o0")], F.lit(True)
    for n in (1, 2, 3):
        on = on & marked(f"w{n}")
        more.append(F.when(on, F.col(f"o{n}")).otherwise(""))
    next_ = F.when(marked("w1"), "").otherwise(F.col("next"))
    w = w.withColumn("value", F.xxhash64(_core(F.concat(*more)))).withColumn("next", next_)
    return w.select("value", F.explode(_placed()).alias("x")).groupBy("x.pattern", "x.around", "value").agg(F.count("*").alias("places"))


#: Places in the table that tells most words apart from those in a pattern.
_BITS = 1 << 15


def _filter_of(patterns: DataFrame) -> Callable[[Column], Column]:
    """A test of a pattern's hash that no pattern of the table fails, and most others do: a table of _BITS places, of which those that a pattern falls on are gathered."""
    at = F.col("pattern").bitwiseAND(F.lit(_BITS - 1)).cast("int")
    held = bytearray(_BITS)
    for r in patterns.select(at.alias("at")).groupBy(F.shiftright("at", 10)).agg(F.collect_set("at").alias("places")).toLocalIterator():
        for x in r["places"]:
            held[x] = 1
    table, one = F.lit(held), F.lit(bytearray([1]))  # a byte a place: found without a walk, and short in a plan
    return lambda h: F.substring(table, h.bitwiseAND(F.lit(_BITS - 1)).cast("int") + 1, F.lit(1)) == one


def _fillers(seen: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, value, id, i) of each word that belongs to no seed and stands in one of the patterns, and of others that the table lets pass."""
    may = _filter_of(patterns)
    # one row for each word and pattern first, then the filter: four tests of four hashes in one are more than the JVM compiles
    rows = _words(seen).select("id", "i", "w", F.explode(F.array(*_patterns())).alias("pattern"))
    rows = rows.where(may(F.col("pattern")) & ~F.contains("w", F.lit(MARK))).withColumn("core", _core(F.col("w"))).where("core <> ''")
    return rows.select("pattern", F.xxhash64("core").alias("value"), "id", "i")


_SALTS = 32


def _with(graph: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """graph joined with side, one row for each key there; a key's rows are dealt over salts."""
    salted = graph.withColumn("salt", F.pmod(F.xxhash64("pattern", "value"), F.lit(_SALTS)).cast("int"))
    every = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return salted.join(every, [key, "salt"]).drop("salt")


def discovered(seen: DataFrame, rounds: int = ROUNDS, sure: float = SURE, support: int = SUPPORT, floor: float = FLOOR) -> DataFrame:
    """(id, i) of the words that sure patterns reveal. seen: id, text, seeds; a written table."""
    seeds = written(_seeds(seen), "pii-seeds")
    strong = written(seeds.groupBy("pattern", "around").agg(F.count("*").alias("seeds"), F.sum("places").alias("places")).where(F.col("seeds") >= support), "pii-patterns")
    # counted before they are joined: a common pattern's places never leave their task
    counts = _fillers(seen, strong).groupBy("pattern").agg(F.count("*").alias("n"))
    live = written(strong.join(counts, "pattern").where(F.col("places") >= floor * (F.col("places") + F.col("n"))), "pii-live")
    mine = live.select("pattern", "around")
    places = written(_fillers(seen, live).join(live.select("pattern"), "pattern"), "pii-places")
    known = seeds.join(mine.drop("around"), "pattern").select("pattern", "value", F.lit(True).alias("seed"))
    graph = known.unionByName(places.select("pattern", "value").join(mine.drop("around"), "pattern").select("pattern", "value", F.lit(False).alias("seed")))
    graph = written(graph.groupBy("pattern", "value").agg(F.max("seed").alias("seed")).join(mine, "pattern"), "pii-graph")
    belief = written(graph.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("b")), "pii-belief")
    share = (F.sum(F.when(F.col("b") >= sure, F.col("b")).otherwise(0.0)) / (F.count("*") + 0.5)).alias("c")
    for _ in range(rounds):
        trust = _with(graph, belief, "value").groupBy("pattern").agg(share).where("c > 0.5")
        best = lambda on: F.coalesce(F.max(F.when(on, F.col("c"))), F.lit(0.0))
        raised = _with(graph, trust, "pattern").groupBy("value").agg((1 - (1 - best(F.col("around"))) * (1 - best(~F.col("around")))).alias("r"))
        belief = written(belief.join(raised, "value", "left").select("value", F.greatest("b", F.coalesce("r", F.lit(0.0))).alias("b")), "pii-belief")
    trust = _with(graph, belief, "value").groupBy("pattern").agg(share).where(F.col("c") >= sure)
    good = _with(graph.where("not seed"), trust, "pattern").join(belief.where(F.col("b") >= sure), "value").select("pattern", "value")
    return places.join(good, ["pattern", "value"]).select("id", "i").distinct()


def _revealed(text: Column, more: Column) -> Column:
    """array<struct<s, k, e>> of the words listed by place in more."""
    lead = F.length(F.regexp_extract(text, r"^\s*+", 0)).cast("bigint")

    def of(units: Column) -> Column:
        def spans(at: Callable[[Column], Column]) -> Column:
            def span(i: Column) -> Column:
                word = F.get(units, i)
                start = lead + at(i) + F.length(F.regexp_extract(word, f"^{_LEAD}*+", 0))
                return F.struct(start.alias("s"), F.lit(KINDS.index("id")).alias("k"), (start + F.length(_core(F.regexp_replace(word, r"\s+\z", "")))).alias("e"))

            return F.transform(more, span)

        return running(F.transform(units, lambda u: F.length(u).cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a + b, spans)

    return F.when(more.isNotNull(), let(F.regexp_extract_all(text, F.lit(r"\S++\s*+"), F.lit(0)), of)).otherwise(F.array()).cast(_SPAN)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def personal_data(documents: DataFrame, text: str = "text", rounds: int = ROUNDS, sure: float = SURE, support: int = SUPPORT, floor: float = FLOOR) -> DataFrame:
    """documents with base and spans (array<struct<s, k, e>>, k the place in KINDS) added: the contract's spans, and all."""
    docs = documents.select([F.col(quoted(c)) for c in documents.columns if c.lower() not in ("base", "spans")])
    seen = written(scanned(docs, text), "pii")  # the ids are settled by writing them
    seen = seen.withColumn("text", F.coalesce(F.col("doc").getField(text), F.lit("")))
    hits = discovered(seen.select("id", "text", "seeds"), rounds, sure, support, floor)
    more = hits.groupBy("id").agg(F.array_sort(F.collect_list("i")).alias("more"))
    base = F.filter("seeds", lambda x: x["k"] < BASE)
    out = seen.join(more, "id", "left").select("doc", base.alias("base"), F.array_sort(F.concat("seeds", _revealed(F.col("text"), F.col("more")))).alias("spans"))
    return out.select("doc.*", "base", "spans")


def _count(k: int) -> Column:
    return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *(_count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:BASE])),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )
