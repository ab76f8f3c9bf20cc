"""The token chunker against a plain loop, chunk by chunk; heading paths and folds in linear time."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import chunking as C
from quarryline.operators import sections as Z


def estimate(s):
    return -(-len(s) // 4)


def strip(s):
    return re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+\Z", "", s)


def tail(text, most):
    out, n = [], 0
    for s in reversed([x for x in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", text) if strip(x)]):
        if out and n + estimate(s) > most:
            break
        out.insert(0, s)
        n += estimate(s)
    return " ".join(out)


def plain(sections, least, most):
    """[(path, text, tokens)] by a loop over lines."""
    out, carried = [], int(most * 0.175)
    for path, content in sections:
        content = content or ""
        prose, code, inside = [], [], None
        for line in content.split("\n"):
            if strip(line).startswith("```"):
                if inside is None:
                    prose.append(f"[CODE_BLOCK_{len(code)}]")
                    inside = [strip(strip(line)[3:])]
                else:
                    code.append("```" + inside[0] + "\n" + "\n".join(inside[1:]) + "\n```")
                    inside = None
            elif inside is None:
                prose.append(line)
            else:
                inside.append(line)
        before = tail(out[-1][1], carried) if out and "[CODE_BLOCK_" not in out[-1][1] else ""
        lines, n = ([before], estimate(before)) if before else ([], 0)
        for line in prose:
            k = estimate(line + "\n")
            if n + k > most and n >= least:
                text = strip("\n".join(lines))
                if text:
                    out.append((path, text, n))
                before = tail(text, carried)
                lines, n = ([before], estimate(before)) if before else ([], 0)
            lines.append(line)
            n += k
        text = strip("\n".join(lines))
        if text:
            out.append((path, text, n))
        about = strip("\n".join(content.split("\n")[:3])[:200]) + "...\n\n"
        out += [(path, about + c, estimate(about + c)) for c in code]
    return out


def document(r, lines):
    words = ["alpha", "beta.", "gamma!", "delta?", "epsilon", "  ", "\t", "zeta. eta.", "```", "```py", "θ"]
    return "\n".join(" ".join(r.choice(words[:8] if r.random() < 0.96 else words) for _ in range(r.randint(0, 12))) for _ in range(lines))


def chunks(df, **more):
    out = {}
    for x in C.token_chunks(df, **more).collect():
        out.setdefault(x.doc_id, []).append((x.chunk_index, x.section_path, x.text, x.token_count))
    return {d: [y[1:] for y in sorted(v)] for d, v in out.items()}


SECTIONS = "doc_id long, sections array<struct<path:string,content:string>>"


@pytest.mark.parametrize(("least", "most"), [(800, 1200), (20, 60), (0, 10)])
def test_chunks_equal_a_plain_loop(spark, least, most):
    r = random.Random(least)
    docs = [(i, [(f"s{k}", document(r, r.choice([0, 1, 5, 60, 300]))) for k in range(r.randint(0, 4))]) for i in range(25)]
    docs += [(100, [("a", None), ("b", ""), ("c", "\n \n")]), (101, [("x", "```\nopen for ever")]), (102, [("x", "```py\n1\n```\n```\n2\n```")]), (103, [("y", "one long line. " * 900)]), (104, [])]
    got = chunks(spark.createDataFrame(docs, SECTIONS), least=least, most=most)
    assert got == {d: c for d, s in docs if (c := plain(s, least, most))}


def test_other_counters(spark):
    """The counter is any expression; here words."""
    df = spark.createDataFrame([(1, [("p", "\n".join(f"line {i} has five words" for i in range(100)))])], SECTIONS)
    got = chunks(df, least=10, most=40, count=lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")))
    assert len(got[1]) >= 13 and all(len(t.split()) == n for _, t, n in got[1])


def test_a_hundred_thousand_lines_in_seconds(spark):
    text = "\n".join(f"This is line {i} of a long text." for i in range(100_000))
    df = spark.createDataFrame([(1, [("long", text)])], SECTIONS)
    chunks(spark.createDataFrame([(1, [("warm", "up")])], SECTIONS))
    start = time.perf_counter()
    got = chunks(df)
    took = time.perf_counter() - start
    assert got[1] == plain([("long", text)], 800, 1200)
    assert took < 20


def paths(rows):
    """Paths by walking back from each heading."""
    out = []
    for k, (level, title) in enumerate(rows):
        path, now = [title], level
        for lv, t in reversed(rows[:k]):
            if lv < now:
                path.insert(0, t)
                now = lv
        if len(path) > 1 and rows[0][0] == min(lv for lv, _ in rows) and path[0] == rows[0][1]:
            path = path[1:]
        out.append(" > ".join(path))
    return out


def test_heading_paths(spark):
    r = random.Random(3)
    docs = [(i, [(r.randint(1, 6), f"t{r.randint(0, 5)}") for _ in range(r.choice([1, 2, 9, 40]))]) for i in range(40)]
    df = spark.createDataFrame([(i, "\n".join("#" * lv + " " + t for lv, t in d)) for i, d in docs], "doc_id long, text string")
    got = {}
    for x in Z.sections(df).collect():
        got.setdefault(x.doc_id, {})[x.section_no] = x.path
    assert {i: [p[k] for k in sorted(p)] for i, p in got.items()} == {i: paths(d) for i, d in docs}


def test_ten_thousand_headings_in_seconds(spark):
    text = "\n".join(f"{'#' * (1 + i % 6)} heading {i}\nbody {i}" for i in range(10_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.perf_counter()
    got = Z.sections(df).orderBy("section_no").collect()
    assert len(got) == 10_000 and got[-1].path == "heading 9996 > heading 9997 > heading 9998 > heading 9999"
    merged = spark.createDataFrame([(1, text)], "doc_id long, text string").select(F.size(C.sections_merged(Z.sections_of(F.col("text")))).alias("n")).first().n
    assert 0 < merged < 10_000
    assert time.perf_counter() - start < 30


def test_structure_rules_reach_the_chunker(spark):
    """A critical section isn't merged with its neighbours, so its chunk has its own path."""
    md = "# Paper\n## Abstract\nshort one\n## Notes\nsome\n## Methods\nours\n## Extra\nmore"
    df = spark.createDataFrame([(1, md)], "doc_id long, text string")
    plain_ = [x.section_path for x in C.document_chunks(df, structure=F.lit("generic")).orderBy("chunk_index").collect()]
    rules = [x.section_path for x in C.document_chunks(df, structure=F.lit("paper")).orderBy("chunk_index").collect()]
    assert plain_ == ["Paper"]
    assert {"Abstract", "Methods"} <= set(rules)


def test_page_normalisation(spark):
    """X20, X22 to X24 against loops over lines."""
    r = random.Random(8)
    line = lambda: r.choice(["", "- item", "Short line", "a line that goes on for much longer than fifty characters, so it may be joined with", "Ends here. " * 6, "and so on, still going on for a while and a while and a while, to be", "1. one", "def f(x):", " "])
    texts = ["\n".join(line() for _ in range(r.randint(0, 30))) for _ in range(60)] + [""]

    def rebuilt(text):
        ls, out, open_ = [strip(x) for x in text.split("\n")], [], []
        for i, x in enumerate(ls):
            if x == "":
                out += [" ".join(open_)] * bool(open_) + [""]
                open_ = []
                continue
            open_.append(x)
            if re.search(r"[.!?]\Z", x) or re.match("[A-Z0-9]", ls[i + 1] if i + 1 < len(ls) else "") or len(x) < 50:
                out.append(" ".join(open_))
                open_ = []
        return "\n".join(out + [" ".join(open_)] * bool(open_))

    def merged(blocks):
        out = []
        for b in blocks:
            if out and out[-1][0] == b[0] == "paragraph":
                out[-1] = ("paragraph", out[-1][1] + "\n\n" + b[1], out[-1][2], b[3])
            else:
                out.append(b)
        return out

    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for x in df.select("i", Z.rebuilt_paragraphs(F.col("text")).alias("p"), Z.blocks_of(F.col("text")).alias("b"), Z.merged_paragraphs(Z.blocks_of(F.col("text"))).alias("m"), Z.normalized_page(F.col("text")).alias("n")).collect():
        assert x.p == rebuilt(texts[x.i])
        assert [tuple(y) for y in x.m] == merged([tuple(y) for y in x.b])
        assert x.n.text == rebuilt(re.sub(r"([A-Za-z])-\n([A-Za-z])", r"\1\2", texts[x.i]))


def test_token_estimate_is_the_default():
    assert C.chunks_of.__defaults__[-1] is X.token_estimate
