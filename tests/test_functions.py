"""Text functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from quarryline.functions import text as X


@pytest.fixture(scope="module")
def one(spark):
    def run(column, **values):
        return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("r")).first().r

    return run


CASES = [
    (X.tokens, "Hello, World-wide  x_1", ["hello", "world", "wide", "x_1"]),
    (X.sentences, "One. Two!? three", ["One", "Two", "three"]),
    (X.sentences_with_marks, "One. Two! three", ["One.", "Two!", "three"]),
    (X.citation_ids, "a [^doc_1:x] [^doc:y] [^doc_2:A > B]", ["doc_1:x", "doc_2:A > B"]),
    (X.context_text, "[Reference: ^doc_1:x]\nDocument: D\n---\nbody\n", "body"),
    (X.normalize_markdown, "a\r\n# H\nb\n* x\n```SQL\nq\n```\n", "a\n\n# H\n\nb\n- x\n```sql\nq\n```\n"),
    (X.clean_extracted, "inter-\nnal  text\n\n3\n", "internal text 3"),
    (X.html_block_text, "<p>a &amp; b</p><ul><li>x<br/>y</ul><script>z</script>", "a & b\n\n\n- x\ny".replace("\n\n\n", "\n\n")),
    (X.html_file_text, "<b>a</b>&lt;i&gt;c<style>p{}</style>", "a c"),
    (X.strip_frontmatter, "---\na: 1\n---\nbody\n---\nx", "body\n---\nx"),
    (X.join_hyphenated, "autostereo-\nscopic", "autostereoscopic"),
    (X.slug, "/a/b/My File.v2.md", "my-file-v2"),
    (X.persona_from_path, "/x/personas/david/RAG/a.md", "david"),
    (X.title_of, "intro\n# The Title \nx", "The Title"),
    (X.title_of, "\n## no\nfirst line", "first line"),
    (X.domain, "https://WWW.Example.com:80/x?y", "example.com"),
    (X.section_anchor, "Introduction > Background", "#introduction-background"),
    (X.strip_mentions, "<@U123> hello", "hello"),
    (X.latex_delimiters, r"\(x\) and \[y\]", "$x$ and \n$$\ny\n$$\n"),
    (X.conversation_title, "First part. Second", "First part"),
    (X.conversation_title, ".x", "New conversation"),
    (X.token_estimate, "abcde", 2),
    (X.iso_date, "21 Jan 2025", "2025-01-21"),
    (X.iso_date, "Mar. 22, 2022", "2022-03-22"),
    (X.json_in, 'x ```{"a": 1,}``` y', '{"a": 1}'),
    (X.slack_markdown, "# H\n**b** [^d:x] [^e:y] [^d:x]\n> q", "_H_\n_b_ [1] [2] [1]\n    q"),
    (X.patent_of_filename, "us10838134b2.pdf", "US10838134B2"),
    (X.line_type, "1. Intro", "heading"),
    (X.line_type, "- item", "list"),
    (X.line_type, "a | b", "table"),
    (X.line_type, "def f", "code"),
    (X.line_type, "plain words", "paragraph"),
]


@pytest.mark.parametrize(("f", "given", "want"), CASES, ids=[f"{f.__name__}-{i}" for i, (f, _, _) in enumerate(CASES)])
def test_function(one, f, given, want):
    assert one(f(F.col("x")), x=given) == want


@pytest.mark.parametrize(("q", "want"), [("hello", True), ("what is 2+2", True), ("how do I resolve this error", True), ("What is DLB technology?", False), ("short", True)])
def test_off_topic(one, q, want):
    assert one(X.is_off_topic(F.col("x")), x=q) is want


@pytest.mark.parametrize("q", ["How does it improve brightness?", "What about power consumption?", "What is DLB technology?"])
def test_reformulation(one, q):
    assert one(X.needs_reformulation(F.col("x"), F.lit(True)), x=q) is True
    assert one(X.needs_reformulation(F.col("x"), F.lit(False)), x=q) is False


@pytest.mark.parametrize(("u", "kind", "ident"), [("US10838134B2", "patent", "US10838134B2"), ("arxiv:2405.10314", "arxiv", "2405.10314"), ("2405.10314", "arxiv", "2405.10314"), ("https://patents.google.com/patent/US1B2/en", "patent", "US1B2"), ("https://x.org", "generic", None)])
def test_routing(one, u, kind, ident):
    r = one(X.url_analysis(F.col("x")), x=u)
    assert (r.type, r.identifier) == (kind, ident)


def test_ngrams(one):
    assert one(X.ngrams(X.tokens(F.col("x")), 3), x="a b") == []
    assert one(X.ngram_containment(X.ngrams(X.tokens(F.col("x"))), X.ngrams(X.tokens(F.col("y")))), x="a b c d", y="z a b c") == 0.5


def test_factual_density(one):
    d = one(X.factual_density(F.col("x")), x="The Lens has 3 parts [^doc_1:a]. generally fine. Is It? Acme made it.")
    assert (d.total, d.factual, d.cited) == (4, 3, 1)  # an opening that makes no claim is not factual


def test_round_half_up(one):
    assert one(X.round_half_up(F.col("x"), 2), x=0.285) == 0.28


def test_formatters_and_validators(spark):
    from pyspark.sql import functions as F

    from quarryline.operators import extract as E

    none = F.lit(None).cast("string")
    r = spark.range(1).select(
        E.arxiv_article(F.lit("T"), F.array(F.lit("A"), F.lit("B")), F.lit("2401.1"), none, F.lit("abs"), F.lit("body")).alias("a"), E.arxiv_article(F.lit("T"), F.array().cast("array<string>"), none, none, none, F.lit("")).alias("b"),
        E.raw_article(F.lit("T"), F.lit("plain")).alias("c"), E.raw_article(F.lit("T"), F.lit("# Own\n\nx")).alias("d"),
        E.assembled_problems(F.lit('---\nid: x\ntitle: "T"\npersonas: [a]\n---\n# H\n')).alias("good"), E.assembled_problems(F.lit('---\nid:\ntitle: ""\npersonas: []\n---\n')).alias("bad"), E.assembled_problems(F.lit("text")).alias("none"),
        E.upload_problems(F.lit("a.md"), F.lit(5)).alias("u"), E.upload_problems(F.lit("a\nb.exe"), F.lit(0)).alias("v"), E.upload_problems(F.lit("a.PDF"), F.lit(99), 10).alias("w"),
    ).first()
    assert r.a == "# T\n\n**Authors**: A, B\n**arXiv**: 2401.1\n\n## Abstract\n\nabs\n\nbody" and r.b == "# T"
    assert r.c == "# T\n\nplain\n" and r.d == "# Own\n\nx\n"
    assert r.good == [] and r.bad == ["no id", "no title", "no personas", "no body"] and r.none == ["no frontmatter", "no heading"]
    assert r.u == [] and r.v == ["unknown file type", "empty file", "control characters in the name"] and r.w == ["file too large"]


def test_long_pages_in_windows(spark):
    """Each claim once; header and abstract in the first window; description parts whole and in order."""
    from pyspark.sql import functions as F

    from quarryline.operators import extract as E

    parts = [f"<heading>H{i}</heading>" + f"text {i} " * (40 + i) for i in range(60)]
    front = '<meta name="DC.title" content="T"><section itemprop="abstract"><div>A</div></section><section '
    claims = '</section><section itemprop="claims">' + "".join(f'<div class="claim" num="{i}">c{i}</div>' for i in range(9)) + "</section>"
    html = front + 'itemprop="description">' + "".join(parts) + claims
    w = spark.createDataFrame([(html,), (html[:1000],)], "h string").select(E.html_windows(F.col("h"), 3000, 100).alias("w")).collect()
    windows = w[0].w
    assert windows[0] == front + "" and w[1].w == [html[:1000]]
    assert "".join(x[100:] for x in windows[1:-1]) == 'itemprop="description">' + "".join(parts[:-1])  # text after the last heading is lost
    assert all(x.startswith(html[:100]) and len(x) <= 3100 for x in windows[1:-1]) and len(windows) > 8
    assert [sum(f">c{i}<" in x for x in windows) for i in range(9)] == [1] * 9 and windows[-1].startswith(html[:100])


def test_patent_html_article(spark):
    from quarryline.operators import extract as E

    html = (
        '<meta name="DC.title" content="A Lamp"><meta name="DC.contributor" scheme="inventor" content="Ann Lee"><dd itemprop="assigneeCurrent">Acme</dd><dd itemprop="assigneeOriginal">Acme</dd>'
        '<time itemprop="grantDate" datetime="2021-05-06">x</time><section itemprop="abstract"><div>It shines. It lasts.</div></section><heading>SUMMARY</heading><p>Short.</p><heading>DETAILED DESCRIPTION</heading><p>Long.</p>'
        '<heading>BRIEF DESCRIPTION OF THE DRAWINGS</heading><div class="description-paragraph"><figref>FIG. 1</figref> a lamp</div><div id="CLM-1" num="1" class="claim"><div>1. A lamp.</div></div>'
    )
    df = spark.createDataFrame([(1, html), (2, ""), (3, None)], "id int, html string")
    h, people, words = F.col("html"), F.array(F.lit("p")), F.array(F.lit("lamp"), F.lit("light"))
    found = lambda *more: E.patent_html_article(F.lit("US1234567B2"), E.patent_parts(h), E.patent_metadata(h), E.drawings(h), E.claims(h), people, *more)
    got = {r.id: r for r in df.select("id", found().alias("plain"), found(F.lit("About lamps."), words, F.array().cast("array<string>")).alias("known")).collect()}
    assert got[1].plain == (
        '---\nid: us1234567b2\ntitle: A Lamp\ntype: patent\npersonas: [p]\nsummary: It shines\nidentifiers:\n  patent_number: "US1234567B2"\ndates:\n  granted: "2021-05-06"\n'
        'actors:\n  - name: "Ann Lee"\n    role: "inventor"\n  - name: "Acme"\n    role: "current_assignee"\n  - name: "Acme"\n    role: "original_assignee"\n---\n\n'
        "# A Lamp\n\n**Patent Number**: US1234567B2  \n**Inventors**: Ann Lee  \n**Current Assignee**: Acme  \n**Grant Date**: 2021-05-06\n\n## Abstract\n\n\nIt shines. It lasts.\n\n"
        "## Summary of the Invention\n\n\nShort.\n\n## Detailed Description\n\n\nLong.\n\n## Drawings\n\n\nThe patent includes the following figures:\n\n- **Figure 1**: a lamp\n\n## Claims\n\n\n1. A lamp."
    )
    assert "summary: About lamps.\n" in got[1].known and "---\n\n**Key Terms**: lamp, light\n**Also Known As**: \n\n# A Lamp" in got[1].known
    bare = '---\nid: us1234567b2\ntitle: US1234567B2\ntype: patent\npersonas: [p]\nidentifiers:\n  patent_number: "US1234567B2"\n---\n\n# US1234567B2\n\n**Patent Number**: US1234567B2'
    assert (got[2].plain, got[3].plain) == (bare, bare)


def test_tokens_are_runs_of_word_signs(spark):
    texts = ["", None, "  ", "A-b_c d'é 1.5", "--x--", "a\u00a0b\tC"]
    got = [r.w for r in spark.createDataFrame([(x,) for x in texts], "s string").select(X.tokens(F.col("s")).alias("w")).collect()]
    assert got == [[], None, [], ["a", "b_c", "d", "1", "5"], ["x"], ["a", "b", "c"]]
