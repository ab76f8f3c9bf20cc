"""Operators against values worked out by hand, and invariants."""

from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import analytics as A
from quarryline.operators import chunking as C
from quarryline.operators import extract as E
from quarryline.operators import search as S
from quarryline.operators import sections as Z
from quarryline.operators import tables as T
from quarryline.streaming import jobs as J


def ranked(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, doc_id string, score double, rank int")


def test_rrf(spark):
    v, b = ranked(spark, [(1, "a", 0.9, 1), (2, "a", 0.8, 2)]), ranked(spark, [(2, "a", 5.0, 1), (3, "b", 4.0, 2)])
    got = {r.chunk_id: (r.score, r.ins) for r in S.rrf(v, b).collect()}
    assert got == {1: (round(1 / 61, 6), 1), 2: (round(1 / 62 + 1 / 61, 6), 2), 3: (round(1 / 62, 6), S.AFTER + 2)}
    other = {r.chunk_id: r.score for r in S.rrf(b, v).collect()}
    assert other == {k: s for k, (s, _) in got.items()}


def test_hybrid_caps_and_boosts(spark):
    v = ranked(spark, [(i, "a" if i < 6 else "b", 1 - i / 10, i) for i in range(1, 9)])
    cited = spark.createDataFrame([("b",)], "document_id string")
    docs = spark.createDataFrame([("a", ["Holo"]), ("b", ["x"])], "doc_id string, tags array<string>")
    got = S.hybrid(v, v.limit(0), cited, docs, "about holography", ["Light field"], most=3).orderBy("rank").collect()
    assert sum(r.doc_id == "a" for r in got) == 3
    assert {r.chunk_id: r.score for r in got}[6] == round(round(1 / 66, 6) * 1.15, 6)
    assert S.hybrid(v, v.limit(0), cited, docs, "nothing", [], most=3).where("tag_boosted").count() == 0


def test_sections_and_paths(spark):
    md = "lost\n# T\nintro\n## A\none\n### Deep\n## B\ntwo"
    got = [(r.level, r.title, r.content, r.path) for r in Z.sections(spark.createDataFrame([(1, md)], "doc_id long, text string")).orderBy("section_no").collect()]
    assert got == [(1, "T", "intro", "T"), (2, "A", "one", "A"), (3, "Deep", "", "A > Deep"), (2, "B", "two", "B")]


def test_packers(spark):
    b = F.array(*(F.struct(F.repeat(F.lit("x"), n).alias("content"), F.lit("paragraph").alias("type"), F.lit(i).alias("page")) for i, n in enumerate([1000, 900, 2500, 100])))
    r = spark.range(1).select(C.smart_packed(b).alias("c"), C.blocks_packed(b).alias("d")).first()
    assert [x.n for x in r.c] == [1900, 2600] and [x.n for x in r.d] == [1900, 2500, 100]


def test_merge_sections(spark):
    s = F.array(*(F.struct(F.lit(lv).alias("level"), F.lit(t).alias("title"), F.repeat(F.lit("y"), n).alias("content"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line")) for lv, t, n in [(1, "a", 40), (2, "b", 40), (1, "c", 4000), (2, "d", 40)]))
    assert [x.title for x in spark.range(1).select(C.sections_merged(s).alias("m")).first().m] == ["a", "c", "d"]


def test_token_chunks_overlap_and_code(spark):
    text = "\n".join(f"Sentence {i} has some words in it." for i in range(300)) + "\n```py\nx = 1\n```"
    df = spark.createDataFrame([(1, [("P", text)])], "doc_id long, sections array<struct<path:string,content:string>>")
    got = C.token_chunks(df).orderBy("chunk_index").collect()
    assert len(got) >= 3 and got[-1].text.endswith("```py\nx = 1\n```") and all(r.token_count <= 1300 for r in got)
    assert got[1].text.split("\n")[0].split(". ")[-1] in got[0].text
    assert all(f"Sentence {i} has" in "".join(r.text for r in got) for i in range(300))


def test_overlap(spark):
    assert spark.range(1).select(C.trailing_sentences(F.lit("One two. Three four. Five."), 5).alias("r")).first().r == "Three four. Five."


def test_paragraphs_and_blocks(spark):
    long = "a" * 60
    r = spark.range(1).select(Z.rebuilt_paragraphs(F.lit(f"{long}\n{long}\nend.\n\nx")).alias("p"), Z.blocks_of(F.lit("- a\n- b\n\ntext\nmore")).alias("b"), Z.without_code(F.lit("a\n```\nb\n```\nc\n```\nd")).alias("c")).first()
    assert r.p == f"{long} {long} end.\n\nx"
    assert [(b.type, b.start_line, b.end_line) for b in r.b] == [("list", 0, 1), ("paragraph", 3, 4)]
    assert r.c == "a\n[CODE_BLOCK_0]\nc\n[CODE_BLOCK_1]"


def test_citations(spark):
    m = spark.createDataFrame([(1, "x [^doc_1:Introduction] y [^doc_2:Background > History] z [^doc_1:Introduction]"), (2, "[^doc_1] [^1] [doc_1] [^Introduction]")], "message_id long, text string")
    assert [(r.message_id, r.number, r.doc_id, r.section_path) for r in A.citation_list(m).orderBy("message_id", "number").collect()] == [(1, 1, "doc_1", "Introduction"), (1, 2, "doc_2", "Background > History")]
    t = {r.message_id: r.t for r in m.select("message_id", A.numbered_citations(F.col("text")).alias("t")).collect()}
    assert t[1] == "x <sup>[1](#citation-1)</sup> y <sup>[2](#citation-2)</sup> z <sup>[1](#citation-1)</sup>" and t[2].startswith("[^doc_1]")


def test_rag_weight(spark):
    w = spark.range(1).select(A.rag_weight(F.lit("The Lens is 3 mm [^doc_1:a]."), F.lit("Source: x\nthe lens is 3 mm doc_1 a"), F.lit(0.04)).alias("w")).first().w
    assert w.citation_presence == 1 and w.factual_density == 1 and w.rag_weight == 0.95


def test_extraction(spark):
    r = spark.range(1).select(
        E.claims(F.lit('<div id="CLM-1" num="1" class="claim"><div class="claim-text">1. A thing.</div></div><div id="CLM-2" num="2" class="claim"><div class="claim-text">2. The thing of claim 1.</div></div>')).alias("c"),
        E.url_items(F.lit("# T\n## S\n- U | multibeam, light guide | aka: Core Patent\n> no\n- V")).alias("u"),
        E.topics(F.lit('### Topic 1: displays\n**Aliases**: "light field", lf\n### Topic 2: x\n**Aliases**: y')).alias("t"),
        E.stitched(F.array(F.lit("[Page 1]\n## A\nx"), F.lit("## A\ny"))).alias("s"),
        F.size(E.html_windows(F.lit("z" * 400_000))).alias("w"),
    ).first()
    assert [(c.number, c.text, c.depends_on) for c in r.c] == [(1, "A thing.", None), (2, "The thing of claim 1.", 1)]
    assert [(u.url, u.key_terms, u.also_known_as, u.section) for u in r.u] == [("U", ["multibeam", "light guide"], "Core Patent", "S"), ("V", None, None, "S")]
    assert [(t.id, t.aliases) for t in r.t] == [("displays", ["light field", "lf"]), ("x", ["y"])]
    assert r.s == "## A\nx\n\n## A\ny" and r.w == 1


def test_upsert_and_page(spark):
    a = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id long, v string, at int")
    b = spark.createDataFrame([(1, "c", 2), (2, "d", 4), (3, "e", 1)], "id long, v string, at int")
    assert {r.id: r.v for r in T.upserted(a, b, "id", "at").collect()} == {1: "c", 2: "b", 3: "e"}
    p = T.page(spark.range(10), 8, 5, "id").collect()
    assert [r.id for r in p] == [8, 9] and p[0].total == 10 and not p[0].has_more


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "pending", "0", 1), (1, "completed", "2", 3), (1, "processing", "1", 2), (2, "failed", "x", 5)]
    df = spark.createDataFrame(rows, "job_id long, status string, progress string, ts int")
    want = {r.job_id: r.status for r in J.job_state(df).collect()}
    df.write.parquet(str(tmp_path / "in"))
    seen = {}
    q = J.publish(J.job_state(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), lambda b, _: seen.update({r.job_id: r.status for r in b.collect()}), str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert seen == want == {1: "completed", 2: "failed"}


def test_files(spark, tmp_path):
    from quarryline.sources import files as S_

    (tmp_path / "a.md").write_text('---\nid: x\ntitle: "T"\n---\nbody')
    (tmp_path / "b.html").write_text("<p>hi</p>")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    got = {r.path.rsplit("/", 1)[1]: r for r in S_.texts(S_.scan(spark, str(tmp_path))).collect()}
    assert got["b.html"].text == "hi" and got["c.pdf"].error == "no reader for pdf"
    got = {r.path.rsplit("/", 1)[1]: r for r in S_.texts(S_.scan(spark, str(tmp_path)), pdf=lambda b: 1 / 0).collect()}
    assert "division" in got["c.pdf"].error and got["a.md"].error is None
    m = S_.markdown(S_.texts(S_.scan(spark, str(tmp_path), ["a.md"]))).first()
    assert dict(m.metadata) == {"id": "x", "title": "T"} and m.body == "body"
    assert X is not None


def test_clean_text_keeps_hyphenated_documents(spark, tmp_path):
    from quarryline.plans import QUERIES

    data = [(1, "auto-\n scopic  view"), (2, "a - \n b"), (3, None), (4, " plain\ntext ")]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in QUERIES["clean_text"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4} and not got[3]
    assert (got[1], got[2], got[4]) == ("autoscopic view", "a - b", "plain text")
