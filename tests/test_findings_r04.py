"""Faults that showed at other sizes than those of the test data, round 4."""

import math
import random
import time

from pyspark.sql import functions as F

from quarryline.operators import analytics as A
from quarryline.operators import extract as E
from quarryline.plans import fields as P
from quarryline.plans.registry import Tables


def test_means_are_rounded_once(spark):  # F2
    """Means of the exact sum, whatever the order of messages; 0.13 + 0.15 + 0.17 + 0.19 in order is more than it."""
    r = random.Random(2)
    weights = {1: [0.13, 0.15, 0.17, 0.19], 2: [0.19, 0.15, 0.13, 0.17], 3: [0.0, 1.0], 4: [None, 0.01], 5: [None]}
    weights |= {c: [r.choice([None, r.randrange(101) / 100, r.random() * 0.99 + 0.01]) for _ in range(r.randint(1, 300))] for c in range(6, 60)}
    rows = [(c, c * 1000 + i, w) for c, ws in weights.items() for i, w in enumerate(ws)]
    none = spark.createDataFrame([], "message_id long, document_id long")
    got = spark.createDataFrame(rows, "conversation_id long, message_id long, rag_weight double").repartition(7, F.hash("message_id"))
    means = {x.conversation_id: x.avg_weight for x in A.conversation_weights(got, none).collect()}
    known = {c: [w for w in ws if w is not None] for c, ws in weights.items()}
    assert means == {c: math.fsum(ws) / len(ws) if ws else None for c, ws in known.items()}
    assert means[1] == means[2] == 0.16


def test_windows_take_few_passes(spark):  # F1
    """Long pages take no more than a few times what one search through them takes; they took over five times that."""
    part = F.lit("<heading>Part</heading><p>" + "<b>é</b> and more of it, " * 200)
    pages = spark.range(60).repartition(1).select(F.concat(F.lit('<p itemprop="abstract"><p itemprop="description">'), F.repeat(part, F.lit(145)), F.lit('<section itemprop="claims">'), F.col("id").cast("string")).alias("h"))

    def took(c):
        best = math.inf
        for _ in range(3):
            start = time.perf_counter()
            pages.select(c).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        return best

    assert pages.select(F.length("h")).first()[0] > 690_000
    assert took(F.size(E.html_windows(F.col("h")))) < 4 * took(F.col("h").rlike("<zq"))


def test_windows_of_odd_pages(spark):  # F1
    """No page, a page without claims, and letters that only other alphabets take for those of a section."""
    page = '<p itemprop="abstract"><p itemprop="description">' + "x" * 300 + '<\u017fection itemprop="claims">'
    df = spark.createDataFrame([(0, None), (1, page), (2, page + '<SECTION\n itemprop="Claims">y')], "i long, h string")
    got = {x.i: x.w for x in df.select("i", E.html_windows(F.col("h"), 100, 5).alias("w")).collect()}
    assert got == {0: [None], 1: [page[: page.index('itemprop="d')]], 2: [page[: page.index('itemprop="d')], '<p it<SECTION\n itemprop="Claims">y']}


def test_windows_of_broken_text(spark):  # F1
    """Bytes that are no text become U+FFFD instead of an error."""
    html = F.concat(F.lit("x"), F.unhex(F.lit("FF")).cast("string"), F.repeat(F.lit("y"), F.lit(20)))
    for most, want in ((100, "x\ufffd" + "y" * 20), (10, "x\ufffdyyy")):
        assert spark.range(1).select(E.html_windows(html, most, 5).alias("w")).first().w == [want]


def test_long_pages_are_dealt_to_many_tasks(spark, monkeypatch):  # F1
    """To more tasks than the session's cores at its beginning ask for, and few pages to a task, however many there are."""
    tables = Tables(spark, "/root/testdata/sf0.01")
    assert P.long_pages(tables).rdd.getNumPartitions() >= 96
    monkeypatch.setattr(P, "PAGES_A_TASK", 2)
    assert P.long_pages(tables).rdd.getNumPartitions() == max(96, tables.pages.count() // 2)
