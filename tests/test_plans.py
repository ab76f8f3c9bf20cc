"""Queries that SQL can't express, against plain versions over whole tables."""

import re

from pyspark.sql import functions as F

from quarryline.plans import QUERIES
from quarryline.plans.grounding import answers
from quarryline.plans.registry import Tables
from quarryline.plans.structure import marked

DATA = "/root/testdata/sf0.001"


def test_slack_markdown(spark):
    steps = [
        (r"\$\$(.+?)\$\$", r"```\1```", re.S), (r"\$(?!\$)(.+?)(?<!\$)\$", r"`\1`", 0), (r"^#{1,6}\s+(.+)$", r"*\1*", re.M), (r"\*\*(.+?)\*\*", r"*\1*", 0), (r"__(.+?)__", r"*\1*", 0),
        (r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", r"_\1_", 0), (r"```\w*\n(.*?)```", r"```\1```", re.S), (r"^[-*]\s+(.+)$", r"• \1", re.M), (r"^>\s+(.+)$", r"    \1", re.M),
    ]
    want = {}
    for x in answers(Tables(spark, DATA)).collect():
        text = "# Head\n**bold** and `code`\n- item\n> quote\n" + x.answer
        for pattern, to, flags in steps:
            text = re.sub(pattern, to, text, flags=flags)
        keys = list(dict.fromkeys(re.findall(r"\[\^([^\]]+)\]", text)))
        want[x.message_id] = re.sub(r"\[\^([^\]]+)\]", lambda m: f"[{keys.index(m[1]) + 1}]", text)  # noqa: B023
    assert {x.message_id: x.text for x in QUERIES["slack_markdown"](spark, DATA).collect()} == want


def test_token_chunks(spark):
    """Every line of a document's sections is in its chunks, in order; a chunk ends only once it has 800 tokens, or with its section."""
    chunks = {}
    from quarryline.operators import chunking as C
    from quarryline.operators import sections as H

    s = marked(Tables(spark, DATA)).select("doc_id", H.sections_of(F.col("text")).alias("s"))
    s = s.select("doc_id", F.transform(C.sections_merged(F.col("s")), lambda x: F.struct(x["title"].alias("path"), x["content"].alias("content"))).alias("sections"))
    for c in C.token_chunks(s).collect():
        chunks.setdefault(c.doc_id, []).append(c)
    listed = {(x.doc_id, x.chunk_index): (x.section_path, x.token_count) for x in QUERIES["token_chunks"](spark, DATA).collect()}
    for x in s.collect():
        mine = sorted(chunks[x.doc_id], key=lambda c: c.chunk_index)
        assert [listed[x.doc_id, c.chunk_index] for c in mine] == [(c.section_path, c.token_count) for c in mine]
        at = 0
        for k, c in enumerate(mine):
            last_of_section = k + 1 == len(mine) or mine[k + 1].section_path != c.section_path
            if not last_of_section:
                assert c.token_count >= 800
        text = "\n".join(c.text for c in mine)
        for line in (line for part in x.sections for line in part.content.split("\n") if line.strip()):
            at = text.index(line.strip(), at)


def test_chunk_statistics(spark):
    sizes = {}
    for x in QUERIES["token_chunks"](spark, DATA).collect():
        sizes.setdefault(x.doc_id, []).append(x.token_count)
    got = {x.doc_id: x for x in QUERIES["chunk_statistics"](spark, DATA).collect()}
    assert {d: (x.chunks, x.tokens) for d, x in got.items()} == {d: (len(n), sum(n)) for d, n in sizes.items()}


def test_lsh_buckets(spark):
    """Eight buckets a vector, those of equal vectors equal."""
    n = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert sum(x.n for x in QUERIES["lsh_buckets"](spark, DATA).collect()) == 8 * n
