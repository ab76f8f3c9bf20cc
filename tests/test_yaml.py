"""Nested frontmatter: shapes of YAML, and writing, reading and writing again."""

import random

import pytest
from pyspark.sql import functions as F

from quarryline.operators import yaml as Y


def read(spark, block):
    return [(e.path, e.value) for e in spark.createDataFrame([(block,)], "b string").select(Y.entries(F.col("b")).alias("e")).first().e]


@pytest.mark.parametrize(
    ("block", "want"),
    [
        ("id: a-b\ntitle: \"T: \\\"x\\\" \\\\ y\"\nn: 5 # five\nurl: https://x.org/#a", [("id", "a-b"), ("title", 'T: "x" \\ y'), ("n", "5"), ("url", "https://x.org/#a")]),
        ("dates:\n  created: \"2024-01-02\"\n  more:\n    deep: 'it''s'\nnext: 1", [("dates.created", "2024-01-02"), ("dates.more.deep", "it's"), ("next", "1")]),
        ("tags: [a, \"b, c\", 'd']\nempty: []", [("tags[0]", "a"), ("tags[1]", "b, c"), ("tags[2]", "d")]),
        ("tags:\n- a\n- b\nlist:\n  - c\n  - d: 1\n    e: 2\n  - f", [("tags[0]", "a"), ("tags[1]", "b"), ("list[0]", "c"), ("list[1].d", "1"), ("list[1].e", "2"), ("list[2]", "f")]),
        ("actors:\n  - name: Ann\n    role: author\n  - name: Bo\n    role: inventor", [("actors[0].name", "Ann"), ("actors[0].role", "author"), ("actors[1].name", "Bo"), ("actors[1].role", "inventor")]),
        ("text: |\n  one\n    two\n\n  three\nfold: >-\n  a\n  b\nlast: z", [("text", "one\n  two\n\nthree"), ("fold", "a b"), ("last", "z")]),
        ("# only\n\na: ~\nb: null\nc:\nd: x", [("a", None), ("b", None), ("c", None), ("d", "x")]),
        ("", []),
        ('"quoted key": v\nk: - not an item', [("quoted key", "v"), ("k", "- not an item")]),
    ],
)
def test_shapes(spark, block, want):
    assert read(spark, block) == want


def test_write_read_write(spark):
    r = random.Random(6)
    word = lambda: r.choice(["plain", "T: x", 'say "hi"', "back\\slash", "#hash", "- dash", "it's", "naïve 日本", "a, b", "{x}", "12", "null here"])
    pairs = lambda keys: [(k, word()) for k in r.sample(keys, r.randint(0, len(keys)))]
    rows = []
    for i in range(60):
        rows.append((i, f"id-{i}", word(), r.choice([None, "paper"]), pairs(["created", "published", "updated"]), r.choice([None, "2024-01-02"]), pairs(["doi", "source_url", "arxiv_id"]), r.choice([None, "https://x.org/a?b=1"]), r.sample(["ann", "bo", "cy"], r.randint(0, 3)), r.choice([None, word()]), r.choice([None, "MIT"])))
    ddl = "i long, id string, title string, type string, dates array<struct<key:string,value:string>>, date string, identifiers array<struct<key:string,value:string>>, source_url string, personas array<string>, summary string, license string"
    df = spark.createDataFrame(rows, ddl)
    meta = F.struct(*[F.col(c) for c in df.columns[1:]])
    first = df.select("i", meta.alias("meta"), Y.written_front(meta).alias("a"))
    again = first.select("i", "meta", "a", Y.read_front(F.col("a")).alias("back"))
    for x in again.select("*", Y.written_front(F.col("back")).alias("b")).collect():
        assert x.b == x.a
        assert (x.back.title, x.back.summary, x.back.personas) == (x.meta.title, x.meta.summary, x.meta.personas)
        assert sorted(map(tuple, x.back.identifiers)) == sorted(map(tuple, x.meta.identifiers))
        assert (x.back.date is None) == bool(x.meta.dates or x.meta.date is None)


def test_body_and_fields(spark):
    md = "---\nid: x\npersonas: [a]\ndates:\n  created: 2024-01-02\n---\nbody"
    got = spark.createDataFrame([(md,), (None,), ("no front",)], "m string").select(Y.read_front(F.col("m")).alias("f")).collect()
    assert (got[0].f.id, got[0].f.dates[0].key, got[0].f.dates[0].value) == ("x", "created", "2024-01-02")
    assert got[2].f.id is None and got[2].f.personas == []
