"""Fill-in-middle by ropes.

A text becomes a rope: a balanced tree whose leaves hold a bounded run of the text, and whose nodes
cache how many units and code points are below them. Prefix, middle and suffix come from splitting
the tree at two unit ranks, the output from concatenating the subtrees with sentinels in another
order; splitting copies one leaf at most, all else is shared. Inversion builds a rope over the output,
splits it at the sentinels and puts the subtrees back.

A unit is a code point, or what a regular expression matches, from left to right: then what stands
before a match belongs to its unit and what stands after the last to that one; a text without a match is one unit.

Which ranks and which form follow from a hash of the document's id, so reruns agree.

Defined results: a null text is empty; an empty text, or one that holds a sentinel, stays plain; a null
doc_id hashes as an empty one; repeated rows come out alike; an empty table gives no rows. Columns named
like the results are replaced, others of any name pass through; the text itself isn't returned, as
``output`` holds it and ``restored`` gives it back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import quoted
from .wordhash import pieces

#: Units in a leaf, at most.
LEAF = 4096
SENTINELS = ("<P>", "<S>", "<M>")


class Rope:
    """A leaf (text, and where its units end, None for code points) or a node (left, right); immutable."""

    __slots__ = ("chars", "ends", "left", "right", "text", "units")

    def __init__(self, text: str = "", ends: list[int] | None = None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.ends, self.left, self.right = text, ends, left, right
        if left is None:
            self.chars = len(text)
            self.units = self.chars if ends is None else len(ends)
        else:
            self.chars, self.units = left.chars + right.chars, left.units + right.units

    @staticmethod
    def of(text: str, unit: re.Pattern | None = None, leaf: int = LEAF) -> Rope:
        if unit is None:
            parts = [Rope(text[a : a + leaf]) for a in range(0, len(text), leaf)]
        else:
            ends = [m.end() for m in unit.finditer(text) if m.end() > m.start()]
            if text:
                ends = [*ends[:-1], len(text)]
            parts = []
            for a in range(0, len(ends), leaf):
                mine, begin = ends[a : a + leaf], ends[a - 1] if a else 0
                parts.append(Rope(text[begin : mine[-1]], [e - begin for e in mine]))
        while len(parts) > 1:  # level by level, so the tree is balanced
            parts = [parts[i].joined(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else Rope("", None if unit is None else [])

    def joined(self, other: Rope) -> Rope:
        if not self.chars:
            return other
        return Rope(left=self, right=other) if other.chars else self

    def split(self, rank: int) -> tuple[Rope, Rope]:
        """The first `rank` units, and the others."""
        if rank <= 0:
            return Rope(), self
        if rank >= self.units:
            return self, Rope()
        if self.left is None:
            at = rank if self.ends is None else self.ends[rank - 1]
            ends = (None, None) if self.ends is None else (self.ends[:rank], [e - at for e in self.ends[rank:]])
            return Rope(self.text[:at], ends[0]), Rope(self.text[at:], ends[1])
        if rank < self.left.units:
            a, b = self.left.split(rank)
            return a, b.joined(self.right)
        a, b = self.right.split(rank - self.left.units)
        return self.left.joined(a), b

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            x = stack.pop()
            if x.left is None:
                yield x.text
            else:
                stack += [x.right, x.left]

    def __str__(self) -> str:
        return "".join(self.leaves())


def rearranged(rope: Rope, form: str, first: int, second: int, sentinels: tuple[str, str, str] = SENTINELS) -> tuple[Rope, int, int]:
    """(output, code points of the prefix, of the middle): cut after `first` and after `second` units."""
    prefix, rest = rope.split(first)
    middle, suffix = rest.split(second - first)
    p, s, m = (Rope(x) for x in sentinels)
    order = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
    out = Rope()
    for x in order:
        out = out.joined(x)
    return out, prefix.chars, middle.chars


def inverted(output: str, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text of which that is the output."""
    if form == "plain":
        return output
    p, s, m = sentinels
    one, two = (s, p) if form == "spm" else (p, s)
    second = output.index(two, len(one))
    third = output.index(m, second + len(two))
    head, middle = Rope.of(output).split(third)
    middle = middle.split(len(m))[1]
    head, tail = head.split(second)
    head, tail = head.split(len(one))[1], tail.split(len(two))[1]
    prefix, suffix = (tail, head) if form == "spm" else (head, tail)
    return str(prefix.joined(middle).joined(suffix))


RESULT = [("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string")]


def _boxed(df: DataFrame, column: str, without: list[str], more: Column) -> tuple[DataFrame, list[str]]:
    """(doc, text and one more), and the names of doc's fields: all columns but those, as one, and the named one beside it."""
    names = [c for c in df.columns if c.lower() not in {x.lower() for x in without}]
    doc = F.struct(F.lit(None).cast("string").alias("none"), *(F.col(quoted(c)).alias(f"_{i}") for i, c in enumerate(names)))
    return df.select(doc.alias("doc"), F.coalesce(F.col(quoted(column)), F.lit("")).alias("text"), more), names


def _unboxed(df: DataFrame, names: list[str], more: list[str]) -> DataFrame:
    return df.select(*(F.col(f"doc._{i}").alias(c) for i, c in enumerate(names)), *more)


def fill_in_middle(documents: DataFrame, plain: int = 10, spm: int = 20, unit: str | None = None, seed: str = "1", doc_id: str = "doc_id", text: str = "text", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """documents without their text, with n (units), form (plain, spm or psm), prefix_chars, middle_chars and output.

    Of 100 documents about `plain` stay as they are, and of the others spm % have the suffix first.
    unit: a regular expression; by default each code point is a unit.
    """
    boxed, names = _boxed(documents, text, [text, *(x for x, _ in RESULT)], F.concat(F.lit(seed + ":"), F.coalesce(F.col(quoted(doc_id)).cast("string"), F.lit(""))).alias("key"))
    schema = T.StructType([boxed.schema["doc"], *T.StructType.fromDDL(", ".join(f"{a} {t}" for a, t in RESULT)).fields])

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit) if unit else None
        for batch in batches:
            for part in pieces(batch, "text"):
                out: list[list] = [[] for _ in RESULT]
                for x, key in zip(part.column("text").to_pylist(), part.column("key").to_pylist(), strict=True):
                    digest = hashlib.sha256(key.encode()).hexdigest()
                    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
                    rope = Rope.of(x, pattern)
                    if not x or any(s in x for s in sentinels) or h[2] % 100 >= 100 - plain:
                        row = (rope.units, "plain", None, None, x)
                    else:
                        form = "spm" if h[3] % 100 < spm else "psm"
                        made, p, m = rearranged(rope, form, *sorted((h[0] % (rope.units + 1), h[1] % (rope.units + 1))), sentinels)
                        row = (rope.units, form, p, m, str(made))
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column("doc"), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], names=["doc", *(x for x, _ in RESULT)])

    return _unboxed(boxed.mapInArrow(transform, schema), names, [x for x, _ in RESULT])


def restored(frames: DataFrame, form: str = "form", output: str = "output", name: str = "restored", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """frames with the text rebuilt from output and form."""
    boxed, names = _boxed(frames, output, [name], F.col(quoted(form)).alias("form"))
    schema = T.StructType([boxed.schema["doc"], T.StructField(name, T.StringType())])

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = [inverted(x, f, sentinels) for x, f in zip(part.column("text").to_pylist(), part.column("form").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(texts, pa.string())], names=["doc", name])

    return _unboxed(boxed.mapInArrow(invert, schema), names, [name])


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return restored(made.withColumn("output_sha256", F.sha2("output", 256))).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2("restored", 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id::VARCHAR) AS x FROM documents),
h AS (SELECT doc_id, text, length(text) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1, n - b) AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
