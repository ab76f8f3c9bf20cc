"""Best-fit packing by a linear grouping scheme.

Documents become token ids; those over the capacity are cut. Only the number of pieces of each
length is needed to decide the packing, so the plan is made from that histogram (at most capacity
rows, whatever the corpus): large lengths go, in falling order, into groups of equal cardinality and
are rounded up to their group's largest; sequences for the few rounded sizes are chosen by exact
subset sums; the true lengths take the places of the rounded ones, and small pieces fill what is
left by best fit. The scheme is
run with a few numbers of groups and once as best fit alone, and the plan of fewest sequences is taken.
The plan says for each length which rank goes where; ranks are computed
distributedly, with each length dealt over many salts.

Defined results: a null or empty text is one piece that holds the final id alone; every row gets its
own pieces, so repeated rows and repeated or null doc_ids are packed each by itself; an empty table
gives no rows. Of other columns none is read.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import parallelism, quoted, written
from .wordhash import pieces as batches_of

CAPACITY = 2048
#: Groups of large lengths, and the share of the capacity up to which a length is small.
GROUPS, SMALL = 512, 1 / 3
#: Words of which a worker remembers the ids.
REMEMBERED = 400_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts, as the tokenizer gives them for the texts at once.

    No token crosses white space, so each word is encoded once and remembered: the first most words
    for good (the common ones come early), others for a while. Words of Latin letters, digits and
    signs are cut as the tokenizer's own pattern cuts them and go straight to its model; any other
    word, and any text that lower-casing or normalising could treat otherwise as a whole than word
    by word, goes through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.most = self.whole.model, most
        self.known: dict[str, bytes] = {}
        self.recent: dict[str, bytes] = {}
        steps = json.loads(self.whole.to_str())
        kinds = [x["type"] for x in steps["normalizer"].get("normalizers", [])], [x["type"] for x in steps["pre_tokenizer"].get("pretokenizers", [])]
        self.by_word = kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
        if self.by_word:
            self.cut = regex.compile(steps["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.plain = re.compile("[!-~\u00a1-\u024f]+").fullmatch
        self.separator = re.compile("[\x1c-\x1f]").search  # white space to str.split(), but not to the tokenizer, which gives each an id
        self.letter = frozenset("abcdefghijklmnopqrstuvwxyz\u00df" + "".join(map(chr, [*range(0xE0, 0xF7), *range(0xF8, 0x100)]))).__contains__
        # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}

    def encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, w: str) -> bytes:
        if not self.plain(w) or "<|" in w:
            return self.encode(w)
        ids = []
        for x in self.cut(w):
            ids += [t.id for t in self.model.tokenize(x if x.isascii() else "".join(map(self.letters.__getitem__, x.encode())))]
        return pack_ids(f"<{len(ids)}I", *ids)

    def remembered(self, w: str) -> bytes:
        x = self.recent.get(w) or self.known.get(w)
        if x is None:
            if w[-1] in ",." and len(w) > 1 and self.letter(w[-2]):  # the sign is a piece by itself
                return self.remembered(w[:-1]) + self.remembered(w[-1])
            x = self.word(w)
            if len(self.known) < self.most:
                self.known[w] = x
            else:
                if len(self.recent) >= self.most // 2:
                    self.recent.clear()
                self.recent[w] = x
        return x

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        out = []
        for text in texts:
            if not self.by_word or "\u03a3" in text or "<|" in text or self.separator(text) or not unicodedata.is_normalized("NFC", text):
                out.append(self.encode(text))
                continue
            split = text.lower().split()
            ids = list(map(self.known.get, split))
            if None in ids:
                for i, x in enumerate(ids):
                    if x is None:
                        ids[i] = self.remembered(split[i])
            out.append(b"".join(ids))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenised(documents: DataFrame, capacity: int = CAPACITY, final_id: int = 0, path: str | None = None, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): pieces of at most capacity ids, the last of a document shorter or as long."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode_all, end = encoder(path or tokenizer_path()), np.array([final_id], "<u4").tobytes()
        for batch in batches:
            for part in batches_of(batch, "text", 1 << 20):
                texts = part.column("text").fill_null("").to_pylist()
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for r, x in enumerate(encode_all(texts)):
                    x += end
                    for k, a in enumerate(range(0, len(x), 4 * capacity)):
                        y = x[a : a + 4 * capacity]
                        rows.append(r), piece.append(k), start.append(a // 4), length.append(len(y) // 4), crc.append(zlib.crc32(y))
                        if with_ids:
                            ids.append(np.frombuffer(y, "<i4"))
                columns = [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], names=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(encode, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def _fullest(sizes: list[int], counts: list[int], first: int, room: int) -> list[tuple[int, int]]:
    """(size index, copies): the size at first once, and others so that the sum is the largest within room; larger sizes are preferred."""
    left = room - sizes[first]
    reach, trail = 1, []
    most = (1 << (left + 1)) - 1
    for i in range(len(sizes) - 1, first - 1, -1):  # from the smallest, so that the way back meets the largest first
        n = min(counts[i] - (i == first), left // sizes[i])
        trail.append((i, reach, n))
        for _ in range(n):
            more = (reach | reach << sizes[i]) & most
            if more == reach:
                break
            reach = more
    at, chosen = reach.bit_length() - 1, {first: 1}
    for i, before, _ in reversed(trail):
        while not before >> at & 1:
            chosen[i] = chosen.get(i, 0) + 1
            at -= sizes[i]
    # `before` is reachable without size i, so the walk takes as few copies as it needs and never more than there are
    return sorted(chosen.items())


def pack_plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in one sequence, number of such sequences)] for {length: pieces}. Deterministic."""
    done: list[tuple[tuple[int, ...], int]] = []
    lengths = sorted((x for x, n in histogram.items() if n > 0), reverse=True)
    assert all(0 < x <= capacity for x in lengths)
    large = [x for x in lengths if small * capacity < x < capacity]
    if histogram.get(capacity, 0):
        done.append(((capacity,), histogram[capacity]))
    # linear grouping: equal cardinality in falling order, each rounded up to its largest
    total = sum(histogram[x] for x in large)
    per = max(1, -(-total // groups))
    stock: dict[int, list[list[int]]] = {}
    size, room = 0, 0
    for x in large:
        n = histogram[x]
        while n:
            if not room:
                size, room = x, per
            k = min(n, room)
            stock.setdefault(size, []).append([x, k])  # a group that begins at the same length joins the one before
            n, room = n - k, room - k
    sizes = sorted(stock, reverse=True)
    counts = [sum(n for _, n in stock[s]) for s in sizes]
    open_bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for first in range(len(sizes)):
        while counts[first]:
            chosen = _fullest(sizes, counts, first, capacity)
            times = min(counts[i] // k for i, k in chosen)
            # true lengths take the places, run by run
            slots = []
            for i, k in chosen:
                counts[i] -= k * times
                for _ in range(k):
                    runs, need = [], times
                    while need:
                        x = stock[sizes[i]][0]
                        take = min(need, x[1])
                        runs.append([x[0], take])
                        x[1] -= take
                        need -= take
                        if not x[1]:
                            stock[sizes[i]].pop(0)
                    slots.append(runs)
            while times:
                k = min(s[0][1] for s in slots)
                content = tuple(s[0][0] for s in slots)
                open_bins[capacity - sum(content)][content] += k
                times -= k
                for s in slots:
                    s[0][1] -= k
                    if not s[0][1]:
                        s.pop(0)
    # best fit of what is left, largest first: a piece goes where least room remains
    for x in (y for y in lengths if y <= small * capacity and y < capacity):
        n = histogram[x]
        while n:
            fits = [r for r, b in open_bins.items() if r >= x and b]
            if not fits:
                k = min(n, capacity // x)
                times = n // k
                open_bins[capacity - k * x][(x,) * k] += times
                n -= k * times
                continue
            r = min(fits)
            content = next(iter(open_bins[r]))
            bins = open_bins[r].pop(content)
            k = min(r // x, n)
            times = min(bins, n // k)
            open_bins[r - k * x][content + (x,) * k] += times
            if bins > times:
                open_bins[r][content] += bins - times
            n -= k * times
    done += [(c, n) for r in sorted(open_bins) for c, n in open_bins[r].items() if n]
    covered: dict[int, int] = defaultdict(int)
    for content, n in done:
        for x in content:
            covered[x] += n
    assert covered == {x: histogram[x] for x in lengths}, "a plan has each piece once"
    return done


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> list[tuple[tuple[int, ...], int]]:
    """The plan of fewest sequences among the grouping scheme's, the same with half as many groups and twice, and best fit of all lengths in falling order (the scheme without large ones)."""
    tried = [(groups, small), (max(1, groups // 2), small), (2 * groups, small), (groups, 1.0)]
    return min((pack_plan(histogram, capacity, g, s) for g, s in tried), key=lambda plan: sum(n for _, n in plan))


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> DataFrame:
    """pieces (with doc_id, piece, start, length and any more) with sequence_id and offset. pieces is read twice: hand over a written table."""
    spark = pieces.sparkSession
    salts = parallelism(spark)
    dealt = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = dealt.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    key, base, times, offset, next_rank, sequence = [], [], [], [], defaultdict(int), 0
    for content, n in best_plan(histogram, capacity, groups, small):
        at = 0
        for x in sorted(set(content), reverse=True):
            k = content.count(x)
            key.append((x << 44) + next_rank[x]), base.append(sequence), times.append(k), offset.append(at)
            next_rank[x] += k * n
            at += k * x
        sequence += n
    order = np.argsort(np.array(key, np.int64), kind="stable")
    plan = spark.sparkContext.broadcast(tuple(np.array(v, np.int64)[order] for v in (key, base, times, offset)))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "_salt"]).select(F.struct(*(F.col(quoted(c)).alias(c) for c in pieces.columns)).alias("doc"), "length", (F.col("_rank") + F.col("_before")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, base, times, offset = plan.value
        for b in batches:
            x = np.asarray(b.column("length"))
            want = (x << 44) + np.asarray(b.column("_rank"))
            row = np.searchsorted(key, want, "right") - 1
            i = want - key[row]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(base[row] + i // times[row]), pa.array(offset[row] + i % times[row] * x)], names=["doc", "sequence_id", "offset"])

    schema = T.StructType([ranked.schema["doc"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema).select("doc.*", "sequence_id", "offset")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents tokenised, cut and packed; with_ids keeps the ids themselves."""
    return pack(written(tokenised(documents, capacity, path=path, doc_id=doc_id, text=text, with_ids=with_ids), "pieces"), capacity)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
