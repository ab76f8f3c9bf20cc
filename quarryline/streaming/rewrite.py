"""A text rewritten while it streams in (ST6): pieces of many texts come in micro-batches, and what can't change any more goes out at once.

Each rule is a delimited expression and its replacement, and keeps a hold-back buffer of its own: what
follows an opening sign that isn't closed yet, or the first half of such a sign. Rules run one after the
other, as on a whole text, so however a text is cut, and in whatever order its pieces come, what goes
out is the whole text's rewriting, part by part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> None:
    """Keyed custom state needs a store that can hold several states of a key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Rule(NamedTuple):
    """The opening and the closing sign of an expression, and what stands before and after it instead."""

    opening: str
    closing: str
    before: str
    after: str

    def fed(self, held: str, more: str, last: bool) -> tuple[str, str]:
        """(what is settled, what is held back) of the text held back so far and what follows it."""
        if held.startswith(self.opening) and not last and self.closing not in held[-len(self.closing) :] + more:
            return "", held + more  # still open: nothing to search again
        text, out, at = held + more, [], 0
        pattern = f"(?s){re.escape(self.opening)}(.+?){re.escape(self.closing)}"
        for m in re.finditer(pattern, text):
            out += [text[at : m.start()], self.before, m[1], self.after]
            at = m.end()
        rest = text[at:]
        if last:
            return "".join([*out, rest]), ""
        keep = rest.find(self.opening)
        if keep < 0:
            keep = len(rest) - next((n for n in range(len(self.opening) - 1, 0, -1) if rest.endswith(self.opening[:n])), 0)
        return "".join([*out, rest[:keep]]), rest[keep:]


#: What ``latex_delimiters`` does to a whole text (X47), in its order.
MATH = (Rule("\\(", "\\)", "$", "$"), Rule("\\[", "\\]", "\n$$\n", "\n$$\n"))


#: Pieces that wait for their turn are kept in blocks of so many.
BLOCK = 64


class Rewriter(StatefulProcessor):
    """Keyed by text. State: the next piece's number, the parts sent, each rule's buffer, the first number of each waiting block; the blocks of pieces that came before their turn.

    A key's state is read and written a few times a micro-batch, not once a piece. frames: whether rows come and go as pandas frames.
    """

    def __init__(self, rules: tuple[Rule, ...], idle_ms: int | None, frames: bool = True):
        self.rules, self.idle_ms, self.frames = rules, idle_ms, frames

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "next long, parts long, held array<string>, waiting array<long>")
        self.waiting = handle.getMapState("waiting", "first long", "seqs array<long>, pieces array<string>, lasts array<boolean>")

    def _restored(self) -> tuple[int, int, list[str], list[int]]:
        found = self.state.get()
        if found is None:
            return 0, 0, [""] * len(self.rules), []
        next_, parts, held, waiting = found
        return next_, parts, list(held), list(waiting)

    def _end(self, waiting: list[int]) -> None:
        self.state.clear()
        if waiting:
            self.waiting.clear()

    def _row(self, key: tuple, part: int, text: str, last: bool):
        if not self.frames:
            return Row(id=key[0], part=part, text=text, is_last=last)
        import pandas as pd

        return pd.DataFrame({"id": [key[0]], "part": [part], "text": [text], "is_last": [last]})

    def _pieces(self, rows: Iterator) -> Iterator[tuple]:
        if not self.frames:
            return (r[1:] for r in rows)
        return (x for df in rows for x in zip(df["seq"], df["piece"], df["is_last"], strict=True))

    def _block(self, first: int) -> dict:
        return {s: (p, z) for s, p, z in zip(*self.waiting.getValue((first,)), strict=True)}

    def handleInputRows(self, key: tuple, rows: Iterator, timerValues) -> Iterator:  # noqa: N802, N803
        next_, parts, held, waiting = self._restored()
        here = {int(s): (p or "", bool(z)) for s, p, z in self._pieces(rows) if s >= next_}
        out, ended = [], False
        while not ended:
            while waiting and waiting[0] <= next_:
                first = waiting.pop(0)
                here = {s: x for s, x in self._block(first).items() if s >= next_} | here
                self.waiting.removeKey((first,))
            if next_ not in here:
                break
            piece, ended = here.pop(next_)
            for i, rule in enumerate(self.rules):
                piece, held[i] = rule.fed(held[i], piece, ended)
            out.append(piece)
            next_ += 1
        text = "".join(out)
        if text or ended:
            yield self._row(key, parts, text, ended)
            parts += 1
        if self.idle_ms:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
        if ended:
            self._end(waiting)
            return
        rest = sorted(here)
        for k in range(0, len(rest), BLOCK):
            block = {s: here[s] for s in rest[k : k + BLOCK]}
            if rest[k] in waiting:  # a piece that came twice
                block = self._block(rest[k]) | block
            else:
                waiting.append(rest[k])
            self.waiting.updateValue((rest[k],), (list(block), [p for p, _ in block.values()], [z for _, z in block.values()]))
        self.state.update((next_, parts, held, sorted(waiting)))
        if self.idle_ms:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        """A text that fell silent ends with what came of it in order."""
        _, parts, held, waiting = self._restored()
        text = ""
        for rule, mine in zip(self.rules, held, strict=True):
            text, _ = rule.fed(mine, text, True)
        self._end(waiting)
        yield self._row(key, parts, text, True)

    def close(self) -> None:
        pass


def rewritten(pieces: DataFrame, rules: tuple[Rule, ...] = MATH, idle_ms: int | None = None) -> DataFrame:
    """(id, part, text, is_last) from a stream of (id, seq, piece, is_last); seq counts a text's pieces from 0. In append mode.

    idle_ms: a text without a new piece for so long (processing time) is ended. Without it, state
    stays until the last piece comes. Pieces that come twice, or after the end, don't count.
    """
    stateful(pieces.sparkSession)
    kind = pieces.schema["id"].dataType.simpleString()
    rows = pieces.where("id is not null").select("id", F.col("seq").cast("long").alias("seq"), "piece", F.coalesce("is_last", F.lit(False)).alias("is_last"))
    return rows.groupBy("id").transformWithState(Rewriter(rules, idle_ms, frames=False), f"id {kind}, part long, text string, is_last boolean", "append", "ProcessingTime" if idle_ms else "None")


def joined(parts: DataFrame) -> DataFrame:
    """(id, text) of what ``rewritten`` gave: a batch over its sink. A text's parts are one group, as the text is one value."""
    return parts.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "").alias("text"))
