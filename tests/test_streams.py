"""Stateful streams: any cut and any order of a text gives its rewriting; replays of updates give the batch's view; timers."""

import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.streaming import jobs as J
from quarryline.streaming import progress as P
from quarryline.streaming import rewrite as R

PIECES = "id long, seq long, piece string, is_last boolean"


def folder():
    return "file://" + tempfile.mkdtemp(prefix="stream-")


def whole(text):
    for rule in R.MATH:
        text = re.sub(f"(?s){re.escape(rule.opening)}(.+?){re.escape(rule.closing)}", lambda m, r=rule: r.before + m[1] + r.after, text)
    return text


def math_text(r):
    return "".join(r.choice(["\\(", "\\)", "\\[", "\\]", "\\", "(", ")", "[", "x", " y", "\n", "$", "é"]) for _ in range(r.randint(0, 60)))


@pytest.mark.parametrize("seed", range(200))
def test_rules_on_any_cut(seed):
    """Each piece's settled text, end to end, is the whole text's rewriting; what is sent is never taken back."""
    r = random.Random(seed)
    text = math_text(r)
    cuts = sorted(r.randint(0, len(text)) for _ in range(r.randint(0, 12)))
    pieces = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
    held, out = ["", ""], []
    for i, piece in enumerate(pieces):
        for k, rule in enumerate(R.MATH):
            piece, held[k] = rule.fed(held[k], piece, i + 1 == len(pieces))
        out.append(piece)
    assert "".join(out) == whole(text)
    if "\\" not in text:
        assert out == pieces  # plain text isn't held back


def test_rewritten_stream(spark):
    r = random.Random(1)
    texts = {i: math_text(r) for i in range(40)} | {100: "", 101: "no formula", 102: "\\(" + "a" * 5000 + "\\)", 103: "open \\[ for ever"}
    rows = []
    for i, t in texts.items():
        cuts = sorted(r.randint(0, len(t)) for _ in range(r.randint(0, 5)))
        ps = [t[a:b] for a, b in zip([0, *cuts], [*cuts, len(t)], strict=True)]
        rows += [(i, s, p or None, s + 1 == len(ps)) for s, p in enumerate(ps)]
    rows += r.sample(rows, 20) + [(None, 0, "x", True)]  # some come twice
    r.shuffle(rows)
    got = R.joined(P.replayed(spark.createDataFrame(rows, PIECES), folder(), R.rewritten, 4)).collect()
    assert {x.id: x.text for x in got} == {i: whole(t) for i, t in texts.items()}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    assert {x.id: x.t for x in df.select("id", X.latex_delimiters(F.col("text")).alias("t")).collect()} == {x.id: x.text for x in got}


def test_settled_text_goes_out_before_the_end(spark):
    """Without the last piece, all but what is held back has been sent; an idle text is ended by its timer."""
    rows = [(1, 0, "a \\(x\\) b \\(open", False), (2, 1, "second", True)]
    out = P.replayed(spark.createDataFrame(rows, PIECES), folder(), R.rewritten, 1).collect()
    assert [(x.id, x.text, x.is_last) for x in out] == [(1, "a $x$ b ", False)]


class State:
    """Stands for a value state, a map state and the timers."""

    def __init__(self):
        self.value, self.map, self.timers = None, {}, []
        self.exists, self.get, self.update = lambda: self.value is not None, lambda: self.value, lambda v: setattr(self, "value", v)
        self.containsKey, self.getValue, self.removeKey = self.map.__contains__, self.map.__getitem__, self.map.pop
        self.updateValue, self.getValueState, self.getMapState = self.map.__setitem__, lambda *_: self, lambda *_: self
        self.listTimers, self.deleteTimer, self.registerTimer = lambda: self.timers, self.timers.remove, self.timers.append
        self.getCurrentProcessingTimeInMs = lambda: 1000

    def clear(self):
        self.value = None
        self.map.clear()


def test_idle_text_ends():
    """An idle text is ended by its timer, with what came of it in order; a processing-time timer keeps a stream alive, so this one is called by hand."""
    import pandas as pd

    state, rewriter = State(), R.Rewriter(R.MATH, 50)
    rewriter.init(state)
    rows = pd.DataFrame([(0, "a \\(x\\) b \\(open", False), (2, "never", False)], columns=["seq", "piece", "is_last"])
    sent = pd.concat(rewriter.handleInputRows((1,), iter([rows]), state))
    assert sent.values.tolist() == [[1, 0, "a $x$ b ", False]] and state.timers == [1050] and list(state.map) == [(2,)]
    ended = pd.concat(rewriter.handleExpiredTimer((1,), state, None))
    assert ended.values.tolist() == [[1, 1, "\\(open", True]] and not state.map and not state.exists()


UPDATES = "job_id string, ts timestamp, status string, current double, total double, message string"


def updates(seed, jobs=12, n=160):
    import datetime as dt

    r = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    out = []
    for k in range(n):
        field = r.choice(["status", "current", "total", "message"])
        value = {"status": r.choice(["pending", "processing", "completed", "failed"]), "current": float(r.randint(0, 9)), "total": 9.0, "message": r.choice(["a", "b"])}
        out.append((f"j{r.randrange(jobs)}", base + dt.timedelta(seconds=k), *(value[f] if f == field or r.random() < 0.2 else None for f in ("status", "current", "total", "message"))))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_replay_equals_batch(spark, seed):
    rows = updates(seed)
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows + [(None, rows[0][1], "failed", None, None, None), ("x", None, "failed", None, None, None)], UPDATES)
    log = P.replayed(df, folder(), P.tracked, 3)
    got = {x.job_id: x for x in P.view(log).collect()}
    batch = {x.job_id: x for x in J.merged_progress(spark.createDataFrame(rows, UPDATES)).collect()}
    state = {x.job_id: x for x in J.job_state(spark.createDataFrame([x for x in rows if x[2]], UPDATES).withColumn("progress", F.lit(""))).collect()}
    assert got.keys() == batch.keys()
    for j, x in got.items():
        assert (x.current, x.total, x.message) == (batch[j].current, batch[j].total, batch[j].message)
        assert x.status == (state[j].status if j in state else None)
    versions = {}
    for x in log.collect():
        versions.setdefault(x.job_id, []).append(x.version)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in versions.values())


def test_subscription_and_polls(spark):
    """In order of time: a snapshot comes first, an end is the last of a run, and completions are those of two polls."""
    rows, path = updates(7), folder()
    before, want = {}, set()
    status = {}
    for k in range(4):
        for x in rows[40 * k : 40 * k + 40]:
            status[x[0]] = x[2] or status.get(x[0])
        want |= {(k, j) for j, s in status.items() if before.get(j) in ("pending", "processing") and s in J.TERMINAL}
        before = dict(status)
        log = P.replayed(spark.createDataFrame(rows[40 * k : 40 * k + 40], UPDATES).coalesce(1), path, P.tracked)
    start = int(rows[0][1].timestamp() * 1e6)
    got = {((x.updated_at // 1000000 - start // 1000000) // 40, x.job_id) for x in P.completions(log).collect()}
    assert {j for _, j in got} == {j for _, j in want} and len(got) == len(want)
    for j in status:
        mine = [x for x in P.subscription(log).orderBy("version").collect() if x.job_id == j]
        assert mine[0].event == "snapshot" and all(x.is_last == (x.event == "end") for x in mine)
        assert all(x.status in J.TERMINAL for x in mine if x.is_last)


def test_timers(spark):
    """A job that falls silent while active is stuck, once; an ended job's state goes, so a later update begins anew."""
    import datetime as dt

    path, base = folder(), dt.datetime(2024, 1, 1)
    track = lambda s: P.tracked(s, stuck_ms=600_000, retain_ms=600_000, late="0 seconds")
    row = lambda j, minutes, status: (j, base + dt.timedelta(minutes=minutes), status, None, None, None)
    for rows in ([row("a", 0, "processing"), row("b", 0, "completed"), row("c", 0, "processing")], [row("c", 8, "processing"), row("clock", 15, "processing")], [row("clock", 30, "processing")], [row("b", 31, "pending"), row("c", 32, "completed")]):
        log = P.replayed(spark.createDataFrame(rows, UPDATES).coalesce(1), path, track)
    events = {}
    for x in log.orderBy("version").collect():
        events.setdefault(x.job_id, []).append((x.version, x.event))
    assert events["a"] == [(1, "snapshot"), (2, "stuck")]
    assert sorted(events["b"]) == [(1, "snapshot"), (1, "snapshot"), (2, "end")]
    assert events["c"] == [(1, "snapshot"), (2, "update"), (3, "stuck"), (4, "end")]
