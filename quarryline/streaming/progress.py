"""Job progress as one stateful stream (ST1, ST2, ST3, ST7): partial updates merge, a subscriber gets a snapshot first, and timers watch the jobs.

Each job keeps, for each field, the value and the time that it is from, so updates may come late and in
any order: the view is that of the newest values, as the batch forms ``job_state`` and
``merged_progress`` give it. What goes out is a log in append mode; the last version of a job is its view.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .jobs import TERMINAL
from .rewrite import stateful

FIELDS = ("status", "current", "total", "message")
EVENT = "version long, event string, status string, current double, total double, message string, created_at long, updated_at long, was_active boolean, is_active boolean"


class Progress(StatefulProcessor):
    """Keyed by job. Times are microseconds; timers run on event time, in milliseconds."""

    def __init__(self, stuck_ms: int | None, retain_ms: int | None):
        self.stuck_ms, self.retain_ms = stuck_ms, retain_ms

    def init(self, handle) -> None:
        self.handle = handle
        fields = ", ".join(f"{f} {'double' if f in ('current', 'total') else 'string'}, {f}_at long" for f in FIELDS)
        self.state = handle.getValueState("state", f"version long, created_at long, updated_at long, {fields}, told boolean")

    def _read(self) -> dict:
        names = ["version", "created_at", "updated_at", *(x for f in FIELDS for x in (f, f"{f}_at")), "told"]
        return dict(zip(names, self.state.get() or [0, *[None] * (len(names) - 1)], strict=True))

    def _event(self, key: tuple, s: dict, event: str, was: bool, now: bool):
        s["version"] += 1
        return Row(job_id=key[0], version=s["version"], event=event, **{f: s[f] for f in FIELDS}, created_at=s["created_at"], updated_at=s["updated_at"], was_active=was, is_active=now)

    def handleInputRows(self, key: tuple, rows: Iterator, timerValues) -> Iterator:  # noqa: N802, N803
        s = self._read()
        first = s["created_at"] is None
        was = not first and s["status"] is not None and s["status"] not in TERMINAL
        ended = not first and s["status"] in TERMINAL
        for _, _, at, *values in rows:  # as tracked selects them
            s["created_at"] = at if s["created_at"] is None else min(s["created_at"], at)
            s["updated_at"] = at if s["updated_at"] is None else max(s["updated_at"], at)
            for f, v in zip(FIELDS, values, strict=True):
                if v is not None and v == v and (s[f"{f}_at"] is None or at >= s[f"{f}_at"]):
                    s[f], s[f"{f}_at"] = v, at
        now = s["status"] is not None and s["status"] not in TERMINAL
        over = s["status"] in TERMINAL
        event = "late" if ended and over else "reopened" if ended else "end" if over else "snapshot" if first else "update"
        s["told"] = False
        if first and event == "end":  # a subscriber sees where the job stands before it is closed
            yield self._event(key, s, "snapshot", was, now)
        yield self._event(key, s, event, was, now)
        self.state.update(tuple(s.values()))
        wait = self.retain_ms if over else self.stuck_ms
        for at in list(self.handle.listTimers()) if self.stuck_ms or self.retain_ms else []:
            self.handle.deleteTimer(at)
        if wait:
            self.handle.registerTimer(max(s["updated_at"] // 1000 + wait, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        if not self.state.exists():
            return
        s = self._read()
        if s["status"] in TERMINAL:
            self.state.clear()  # retained long enough
        elif not s["told"]:
            s["told"] = True
            yield self._event(key, s, "stuck", True, True)
            self.state.update(tuple(s.values()))

    def close(self) -> None:
        pass


def tracked(updates: DataFrame, stuck_ms: int | None = None, retain_ms: int | None = None, late: str = "10 minutes") -> DataFrame:
    """(job_id, version, event, status, current, total, message, created_at, updated_at, was_active, is_active) from a stream of partial updates (job_id, ts, status, current, total, message), nulls where a field doesn't change.

    Events: snapshot (the first that is known of a job), update, end (it became completed or failed),
    late (an update of an ended job that came after), reopened, and, with stuck_ms, stuck (no update
    for so long while active). With retain_ms an ended job's state goes after so long; both run on event
    time with a watermark. was_active and is_active are the job's state before and after a micro-batch, so
    a poll's completions are the rows that were active and aren't. Of updates of one time the last that came counts.
    """
    stateful(updates.sparkSession)
    timed = bool(stuck_ms or retain_ms)
    kind = updates.schema["job_id"].dataType.simpleString()
    rows = updates.where("job_id is not null and ts is not null")
    if timed:
        rows = rows.withWatermark("ts", late)
    columns = [F.col(c).cast("double" if c in ("current", "total") else "string").alias(c) for c in FIELDS]
    rows = rows.select("job_id", "ts", F.unix_micros("ts").alias("at"), *columns)
    return rows.groupBy("job_id").transformWithState(Progress(stuck_ms, retain_ms), f"job_id {kind}, {EVENT}", "append", "EventTime" if timed else "None")


def view(log: DataFrame) -> DataFrame:
    """Where each job stands: the last version of it in the log."""
    last = F.max_by(F.struct("status", "current", "total", "message", "created_at", "updated_at"), "version").alias("x")
    return log.groupBy("job_id").agg(last).select("job_id", "x.*")


def subscription(log: DataFrame) -> DataFrame:  # ST3: a snapshot, updates, and the end, after which nothing comes
    return log.where("event in ('snapshot', 'update', 'end', 'stuck')").select("job_id", "version", "event", "status", "current", "total", "message", (F.col("event") == "end").alias("is_last"))


def completions(log: DataFrame) -> DataFrame:  # ST7: of a micro-batch or of many
    return log.where("was_active and not is_active").select("job_id", "version", "status", "updated_at")


def replayed(batches: DataFrame, folder: str, stream, files: int | None = None) -> DataFrame:
    """What stream(readStream) sends to a sink when the rows of batches come as a stream of so many micro-batches (one, without it), each of files of all cores: for replays and tests."""
    spark = batches.sparkSession
    cores = spark.sparkContext.defaultParallelism
    rows = batches.repartition(files * cores) if files else batches
    rows.write.mode("append").parquet(f"{folder}/in")
    reader = spark.readStream.schema(batches.schema)
    if files:
        written = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{folder}/in").select("path").count()
        reader = reader.option("maxFilesPerTrigger", -(-written // files))
    source = reader.parquet(f"{folder}/in")
    held, key = spark.conf.get("spark.sql.shuffle.partitions"), "spark.sql.shuffle.partitions"
    spark.conf.set(key, min(int(held), cores))  # a replay's state needs no more stores than there are cores; a stream keeps what it began with
    try:
        query = stream(source).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, held)
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")
