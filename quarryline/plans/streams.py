"""Stateful streams replayed over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.scratch import shared_dir
from ..streaming import progress as P
from ..streaming import rewrite as R
from .registry import query
from .retrieval import messages


def _folder(t) -> str:
    return f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"


_MATHS = "SELECT conv_id * 4294967296 + turn AS id, regexp_replace(regexp_replace(text, ',', '\\( x, y \\)', 'g'), '\\.', '\\[ z. \\] \\( .', 'g') AS text FROM conversations"


def maths(t):
    """The tables hold no formulas: each comma becomes an inline one, each full stop a display one and an inline one that stays open until the next comma."""
    text = F.replace(F.replace("text", F.lit(","), F.lit("\\( x, y \\)")), F.lit("."), F.lit("\\[ z. \\] \\( ."))
    return messages(t).select(F.col("message_id").alias("id"), text.alias("text"))


@query(
    "WITH m AS (SELECT conv_id * 4294967296 + turn AS id, replace(replace(text, ',', '\\( x, y \\)'), '.', '\\[ z. \\] \\( .') AS text FROM conversations) "
    "SELECT id, regexp_replace(regexp_replace(text, '\\\\\\((.+?)\\\\\\)', '$\\1$', 'gs'), '\\\\\\[(.+?)\\\\\\]', chr(10) || '$$' || chr(10) || '\\1' || chr(10) || '$$' || chr(10), 'gs') AS text FROM m"
)
def math_stream(t):
    """Messages cut into pieces of 17 characters, of which each of three micro-batches gets some, in no order."""
    m = maths(t).withColumn("pieces", F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / 17), F.lit(1)) - 1), lambda i: F.substring(F.col("text"), (i * 17 + 1).cast("int"), F.lit(17))))
    rows = m.select("id", F.size("pieces").alias("n"), F.posexplode("pieces").alias("seq", "piece"))
    cut = rows.select("id", F.col("seq").cast("long").alias("seq"), "piece", (F.col("seq") == F.col("n") - 1).alias("is_last"))
    return R.joined(P.replayed(cut, _folder(t), R.rewritten, 3))


def updates(t):
    """Each user's events as partial updates of a job."""
    e, v = F.col("event_type"), F.col("value")
    return t.events.select(
        F.col("user_id").alias("job_id"), F.timestamp_add("MICROSECOND", F.col("event_id"), F.date_trunc("second", "ts")).alias("ts"),
        F.when(e == "error", "failed").when(e == "purchase", "completed").when(e == "signup", "pending").when(e == "click", "processing").alias("status"),
        F.when(e != "view", v).alias("current"), F.when(e == "view", v).alias("total"), F.when(e == "view", F.col("props")).alias("message"),
    )


_UPDATES = """u AS (SELECT user_id AS job_id, epoch_us(date_trunc('second', ts)) + event_id AS us, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'processing' END AS status,
CASE WHEN event_type <> 'view' THEN value END AS current, CASE WHEN event_type = 'view' THEN value END AS total, CASE WHEN event_type = 'view' THEN props END AS message FROM events)"""


@query(f"WITH {_UPDATES} SELECT job_id, arg_max(status, us) FILTER (status IS NOT NULL) AS status, arg_max(current, us) FILTER (current IS NOT NULL) AS current, arg_max(total, us) FILTER (total IS NOT NULL) AS total, arg_max(message, us) FILTER (message IS NOT NULL) AS message, min(us) AS created_at, max(us) AS updated_at FROM u GROUP BY job_id")
def progress_stream(t):
    """All updates as a stream of four micro-batches, in no order; the jobs' views at its end."""
    return P.view(P.replayed(updates(t), _folder(t), P.tracked, 4))


_POLLS = "u2 AS (SELECT *, (us - (SELECT min(us) FROM u)) * 3 // ((SELECT max(us) - min(us) FROM u) + 1) AS poll FROM u)"


@query(
    f"""WITH {_UPDATES}, {_POLLS}, p AS (SELECT DISTINCT poll FROM u2), s AS (SELECT p.poll, job_id, arg_max(status, us) FILTER (status IS NOT NULL) AS status FROM p JOIN u2 ON u2.poll <= p.poll GROUP BY p.poll, job_id)
SELECT b.poll, b.job_id, b.status FROM s a JOIN s b ON a.job_id = b.job_id AND b.poll = a.poll + 1 WHERE a.status NOT IN ('completed', 'failed') AND b.status IN ('completed', 'failed')"""
)
def completions_by_poll(t):
    """Three polls in order of time, each what came since the last: the jobs that were active at one and aren't at the next."""
    u, folder = updates(t).withColumn("at", F.unix_micros("ts")), _folder(t)
    low, high = u.agg(F.min("at"), F.max("at")).first()
    poll = lambda at: F.expr(f"({at} - {low}L) * 3 div ({high - low + 1}L)")
    for k in range(3):
        log = P.replayed(u.where(poll("at") == k).drop("at"), folder, P.tracked)
    return P.completions(log).select(poll("updated_at").alias("poll"), "job_id", "status")
