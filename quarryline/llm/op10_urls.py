"""URL filters that hold at fetch time: a temporal list join in DataFrame functions only.

Dated list entries (kind, key, day, action) become validity intervals: an ``add`` holds until the next
entry of its key. Kind ``host`` means that host, kind ``domain`` that host and all below it. Each
distinct host is looked up once, under itself and its parents. From the bounds of its intervals follow
the changes of what holds for it, day by day; captures and changes are then put in order of host and
day, and each capture takes what the last change on or before its day left (an as-of join, by one
window). A host's captures are dealt over salts (by a hash of the row) that grow with their number, its
changes are copied to each, so a host with very many captures isn't one task's work.

Hosts are read as browsers read them: control characters and spaces at the ends go, and tabs and line
ends anywhere; the scheme may be missing before //; backslashes count as slashes; what stands before
the last @ is user data; a final dot, a port and the case don't count. Escapes and Unicode host names
stay as they are written.

Defined results: a null URL or one without a host has no host and is never blocked, nor is a capture
without a day; entries with a null kind, key or day are ignored; entries of one key and day count in
the order add, remove; repeated entries count once; repeated captures are judged each by itself; empty
tables give no rows or no blocks. Captures keep their other columns, of any name, but for those named
like the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import parallelism, quoted, written

_HOST = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)"


def host(url: Column) -> Column:
    """The lower-case host; null where there is none."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\r\n]", ""), r"\\", "/"))
    return F.nullif(F.regexp_replace(F.regexp_extract(plain, _HOST, 1), r"\.\z", ""), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, key, since, until) from (kind, key, day, action); until is null while the entry holds on."""
    e = entries.where("kind is not null and key is not null and day is not null").select("kind", F.lower("key").alias("key"), F.col("day").cast("date").alias("day"), F.lower("action").alias("action")).distinct()
    following = F.lead("day").over(Window.partitionBy("kind", "key").orderBy("day", "action"))
    return e.withColumn("until", following).where("action = 'add' and (until is null or until > day)").select("kind", "key", F.col("day").alias("since"), "until")


_ENTRY = "array<struct<since:date,until:date,kind:string,key:string>>"


def changes(hosts: DataFrame, spans: DataFrame) -> DataFrame:
    """(host, day, holds: array<struct<since, until, kind, key>>): what holds for a host from that day to its next one. hosts: different ones."""
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = hosts.select("host", F.explode(F.concat(F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("key"))), F.transform(parents, lambda p: F.struct(F.lit("domain").alias("kind"), p.alias("key"))))).alias("x")).select("host", "x.*")
    mine = keys.join(spans, ["kind", "key"]).select("host", F.struct("since", "until", "kind", "key").alias("x"))
    days = mine.select("host", F.explode(F.array("x.since", "x.until")).alias("day")).where("day is not null").distinct()
    on = days.join(mine, "host", "left")
    holds = F.collect_list(F.when((F.col("x.since") <= F.col("day")) & (F.col("x.until").isNull() | (F.col("x.until") > F.col("day"))), F.col("x")))
    return on.groupBy("host", "day").agg(F.array_sort(holds).cast(_ENTRY).alias("holds"))


def url_filter(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day", share: int | None = None) -> DataFrame:
    """captures with host, entries (those that hold on the capture's day) and blocked added.

    share: captures of a host that one task takes, about; by default an even share of all, 500 at least.
    """
    mine = [c for c in captures.columns if c.lower() not in ("host", "entries", "blocked")]
    c = captures.select(F.struct(*(F.col(quoted(x)).alias(x) for x in mine)).alias("c"))
    c = c.select("c", host(F.col("c").getField(url)).alias("host"), F.col("c").getField(day).cast("date").alias("day"))
    counts = written(c.where("host is not null").groupBy("host").agg(F.count("*").alias("n")), "url-hosts")
    if share is None:
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        share = max(500, -(-total // parallelism(captures.sparkSession)))
    known = changes(counts.select("host"), intervals(entries)).join(counts, "host").withColumn("salts", F.ceil(F.col("n") / share).cast("int"))
    hot = counts.where(F.col("n") > share).select("host", F.ceil(F.col("n") / share).cast("int").alias("salts"))
    # a host of more than `share` captures is one row there, so there are at most captures / share of them
    dealt = c.join(F.broadcast(hot), "host", "left").select("c", "host", "day", F.pmod(F.xxhash64("c"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    none = F.lit(None)
    events = dealt.select("host", "day", "salt", F.lit(1).alias("late"), "c", none.cast(_ENTRY).alias("holds"))
    marks = known.select("host", "day", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("late"), none.cast(dealt.schema["c"].dataType).alias("c"), "holds")
    w = Window.partitionBy("host", "salt").orderBy("day", "late").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    judged = events.where("host is not null and day is not null").unionByName(marks).withColumn("holds", F.last("holds", ignorenulls=True).over(w)).where("late = 1")
    every = judged.select("c", "host", "holds").unionByName(events.where("host is null or day is null").select("c", "host", "holds"))
    out = every.withColumn("entries", F.coalesce("holds", F.array().cast(_ENTRY)))
    return out.select("c.*", "host", "entries", (F.size("entries") > 0).alias("blocked"))


def _listed(hosts: DataFrame) -> DataFrame:
    """A block list for the query, made from the hosts by a rule: dated additions and removals of hosts and of their parent domains."""
    v = F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    entry = lambda kind, key, n, action: F.struct(F.lit(kind).alias("kind"), key.alias("key"), day(n.cast("int")).alias("day"), F.lit(action).alias("action"))
    h, parent = F.col("host"), F.regexp_extract("host", r"^[^.]+\.(.+)$", 1)
    made = F.array(
        F.when(v % 2 == 0, entry("host", h, v % 180, "add")),
        F.when(v % 2 == 0, entry("host", h, v % 180 + 60 + v % 50, "remove")),
        F.when(v % 6 == 0, entry("host", h, v % 180 + 150, "add")),
        F.when((v % 97 == 1) & (parent != ""), entry("domain", parent, v % 300, "add")),
        F.when((v % 97 == 1) & (parent != ""), entry("domain", parent, v % 300 + 9, "remove")),
    )
    return hosts.select(F.explode(F.array_compact(made)).alias("x")).select("x.*")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages has no fetch days and no list: both follow from a rule, page_id * 37 modulo 365 days after New Year 2024 and ``_listed``."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 365).cast("int"))
    captures = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", day.alias("day"))
    hosts = captures.select(host(F.col("url")).alias("host")).where("host is not null").distinct()
    return url_filter(captures, _listed(hosts)).select("page_id", "host", F.col("day").cast("string").alias("day"), F.size("entries").cast("long").alias("n_entries"), "blocked")


SQL = r"""
WITH c AS (SELECT page_id, nullif(regexp_replace(regexp_extract(lower(replace(regexp_replace(regexp_replace(url, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '[\t\r\n]', '', 'g'), '\', '/')), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)', 1), '\.$', ''), '') AS host, DATE '2024-01-01' + (page_id * 37 % 365)::INT AS day FROM pages),
h AS (SELECT host, ('0x' || substr(md5(host), 1, 4))::INT AS v, regexp_extract(host, '^[^.]+\.(.+)$', 1) AS parent FROM (SELECT DISTINCT host FROM c WHERE host IS NOT NULL)),
e AS (SELECT DISTINCT kind, key, DATE '2024-01-01' + n AS day, action FROM (
  SELECT 'host' AS kind, host AS key, v % 180 AS n, 'add' AS action FROM h WHERE v % 2 = 0
  UNION ALL SELECT 'host', host, v % 180 + 60 + v % 50, 'remove' FROM h WHERE v % 2 = 0
  UNION ALL SELECT 'host', host, v % 180 + 150, 'add' FROM h WHERE v % 6 = 0
  UNION ALL SELECT 'domain', parent, v % 300, 'add' FROM h WHERE v % 97 = 1 AND parent <> ''
  UNION ALL SELECT 'domain', parent, v % 300 + 9, 'remove' FROM h WHERE v % 97 = 1 AND parent <> '')),
i AS (SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY kind, key ORDER BY day, action) AS until FROM e) WHERE action = 'add' AND (until IS NULL OR until > day)),
m AS (SELECT page_id, count(*) AS n FROM c JOIN i ON i.day <= c.day AND (i.until IS NULL OR i.until > c.day) AND ((i.kind = 'host' AND i.key = c.host) OR (i.kind = 'domain' AND (i.key = c.host OR ends_with(c.host, '.' || i.key)))) GROUP BY page_id)
SELECT c.page_id, c.host, strftime(c.day, '%Y-%m-%d') AS day, coalesce(n, 0)::BIGINT AS n_entries, coalesce(n, 0) > 0 AS blocked FROM c LEFT JOIN m USING (page_id)
"""
