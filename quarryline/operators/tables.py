"""Reads and writes over tables: filters, pages, joins to children, upserts, cascades (sections 2.1, 2.2, 2.6, 2.8)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filtered(df: DataFrame, **equal) -> DataFrame:  # P1, P9: None and "all" ask for nothing
    for c, v in equal.items():
        if v is not None and v != "all":
            df = df.where(F.col(c) == v)
    return df


def within(df: DataFrame, column: str, since=None, until=None, before=None) -> DataFrame:  # P2
    for v, test in ((since, F.col(column).__ge__), (until, F.col(column).__le__), (before, F.col(column).__lt__)):
        if v is not None:
            df = df.where(test(v))
    return df


def last_day(df: DataFrame, column: str, as_of: Column) -> DataFrame:  # P10
    return df.where(F.col(column) >= as_of - F.expr("INTERVAL 24 HOURS"))


def among(df: DataFrame, column: str, values: list | DataFrame) -> DataFrame:  # P3, J9: a semi-join for a table of values
    return df.join(values.select(column).distinct(), column, "left_semi") if isinstance(values, DataFrame) else df.where(F.col(column).isin(values))


def missing_any(df: DataFrame, *columns: str) -> DataFrame:  # P5
    test = F.lit(False)
    for c in columns:
        test = test | F.col(c).isNull()
    return df.where(test)


def present(df: DataFrame, *columns: str) -> DataFrame:  # P4
    return df.where(reduce(and_, (F.col(c).isNotNull() for c in columns)))


def owned(df: DataFrame, owner: str, user, is_admin: bool = False) -> DataFrame:  # P23: an admin sees all rows, others their own
    return df if is_admin else df.where(F.col(owner) == user)


def like_any(q: str, *columns: str) -> Column:  # P6: % and _ in q stay wildcards
    test = F.lit(False)
    for c in columns:
        test = test | F.col(c).ilike(f"%{q}%")
    return test


def holds_all(array: Column, want: list[str]) -> Column:  # P7
    return F.size(F.array_except(F.array(*map(F.lit, want)), array)) == 0


def overlaps(array: Column, any_of: list[str]) -> Column:  # P8
    return F.arrays_overlap(array, F.array(*map(F.lit, any_of)))


def matches_client_filter(q: str, persona: str | None = None, type_: str | None = None, empty_only: bool = False) -> Column:  # P11, P12
    low = q.lower()
    test = F.contains(F.lower("title"), F.lit(low)) | F.contains(F.lower("id"), F.lit(low)) | F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(low)))
    if persona is not None:
        test = test & F.array_contains("personas", persona)
    if type_ is not None:
        test = test & (F.col("type") == type_)
    return test & (F.col("chunk_count") == 0) if empty_only else test


def page(df: DataFrame, offset: int, limit: int, *order) -> DataFrame:  # A8, S1, S2: with the total, and whether there is more
    """order must be total. The count is an aggregate of its own, one row, so the page needs no global window."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def counted(df: DataFrame) -> DataFrame:  # A7: the number of rows, and none of them
    return df.agg(F.count("*").alias("total"))


def by_weight(df: DataFrame, weight: str, *ties: str) -> DataFrame:  # S5: no weight counts as 1
    return df.orderBy(F.coalesce(F.col(weight), F.lit(1.0)), *ties)


def newest_first(column: str) -> Column:  # S1: nulls first, as the reference's database has it
    return F.col(column).desc_nulls_first()


def sorted_by(df: DataFrame, column: str, descending: bool, *ties: str) -> DataFrame:  # S6
    return df.orderBy(F.col(column).desc() if descending else F.col(column).asc(), *ties)


def figure_order(label: Column) -> Column:  # S7
    return F.regexp_extract(label, r"^\d+", 0).try_cast("int")


def single(df: DataFrame) -> DataFrame:  # S8
    """The only row; an error if there are none or several."""
    rows = df.limit(2).count()
    if rows != 1:
        raise ValueError(f"one row asked for, {rows if rows < 2 else 'several'} found")
    return df


def with_children(parents: DataFrame, key: str, files: DataFrame, chunks: DataFrame) -> DataFrame:  # J1, J2
    """Each parent with its first file and its number of chunks. Children are aggregated before they are joined, so neither multiplies the other."""
    first = files.groupBy(key).agg(F.min_by(F.struct(*[c for c in files.columns if c != key]), "file_id").alias("file"))
    n = chunks.groupBy(key).agg(F.count("*").alias("chunk_count"))
    return parents.join(first, key, "left").join(n, key, "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def nested(parents: DataFrame, children: DataFrame, key: str, name: str, order: str, inner: bool = False) -> DataFrame:  # J3, J4, J6
    """Parents with their children as an ordered array; inner drops parents without any."""
    rows = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in children.columns if c not in (key, order)]))).alias(name))
    return parents.join(rows, key, "inner" if inner else "left")


def lookup(df: DataFrame, table: DataFrame, key: str, column: str, default=None) -> DataFrame:  # J5, J11, J12
    return df.join(table.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def gone_since(before: DataFrame, now: DataFrame, key: str) -> DataFrame:  # J13, U4, ST7
    return before.join(now.select(key).distinct(), key, "left_anti")


def merged_by_name(a: Column, b: Column) -> Column:  # J14
    return F.concat(a, F.filter(b, lambda x: ~F.array_contains(F.transform(a, lambda y: y["name"]), x["name"])))


def upserted(table: DataFrame, rows: DataFrame, key: str, version: str) -> DataFrame:  # IO15: the latest version of each key
    w = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last(), F.desc("_new"))
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def updated(df: DataFrame, where: Column, **values: Column) -> DataFrame:  # IO16
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def inserted_if_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:  # IO19
    return table.unionByName(rows.join(table.select(key), key, "left_anti"))


def cascaded(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:  # IO17: children that stay
    return children.join(deleted.select(key), key, "left_anti")


def replaced(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:  # IO18: all old rows of the keys that come anew go
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def backfilled(df: DataFrame, found: DataFrame, key: str, *columns: str) -> DataFrame:  # IO23: never over a value
    extra = found.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = df.join(extra, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in columns}).select(df.columns)


def with_hash(df: DataFrame, text: str) -> DataFrame:  # IO21
    return df.withColumn("content_hash", F.sha2(F.col(text), 256)).withColumn("file_size", F.octet_length(text))


def last_messages(messages: DataFrame, key: str, order: str, n: int = 6) -> DataFrame:  # W3, W4
    """The last n rows of each conversation. The window keeps n rows of a group in each task before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def last_user_message(messages: DataFrame, key: str, order: str) -> DataFrame:  # W5
    return messages.where("role = 'user'").groupBy(key).agg(F.max_by("text", order).alias("text"))


def carried(df: DataFrame, key: str, order: str, column: str) -> DataFrame:  # W8's simple kin W9: the last value so far
    return df.withColumn(column, F.last(column, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
