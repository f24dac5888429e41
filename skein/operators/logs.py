"""Event logs: reports, counters, retention, latest-wins dimensions and sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recent(df: DataFrame, at: str, n: int, where: Column | None = None, ties: list[str] = []) -> DataFrame:
    """The n most recent rows; Spark keeps n rows for each task, so nothing is sorted whole."""
    return (df if where is None else df.filter(where)).orderBy(F.desc(at), *ties).limit(n)


def counters(df: DataFrame, at: str, user: str, kind: str, now: Column, window: str = "1 day") -> DataFrame:
    """Counters of a log in one pass."""
    recently = F.col(at) > now - F.expr(f"interval {window}")
    return df.agg(
        F.count("*").alias("events"),
        F.countDistinct(user).alias("users"),
        F.countDistinct(kind).alias("kinds"),
        F.count_if(recently).alias("recent"),
        F.count_if(F.col(kind) == "error").alias("errors"),
        F.countDistinct(F.when(recently, F.col(user))).alias("recent_users"),
    )


def grouped_counts(df: DataFrame, by: str, where: Column | None = None) -> DataFrame:
    return (df if where is None else df.filter(where)).groupBy(by).agg(F.count("*").alias("n"))


def retained(df: DataFrame, at: str, now: Column, days: Column) -> DataFrame:
    """Rows younger than the days their kind is kept for; null days: for ever."""
    return df.filter(days.isNull() | (F.col(at) >= now - F.make_dt_interval(days)))


def latest(df: DataFrame, key: str, at: str, ties: list[str] = []) -> DataFrame:
    """The latest row of each key: a grouped maximum, so updates pre-aggregate where they lie."""
    order = F.struct(at, *ties)
    row = F.struct(*(c for c in df.columns if c != key))
    return df.groupBy(key).agg(F.max_by(row, order).alias("_r")).select(key, "_r.*")


def sliding_hits(df: DataFrame, key: str, at: str, seconds: int, limit: int, ties: list[str] = []) -> DataFrame:
    """Adds how many rows of the key fall in the last ``seconds`` and whether that is over the limit.

    Refused rows count too, so this refuses more than a limiter that forgets them; see
    ``skein.streaming.limiter`` for the exact one.
    """
    w = Window.partitionBy(key).orderBy(F.col(at).cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    n = F.count("*").over(w)
    return df.withColumn("hits", n).withColumn("refused", n > limit)


def tumbling(df: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """Adds the epoch of each row: its number in the sequence over ``size``, rounded down."""
    return df.withColumn("epoch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / size))
