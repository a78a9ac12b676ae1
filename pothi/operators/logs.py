"""Request logs: caps, tails, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def log_time(ts: Column) -> Column:
    """Timestamp of an ISO string with Z or an offset."""
    return F.try_to_timestamp(F.regexp_replace(ts, "Z$", "+00:00"))


def requests(log: DataFrame) -> DataFrame:
    """Each request once, though retried: the first arrival of equal ts, name, method and path."""
    key = ["ts", "name", "method", "path"]
    rest = [c for c in log.columns if c not in key]
    once = log.groupBy(*key).agg(F.min(F.struct("received_at", *[c for c in rest if c != "received_at"])).alias("r"))
    return once.select(*key, "r.*").withColumn("at", log_time(F.col("ts")))


def daily_cap(log: DataFrame, at: str, tie: str, cap: int) -> DataFrame:
    """``log`` with admitted: the first ``cap`` of each UTC day.

    A day may hold a third of all rows, so rows are ranked within hours first and
    hours get the count of those before them; no task sorts a day.
    """
    hour, day = F.date_trunc("hour", at), F.to_date(at)
    sizes = log.groupBy(day.alias("_day"), hour.alias("_hour")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_day").orderBy("_hour").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_hour", before.alias("_before"))
    rank = F.row_number().over(W.partitionBy("_hour").orderBy(at, tie))
    ranked = log.withColumn("_hour", hour).withColumn("_rank", rank).join(offsets, "_hour")
    return ranked.withColumn("admitted", F.col("_rank") + F.col("_before") <= cap).drop("_hour", "_rank", "_before")


def tail(log: DataFrame, at: str, tie: str, n: int) -> DataFrame:
    """The last ``n`` rows, newest last."""
    return log.orderBy(F.desc(at), F.desc(tie)).limit(n).orderBy(F.asc(at), F.asc(tie))


def recent(df: DataFrame, owner: str, item: str, at: str, keep: int = 20) -> DataFrame:
    """Per owner the newest ``keep`` items, each once with its latest time."""
    last = df.groupBy(owner, item).agg(F.max(at).alias(at))
    rank = F.row_number().over(W.partitionBy(owner).orderBy(F.desc(at), F.asc(item)))
    return last.withColumn("place", rank).where(F.col("place") <= keep)
