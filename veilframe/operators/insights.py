"""Insights over time and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def monthly(events: DataFrame, ts: str, family: str, months: int = 24, most: int = 10**9) -> DataFrame:
    """month, family, n of the newest months; counts are capped at most."""
    n = events.where(F.col(ts).isNotNull()).groupBy(F.date_format(ts, "yyyy-MM").alias("month"), F.col(family).alias("family")).agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("n"))
    newest = n.select("month").distinct().withColumn("r", F.dense_rank().over(Window.orderBy(F.desc("month")))).where(F.col("r") <= months).select("month")
    return n.join(F.broadcast(newest), "month")  # a row per month at most


def well_formed(stored: DataFrame, most: int = 10**9) -> DataFrame:
    """Rows of (month, family, n) whose month is a year and month and whose n lies in 1 to most; all others are dropped."""
    return stored.where(F.col("month").rlike("^[0-9]{4}-(0[1-9]|1[0-2])$") & F.col("family").isNotNull() & F.col("n").between(1, most))


def all_time(counts: DataFrame, most: int = 10**9) -> DataFrame:
    """family and n over all months, n being most at most."""
    return counts.groupBy("family").agg(F.least(F.sum("n"), F.lit(most)).alias("n"))


def histogram(df: DataFrame, key: str, conf: str) -> DataFrame:
    """Ten-bin histogram of confidences by key."""
    at = F.least(F.lit(9), F.greatest(F.lit(0), F.floor(F.col(conf) * 10))).cast("int")
    return df.groupBy(key, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    w = F.session_window(ts, gap)
    return events.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("runs")).select(key, F.col("w.start").alias("first_at"), "runs")
