"""Sources and sinks: text tables, lenient settings, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = "profile string, allow array<string>, deny array<string>, patterns array<string>"


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A table of a folder. With spread, one of fewer file splits than cores is dealt to all cores; rows stay the same."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df._jdf.rdd().getNumPartitions() < cores else df


def settings(lines: DataFrame, column: str = "value") -> DataFrame:
    """Settings rows from JSON text; what is malformed is null, lists are trimmed to sane entries."""
    s = F.from_json(column, SETTINGS, {"mode": "PERMISSIVE"})
    tidy = lambda c, n: F.slice(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (F.length(F.trim(x)) > 0) & (F.length(x) <= n))), 1, 500)
    return lines.select(F.coalesce(s["profile"], F.lit("balanced")).alias("profile"), tidy(s["allow"], 256).alias("allow"), tidy(s["deny"], 256).alias("deny"), tidy(s["patterns"], 512).alias("patterns"))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
