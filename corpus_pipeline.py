"""A corpus pipeline of five stages: quality rules, toxicity, n-gram Jaccard join, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

Defined cases: a null or empty text fails the quality rules, so it leaves in the first stage; taken alone, the other
stages keep it (toxicity scores it as one without matches, it links with nothing, holds no secret and packs as the end
id). Null ids stay; very long texts are read whole; repeated rows are judged row by row until the join keeps one of
each; ties go to the smallest id; an empty table gives an empty result; other columns of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.llm import jaccard_join, packing, quality_rules, secret_scan, toxicity
from veilframe.llm.common import held_out, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Packing and the learnt toxicity model are beyond SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.quality_rules(docs, COLUMNS).where("kept").select(COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the grammar learns from the labels of this stage's documents."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 4, 2))
    return toxicity.toxicity(docs, model, COLUMNS).where(F.col("score") < toxicity.THRESHOLD).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component.

    Of rows that repeat an id, each different text stays, once, with the least of its other columns; rows without an id
    link with nothing and all stay. The texts are shuffled once, by id, and no further for the repeated rows.
    """
    found = jaccard_join.jaccard_components(docs)
    first = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    equal = Window.partitionBy("doc_id", "text").orderBy(*rest)
    kept = docs.select(COLUMNS).join(first, "doc_id", "left_semi").withColumn("__nth", F.row_number().over(equal)).where(F.col("__nth") == 1)
    return kept.select(COLUMNS).unionByName(docs.where(F.col("doc_id").isNull()).select(COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked in the text."""
    masked = secret_scan.redact(docs.select(COLUMNS))
    return masked.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return packing.packed(docs)


STAGES = [("quality rules", quality), ("toxicity", toxic), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread=True)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
