"""Sinks and re-reads: feature tables, predictions, OOF scores, reports.

All outputs are keyed by ``id`` (never positional).  Feature tables are
partitioned by role so a later job reads only the role it needs
(partition pruning); predictions and OOF scores are plain keyed parquet;
reports are small tables written as one CSV file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_feature_table(df: DataFrame, path: str) -> str:
    """A2: wide feature table, one folder per role, id and label last."""
    front = [c for c in df.columns if c not in ("id", "y", "role")]
    df.select(*front, "id", "y", "role").write.mode("overwrite").partitionBy("role").parquet(path)
    return path


def read_feature_table(spark: SparkSession, path: str, role: str) -> DataFrame:
    """A3: re-read one role of a feature table (the role filter prunes the
    other partitions' files)."""
    return spark.read.parquet(path).filter(F.col("role") == role)


def write_predictions(df: DataFrame, path: str, score: str = "score", name: str = "Churn") -> str:
    """A4 / A5: keyed prediction or OOF table (id, score)."""
    return write_scores(df, path, {score: name})


def write_scores(df: DataFrame, path: str, scores: dict[str, str]) -> str:
    """A5: keyed table of several models' scores: (id, the new names of the
    columns of ``scores``)."""
    df.select("id", *[F.col(c).alias(name) for c, name in scores.items()]).write.mode("overwrite").parquet(path)
    return path


def write_report(df: DataFrame, path: str) -> str:
    """A small report table (importances, sweep results) as one CSV
    file; only for tables whose size is bounded by the report itself."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path
