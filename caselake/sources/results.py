"""Scores, predictions and experiments in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselake.plans.log import Setting

SETTING = ["split", "percentage", "unit", "end", "longer_than", "method", "data"]


def write_scores(report: DataFrame, path: str) -> None:
    """Sorted, most anomalous first."""
    report.orderBy("score").write.mode("overwrite").option("header", True).csv(path)


def read_scores(spark: SparkSession, path: str, schema: str = "case_id string, score double, label int") -> DataFrame:
    return spark.read.option("header", True).csv(path, schema=schema)


def tag(results: DataFrame, setting: Setting, method: str, data: str) -> DataFrame:
    """Add the columns that name an experiment."""
    return results.withColumns({k: F.lit(v) for k, v in zip(SETTING, (setting.split, setting.percentage, "case" if setting.by_case else "event", setting.add_end, setting.longer_than or 0, method, data), strict=True)})


def write_predictions(results: DataFrame, folder: str) -> None:
    """Append tagged results, one folder a setting, so that reading some settings reads their files only."""
    results.write.mode("append").partitionBy(*SETTING).parquet(folder)


def read_predictions(spark: SparkSession, folder: str, condition: str | None = None) -> DataFrame:
    df = spark.read.parquet(folder)
    return df.where(condition) if condition else df


def unfinished(grid: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the grid of settings for which no results are there."""
    return grid.join(spark.read.parquet(folder).select(*SETTING).distinct(), SETTING, "left_anti")


def cached(df: DataFrame, folder: str, setting: Setting) -> DataFrame:
    """A prepared log kept by its setting: written once, read afterwards."""
    from pyspark.errors import AnalysisException

    spark, path = df.sparkSession, f"{folder}/{_name(setting)}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        df.write.parquet(path)
        return spark.read.parquet(path)


def _name(setting: Setting) -> str:
    return "_".join(f"{k}-{v}" for k, v in vars(setting).items())
