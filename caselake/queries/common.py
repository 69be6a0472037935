"""Helpers of the query modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselake.plans.log import EventLog, get_log
from caselake.plans.order import folder  # noqa: F401  (for the query modules)


def r6(c: str | Column) -> Column:
    """Rounded to six places, without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def events(spark: SparkSession, d: str) -> EventLog:
    return get_log(spark, d, "events")


def shipping(spark: SparkSession, d: str) -> EventLog:
    return get_log(spark, d, "shipping")


def ordering(spark: SparkSession, d: str) -> EventLog:
    return get_log(spark, d, "ordering")


def dialog(spark: SparkSession, d: str) -> EventLog:
    return get_log(spark, d, "dialog")


def long_text(c: str, separator: str = ",") -> Column:
    """An array as one text."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), separator)


def labelled_orders(spark: SparkSession, d: str) -> DataFrame:
    return ordering(spark, d).df
