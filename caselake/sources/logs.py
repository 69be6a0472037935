"""Logs in files: delimited text, XES and MXML (by Spark's own readers), and back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselake.functions.columns import parse_time
from caselake.operators.prepare import dictionary, encode
from caselake.plans.log import EventLog, as_category
from caselake.plans.order import folder

_ATTRIBUTES = T.ArrayType(T.StructType([T.StructField("_key", T.StringType()), T.StructField("_value", T.StringType())]))
_XES_EVENT = T.StructType([T.StructField("string", _ATTRIBUTES), T.StructField("date", _ATTRIBUTES), T.StructField("int", _ATTRIBUTES), T.StructField("float", _ATTRIBUTES)])
_XES = T.StructType([T.StructField("string", _ATTRIBUTES), T.StructField("event", T.ArrayType(_XES_EVENT))])
_MXML_DATA = T.StructType([T.StructField("attribute", T.ArrayType(T.StructType([T.StructField("_name", T.StringType()), T.StructField("_VALUE", T.StringType())])))])
_MXML_ENTRY = T.StructType([T.StructField(n, t) for n, t in (("WorkflowModelElement", T.StringType()), ("EventType", T.StringType()), ("Timestamp", T.StringType()), ("Originator", T.StringType()), ("Data", _MXML_DATA))])
_MXML = T.StructType([T.StructField("_id", T.StringType()), T.StructField("AuditTrailEntry", T.ArrayType(_MXML_ENTRY))])


def unpacked(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """A folder with the text of a zip archive of one file, as UTF-8.

    An archive can't be split, so one task unpacks it, some megabytes at a time, into the folder that the session shares; what
    reads the folder then has many tasks.
    """

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for content in (c for batch in batches for c in batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                (name,) = archive.namelist()
                with archive.open(name) as f:
                    while some := f.readlines(1 << 23):
                        yield pd.DataFrame({"value": [x.rstrip(b"\r\n").decode(encoding) for x in some]})

    at = folder(spark, "unpacked")
    spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "value string").write.text(at)
    return at


def read_delimited(spark: SparkSession, path: str, schema: str | T.StructType | None = None, separator: str = ",", header: bool = True, rows: int | None = None, encoding: str = "ISO-8859-1", time_format: str | None = None) -> DataFrame:
    """Delimited text, plain, gzip or zip. With ``schema`` nothing is inferred; ``rows`` limits the read."""
    if path.lower().endswith(".zip"):
        path, encoding = unpacked(spark, path, encoding), "UTF-8"
    reader = spark.read.options(sep=separator, header=header, encoding=encoding)
    if time_format:
        reader = reader.option("timestampNTZFormat", time_format)
    df = reader.csv(path, schema=schema) if schema else reader.csv(path, inferSchema=True)
    return df.limit(rows) if rows else df


def read_start_end(spark: SparkSession, path: str, columns: dict[str, int], separator: str = ",", time_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Columns by number: name -> position; ``start`` and ``end`` become timestamps."""
    raw = spark.read.options(sep=separator, header=True).csv(path)
    out = raw.select(*(F.col(f"`{raw.columns[i]}`").alias(n) for n, i in columns.items()))
    return out.withColumns({n: F.to_timestamp_ntz(n, F.lit(time_format)) for n in ("start", "end") if n in columns})


def normalise(df: DataFrame, case: str, activity: str, time: str) -> DataFrame:
    """(case_id, activity_id, time): names made uniform, times parsed from either format, activities numbered from 1."""
    named = df.select(F.col(case).alias("case_id"), F.col(activity).cast("string").alias("activity"), parse_time(F.col(time).cast("string")).alias("time"))
    return encode(named, ["activity"], dictionary(named, ["activity"])).withColumnRenamed("activity", "activity_id")


def _value(list_, key: str):
    """The value of a key in a list of (key, value); null without it."""
    return F.get(F.filter(list_, lambda a: a["_key"] == key), F.lit(0))["_value"]


def read_xes(spark: SparkSession, path: str, names_only: bool = False) -> DataFrame:
    """(case_id, position, activity, resource, lifecycle, time) of an XES file; one task reads a piece of the file at trace tags.

    ``names_only`` gives case, position, activity and time.
    """
    traces = spark.read.format("xml").option("rowTag", "trace").schema(_XES).load(path)
    events = traces.select(_value(F.col("string"), "concept:name").alias("case_id"), F.posexplode("event").alias("position", "e"))
    of = lambda kind, key: _value(F.col(f"e.{kind}"), key)
    out = events.select("case_id", "position", of("string", "concept:name").alias("activity"), of("string", "org:resource").alias("resource"), of("string", "lifecycle:transition").alias("lifecycle"), F.to_timestamp(of("date", "time:timestamp")).alias("time"))
    return out.select("case_id", "position", "activity", "time") if names_only else out


def write_mxml(log: EventLog, path: str) -> None:
    """Write cases as process instances with their events (activity, resource, complete) in order."""
    s = log.spec
    entry = F.struct(
        as_category(s.activity).alias("WorkflowModelElement"), F.lit("complete").alias("EventType"),
        F.date_format(s.time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("Timestamp"), as_category("resource").alias("Originator"),
    )
    rows = log.df.select(F.col(s.case).cast("string").alias("_id"), F.struct(*s.order, entry.alias("e")).alias("e"))
    cases = rows.groupBy("_id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["e"]).alias("AuditTrailEntry"))
    cases.write.format("xml").options(rootTag="Process", rowTag="ProcessInstance").mode("overwrite").save(path)


def read_mxml(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, position, activity, lifecycle, resource, time) of an MXML file."""
    cases = spark.read.format("xml").option("rowTag", "ProcessInstance").schema(_MXML).load(path)
    events = cases.select(F.col("_id").alias("case_id"), F.posexplode("AuditTrailEntry").alias("position", "e"))
    return events.select("case_id", "position", F.col("e.WorkflowModelElement").alias("activity"), F.col("e.EventType").alias("lifecycle"), F.col("e.Originator").alias("resource"), F.to_timestamp("e.Timestamp").alias("time"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch by extension (before .gz or .zip)."""
    name = path.lower().removesuffix(".gz").removesuffix(".zip")
    for end, read in ((".xes", read_xes), (".mxml", read_mxml), (".csv", read_delimited), (".txt", read_delimited)):
        if name.endswith(end):
            zipped = read is not read_delimited and path.lower().endswith(".zip")
            return read(spark, unpacked(spark, path) if zipped else path)
    return spark.read.parquet(path)


def write_xes(log: EventLog, path: str) -> None:
    """Write an XES file of traces with names, resources and times; read back by :func:`read_xes`."""
    s = log.spec
    attribute = lambda key, value: F.struct(F.lit(key).alias("_key"), value.cast("string").alias("_value"))
    strings = [attribute("concept:name", F.col(s.activity))] + ([attribute("org:resource", F.col(s.resource))] if s.resource else [])
    event = F.struct(F.array(*strings).alias("string"), F.array(attribute("time:timestamp", F.date_format(s.time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))).alias("date"))
    grouped = log.df.groupBy(s.case).agg(F.transform(F.array_sort(F.collect_list(F.struct(*(F.col(o) for o in s.order), event.alias("_event")))), lambda e: e["_event"]).alias("event"))
    grouped.select(F.array(attribute("concept:name", F.col(s.case))).alias("string"), "event").write.format("xml").options(rowTag="trace", rootTag="log").mode("overwrite").save(path)


def write_encoded(log: EventLog, path: str, format: str = "csv") -> DataFrame:
    """Write the log with its categories as ids; returns the dictionary."""
    words = dictionary(log.df, log.attributes())
    writer = encode(log.df, log.attributes(), words).write.mode("overwrite")
    writer.option("header", True).csv(path) if format == "csv" else writer.format(format).save(path)
    return words
