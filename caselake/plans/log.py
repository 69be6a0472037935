"""A log is a DataFrame of events and a description of its columns."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class LogSpec:
    """Names of the columns of a log. Without ``case`` each row is a unit of its own and there is no context."""

    case: str | None = "case_id"
    activity: str = "activity"
    order: tuple[str, ...] = ("time",)
    time: str | None = "time"
    resource: str | None = None
    categorical: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    k: int = 2


@dataclass(frozen=True)
class Setting:
    """An experiment: context length, split, unit, end event, percentage, folds, least case length."""

    k: int | None = None
    split: str = "train-test"
    by_case: bool = False
    add_end: bool = False
    percentage: float = 66.0
    folds: int = 3
    longer_than: int | None = None


@dataclass(frozen=True)
class EventLog:
    df: DataFrame
    spec: LogSpec = field(default_factory=LogSpec)

    def window(self) -> WindowSpec:
        """The one window that all operators over a case use, so that a plan has one exchange and sort for them."""
        return Window.partitionBy(self.spec.case).orderBy(*self.spec.order)

    def with_df(self, df: DataFrame, **changes) -> EventLog:
        return EventLog(df, replace(self.spec, **changes) if changes else self.spec)

    def attributes(self) -> list[str]:
        """Categorical attributes with the activity first, without case, time and order."""
        return [self.spec.activity, *(c for c in self.spec.categorical if c != self.spec.activity)]


def column_kinds(df: DataFrame, categorical: tuple[str, ...] = (), numeric: tuple[str, ...] = ()) -> dict[str, str]:
    """``numeric`` for floating-point columns, ``categorical`` for all others; the two lists override."""
    kinds = {f.name: "numeric" if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else "categorical" for f in df.schema}
    return kinds | dict.fromkeys(categorical, "categorical") | dict.fromkeys(numeric, "numeric")


def detect(df: DataFrame, case: str | None, activity: str, order: tuple[str, ...], time: str | None = None, resource: str | None = None, k: int = 2) -> EventLog:
    """A log whose attribute kinds come from the column types."""
    special = {case, time, *order} - {activity, resource}
    kinds = {c: kind for c, kind in column_kinds(df).items() if c not in special}
    of = lambda kind: tuple(c for c, x in kinds.items() if x == kind)
    return EventLog(df, LogSpec(case, activity, order, time, resource, of("categorical"), of("numeric"), k if case else 0))


#: Columns of each table that its log uses: case, activity, time, resource, numeric, and what orders equal times.
CATALOGUE: dict[str, tuple[str, dict[str, str], LogSpec]] = {
    "events": (
        "events",
        {"case_id": "user_id", "activity": "event_type", "time": "ts", "resource": "get_json_object(props, '$.k')", "value": "value", "tie": "event_id"},
        LogSpec(order=("time", "tie"), resource="resource", categorical=("activity", "resource"), numeric=("value",)),
    ),
    "shipping": (
        "lineitem",
        {"case_id": "l_orderkey", "activity": "concat(l_returnflag, l_linestatus)", "time": "l_shipdate", "resource": "l_suppkey", "part": "l_partkey", "line": "l_linenumber", "quantity": "l_quantity", "price": "l_extendedprice"},
        LogSpec(order=("time", "line", "part", "resource", "quantity", "price"), resource="resource", categorical=("activity", "resource"), numeric=("quantity", "price")),
    ),
    "ordering": (
        "orders",
        {"case_id": "o_custkey", "activity": "o_orderpriority", "time": "o_orderdate", "status": "o_orderstatus", "price": "o_totalprice", "tie": "o_orderkey"},
        LogSpec(order=("time", "tie"), categorical=("activity", "status"), numeric=("price",)),
    ),
    "dialog": ("conversations", {"case_id": "conv_id", "activity": "role", "turn": "turn"}, LogSpec(order=("turn",), time=None, categorical=("activity",))),
}


def get_log(spark: SparkSession, sf_dir: str, name: str) -> EventLog:
    """A named log; the column list reaches the scan, so nothing else is read."""
    table, columns, spec = CATALOGUE[name]
    return EventLog(spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{e} AS {c}" for c, e in columns.items())), spec)


def get_all_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All logs under each other with their name; columns a log lacks are null."""
    out = None
    for name in CATALOGUE:
        df = get_log(spark, sf_dir, name).df.withColumn("log", F.lit(name)).withColumn("case_id", F.col("case_id").cast("long"))
        df = df.withColumn("resource", F.col("resource").cast("string")) if "resource" in df.columns else df
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def as_category(c: str | Column) -> Column:
    """Categories are compared as text, null being one of its own."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("nan"))
