"""Registries of methods and metrics: user code is functions over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from itertools import product
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselake.operators import classify, metrics
from caselake.operators.predict import backoff_tables, predicted_results
from caselake.operators.prepare import by_position, prepare_context, prepare_split
from caselake.plans.log import EventLog, Setting
from caselake.plans.order import checkpointed, with_index, written

Metric = Callable[[DataFrame], DataFrame]
METRICS: dict[str, Metric] = {"accuracy": metrics.accuracy, "precision": metrics.weighted_precision, "recall": metrics.weighted_recall, "brier": metrics.brier}


@dataclass(frozen=True)
class Method:
    """``train(df) -> model``, ``test(model, df, keys) -> (keys, expected, predicted, p_predicted, p_expected)``, ``update(model, df) -> model``."""

    name: str
    train: Callable[..., Any]
    test: Callable[..., DataFrame]
    update: Callable[..., Any] | None = None
    parameters: dict = field(default_factory=dict)


METHODS: dict[str, Method] = {}


def register(method: Method) -> Method:
    METHODS[method.name] = method
    return method


def _parents(df: DataFrame, k: int = 2) -> list[str]:
    return [f"activity_Prev{i}" for i in range(k)]


register(Method(
    "counts",
    lambda df, **p: (backoff_tables(df, "activity", _parents(df, **p)), p),
    lambda model, df, keys: predicted_results(df, model[0], "activity", _parents(df, **model[1]), keys),
))
register(Method(
    "linear",
    lambda df, **p: (classify.train_linear(df, "activity", _parents(df, **p)), p),
    lambda model, df, keys: classify.test_linear(model[0], df, "activity", _parents(df, **model[1]), keys),
))


def cross_validate(method: Method, folded: DataFrame, k: int, keys: list[str], metric: str = "accuracy") -> DataFrame:
    """(fold, metric) over all folds."""
    out = None
    for i in range(k):
        model = method.train(folded.where(F.col("fold") != i), **method.parameters)
        one = METRICS[metric](method.test(model, folded.where(F.col("fold") == i), keys)).withColumn("fold", F.lit(i).cast("long"))
        one = written(one)
        out = one if out is None else out.unionByName(one)
    return out


def experiments(**axes: list) -> list[Setting]:
    """The grid: every combination of the values given for fields of a setting."""
    return [Setting(**dict(zip(axes, values, strict=True))) for values in product(*axes.values())]


def run_experiments(log: EventLog, settings: list[Setting], names: list[str], keys: list[str], metric: str = "accuracy") -> DataFrame:
    """(fields of the setting, method, metric): each method under each setting; ``k-fold`` gives the mean of its folds.

    A setting is prepared once for all its methods, and contexts once for all settings that share them, with the positions of
    their rows, so that a split by position is a comparison. The loop is over experiments; the driver holds one number for each.
    """
    rows, contexts = [], {}
    for setting in settings:
        shared = (setting.k, setting.add_end, setting.longer_than, by_position(setting))
        if shared not in contexts:
            ready = prepare_context(log, setting)
            df = with_index(ready.df, *ready.spec.order, ready.spec.case, name="_place") if by_position(setting) else ready.df
            contexts[shared] = ready.with_df(checkpointed(df))
        ready = prepare_split(contexts[shared], setting, "_place" if by_position(setting) else None)
        df = ready.df.drop("_place") if by_position(setting) else checkpointed(ready.df)
        for name in names:
            method, k = METHODS[name], {"k": ready.spec.k}
            if setting.split == "k-fold":
                found = cross_validate(replace(method, parameters=k), df, setting.folds, keys, metric).agg(F.avg(metric))
            else:
                found = METRICS[metric](method.test(method.train(df.where("split = 'train'"), **k), df.where("split = 'test'"), keys))
            rows.append((*asdict(setting).values(), name, found.first()[0]))
    schema = "k int, split string, by_case boolean, add_end boolean, percentage double, folds int, longer_than int"
    return log.df.sparkSession.createDataFrame(rows, f"{schema}, method string, {metric} double")
