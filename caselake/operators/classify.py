"""Classifiers over the k-context by Spark's own learners."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, IndexToString, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.recommendation import ALS
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselake.plans.log import as_category
from caselake.plans.order import checkpointed, written


def train_linear(df: DataFrame, label: str, columns: list[str], iterations: int = 30, regularisation: float = 1e-3) -> PipelineModel:
    """A softmax over one weight for each (column, value, label): a dense layer over one embedding for each column.

    Equal rows are one with their number as weight, so after one count of the rows a fit costs their different values only.
    Features are divided by their deviation over all rows before the fit, as the learner's own scaling takes weights for shares.
    """
    counts = checkpointed(df.groupBy(as_category(label).alias("label"), *(as_category(c).alias(c) for c in columns)).agg(F.count("*").cast("double").alias("weight")))
    coded = Pipeline(stages=[
        StringIndexer(inputCol="label", outputCol="label_id", handleInvalid="keep", stringOrderType="alphabetAsc"),
        StringIndexer(inputCols=columns, outputCols=[f"{c}_id" for c in columns], handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=[f"{c}_id" for c in columns], outputCols=[f"{c}_hot" for c in columns], handleInvalid="keep"),
        VectorAssembler(inputCols=[f"{c}_hot" for c in columns], outputCol="hot"),
    ]).fit(counts)
    rows = coded.transform(counts)
    means, n = rows.agg(Summarizer.mean(F.col("hot"), F.col("weight")), F.sum("weight")).first()  # a number for each value
    scale = [1 / math.sqrt(p * (1 - p) * n / (n - 1)) if 0 < p < 1 else 0.0 for p in means]
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(scale), inputCol="hot", outputCol="x")
    fitted = LogisticRegression(featuresCol="x", labelCol="label_id", weightCol="weight", predictionCol="y", family="multinomial", maxIter=iterations, regParam=regularisation, standardization=False).fit(scaled.transform(rows))
    return PipelineModel([*coded.stages, scaled, fitted])


def test_linear(model: PipelineModel, df: DataFrame, label: str, columns: list[str], keys: list[str]) -> DataFrame:
    """(keys, expected, predicted, p_predicted, p_expected)."""
    names = model.stages[0].labels
    rows = model.transform(df.select(*(F.col(k).alias(f"key_{k}") for k in keys), as_category(label).alias("label"), *(as_category(c).alias(c) for c in columns)))
    rows = IndexToString(inputCol="y", outputCol="predicted", labels=[*names, "0"]).transform(rows)
    p = vector_to_array("probability")
    return rows.select(
        *(F.col(f"key_{k}").alias(k) for k in keys), F.col("label").alias("expected"), "predicted",
        F.get(p, F.col("y").cast("int")).alias("p_predicted"), F.coalesce(F.get(p, F.col("label_id").cast("int")), F.lit(0.0)).alias("p_expected"),
    )


def test_and_update(df: DataFrame, batch: str, label: str, columns: list[str], keys: list[str], kept: int | None = None) -> DataFrame:
    """Results of every batch after the first by a classifier that is updated with each batch once it has been tested.

    An update fits on the last ``kept`` batches: 1 is the batch alone, more are retained data, None is all so far. The loop is
    over the batches, which are calendar units; each fit and test is a Spark job over their rows.
    """
    batches = [r[0] for r in df.select(batch).distinct().orderBy(batch).collect()]
    out = None
    for i in range(1, len(batches)):
        learned = batches[max(0, i - kept) : i] if kept else batches[:i]
        model = train_linear(df.where(F.col(batch).between(learned[0], learned[-1])), label, columns)
        part = written(test_linear(model, df.where(F.col(batch) == batches[i]), label, columns, keys))  # labels and weights leave the plan
        out = part if out is None else out.unionByName(part)
    return df.select(*keys, *(F.lit("").alias(c) for c in ("expected", "predicted")), *(F.lit(0.0).alias(c) for c in ("p_predicted", "p_expected"))).limit(0) if out is None else out


def co_occurrence_embedding(pairs: DataFrame, a: str, b: str, seed: int = 42) -> DataFrame:
    """(kind, value, embedding): vectors of two columns whose products approach how often values meet; dimension is the
    fourth root of (values of a times values of b), rounded up."""
    counts = pairs.groupBy(as_category(a).alias("a"), as_category(b).alias("b")).agg(F.count("*").cast("float").alias("n"))
    model = Pipeline(stages=[StringIndexer(inputCols=["a", "b"], outputCols=["ia", "ib"], stringOrderType="alphabetAsc")]).fit(counts)
    la, lb = model.stages[0].labelsArray
    rank = max(1, -int(-((len(la) * len(lb)) ** 0.25) // 1))
    coded = model.transform(counts).select(F.col("ia").cast("int").alias("ia"), F.col("ib").cast("int").alias("ib"), "n")
    als = ALS(userCol="ia", itemCol="ib", ratingCol="n", rank=rank, implicitPrefs=True, seed=seed, maxIter=10).fit(coded)
    out = None
    for kind, labels, factors in ((a, la, als.userFactors), (b, lb, als.itemFactors)):
        named = IndexToString(inputCol="at", outputCol="value", labels=list(labels)).transform(factors.withColumn("at", F.col("id").cast("double")))
        part = named.select(F.lit(kind).alias("kind"), "value", F.col("features").alias("embedding"))
        out = part if out is None else out.unionByName(part)
    return out
