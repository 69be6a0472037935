"""Models that are tables: conditional counts, functional dependencies, value frequencies; and scores from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caselake.plans.log import EventLog, as_category
from caselake.plans.order import checkpointed

FLOOR = 1e-10


def key_of(columns: list[str]) -> Column:
    """The values of the parents as one array; also the key of "no parents"."""
    return F.array(*(as_category(c) for c in columns)) if columns else F.array(F.lit(""))


def conditional_table(df: DataFrame, value: str, parents: list[str]) -> DataFrame:
    """(parents, value, n, n_parents, p, p_parents): counts of a value given the values of its parents, and probabilities."""
    counts = df.groupBy(key_of(parents).alias("parents"), as_category(value).alias("value")).agg(F.count("*").alias("n"))
    return with_probabilities(counts)


def with_probabilities(counts: DataFrame) -> DataFrame:
    """Derive n_parents, p and p_parents from (parents, value, n). The total is one row, joined, so no window has all rows."""
    given = counts.withColumn("n_parents", F.sum("n").over(Window.partitionBy("parents")))
    total = counts.agg(F.sum("n").alias("total"))
    return given.join(F.broadcast(total)).select("parents", "value", "n", "n_parents", (F.col("n") / F.col("n_parents")).alias("p"), (F.col("n_parents") / F.col("total")).alias("p_parents"))


def update_table(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts are additive: the table of old and new events together."""
    return with_probabilities(old.select("parents", "value", "n").unionByName(new.select("parents", "value", "n")).groupBy("parents", "value").agg(F.sum("n").alias("n")))


def new_relation_rate(df: DataFrame, parents: list[str]) -> DataFrame:
    """One row: different parent tuples for each row; 1 without parents."""
    rate = (F.count_distinct(key_of(parents)) / F.count("*")) if parents else F.lit(1.0)
    return df.agg(rate.alias("rate"))


def value_frequency(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share)."""
    counts = df.groupBy(as_category(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("value", "n", (F.col("n") / F.col("total")).alias("share"))


def dependency_table(df: DataFrame, parent: str, child: str) -> DataFrame:
    """(parent_value, value, violation): the commonest child value of each parent value (ties: smallest), and the share of
    rows with another."""
    counts = df.groupBy(as_category(parent).alias("parent_value"), as_category(child).alias("value")).agg(F.count("*").alias("n"))
    best = counts.groupBy("parent_value").agg(F.max(F.struct("n")).alias("m"), F.sum("n").alias("all"))
    top = counts.join(best, "parent_value").where(F.col("n") == F.col("m.n")).groupBy("parent_value").agg(F.min("value").alias("value"), F.first("n").alias("n"), F.first("all").alias("all"))
    rate = top.agg(((F.sum("all") - F.sum("n")) / F.sum("all")).alias("violation"))
    return top.join(F.broadcast(rate)).select("parent_value", "value", "violation")


@dataclass
class Node:
    """Tables of one attribute."""

    name: str
    parents: list[str] = field(default_factory=list)
    dependencies: list[str] = field(default_factory=list)
    table: DataFrame | None = None
    relation_rate: float = 1.0
    values: DataFrame | None = None
    value_rate: float = 0.0
    dependency_tables: dict[str, DataFrame] = field(default_factory=dict)
    violations: dict[str, float] = field(default_factory=dict)


def train(df: DataFrame, structure: dict[str, tuple[list[str], list[str]]]) -> dict[str, Node]:
    """Nodes of ``structure``: name -> (conditional parents, functional parents).

    The rows are read once for each table; tables are checkpointed, as training and scoring use them several times. The rates
    come from the tables, and only they go to the driver.
    """
    out = {}
    for name, (parents, dependencies) in structure.items():
        table = checkpointed(conditional_table(df, name, parents))
        rates = table.agg(F.count_distinct("value").alias("v"), F.count_distinct("parents").alias("r"), F.sum("n").alias("n")).first()
        node = Node(name, parents, dependencies, relation_rate=rates["r"] / rates["n"] if parents and rates["n"] else 1.0, value_rate=rates["v"] / rates["n"] if rates["n"] else 1.0)
        node.table = table if parents else None
        node.values = checkpointed(table.select("value").distinct())
        for d in dependencies:
            node.dependency_tables[d] = checkpointed(dependency_table(df, d, name))
            r = node.dependency_tables[d].agg(F.first("violation")).first()
            node.violations[d] = r[0] or 0.0
        out[name] = node
    return out


def score_events(df: DataFrame, nodes: dict[str, Node]) -> DataFrame:
    """Add ``score_<attribute>``: ln of the product of three parts, at least 1e-10.

    Functional parents: 1 - v if the child is as expected, the parent's value is unknown or "no event"; else v. Conditional
    table: the rate r of new parent tuples if the tuple is unknown; (1-r) r if only the value is; else (1-r) p; 1 without
    parents. Value: the rate of new values if unknown, else 1 minus it. Numeric nodes (``density.NumericNode``) add the ln of
    their conditional density. Scoring changes nothing in the model.
    """
    for node in nodes.values():
        if not isinstance(node, Node):
            df = node.add_score(df)
            continue
        c, parts = as_category(node.name), []
        for d, table in node.dependency_tables.items():
            v = F.lit(node.violations[d])
            df = df.join(table.select(F.col("parent_value").alias("_pv"), F.col("value").alias("_ev")), as_category(d) == F.col("_pv"), "left")
            df = df.withColumn(f"_fd_{d}", F.when(F.col("_ev").isNull() | (as_category(d) == "0") | (F.col("_ev") == c), 1 - v).otherwise(v)).drop("_pv", "_ev")
            parts.append(f"_fd_{d}")
        if node.table is not None:
            r = F.lit(node.relation_rate)
            known = node.table.select(F.col("parents").alias("_p")).distinct().withColumn("_known", F.lit(True))
            exact = node.table.select(F.col("parents").alias("_p2"), F.col("value").alias("_v2"), F.col("p").alias("_pr"))
            df = df.withColumn("_key", key_of(node.parents)).join(known, F.col("_key") == F.col("_p"), "left").join(exact, (F.col("_key") == F.col("_p2")) & (c == F.col("_v2")), "left")
            df = df.withColumn("_ct", F.when(F.col("_known").isNull(), r).otherwise((1 - r) * F.coalesce("_pr", r))).drop("_key", "_p", "_known", "_p2", "_v2", "_pr")
            parts.append("_ct")
        df = df.join(node.values.select(F.col("value").alias("_v")), c == F.col("_v"), "left")
        df = df.withColumn("_nv", F.when(F.col("_v").isNull(), F.lit(node.value_rate)).otherwise(1 - F.lit(node.value_rate))).drop("_v")
        parts.append("_nv")
        product = F.lit(1.0)
        for p in parts:
            product = product * F.col(p)
        df = df.withColumn(f"score_{node.name}", F.ln(F.greatest(product, F.lit(FLOOR)))).drop(*parts)
    return df


def score_columns(scored: DataFrame) -> list[str]:
    return [c for c in scored.columns if c.startswith("score_")]


def case_scores(scored: DataFrame, case: str) -> DataFrame:
    """(case, events, a mean for each attribute, score): the score is the sum of the attributes' means over events."""
    columns = score_columns(scored)
    means = scored.groupBy(case).agg(F.count("*").alias("events"), *(F.avg(c).alias(c) for c in columns))
    return means.withColumn("score", sum((F.col(c) for c in columns[1:]), F.col(columns[0])))


def scores_by_attribute(scores: DataFrame, case: str) -> DataFrame:
    """(case, attribute, score)."""
    columns = score_columns(scores)
    long = scores.unpivot(case, columns, "attribute", "score")
    return long.withColumn("attribute", F.regexp_replace("attribute", "^score_", ""))


def ranked_report(scores: DataFrame, labels: DataFrame, case: str, label: str, n: int | None = None) -> DataFrame:
    """Cases with score and label, most anomalous first; ``n`` keeps the top."""
    out = scores.select(case, "score").join(labels.select(case, label), case).orderBy("score", case)
    return out.limit(n) if n else out


def reference_level(scores: DataFrame) -> DataFrame:
    """One row: mean and population standard deviation of the training scores."""
    return scores.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def save(nodes: dict[str, Node], folder: str) -> None:
    """Write the tables of a model under ``folder`` and its rates as one more table."""
    spark = None
    rows = []
    for n in nodes.values():
        spark = n.values.sparkSession
        n.values.write.mode("overwrite").parquet(f"{folder}/{n.name}/values")
        if n.table is not None:
            n.table.write.mode("overwrite").parquet(f"{folder}/{n.name}/table")
        for d, t in n.dependency_tables.items():
            t.write.mode("overwrite").parquet(f"{folder}/{n.name}/dependency_{d}")
        rows.append((n.name, n.parents, n.dependencies, n.relation_rate, n.value_rate, [n.violations[d] for d in n.dependencies]))
    spark.createDataFrame(rows, "name string, parents array<string>, dependencies array<string>, relation_rate double, value_rate double, violations array<double>").write.mode("overwrite").parquet(f"{folder}/_nodes")


def load(spark: SparkSession, folder: str) -> dict[str, Node]:
    out = {}
    for r in spark.read.parquet(f"{folder}/_nodes").collect():  # one row an attribute
        at = f"{folder}/{r['name']}"
        tables = {d: spark.read.parquet(f"{at}/dependency_{d}") for d in r["dependencies"]}
        out[r["name"]] = Node(r["name"], r["parents"], r["dependencies"], spark.read.parquet(f"{at}/table") if r["parents"] else None, r["relation_rate"], spark.read.parquet(f"{at}/values"), r["value_rate"], tables, dict(zip(r["dependencies"], r["violations"], strict=True)))
    return out


def default_structure(log: EventLog) -> dict[str, tuple[list[str], list[str]]]:
    """Each attribute given its own last values and the attributes before it in the same event."""
    attributes = log.attributes()
    return {a: ([f"{a}_Prev{i}" for i in range(log.spec.k)] + attributes[:n], []) for n, a in enumerate(attributes)}
