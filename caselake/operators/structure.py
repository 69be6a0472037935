"""Structure of a Bayesian network over context columns: scores of candidate edges, greedy search, updates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselake.operators.context import k_context
from caselake.operators.density import NumericNode, numeric_node
from caselake.operators.model import Node, train
from caselake.operators.statistics import CountStore, Family, columns_of, family, likelihoods, named_counts, search
from caselake.operators.stats import functional_dependencies
from caselake.plans.log import EventLog, as_category
from caselake.plans.order import checkpointed

GAIN = 1e-10


def family_scores(df: DataFrame, families: list[tuple[str, tuple[str, ...]]], weight: str | None = None) -> DataFrame:
    """(node, parents, loglik, tuples): sum of n ln(n / n_parents), and the number of parent tuples, of many families.

    All families come from one pass over the rows, or over counts of them if ``weight`` names the count. ``parents`` is a
    comma-joined sorted list.
    """
    families = [family(n, p) for n, p in families]
    return likelihoods(named_counts(df, list(dict.fromkeys(map(columns_of, families))), weight), families)


def edge_deltas(df: DataFrame, parents: dict[str, tuple[str, ...]], candidates: list[tuple[str, str]]) -> DataFrame:
    """(parent, node, delta): change of (log-likelihood - tuples) when an edge is added, or removed if it is there."""
    changed = {(a, b): tuple(sorted({*parents.get(b, ())} ^ {a})) for a, b in candidates}
    families = [(b, p) for (_, b), p in changed.items()] + [(b, parents.get(b, ())) for _, b in candidates]
    scores = family_scores(df, families).select("node", F.col("parents").alias("key"), (F.col("loglik") - F.col("tuples")).alias("s"))
    table = df.sparkSession.createDataFrame([(a, b, ",".join(changed[a, b]), ",".join(sorted(parents.get(b, ())))) for a, b in candidates], "parent string, node string, after string, before string")
    after, before = scores.withColumnsRenamed({"key": "after", "s": "sa"}), scores.withColumnsRenamed({"key": "before", "s": "sb"})
    return table.join(after, ["node", "after"]).join(before, ["node", "before"]).select("parent", "node", (F.col("sa") - F.col("sb")).alias("delta"))


def creates_cycle(parents: dict[str, set[str]], a: str, b: str) -> bool:
    """Whether the edge a -> b closes a cycle, i.e. b is an ancestor of a."""
    open_, seen = [a], set()
    while open_:
        x = open_.pop()
        if x == b:
            return True
        if x not in seen:
            seen.add(x)
            open_ += parents.get(x, ())
    return False


def learn(df: DataFrame, allowed: list[tuple[str, str]], start: list[tuple[str, str]] = (), fixed: list[tuple[str, str]] = (), most: int | None = None) -> list[tuple[str, str]]:
    """Greedy search: in each round the addition or removal with the largest gain, until none is above 1e-10.

    ``fixed`` edges always stay; ``most`` limits the rounds, if given. Each round raises the score, so the search ends. Rows are
    counted once; scores are memoized by family, so after the first round only the changed node's are computed. The driver
    holds one number for each candidate.
    """
    columns = sorted({c for e in (*allowed, *start, *fixed) for c in e})
    counts = checkpointed(df.groupBy(*(as_category(c).alias(c) for c in columns)).agg(F.count("*").alias("_rows")))

    def score(families: list[Family]) -> dict[Family, float]:
        found = family_scores(counts, families, "_rows").collect()  # one row a family
        return {family(r["node"], filter(None, r["parents"].split(","))): r["loglik"] - r["tuples"] for r in found}

    return search(score, allowed, creates_cycle, start, fixed, most, GAIN)


def learn_from_counts(store: CountStore, allowed: list[tuple[str, str]], start: list[tuple[str, str]] = (), fixed: list[tuple[str, str]] = (), most: int | None = None) -> list[tuple[str, str]]:
    """The search of ``learn`` over a store of counts, which may hold numeric columns.

    A numeric node takes numeric and categorical parents, and moves of its edges are scored by conditional densities; a
    categorical node takes categorical parents only.
    """
    possible = [(a, b) for a, b in allowed if a not in store.numeric or b in store.numeric]
    return search(store.scores, possible, creates_cycle, start, fixed, most, GAIN)


def model_score(df: DataFrame, parents: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row: total log-likelihood, complexity (tuples) and their difference."""
    s = family_scores(df, list(parents.items()))
    return s.agg(F.sum("loglik").alias("loglik"), F.sum("tuples").alias("complexity")).withColumn("score", F.col("loglik") - F.col("complexity"))


def strongly_connected(pairs: set[tuple[str, str]]) -> list[set[str]]:
    """Groups of columns that determine each other, on a graph with as many nodes as columns."""
    nodes = {c for p in pairs for c in p}
    reach = {a: {a} for a in nodes}
    for _ in nodes:
        for a, b in pairs:
            reach[a] |= reach[b]
    groups, left = [], set(nodes)
    while left:
        a = min(left)
        group = {b for b in left if b in reach[a] and a in reach[b]}
        groups.append(group)
        left -= group
    return groups


def without_cycles(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Inside a group of mutual dependencies all but the smallest node depend on that one only."""
    lead = {c: min(g) for g in strongly_connected(set(pairs)) for c in g}
    return sorted((a, b) for a, b in pairs if lead[a] != lead[b] or a == lead[a])


def allowed_edges(attributes: list[str], k: int, only: str | None = None) -> list[tuple[str, str]]:
    """Previous to current, and current to current; into ``only`` if given."""
    previous = [f"{a}_Prev{i}" for a in attributes for i in range(k)]
    into = [only] if only else attributes
    return [(p, a) for a in into for p in previous] + [(a, b) for b in into for a in attributes if a != b]


def generate_model(log: EventLog, only_activity: bool = False, threshold: float = 0.99, remove: tuple[str, ...] = ()) -> tuple[dict[str, Node], list[tuple[str, str]], list[tuple[str, str]]]:
    """Context, functional dependencies without cycles, greedy search over the rest, and the tables: nodes, edges, dependencies."""
    attributes = [a for a in log.attributes() if not a.startswith(remove or ("\0",))]
    df = checkpointed(k_context(log, columns=attributes))
    previous = [f"{a}_Prev{i}" for a in attributes for i in range(log.spec.k)]
    later = df.where(F.col(previous[0]) != "0") if previous else df
    found = functional_dependencies(later, [*attributes, *previous], attributes, threshold).collect()  # columns squared at most
    dependencies = without_cycles([(r["parent"], r["child"]) for r in found])
    allowed = [e for e in allowed_edges(attributes, log.spec.k, log.spec.activity if only_activity else None) if e not in dependencies]
    edges = learn(df, allowed)
    structure = {a: ([p for p, c in edges if c == a], [p for p, c in dependencies if c == a]) for a in attributes}
    return train(df, structure), edges, dependencies


def mixed_context(log: EventLog, numeric: list[str]) -> DataFrame:
    """The context of all attributes and of numeric columns, whose earlier values are null where there are none."""
    s, w = log.spec, log.window()
    df = k_context(log, columns=log.attributes())
    return df.withColumns({f"{c}_Prev{i}": F.lag(c, i + 1).over(w) for c in numeric for i in range(s.k)})


def mixed_edges(log: EventLog, numeric: list[str]) -> list[tuple[str, str]]:
    """Edges that a search over mixed nodes may use: those of ``allowed_edges``, and into each numeric column from its own and
    other numeric columns' earlier values, other numeric columns, and attributes of the event."""
    into = [(f"{p}_Prev{i}", c) for c in numeric for p in numeric for i in range(log.spec.k)]
    same = [(p, c) for c in numeric for p in (*numeric, *log.attributes()) if p != c]
    return allowed_edges(log.attributes(), log.spec.k) + into + same


def generate_mixed_model(log: EventLog, numeric: dict[str, tuple[float, float]]) -> tuple[dict[str, Node | NumericNode], list[tuple[str, str]]]:
    """Nodes and edges of a model with numeric columns, each given with a bandwidth and a cell width. The rows are counted once;
    the search works on counts. ``model.score_events`` takes the nodes on rows of ``mixed_context``."""
    df = checkpointed(mixed_context(log, list(numeric)))
    widths = {f"{c}{x}": v for c, v in numeric.items() for x in ("", *(f"_Prev{i}" for i in range(log.spec.k)))}
    allowed = mixed_edges(log, list(numeric))
    store = CountStore(df.sparkSession, {c for e in allowed for c in e}, widths)
    store.add(df)
    edges = learn_from_counts(store, allowed)
    parents = {c: [a for a, b in edges if b == c] for c in (*log.attributes(), *numeric)}
    nodes = train(df, {a: (parents[a], []) for a in log.attributes()})
    for c in numeric:
        continuous, discrete = ([p for p in parents[c] if (p in widths) == kind] for kind in (True, False))
        h, d = zip(*(widths[x] for x in (*continuous, c)), strict=True)
        nodes[c] = numeric_node(df, c, continuous, discrete, list(h), list(d))
    return nodes, edges


def update_model(log: EventLog, edges: list[tuple[str, str]], dependencies: list[tuple[str, str]], only_activity: bool = False) -> tuple[dict[str, Node], list[tuple[str, str]]]:
    """The search started from the old edges on new data, and all tables learned again."""
    attributes = log.attributes()
    df = checkpointed(k_context(log, columns=attributes))
    allowed = [e for e in allowed_edges(attributes, log.spec.k, log.spec.activity if only_activity else None) if e not in dependencies]
    edges = learn(df, allowed, start=edges)
    return train(df, {a: ([p for p, c in edges if c == a], [p for p, c in dependencies if c == a]) for a in attributes}), edges


def subsets(columns: list[str], most: int) -> list[tuple[str, ...]]:
    return [s for r in range(most + 1) for s in combinations(columns, r)]
