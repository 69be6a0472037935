"""Secrets in texts, told apart by how widely each value is copied over the corpus.

Everything here is DataFrame expressions. Candidate spans come from three patterns. The value of each is hashed, and the
corpus is asked how many repositories and owners have it: a value that several owners have in many repositories is an
``example`` (a key from a manual, a fixture), and so is one of more than one owner that doesn't look random. Any other value
that looks random is ``live``. Both are spans beside the pattern's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselake.llm.common import cut, join_counted, text_of

# Kind -> pattern; the group that holds the value; least characters of that group. Order is that of the report.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 6),
    "access": (r"()(AKIA[A-Z0-9]+)", 20),
    "hex": (r"()([0-9a-f]+)", 24),
}
RANKS = {kind: rank for rank, kind in enumerate([*KINDS, "live", "example"])}
#: A run of that many matches is summed at once (see ``_ends``).
RUN = 256
#: A value that looks random is an example only if so many owners (null not counted) have it, in so many repositories.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 10
#: A value is live-looking if it has this many different characters for its length (at most 16 counted).
DISTINCT_SHARE = 0.5


def _running(values: Column) -> Column:
    """Running sums of an array of numbers, in runs of ``RUN`` so that no array is copied for each element."""
    zero = F.array().cast("array<long>")

    def within(part: Column, start: Column) -> Column:
        seen = F.struct(start.alias("sum"), zero.alias("sums"))
        step = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["sums"], F.array(a["sum"] + x)).alias("sums"))
        return F.aggregate(part, seen, step)["sums"]

    runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / RUN).cast("int") - 1), lambda i: F.slice(values, i * RUN + 1, RUN))
    whole = F.struct(F.lit(0).cast("long").alias("sum"), zero.alias("sums"))

    def add(a: Column, run: Column) -> Column:
        sums = within(run, a["sum"])
        return F.struct(F.element_at(sums, -1).alias("sum"), F.concat(a["sums"], sums).alias("sums"))

    return F.when(F.size(values) > 0, F.aggregate(runs, whole, add)["sums"]).otherwise(zero)


def _spans(text: Column, kind: str) -> Column:
    """Array of (start, end, kind rank, value start, value) of the matches of one kind that are long enough.

    The text is split at the matches; lengths of what stands between and of the matches add up to positions in code points.
    """
    pattern, least = KINDS[kind]
    hit = F.lit(pattern)
    matches = F.regexp_extract_all(text, hit, F.lit(0))
    heads = F.regexp_extract_all(text, hit, F.lit(1))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
    each = F.arrays_zip(matches.alias("m"), heads.alias("h"), _running(steps).alias("e"))

    def span(x: Column) -> Column:
        start, head = x["e"] - F.length(x["m"]), F.length(x["h"])
        return F.struct(start.alias("start"), x["e"].alias("end"), F.lit(RANKS[kind]).alias("rank"), (start + head).alias("value_start"), F.substr(x["m"], head + 1).alias("value"))

    kept = F.filter(each, lambda x: F.length(x["m"]) - F.length(x["h"]) >= least)
    return F.transform(kept, span)


# What the pattern of each kind needs; texts without it aren't searched.
HINTS = {"assign": r"(?i)(?:passw|secret|token|api_?key)", "access": "AKIA", "hex": "[0-9a-f]{24}"}


def scan(docs: DataFrame, text_column: str = "text", output: str = "spans") -> DataFrame:
    """Add ``output``: all candidate spans of each whole text, by start and then kind. Null text counts as empty."""
    text = text_of(text_column)
    none = F.array().cast("array<struct<start:bigint,end:bigint,rank:int,value_start:bigint,value:string>>")
    found = [F.when(text.contains(HINTS[k]) if k == "access" else text.rlike(HINTS[k]), _spans(text, k)).otherwise(none) for k in KINDS]
    return docs.withColumn(output, F.array_sort(F.concat(*found)))


def ownership(candidates: DataFrame) -> DataFrame:
    """(value, repository, owner) rows -> for each hash of a value: its rows, repositories and owners.

    Partial aggregations from the finest key up, so that a value that a third of the corpus has is counted where it is read; no
    set is gathered. ``n`` is the number of rows. A repository that several owners have is one. A null owner is one of ``owners`` but not of ``named``.
    """
    hashed = candidates.select(F.sha2("value", 256).alias("value_hash"), "repository", "owner")
    fine = hashed.groupBy("value_hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = fine.groupBy("value_hash", "owner").agg(F.sum("n").alias("n"))
    owners = by_owner.groupBy("value_hash").agg(F.sum("n").alias("n"), F.count("*").alias("owners"), F.count("owner").alias("named"))
    repositories = fine.select("value_hash", "repository").distinct().groupBy("value_hash").agg(F.count("*").alias("repositories"))
    return owners.join(repositories, "value_hash")


def looks_random(value: Column) -> Column:
    """Many different characters for its length, and both a digit and a letter."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return (different >= DISTINCT_SHARE * F.least(F.length(value), F.lit(16))) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def counts_up(value: Column) -> Column:
    """At least half of the characters follow the one before (0123456789abcdef), as in a placeholder."""
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c))
    steps = F.transform(codes, lambda c, i: (c - F.get(codes, i - 1) == 1).cast("int"))
    return 2 * F.size(F.filter(steps, lambda x: x == 1)) >= F.length(value)


def classify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """Each row of ``docs`` as (id, text_key, spans): base spans and the ``live`` or ``example`` spans of their values.

    ``text_key`` is a hash of the text; ``spans`` an array of (start, rank, end), sorted (see ``RANKS``), empty for
    texts without any. Repeated rows come back each. Positions are code points, ends exclusive. Null text counts as empty, a
    null owner or repository as one of its own; an empty table gives an empty one, and other columns are not read. A value of
    one owner that doesn't look random adds no span. A random-looking value is an ``example`` only from ``EXAMPLE_OWNERS`` and
    ``EXAMPLE_REPOSITORIES`` up, or if it counts up.
    """
    narrow = scan(docs.select(F.col(id_column).alias("id"), F.col(owner).alias("owner"), F.col(repository).alias("repository"), text_of(text_column).alias("text")))
    narrow = narrow.select(F.monotonically_increasing_id().alias("row"), "id", "owner", "repository", F.xxhash64("text").alias("text_key"), "spans")
    narrow = cut(narrow)  # which fixes the row numbers
    each = narrow.where(F.size("spans") > 0).select("row", "id", "text_key", "owner", "repository", F.explode("spans").alias("s"))
    each = each.select("row", "id", "text_key", "owner", "repository", "s.*")
    counts = cut(ownership(each.select("value", "owner", "repository")))
    hashed = each.select("row", "id", "text_key", "start", "end", "rank", "value_start", "value", F.sha2("value", 256).alias("value_hash"))
    joined = join_counted(hashed, counts, "value_hash", "n")
    base = F.struct("start", "rank", "end")
    value = F.col("value")
    widespread = (F.col("named") >= EXAMPLE_OWNERS) & (F.col("repositories") >= EXAMPLE_REPOSITORIES)
    example = (F.col("owners") > 1) & (widespread | ~looks_random(value) | counts_up(value))
    verdict = F.when(example, F.lit(RANKS["example"])).when(looks_random(value), F.lit(RANKS["live"]))
    added = F.when(verdict.isNotNull(), F.struct(F.col("value_start").alias("start"), verdict.alias("rank"), F.col("end")))
    spans = joined.select("row", "id", "text_key", F.explode(F.array_compact(F.array(base, added))).alias("s"))
    gathered = spans.groupBy("row", "id", "text_key").agg(F.array_sort(F.collect_set("s")).alias("spans")).drop("row")
    empty = narrow.where(F.size("spans") == 0).select("id", "text_key", F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>").alias("spans"))
    return gathered.unionByName(empty)


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in RANKS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["rank"]], s["start"], s["end"])), ",")


def redact(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", mark: str = "[SECRET]", **by) -> DataFrame:
    """Replace every live-looking value by ``mark``; rows, other columns and texts without such values stay as they are."""
    found = classify(docs, id_column, text_column, **by)
    live = F.filter("spans", lambda s: s["rank"] == RANKS["live"])
    bad = found.select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), live.alias("_live")).where(F.size("_live") > 0)
    bad = bad.dropDuplicates(["_id", "_key"])  # equal texts have equal spans
    docs = docs.withColumn("_text_key", F.xxhash64(text_of(text_column)))
    joined = docs.join(bad, F.col(id_column).eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left")
    text, n = F.col(text_column), F.size("_live")
    # spans may overlap (a hex value inside an assigned one): begin each piece where all before have ended
    reached = F.transform("_live", lambda s, i: F.coalesce(F.array_max(F.transform(F.slice("_live", 1, i), lambda p: p["end"])), F.lit(0).cast("long")))
    pieces = F.zip_with("_live", reached, lambda s, r: F.when(s["start"] >= r, F.concat(F.substr(text, (r + 1).cast("int"), (s["start"] - r).cast("int")), F.lit(mark))).otherwise(F.lit("")))
    last = F.substr(text, (F.array_max(F.transform("_live", lambda s: s["end"])) + 1).cast("int"))
    clean = F.when(n > 0, F.concat(F.array_join(pieces, ""), last)).otherwise(text)
    return joined.withColumn(text_column, clean).drop("_id", "_key", "_live", "_text_key")
