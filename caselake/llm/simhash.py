"""Near-duplicates by SimHash, with pairs sought in a table of distances to reference fingerprints.

Every distinct fingerprint gets its Hamming distances to many references. By the triangle inequality, two fingerprints
within ``radius`` have distances that differ by ``radius`` at most to every reference, so a larger difference discards a
pair without looking at it. The references are the zero fingerprint, masks of two neighbouring bits, and pseudo-random
ones. From the distances to zero and to a mask follows how many bits of the mask are set; ``radius`` differing bits
change that for at most ``radius`` masks. The masks are dealt into groups, and with ``radius + 3`` groups any pair within
``radius`` agrees on all masks of some three groups: these coordinates are the keys on which pairs meet. Where more than two
meet, ranges of the distances to the pseudo-random references, wide enough to overlap by ``radius``, part them further.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselake.llm.common import cut, join_counted, small_batches, text_of

SEED = 42
RADIUS = 2
GROUPS = 5
MASK_BITS = 2
RANDOM_REFERENCES = 16
#: Width of a range of distances; references by which a level parts crowded keys; levels.
WIDTH = 8
REFERENCES_OF_LEVEL = 4
LEVELS = 2
#: Shingle hashes whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str, width: int = 3) -> int:
    """SimHash of a text over XXH64 of its word shingles, as a signed 64-bit number.

    Words are runs without ASCII white space, A-Z lower-cased; repeats count. Fewer words than ``width`` make one shingle, no
    words the fingerprint zero.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else iter([b" ".join(words)])
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        part = hashes[i : i + CHUNK]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def add_fingerprint(docs: DataFrame, text_column: str = "text", output: str = "fp", width: int = 3) -> DataFrame:
    """Add the fingerprint of each text (null: empty) as a long; all rows and other columns stay."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array((fingerprint(x, width) for x in texts.to_pylist()), pa.int64())

    return docs.withColumn(output, fingerprints(text_of(text_column)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def references() -> tuple[list[int], list[int]]:
    """Masks of neighbouring bits, and pseudo-random fingerprints that a rule gives."""
    masks = [((1 << MASK_BITS) - 1) << i for i in range(0, 64, MASK_BITS)]
    return [_signed(m) for m in masks], [_signed(xxhash.xxh64_intdigest(str(i), SEED)) for i in range(RANDOM_REFERENCES)]


def _distance(fp: Column, reference: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(reference).cast("long")))


def distance_table(fps: DataFrame) -> DataFrame:
    """Add ``d0`` (distance to zero), ``dm`` (to each mask) and ``dr`` (to each pseudo-random reference)."""
    masks, others = references()
    fp = F.col("fp")
    return fps.select(
        "*",
        F.bit_count(fp).alias("d0"),
        F.array(*(_distance(fp, m).cast("byte") for m in masks)).alias("dm"),
        F.array(*(_distance(fp, m).cast("byte") for m in others)).alias("dr"),
    )


def _keyed(table: DataFrame, groups: int, radius: int) -> DataFrame:
    """(fp, choice, key): for each choice of ``groups - radius`` groups of masks, the set bits of their masks as one key.

    The count of set bits in a mask is (d0 + its bits - distance to it) / 2; a group's counts are read as a number in base 3.
    """
    n = 64 // MASK_BITS
    edges = [n * g // groups for g in range(groups + 1)]
    counts = F.transform("dm", lambda d: ((F.col("d0") + MASK_BITS - d) / 2).cast("long"))
    number = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, c: a * (MASK_BITS + 1) + c)
    of_group = table.select("fp", counts.alias("counts")).select("fp", F.array(*(number(F.slice("counts", a + 1, b - a)) for a, b in zip(edges, edges[1:]))).alias("g"))
    choices = F.array(*(F.array(*map(F.lit, chosen)) for chosen in combinations(range(groups), groups - radius)))
    chosen = of_group.select("fp", "g", F.posexplode(choices).alias("choice", "of"))
    return chosen.select("fp", "choice", F.xxhash64(F.transform("of", lambda i: F.col("g")[i])).alias("key"))


def _parted(crowded: DataFrame, first: int, references_: int) -> DataFrame:
    """(fp, key) rows -> rows with finer keys: the ranges of the distances to some of the pseudo-random references.

    Ranges are ``WIDTH`` wide. A fingerprint is put in the range of its distance and in that of its distance plus the radius;
    of two within the radius, the further one's range is one of these two of the nearer one, so they still share a key.
    """
    out = crowded
    _, others = references()
    for r in others[first : first + references_]:
        d = _distance(F.col("fp"), r)
        cells = F.array_distinct(F.array(*(F.floor((d + x) / WIDTH).cast("int") for x in (0, RADIUS))))
        out = out.select("fp", "key", F.explode(cells).alias("cell")).select("fp", F.xxhash64("key", "cell").alias("key"))
    return out


def _met(keyed: DataFrame) -> DataFrame:
    """(key, n, a, b) of the keys that more than one fingerprint has: how many, the smallest and the largest."""
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")


def candidate_pairs(fps: DataFrame, groups: int = GROUPS) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) that alone share a key, fingerprints that share a key with more than one other at every level)."""
    keyed = _keyed(distance_table(fps), groups, RADIUS).select("fp", F.xxhash64("choice", "key").alias("key"))
    pairs, buckets = None, cut(_met(keyed))
    for level in range(LEVELS):
        two = buckets.where("n = 2").select("a", "b")
        pairs = two if pairs is None else pairs.unionByName(two)
        crowded = keyed.join(buckets.where("n > 2").select("key"), "key").select("fp", "key")
        keyed = cut(_parted(crowded, level * REFERENCES_OF_LEVEL, REFERENCES_OF_LEVEL))
        buckets = cut(_met(keyed))
    pairs = pairs.unionByName(buckets.where("n = 2").select("a", "b"))
    return pairs.distinct(), keyed.join(buckets.where("n > 2").select("key"), "key").select("fp").distinct()


def within_radius(pairs: DataFrame) -> DataFrame:
    """Pairs whose largest coordinate difference in the table is within the radius; all others are no links."""
    for side in "ab":
        pairs = pairs.withColumnRenamed(side, "fp")
        pairs = distance_table(pairs).withColumnsRenamed({"fp": side, "d0": f"d0{side}", "dm": f"dm{side}", "dr": f"dr{side}"})
    furthest = F.greatest(
        F.abs(F.col("d0a") - F.col("d0b")),
        *(F.array_max(F.zip_with(f"{d}a", f"{d}b", lambda x, y: F.abs(x - y))) for d in ("dm", "dr")),
    )
    return pairs.where(furthest <= RADIUS).select("a", "b")


def links(fps: DataFrame, groups: int = GROUPS) -> DataFrame:
    """Links (a, b), a < b, that connect distinct fingerprints exactly as all pairs at ``RADIUS`` or fewer bits do.

    Two fingerprints that alone share a key are a pair: it is discarded when any coordinate differs by more than the radius,
    else verified. Where more share a key, chance mates are parted by further references; what is crowded after all levels is
    a family of near copies, and is not paired. Each of it is put on the 65 fingerprints at most one bit away; two are within
    two bits exactly if they meet on one, where at most 65 can meet, and a star of links on each meeting point connects
    them. So no bucket makes pairs, and none is cut.
    """
    pairs, dense = candidate_pairs(fps, groups)
    pairs = within_radius(pairs).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i)).cast("long")) for i in range(64)))
    meets = dense.select("fp", F.explode(near).alias("at")).groupBy("at").agg(F.collect_list("fp").alias("fps"))
    stars = meets.where(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b): each vertex with the smallest of its component as ``root``.

    Alternates two steps until nothing changes: every vertex hangs its larger neighbours on the smallest one, then its smaller
    ones. Each round is a grouping and a join; the work per round is in proportion to the links and rounds grow with the
    logarithm of the longest chain. No component is gathered in one place.
    """
    star = cut(edges.select("a", "b"))
    seen = None
    while True:
        both = star.union(star.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        least = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        up = large.withColumnRenamed("b", "u").join(least, "u")
        small = up.where("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y")).union(least.select("m", "u"))
        star = cut(small.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct())
        now = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == now:
            break
        seen = now
    return star.select(F.col("b").alias("vertex"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Add ``fp`` and ``component_id`` (the smallest id that links reach) to each row of ``docs``.

    Rows with equal fingerprints are one vertex, so copies are never paired. Null text counts as empty; all texts without
    words have fingerprint zero and are linked like any other. A null id is a component's smallest only if all are null.
    Columns of ``docs`` named like the outputs are replaced. Repeated rows stay, each with the same values.
    """
    docs = _with_keys(docs.drop("fp", "component_id"), id_column, text_column)
    found = _found(docs, id_column, text_column).select(*KEYS, "fp", "component_id")
    return docs.join(found, KEYS, "left").drop(*KEYS)


#: Columns by which rows are found again: the id as text (null: its own flag), and a hash of the text.
KEYS = ["_no_id", "_id_text", "_text_key"]


def _with_keys(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    of = (F.col(id_column).isNull(), F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.xxhash64(text_of(text_column)))
    return docs.withColumns(dict(zip(KEYS, of, strict=True)))


def _found(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(keys, id, fp, root, component_id) for each distinct id and text of rows with keys."""
    narrow = cut(add_fingerprint(docs, text_column, "fp").select(*KEYS, F.col(id_column).alias("id"), "fp").distinct())
    return join_counted(narrow, component_of(narrow.select("fp", "id")), "fp", "n")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component: that of its smallest id (of several texts with that id, the one of the lowest hash).

    Components are told apart by their root, since several may have the same smallest id, or none. Which rows stay is found
    on keys; texts are moved once. All columns of ``docs`` stay; an empty table gives an empty one.
    """
    keyed = _with_keys(docs, id_column, text_column)
    found = _found(keyed.select(id_column, text_column, *KEYS), id_column, text_column).where(F.col("id").eqNullSafe(F.col("component_id")))
    kept = found.groupBy("root").agg(F.min(F.struct(*KEYS)).alias("k")).select("k.*")
    return keyed.join(kept, KEYS).dropDuplicates(KEYS).drop(*KEYS)


def component_of(ids: DataFrame) -> DataFrame:
    """(fp, id) rows -> (fp, n, root, component_id) for each distinct fingerprint: its rows, and the smallest fingerprint and id
    of its component."""
    fps = cut(ids.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    roots = components(links(fps.select("fp")))
    rooted = cut(fps.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").select("fp", "id", "n", F.coalesce("root", "fp").alias("root")))
    smallest = cut(rooted.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("_members")))
    return cut(join_counted(rooted.select("fp", "n", "root"), smallest, "root", "_members").select("fp", "n", "root", "component_id"))
