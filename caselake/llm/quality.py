"""Quality of texts by Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, then a linear
hinge-loss model fitted by dual coordinate descent.

The n-grams are of words (one and two in a row), of shapes of words (case, digits, marks at the ends; one to three) and of
marks of repetition. All are hashed into one space.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselake.llm.common import Memo, cut, lowest, small_batches, text_of

#: N-grams are hashed into so many features, which bounds the counts that go to the driver and the model that is broadcast.
FEATURES = 1 << 18
SHAPES = 1 << 12
#: Labelled ids, of lowest hash, from which the log-count ratios are counted, and of these the ones on which the hinge-loss
#: model is fitted. The bound lets the ids be broadcast, so that texts are not shuffled to meet their labels.
RATIO_ROWS = 40_000
FIT_ROWS = 4_000
#: The rows that are fitted have at most that many features together, so that long texts can't fill the driver.
FIT_FEATURES = 1 << 23
ALPHA = 1.0
#: Training rows that must have a feature before its ratio counts.
LEAST_ROWS = 5
COST = 1.0
EPOCHS = 12
SEED = 11

MARKS_BEFORE = re.compile(r"\W*")


def word_parts(word: str) -> tuple[str, str, str]:
    """Marks before, middle and marks after, in time in proportion to the word."""
    start, end = MARKS_BEFORE.match(word).end(), len(word)
    while end > start and not (word[end - 1].isalnum() or word[end - 1] == "_"):
        end -= 1
    return word[:start], word[start:end], word[end:]


def shape(word: str) -> int:
    """A small number for the shape of a word: marks before, kind of its middle and length class, marks after."""
    before, middle, after = word_parts(word)
    if not middle:
        kind = "."
    elif middle.isalpha():
        kind = "a" if middle.islower() else "A" if middle[1:].islower() or len(middle) == 1 else "U" if middle.isupper() else "m"
    else:
        kind = "0" if middle.isdigit() else "x"
    long = "" if len(middle) < 25 else "+"
    return zlib.crc32(f"{before[-2:]}{kind}{long}{after[:3]}".encode()) % SHAPES


def numbers_of(word: str) -> int:
    """The shape of a word in the lower bits, above it a hash of its letters in lower case."""
    core = "".join(filter(str.isalnum, word)).lower() or word
    return (zlib.crc32(core.encode()) << 12) | shape(word)


_WORDS = Memo(numbers_of)


def features(text: str) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text: n-grams of one and two words, of one to three shapes, of repetition marks.

    A repetition mark tells whether a word equals the word before, or the one two before. An empty text has one feature.
    """
    words = text.split()
    if not words:
        return np.array([0], np.int32)
    both = np.fromiter(map(_WORDS.__getitem__, words), np.int64, len(words))
    s, w = both & (SHAPES - 1), both >> 12
    same = np.zeros(len(words), np.int64)
    same[1:] = w[1:] == w[:-1]
    same[2:] += 2 * (w[2:] == w[:-2])
    grams = [s + 1, w * 2_654_435_761 + 97]
    if len(s) > 1:
        grams.append(w[1:] * 40_503 + w[:-1] * 2_246_822_519 + 193)
        two = s[1:] * 8191 + s[:-1] * 131 + 7_000_003
        grams.append(two)
        if len(s) > 2:
            grams.append(two[1:] * 524_287 + s[:-2] * 31 + 11)
            run = same[2:] * 16 + same[1:-1] * 4 + same[:-2]
            grams.append(np.where(run > 0, run * 104_729 + 1_299_709, 1))
    if not same.any():
        grams.append(np.array([1], np.int64))
    mixed = np.concatenate(grams).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique((mixed >> np.uint64(64 - 18)).astype(np.int32))


def add_features(docs: DataFrame, text_column: str = "text", output: str = "features") -> DataFrame:
    """Add ``output``, the features of each whole text (null: empty). Rows and other columns stay."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def numbers(texts: pa.Array) -> pa.Array:
        found = [features(x) for x in texts.to_pylist()]
        offsets = np.zeros(len(found) + 1, np.int32)
        np.cumsum([len(x) for x in found], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.empty(0, np.int32), pa.int32()))

    return docs.withColumn(output, numbers(text_of(text_column)))


def log_count_ratios(training: DataFrame, alpha: float = ALPHA, least_rows: int = LEAST_ROWS) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) with p, q = alpha + rows of label 1, 0 that have the feature; over all rows of ``training``.
    0 for features of fewer rows than ``least_rows``. At most ``FEATURES`` counts for each label come to the driver.
    """
    counts = training.select("label", F.explode("features").alias("f")).groupBy("f").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    p, q = np.full(FEATURES, alpha), np.full(FEATURES, alpha)
    counts = counts.where(F.col("p") + F.col("q") >= least_rows).toPandas()
    p[counts["f"]] += counts["p"]
    q[counts["f"]] += counts["q"]
    ratios = np.log((p / p.sum()) / (q / q.sum()))
    ratios[(p == alpha) & (q == alpha)] = 0.0
    return ratios


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Weights w of min |w|^2 / 2 + sum c_i max(0, 1 - y w x), x = the ratios of a row's features, scaled to length 1.

    One dual variable a time, in an order shuffled with a fixed seed; 0 <= dual <= c_i. c_i weighs the classes equally. The
    last weight is that of a constant.
    """
    y = np.where(labels == 1, 1.0, -1.0)
    positive = max(1, int((y > 0).sum()))
    each = cost * len(y) / 2 / np.where(y > 0, positive, max(1, len(y) - positive))
    w, dual, rng = np.zeros(len(ratios) + 1), np.zeros(len(y)), np.random.default_rng(SEED)
    vectors = []
    for r in rows:
        x = ratios[r]
        vectors.append((np.append(r, np.int32(len(ratios))), np.append(x / (np.linalg.norm(x) or 1.0), 1.0).astype(np.float32)))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            at, x = vectors[i]
            slope = y[i] * (w[at] @ x) - 1.0
            new = min(max(dual[i] - slope / (x @ x), 0.0), each[i])
            if new != dual[i]:
                w[at] += (new - dual[i]) * y[i] * x
                moved = max(moved, abs(new - dual[i]))
                dual[i] = new
        if moved < 1e-3:
            break
    return w


def margin(row: np.ndarray, w: np.ndarray, ratios: np.ndarray) -> float:
    x = ratios[row]
    return float(w[row] @ x / (np.linalg.norm(x) or 1.0) + w[-1])


def scale_of(margins: np.ndarray, labels: np.ndarray) -> float:
    """Slope a of score = 1 / (1 + exp(-a margin)), by Newton steps on the likelihood; the threshold stays at margin 0."""
    y, a = np.where(labels == 1, 1.0, -1.0), 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(a * y * margins, -30, 30)))
        gradient, curve = (p * y * margins).sum() - 1e-3 * a, (p * (1 - p) * margins**2).sum() + 1e-3
        a = float(np.clip(a + gradient / curve, 0.1, 20.0))
    return a


def score(featured: DataFrame, training: DataFrame, id_column: str = "doc_id", fit_rows: int = FIT_ROWS, fit_features: int = FIT_FEATURES, output: str = "score") -> DataFrame:
    """Add ``output`` (0 to 1) to rows with ``features``, learned from ``training`` (id, label 0 or 1, features).

    Ratios come from all training rows; the hinge-loss model from those of the ``fit_rows`` ids with the lowest hash, in that
    order as long as they have ``fit_features`` features together, so it is the same on every run. Rows of one label only, or none, make a model that knows nothing: all scores are 0.5.
    """
    spark = featured.sparkSession
    ratios = log_count_ratios(training)
    chosen = lowest(training.select(F.col(id_column).alias("_id")).distinct(), fit_rows, SEED)  # ids first: features are large
    sample = training.join(F.broadcast(chosen), F.col(id_column) == F.col("_id")).select(F.xxhash64("_id").alias("h"), "label", "features")
    sizes = sample.groupBy("h").agg(F.sum(F.size("features")).alias("n")).toPandas().sort_values("h")  # one row an id
    beyond = sizes.loc[sizes["n"].cumsum() > fit_features, "h"]
    if len(beyond):
        sample = sample.where(F.col("h") < int(beyond.min()))
    sample = sample.toPandas().sort_values(["h", "label"], kind="stable", ignore_index=True)
    labels = sample["label"].to_numpy(np.int64)
    rows = [np.asarray(x, np.int32) for x in sample["features"]]
    if len(set(labels.tolist())) < 2:
        w, slope = np.zeros(FEATURES + 1), 1.0
    else:
        w = dual_coordinate_descent(rows, labels, ratios)
        slope = scale_of(np.array([margin(r, w, ratios) for r in rows]), labels)
    model = spark.sparkContext.broadcast((w.astype(np.float32), ratios.astype(np.float32), slope))

    @F.arrow_udf("double")
    def scores(lists: pa.Array) -> pa.Array:
        weights, scales, a = model.value
        flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.value_lengths())
        x = scales[flat].astype(np.float64)
        begin = np.cumsum(sizes) - sizes
        dots, norms = np.add.reduceat(weights[flat] * x, begin), np.sqrt(np.add.reduceat(x * x, begin))
        m = dots / np.where(norms > 0, norms, 1.0) + weights[-1]
        return pa.array(1 / (1 + np.exp(-np.clip(a * m, -30, 30))), pa.float64())

    return featured.withColumn(output, scores(F.col("features")))


def quality(docs: DataFrame, labels: DataFrame, held_out: Column, label_column: str = "quality", id_column: str = "doc_id", text_column: str = "text", ratio_rows: int = RATIO_ROWS) -> DataFrame:
    """(id, held_out, score, predicted) for each row of ``docs``; labels are learned where ``held_out`` is false only.

    ``held_out`` is a condition on ``doc_id``; where it is null, as for a null id, a row is not held out. Null text counts as
    empty. Rows whose label is null, or whose id has no label or is null, teach nothing. An id with several labels or texts
    teaches each of them once. ``ratio_rows`` ids are learned from. Repeated rows are scored each; an empty table gives an empty one; other columns are not read.
    """
    out = F.coalesce(held_out, F.lit(False))
    narrow = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    known = labels.select(F.col(id_column).alias("doc_id"), F.col(label_column).cast("int").alias("label")).where("label in (0, 1)").distinct().where(~out)
    ids = lowest(known.select("doc_id").where("doc_id is not null").distinct(), ratio_rows, SEED, "doc_id")
    chosen = known.join(F.broadcast(ids), "doc_id")  # at most ratio_rows ids, with at most both labels each
    training = cut(add_features(narrow.join(F.broadcast(chosen), "doc_id")).select("doc_id", "label", "features"))
    scored = score(add_features(narrow), training)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
