"""Toxicity of texts whose words may be disguised, by noisy-channel decoding.

A disguised word (1d10t, st00pid, i.d.i.o.t, stuuupid) is a lattice: each character may stand for others, a run of one letter
for one or two of it, a mark between single letters for nothing. Viterbi decoding picks the path that is likeliest under a
character model of the corpus times the channel. The restored words are then scored by what labelled texts tell of them.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselake.llm.common import Memo, cut, lowest, small_batches, text_of

# The characters of the model (0: between words, 1: any other), and what a character may stand for.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâäçèéêëìíîïñòóôöùúûüœ"
SYMBOLS = 64
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "*": "aeiou"}
#: Log-probabilities of the channel: a letter as itself, a disguised one, a doubled letter that is meant, a mark put in, a
#: mark that stands between words.
AS_IS, DISGUISED, DOUBLED, MARK, GAP = 0.0, -1.0, -1.5, 0.0, -8.0

CODE = {c: i + 2 for i, c in enumerate(LETTERS)}
INNER = re.escape("".join(STANDS_FOR))
BEFORE, AFTER = ".,;:!?\"'()[]{}<>|%&#*~-_/\\^`=+", ".,;:!?\"'()[]{}<>|%&#*~-_/\\^`=+@$"
MARKS = BEFORE + "$@"
RUN = re.compile(r"([^\W\d_])\1\1")
DISGUISE = re.compile(rf"(?:[^\W\d_][{INNER}]|[{INNER}][^\W\d_])|([^\W\d_])\1\1")
PLAIN = re.compile(rf"[^\W_{INNER}]*(?:[{INNER}][^\W_{INNER}]*)*")
SPELT = re.compile(r"(?<!\w)[^\W_](?:([ .\-_*/])[^\W_])(?:\1[^\W_])+(?!\w)")

#: Labelled rows of each class, of lowest hash of their id, from which words are learned.
FIT_ROWS = 4000
PREFIXES = (4, 5)
#: Families of texts that must have a feature before it counts.
LEAST_FAMILIES = 3
STRONG = 4.0
#: Weights of the evidence (largest log-odds, number of strong words, constant) where there are too few labels to fit them.
DEFAULT_WEIGHTS = np.array([1.0, 0.0, -4.0])
SEED = 13


def character_counts(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """Counts of three following characters over the whole texts of all rows, as an array of 64 x 64 x 64.

    Each task adds up its own rows; the sums are over at most 262,144 keys whatever the corpus.
    """
    small_batches(docs.sparkSession)

    def count(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        table = np.ones(1 << 16, np.int64)
        table[[i for i in range(1 << 16) if chr(i).isspace()]] = 0
        for c, i in CODE.items():
            table[ord(c)] = i
        for batch in batches:
            text = "  ".join(["", *batch.column(0).to_pylist(), ""]).lower()
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            codes = table[np.where(points < 1 << 16, points, 0xFFFF)]
            total += np.bincount(codes[:-2] * SYMBOLS**2 + codes[1:-1] * SYMBOLS + codes[2:], minlength=SYMBOLS**3)
        keys = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(total[keys], pa.int64())], names=["gram", "n"])

    grams = docs.select(text_of(text_column).alias("text")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SYMBOLS**3, np.int64)
    out[grams["gram"].to_numpy(np.int64)] = grams["n"].to_numpy(np.int64)
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log-probability of a character after two, interpolated with shorter contexts; the last axis is the character."""
    one = counts.sum((0, 1)) + 0.5
    one = one / one.sum()
    two = counts.sum(0) + 20 * one
    two = two / two.sum(1, keepdims=True)
    three = counts + 5 * two[None]
    return np.log(three / three.sum(2, keepdims=True)).astype(np.float32)


class Restorer:
    """Restores disguised words under one character model; without a model, words are only lower-cased."""

    def __init__(self, model: np.ndarray | None):
        self.model = None if model is None else model.tolist()
        self.memo = Memo(self._token)

    def _choices(self, token: str, spelt: bool) -> list[list[tuple[str, float]]]:
        """The lattice: for each run of a character, what it may be with the log-probability of the channel."""
        out, i = [], 0
        while i < len(token):
            c, n = token[i], 1
            while i + n < len(token) and token[i + n] == c:
                n += 1
            i += n
            if spelt and c in " .-_*/":
                out.append([("", MARK), (" ", GAP)])
            elif c in STANDS_FOR:
                options = [(s, DISGUISED) for s in STANDS_FOR[c]] + [(c, AS_IS - 2.0)]
                out += [options] * min(n, 2) if n < 3 else [options + [(2 * s, w + DOUBLED) for s, w in options]]
            elif n < 3:
                out += [[(c, AS_IS)]] * n
            else:
                out.append([(c, AS_IS), (2 * c, DOUBLED)])
        return out

    def decode(self, token: str, spelt: bool = False) -> str:
        """The likeliest reading of a lower-case token, by Viterbi over the last two characters."""
        paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for options in self._choices(token, spelt):
            then: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, text) in paths.items():
                for piece, weight in options:
                    x, y, s = a, b, score + weight
                    for c in piece:
                        code = 0 if c == " " else CODE.get(c, 1)
                        s += self.model[x][y][code]
                        x, y = y, code
                    if (x, y) not in then or s > then[x, y][0]:
                        then[x, y] = (s, text + piece)
            paths = then
        return max((score + self.model[a][b][0], text) for (a, b), (score, text) in paths.items())[1]

    def _token(self, token: str) -> str:
        low = token.lower()
        if self.model is None:
            return low
        core = low.lstrip(BEFORE)
        middle = core.rstrip(AFTER)
        if middle.isalpha():
            if not RUN.search(middle):
                return low
        elif not DISGUISE.search(middle) or not PLAIN.fullmatch(middle):
            return low
        at = len(low) - len(core)
        return low[:at] + self.decode(middle) + low[at + len(middle) :]

    def words(self, text: str) -> list[str]:
        """Tokens of a text, letters spelt out with marks between them put together."""
        if self.model is not None and SPELT.search(text):
            text = SPELT.sub(lambda m: self.decode(m[0].lower(), spelt=True), text)
        return text.split()

    def restore(self, text: str) -> str:
        """The text in lower case with disguised words restored; white space becomes one space."""
        return " ".join(map(self.memo.__getitem__, self.words(text)))


def core_of(word: str) -> str:
    """A word without the marks at its ends."""
    return word.strip(MARKS)


class Odds(dict):
    """Log-odds of words (as ``=word``) and of first letters of longer words (as ``^word``)."""

    def of_word(self, core: str) -> float:
        n = len(core)
        return max([self.get("=" + core, 0.0), *[self.get("^" + core[:p], 0.0) for p in PREFIXES if n > p]])


#: Tokens that a worker remembers; it keeps them while later stages of a pipeline run in it.
REMEMBERED = 100_000


class Evidence:
    """What the words of a text tell, once they are restored."""

    def __init__(self, restorer: Restorer, odds: Odds):
        self.restorer = restorer
        self.memo = Memo(lambda token: odds.of_word(core_of(restorer._token(token))), REMEMBERED)

    def of(self, text: str) -> tuple[float, float]:
        return strength(map(self.memo.__getitem__, set(self.restorer.words(text))))


def strength(found) -> tuple[float, float]:
    """The largest log-odds of a word, and the logarithm of one more than the number of different words over ``STRONG``."""
    found = [x for x in found if x > 0]
    return (max(found), math.log1p(sum(x >= STRONG for x in found))) if found else (0.0, 0.0)


def family(words) -> int:
    """The least hash of the words of a text: mostly equal for near copies, so that a family of copies counts as one text."""
    return min((zlib.crc32(w.encode()) for w in words), default=0)


def features_of(words: Column) -> Column:
    """Array of words -> their features: ``=word``, and ``^`` with the first letters of longer words."""
    first = [F.transform(F.filter(words, lambda w, p=p: F.length(w) > p), lambda w, p=p: F.concat(F.lit("^"), F.substring(w, 1, p))) for p in PREFIXES]
    return F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit("="), w)), *first))


def log_odds(n: np.ndarray, m: np.ndarray, toxic: int, others: int) -> np.ndarray:
    """For each feature, the log of its rate in families of toxic texts (n of ``toxic``) over that in the others (m).

    Counts are taken at a standard deviation on the careful side, so that a word of a few texts proves little. 0 for features
    that fewer than ``LEAST_FAMILIES`` toxic families have, or whose odds are against.
    """
    x = np.log(np.maximum(n - np.sqrt(n), 1e-9) / (toxic + 1)) - np.log((m + np.sqrt(m) + 0.5) / (others + 1))
    return np.where(n >= LEAST_FAMILIES, np.maximum(x, 0.0), 0.0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (the last is the constant's) of a logistic regression by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
    return w


def read_words(sample: DataFrame, model, text_column: str = "text") -> DataFrame:
    """Add ``words`` (distinct restored words of each whole text) and ``family``; the texts themselves go no further."""

    @F.pandas_udf("words array<string>, family long")
    def of(texts: pd.Series) -> pd.DataFrame:
        restorer = Restorer(model.value)
        cores = Memo(lambda token: core_of(restorer._token(token)), 100_000)
        found = [sorted(set(map(cores.__getitem__, set(restorer.words(t))))) for t in texts]
        return pd.DataFrame({"words": found, "family": [family(w) for w in found]})

    return sample.withColumn("_read", of(text_column)).select("*", "_read.*").drop("_read", text_column)


def fit(sample: DataFrame) -> tuple[Odds, np.ndarray]:
    """Log-odds of features and weights of the evidence, from (label, words, family) rows.

    The weights are fitted on evidence by log-odds that have not seen the text: each half of the families (by hash) is judged
    by the other half. The log-odds kept are those of all. Spark counts the families; to the driver come the counts of features
    that ``LEAST_FAMILIES`` toxic families have, and two numbers for each row.
    """
    sample = cut(sample.withColumn("half", F.pmod("family", F.lit(2)).cast("int")))
    of = lambda label, half: (F.col("label") == label) & (F.col("half") == half)
    cells = [(label, half) for label in (0, 1) for half in (0, 1)]
    families = sample.select("label", "half", "family").distinct().agg(*(F.count_if(of(*c)) for c in cells)).first()
    size = dict(zip(cells, families, strict=True))
    each = sample.select("label", "half", "family", F.explode(features_of(F.col("words"))).alias("feature")).distinct()
    counts = each.groupBy("feature").agg(*(F.count_if(of(*c)).alias(f"n{c[0]}{c[1]}") for c in cells))
    counts = counts.where(F.col("n10") + F.col("n11") >= LEAST_FAMILIES).toPandas()
    names = counts["feature"].tolist()
    n = {c: counts[f"n{c[0]}{c[1]}"].to_numpy(np.float64) for c in cells}
    odds = lambda halves: log_odds(sum(n[1, h] for h in halves), sum(n[0, h] for h in halves), sum(size[1, h] for h in halves), sum(size[0, h] for h in halves))
    weights = DEFAULT_WEIGHTS
    if all(size.values()):
        other = sample.sparkSession.sparkContext.broadcast([Odds((names[i], float(x[i])) for i in np.flatnonzero(x).tolist()) for x in (odds([1]), odds([0]))])

        @F.pandas_udf("array<double>")
        def evidence(words: pd.Series, half: pd.Series) -> pd.Series:
            judges = [Memo(o.of_word) for o in other.value]
            return pd.Series([list(strength(map(judges[h].__getitem__, w))) for w, h in zip(words, half, strict=True)])

        judged = sample.select("label", evidence("words", "half").alias("e")).select("label", F.col("e")[0].alias("e0"), F.col("e")[1].alias("e1")).toPandas().sort_values(["label", "e0", "e1"])
        weights = logistic(judged[["e0", "e1"]].to_numpy(), judged["label"].to_numpy(np.float64))
    kept = odds([0, 1])
    return Odds((names[i], float(kept[i])) for i in np.flatnonzero(kept).tolist()), weights


_HELD: dict[str, Evidence] = {}


def score(docs: DataFrame, training: DataFrame, id_column: str = "doc_id", text_column: str = "text", output: str = "score", fit_rows: int = FIT_ROWS, channel: bool = True) -> DataFrame:
    """Add ``output`` (0 to 1, higher: toxic likelier) to every row; null and empty texts are scored as texts without words.

    ``training`` has id and label (0, 1); its ``fit_rows`` rows of each label with the lowest hash of the id are looked up in
    ``docs`` and learned from, copies once. The character model is of all rows. Without labels of both kinds every score comes
    from a fixed default. Other columns and repeated rows stay; an empty table gives an empty one. ``channel`` false reads the
    words as they are written, to measure what restoring them is worth.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = language_model(character_counts(docs, text_column)) if channel else None
    known = training.select(F.col(id_column).alias("_id"), "label").where("_id is not null").distinct()
    chosen = lowest(known.where("label = 0"), fit_rows, SEED).unionByName(lowest(known.where("label = 1"), fit_rows, SEED))
    rows = docs.select(F.col(id_column).alias("_id"), text_of(text_column).alias("text")).join(F.broadcast(chosen), "_id")  # at most 2 fit_rows ids
    sample = rows.select("text", "label").dropDuplicates()
    odds, weights = fit(read_words(sample, spark.sparkContext.broadcast(model)))
    shared, name = spark.sparkContext.broadcast((model, odds, weights)), uuid.uuid4().hex

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        evidence = _HELD.get(name)
        if evidence is None:
            _HELD.clear()
            evidence = _HELD[name] = Evidence(Restorer(shared.value[0]), shared.value[1])
        w = shared.value[2]
        x = np.array([evidence.of(t) for t in texts.to_pylist()]).reshape(-1, 2)
        return pa.array(1 / (1 + np.exp(-np.clip(x @ w[:2] + w[2], -30, 30))), pa.float64())

    return docs.withColumn(output, scores(text_of(text_column)))


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, label_column: str = "toxic", id_column: str = "doc_id", text_column: str = "text", channel: bool = True) -> DataFrame:
    """Add ``held_out``, ``score`` and ``predicted`` to every row; labels are learned where ``held_out`` is false only.

    ``held_out`` is a condition on ``doc_id``; where it is null, as for a null id, a row is not held out. Columns of ``docs``
    with these names are replaced, all others stay, as do repeated rows. Null and empty texts count as texts without words.
    Null ids and labels teach nothing. An empty table gives an empty one.
    """
    held_out = F.coalesce(held_out, F.lit(False))
    known = labels.select(F.col(id_column).alias("doc_id"), F.col(label_column).cast("int").alias("label")).where("label in (0, 1)").where(~held_out)
    scored = score(docs, known.withColumnRenamed("doc_id", id_column) if id_column != "doc_id" else known, id_column, text_column, channel=channel)
    return scored.withColumn("held_out", held_out).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
