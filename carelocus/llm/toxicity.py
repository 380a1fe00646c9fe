"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary text. Each interpolates, with the absolute discount estimated from
its counts of counts, its own pairs with its own continuation counts (in how many pairs of the class a word comes
second), and these with continuation counts that both classes share; what is left goes to unknown words. So a word
that is rare in both classes gets its probability from the shared counts.

The models are then pruned as n-gram models are: an expression keeps probabilities of its own only if its split over
the classes departs from its backoff's. A word's backoff is the shared model, so its split is that of the texts; a
pair's is that of its second word. The departure is a likelihood ratio (G) of numbers of texts, so that a text that
repeats a word does not outweigh many that share one. Other words and pairs back off, with the factor that makes all
probabilities of a history sum to 1. The level of departure is one of `LEVELS` by its loss on labelled texts that the
models have not seen.

A text's evidence is the difference of the two log-likelihoods per word, all occurrences counted; a logistic curve
fitted on those unseen texts, weighted to the classes' true sizes, turns it into a score.

The fit takes a bounded sample of labelled rows: of each class the `rows_per_class` rows with the smallest hash of
their id, those of more than `max_row_chars` characters left out, and of these as many as have `class_chars`
characters together (never are rows left out of scoring). Counting is distributed; only the kept expressions come to
the driver and go to the tasks. The sample's ids are broadcast (at most 2 x rows_per_class).

Cases: null and empty texts have the evidence of one unknown word; very long texts are scored whole; equal texts get equal scores; a
null label counts as unlabelled, of several labels of one document the greatest counts; without labels of both
classes every score is 0. Only the id and text columns and the labels' id and class are read, so extra columns and
clashing names do no harm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelocus.llm.common import field, fold, hold, map_arrow, offsets_of, stored, text_slices

ROWS_PER_CLASS = 4000
MAX_ROW_CHARS = 100_000
CLASS_CHARS = 8_000_000
FOLDS = 5
#: Every so many-th sampled row (by hash) fits the curve instead of the models.
CURVE_PART = 4
#: Departures (G, one degree of freedom) that chance reaches with odds of 1 %, 0.1 % and 0.01 %.
LEVELS = (6.63, 10.83, 15.14)
#: In place of the word before: at the start of a text, and in rows that count the texts of a word.
START, TEXTS = -1, -2
WORD = re.compile(r"[^\W_]+")
CACHED_WORDS = 300_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word) >> 1
        return h


_hashes = _Hashes()


def forget() -> None:
    """Empty the cache of word hashes. A function of the module: a task's closure would hold a copy of the cache."""
    _hashes.clear()


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets by text)."""
    rows = [list(map(_hashes.__getitem__, words_of(t))) for t in texts]
    sizes = np.array([len(r) for r in rows], np.int64)
    return np.fromiter(chain.from_iterable(rows), np.int64, int(sizes.sum())), offsets_of(sizes)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(1)).astype(np.int64)


def expressions(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word before or START, word, text) of all words of the texts."""
    h, at = word_hashes(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(at))
    first = np.concatenate([[np.int64(START)], h[:-1]]) if len(h) else h
    first[at[:-1][np.diff(at) > 0]] = START
    return first, h, text


def departure(a: Column, b: Column, of_a: Column, of_b: Column) -> Column:
    """G of the split (a, b) against the split of (of_a, of_b), of which a and b are parts."""
    share_a, share_b = of_a / (of_a + of_b), of_b / (of_a + of_b)

    def side(x: Column, y: Column) -> Column:
        def part(k: Column, share: Column) -> Column:
            return F.when(k > 0, k * F.log(k / ((x + y) * share))).otherwise(0.0)

        return part(x, share_a) + part(y, share_b)

    return 2 * (side(a, b) + side(of_a - a, of_b - b))


def discount(once: int, twice: int) -> float:
    """The absolute discount by counts of counts; 0.5 where they are too few to tell."""
    return once / (once + 2 * twice) if once and twice else 0.5


class Counts(NamedTuple):
    """What the models keep of the sample. Class columns are ordinary, toxic. `words`: word, continuations by class
    and shared, departure. `pairs`: word before, word, continuations of the word by class and shared and its
    departure, occurrences by class, occurrences and discounted mass of the history by class, departure."""

    words: np.ndarray
    pairs: np.ndarray
    vocabulary: int
    total: np.ndarray  # continuations by class and shared
    mass: np.ndarray  # what the discounts take from them
    word_discount: np.ndarray
    pair_discount: np.ndarray


class ClassModels:
    """Differences of the two models' log probabilities, by word and word pair."""

    def __init__(self, counts: Counts, level: float):
        self.counts, total, mass = counts, np.maximum(counts.total, 1e-9), counts.mass
        keep = counts.words["g"] > level
        kept = counts.words[keep]
        own, shared = self.interpolated(kept, total, mass)
        #: Factor of the shared probability for all words that are not kept.
        self.factor = (1 - own.sum(0)) / (1 - shared.sum())
        order = np.argsort(kept["word"])
        self.words, self.p_word = kept["word"][order], own[order]
        pairs = counts.pairs[counts.pairs["g"] > level]
        own, shared = self.interpolated(pairs, total, mass)
        p_word = np.where((pairs["word_g"] > level)[:, None], own, shared[:, None] * self.factor)
        seen, spare, history = (np.stack([pairs[c + "_0"], pairs[c + "_1"]], 1).astype(float) for c in ("seen", "spare", "history"))
        # A history that a class has not seen leaves all to the class's words.
        known = history > 0
        p_pair = np.where(known, np.maximum(seen - counts.pair_discount, 0) + spare * p_word, p_word) / np.where(known, history, 1)
        self.heads, at = np.unique(pairs["first"], return_inverse=True)
        left = [1 - np.stack([np.bincount(at, p[:, c], len(self.heads)) for c in (0, 1)], 1) for p in (p_pair, p_word)]
        #: Factor of the words' probabilities after a history, for pairs that are not kept.
        self.head_factor = left[0] / left[1]
        keys = pair_hash(pairs["first"], pairs["word"])
        order = np.argsort(keys)
        self.pairs, self.p_pair = keys[order], p_pair[order]

    def interpolated(self, rows: np.ndarray, total: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability by class, shared probability) of each row's word."""
        n, d = self.counts.vocabulary, self.counts.word_discount
        shared = (np.maximum(rows["after"] - d[2], 0) + mass[2] / (n + 1)) / total[2]
        own = np.stack([np.maximum(rows[f"after_{c}"] - d[c], 0) / total[c] + (mass[c] / total[c] if self.counts.total[c] else 1.0) * shared for c in (0, 1)], 1)
        return own, shared

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Toxic minus ordinary log-likelihood per word of each text."""
        first, word, text = expressions(texts)
        if not len(word):
            return np.full(len(texts), gap_of(self.factor))
        gap = np.full(len(word), gap_of(self.factor))
        for keys, wanted, values in ((self.words, word, gap_of(self.p_word)), (self.heads, first, gap_of(self.head_factor)), (self.pairs, pair_hash(first, word), gap_of(self.p_pair))):
            if len(keys):
                spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                found = keys[spot] == wanted
                gap = np.where(found, values[spot] + (gap if keys is self.heads else 0.0), gap)
        size = np.bincount(text, minlength=len(texts))
        return np.where(size > 0, np.bincount(text, gap, len(texts)) / np.maximum(size, 1), gap_of(self.factor))


def gap_of(p: np.ndarray) -> np.ndarray:
    return np.log(p[..., 1] / p[..., 0])


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Weighted logistic regression of y on x with a small ridge; (slope, intercept) on the scale of x."""
    mid, wide = float(np.average(x, weights=weight)), float(x.std()) or 1.0
    z = np.stack([(x - mid) / wide, np.ones_like(x)], 1)
    b = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        ridge = np.diag([1e-3, 0.0])
        grad = z.T @ (weight * (p - y)) + ridge @ b
        b = b - np.linalg.solve((z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + ridge + 1e-9 * np.eye(2), grad)
        b = np.clip(b, -50, 50)
    return float(b[0] / wide), float(b[1] - b[0] * mid / wide)


def sampled(docs: DataFrame, known: DataFrame, id_col: str, text_col: str, rows_per_class: int, max_row_chars: int, class_chars: int) -> DataFrame:
    """(_id, _text, _toxic, _curve) of the rows to learn from."""
    pick = known.filter("_toxic = 0").orderBy("_order", "_id").limit(rows_per_class).unionByName(known.filter("_toxic = 1").orderBy("_order", "_id").limit(rows_per_class))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.length(text_col).alias("_chars")).filter(F.col("_chars") <= max_row_chars)
    part = (F.pmod(F.xxhash64(F.col("_id"), F.lit(1)), F.lit(CURVE_PART)) == 0).alias("_curve")
    sample = stored(rows.join(F.broadcast(pick), "_id").select("_id", "_text", "_toxic", "_order", "_chars", part), "toxicity-sample")
    # Sizes alone, a few thousand rows a class; rows of one id stay together.
    so_far = F.sum("_chars").over(Window.partitionBy("_toxic").orderBy("_order", "_id"))
    inside = sample.select("_id", "_toxic", "_order", "_chars").withColumn("_so_far", so_far).filter(F.col("_so_far") <= class_chars).select("_id").distinct()
    return sample.join(F.broadcast(inside), "_id", "left_semi").select("_id", "_text", "_toxic", "_curve")


def counted(sample: DataFrame, level: float) -> Counts:
    """The counts of expressions of `sample` (_text, _toxic) that depart by more than `level` from their backoff."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity", forget)
        for piece, texts in text_slices(batches, "_text", 1 << 22):
            before, own, text = expressions(texts)
            toxic = np.array(piece.column(1).to_pylist(), np.int64)
            # One row for each pair of a text with its occurrences, and one for each word of a text.
            _, pair, times = np.unique(pair_hash(pair_hash(before, own), text), return_index=True, return_counts=True)
            _, one = np.unique(pair_hash(own, text), return_index=True)
            first, word = np.concatenate([before[pair], np.full(len(one), TEXTS, np.int64)]), np.concatenate([own[pair], own[one]])
            seen, label = np.concatenate([times, np.ones(len(one), np.int64)]), toxic[np.concatenate([text[pair], text[one]])]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (first, word, seen * (1 - label), seen * label, 1 - label, label)], names=schema.names)

    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("first", "word", "seen_0", "seen_1", "texts_0", "texts_1")])
    grams = map_arrow(sample.select("_text", "_toxic"), count, schema).groupBy("first", "word").agg(*[F.sum(c).alias(c) for c in schema.names[2:]])
    grams = stored(grams, "toxicity-grams")
    pairs = grams.filter(F.col("first") != TEXTS)
    after = pairs.groupBy("word").agg(F.count_if(F.col("seen_0") > 0).alias("after_0"), F.count_if(F.col("seen_1") > 0).alias("after_1"), F.count("*").alias("after"))
    size = sample.agg(F.count_if(F.col("_toxic") == 0).alias("n0"), F.count_if(F.col("_toxic") == 1).alias("n1")).first()
    words = after.join(grams.filter(F.col("first") == TEXTS).select("word", "texts_0", "texts_1"), "word")
    n0, n1 = (F.lit(float(size[c])) for c in ("n0", "n1"))
    words = stored(words.withColumn("g", departure(F.col("texts_0"), F.col("texts_1"), n0, n1)), "toxicity-words")

    def rare(df: DataFrame, columns: list[str]) -> np.ndarray:
        row = df.agg(*[F.count_if(F.col(c) == k).alias(f"{c}_is_{k}") for c in columns for k in (1, 2)]).first()
        return np.array([discount(row[f"{c}_is_1"], row[f"{c}_is_2"]) for c in columns])

    three = ["after_0", "after_1", "after"]
    word_discount, pair_discount = rare(words, three), rare(pairs, ["seen_0", "seen_1"])
    sums = words.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in three], *[F.sum(F.least(F.col(c).cast("double"), F.lit(d))).alias("mass_" + c) for c, d in zip(three, word_discount.tolist(), strict=True)]).first()
    heads = pairs.groupBy("first").agg(
        *[F.sum(f"seen_{c}").cast("double").alias(f"history_{c}") for c in (0, 1)], *[F.sum(F.least(F.col(f"seen_{c}").cast("double"), F.lit(float(pair_discount[c])))).alias(f"spare_{c}") for c in (0, 1)]
    )
    of_word = words.select("word", *three, F.col("g").alias("word_g"), F.col("texts_0").alias("w0"), F.col("texts_1").alias("w1"))
    apart = pairs.join(of_word, "word").withColumn("g", departure(F.col("texts_0"), F.col("texts_1"), F.col("w0"), F.col("w1"))).filter(F.col("g") > level)
    apart = apart.join(heads, "first")

    def records(df: DataFrame, ids: list[str], numbers: list[str]) -> np.ndarray:
        table = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in numbers]).toArrow()  # bounded by the sample
        out = np.zeros(table.num_rows, [(c, np.int64) for c in ids] + [(c, np.float64) for c in numbers])
        for c in ids + numbers:
            out[c] = table.column(c).to_numpy()
        return out

    kept = records(words.filter(F.col("g") > level), ["word"], [*three, "g"])
    numbers = [*three, "word_g", "seen_0", "seen_1", "history_0", "history_1", "spare_0", "spare_1", "g"]
    return Counts(kept, records(apart, ["first", "word"], numbers), sums["n"], np.array([sums[c] or 0 for c in three], float), np.array([sums["mass_" + c] or 0 for c in three], float), word_discount, pair_discount)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows_per_class: int, max_row_chars: int, class_chars: int) -> tuple[ClassModels, float, float] | None:
    known = labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("_toxic")).filter(F.col("_id").isNotNull() & F.col("_toxic").isin(0, 1) & (fold("_id", FOLDS) != 0))
    known = known.groupBy("_id").agg(F.max("_toxic").alias("_toxic")).withColumn("_order", F.xxhash64("_id"))
    sizes = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}  # two rows
    if len(sizes) < 2:
        return None
    sample = stored(sampled(docs, known, id_col, text_col, rows_per_class, max_row_chars, class_chars), "toxicity-sample")
    counts = counted(sample.filter("not _curve"), LEVELS[0])
    models = [ClassModels(counts, x) for x in LEVELS]

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity", forget)
        for piece, texts in text_slices(batches, "_text"):
            x = np.stack([m.evidence(texts) for m in models], 1)
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), piece.column(1)], names=["x", "y"])

    curve = map_arrow(sample.filter("_curve").select("_text", "_toxic"), evidence, T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("y", T.IntegerType())])).toArrow()
    x, y = np.array(curve.column("x").to_pylist(), float).reshape(-1, len(models)), curve.column("y").to_numpy().astype(float)
    if len(x) < 20 or y.min() == y.max():  # too few rows for a curve of their own: evidence 0 is even odds
        return models[0], 20.0, 0.0
    weight = np.where(y == 1, sizes[1] / max(1, (y == 1).sum()), sizes[0] / max(1, (y == 0).sum()))
    weight /= weight.mean()
    best = None
    for i, m in enumerate(models):
        slope, intercept = fit_curve(x[:, i], y, weight)
        z = np.clip(slope * x[:, i] + intercept, -30, 30)
        loss = float((weight * (np.logaddexp(0, z) - y * z)).mean())
        if best is None or loss < best[0]:
            best = (loss, m, slope, intercept)
    return best[1:]


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_class: int = ROWS_PER_CLASS, max_row_chars: int = MAX_ROW_CHARS, class_chars: int = CLASS_CHARS, key_col: str | None = None) -> DataFrame:
    """(id, held_out, score, predicted, evidence) of every text. `labels` holds the id and `toxic` (0 or 1). With
    `key_col`, that column stands in place of the id in the result."""
    key_col = key_col or id_col
    model = fit(docs, labels, id_col, text_col, rows_per_class, max_row_chars, class_chars)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([field(docs, key_col), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("toxicity", forget)
        fitted = shared.value
        for piece, texts in text_slices(batches, "_text"):
            x = fitted[0].evidence(texts) if fitted else np.zeros(len(texts))
            score = 1 / (1 + np.exp(-np.clip(fitted[1] * x + fitted[2], -50, 50))) if fitted else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(x)], names=schema.names)

    return map_arrow(docs.select(F.col(key_col), (fold(id_col, FOLDS) == 0).alias("held_out"), F.col(text_col).alias("_text")), run, schema)
