"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over hashed byte trigrams tells the
languages with a 1 from those with a 0: its weight for a trigram is the log odds of the trigram in the two sets
(each language of a set counts alike). A text's bit value is the mean weight of its trigrams times their number,
up to a limit. Decoding sums over bits a logistic loss of value times codeword, weighted by how far the bit's two
sets are apart (Jensen-Shannon), and takes the codeword with the least loss. If the second one is within a margin
the text is flagged as ambiguous; its prediction stays the nearest one, ties go to the first language by name.

Up to seven languages get the exhaustive code (all ways to split them in two), more get the widest of some random
codes from a fixed seed.

The fit takes a bounded sample: for each language all rows, or those with a hash below a cut-off that leaves about
`rows_per_language`; counts of the sample are summed per language (languages x `BUCKETS` numbers reach the driver).
More than `max_languages` languages raise an error.

Cases: a null text or one without a letter is `und` with score 0; very long texts are read whole; equal rows get
equal results; without learnable rows every text is `und`; an empty table gives an empty result. Only the id, text
and language columns are read, so extra columns and clashing names do no harm.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelocus.llm.common import field, fold, map_arrow, offsets_of, text_slices

BUCKETS = 1 << 13
ROWS_PER_LANGUAGE = 20_000
MAX_LANGUAGES = 512
#: A text counts as so many independent trigrams at most.
EVIDENCE = 40.0
AMBIGUOUS = 1.0
FOLDS = 5

_FOLD_BYTES = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every byte trigram of the lower-cased texts, offsets by text); ASCII that is no letter is blank."""
    raw = [(" " + t.lower() + " ").encode().translate(_FOLD_BYTES) for t in texts]
    b = np.frombuffer(b"".join(raw) + b"  ", np.uint8).astype(np.uint32)
    mixed = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)
    return (mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64), offsets_of(np.array([len(r) for r in raw], np.int64))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def code_matrix(n: int, seed: int = 7) -> np.ndarray:
    """Codewords (rows) of n languages, entries -1 and 1, no constant or repeated column."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        columns = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, float).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, width = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, bits))
        code[:, np.abs(code.sum(0)) == n] *= np.where(np.arange(n) % 2, -1, 1)[:, None]
        agree = code @ code.T - 2 * bits * np.eye(n)
        if (least := bits - agree.max()) > width:
            best, width = code, least
    return best


class CodeModel:
    """Bit classifiers and codewords of the learned languages."""

    def __init__(self, counts: dict[str, np.ndarray], smoothing: float = 0.5):
        self.languages = sorted(counts)
        self.code = code_matrix(len(self.languages))
        table = np.array([counts[k] for k in self.languages], float).reshape(len(self.languages), BUCKETS) + smoothing
        table /= table.sum(1, keepdims=True)
        weights, apart = [], []
        for bit in self.code.T:
            if (bit == bit[0]).all():  # a single language
                weights.append(np.zeros(BUCKETS))
                apart.append(1.0)
                continue
            one, zero = table[bit > 0].mean(0), table[bit < 0].mean(0)
            mid = (one + zero) / 2
            weights.append(np.log(one / zero))
            apart.append(float((one * np.log2(one / mid) + zero * np.log2(zero / mid)).sum() / 2))
        self.weights = np.array(weights, np.float32).reshape(-1, BUCKETS).T.copy()
        self.importance = np.array(apart) / max(sum(apart), 1e-12) * len(apart)

    def values(self, texts: list[str]) -> np.ndarray:
        """Bit values of each text."""
        grams, at = trigrams(texts)
        out = np.zeros((len(texts), self.weights.shape[1]))
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            own = grams[a:b]
            mean = (np.bincount(own, minlength=BUCKETS).astype(np.float32) @ self.weights if b - a > 2000 else self.weights[own].sum(0, dtype=np.float64)) / (b - a)
            out[i] = mean * min(float(b - a), EVIDENCE)
        return out

    def decode(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, share of exp(-loss), second-best loss minus best)."""
        loss = (np.logaddexp(0, -values[:, None, :] * self.code[None]) * self.importance).sum(2)
        best = loss.argmin(1)
        weight = np.exp(loss.min(1, keepdims=True) - loss)
        ordered = np.sort(loss, 1)
        gap = ordered[:, 1] - ordered[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return best, 1 / weight.sum(1), gap


def fit(train: DataFrame, id_col: str, text_col: str, lang_col: str, rows_per_language: int, max_languages: int) -> CodeModel | None:
    sizes = train.filter(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).cast("string").alias("lang")).count().limit(max_languages + 1).collect()
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not sizes:
        return None
    cut = F.create_map(*(x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, rows_per_language / r["count"])))))
    draw = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)) / F.lit(1 << 20)
    rows = train.select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"), draw.alias("_draw")).filter(F.col("_lang").isNotNull()).filter(F.col("_draw") < cut[F.col("_lang")]).select("_lang", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for piece, texts in text_slices(batches, "_text"):
            grams, at = trigrams(texts)
            for lang, text, a, b in zip(piece.column(0).to_pylist(), texts, at[:-1].tolist(), at[1:].tolist(), strict=True):
                if has_letter(text):
                    sums[lang] = sums.get(lang, 0) + np.bincount(grams[a:b], minlength=BUCKETS)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype(np.int64).tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "counts"])

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("counts", T.ArrayType(T.LongType()))])
    summed = map_arrow(rows, count, schema).select("lang", F.posexplode("counts").alias("bucket", "n")).filter("n > 0").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for lang, bucket, n in summed.collect():  # at most languages x BUCKETS rows
        counts.setdefault(lang, np.zeros(BUCKETS, np.int64))[bucket] = n
    return CodeModel(counts) if counts else None


def identify(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, max_languages: int = MAX_LANGUAGES
) -> DataFrame:
    """(id, held_out, lang_pred, score, ambiguous) of every text; learns from the rows that are not held out."""
    rows = df.select(F.col(id_col), F.col(text_col), F.col(lang_col), (fold(id_col, FOLDS) == 0).alias("_held"))
    model = fit(rows.filter(~F.col("_held")), id_col, text_col, lang_col, rows_per_language, max_languages)
    schema = T.StructType(
        [field(df, id_col), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_slices(batches, "_text"):
            known = np.array([has_letter(t) for t in texts]) if model else np.zeros(len(texts), bool)
            lang, score, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            at = np.flatnonzero(known)
            if len(at):
                best, share, gap = model.decode(model.values([texts[i] for i in at]))
                score[at], unsure[at] = share, gap < AMBIGUOUS
                for i, k in zip(at.tolist(), best.tolist(), strict=True):
                    lang[i] = model.languages[k]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], names=schema.names)

    return map_arrow(rows.select(id_col, F.col("_held").alias("held_out"), F.col(text_col).alias("_text")), run, schema)
