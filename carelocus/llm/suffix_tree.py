"""Language-model scores from a probabilistic suffix tree over words.

States are contexts of 0, 1 or 2 words (a start mark stands before a text). A state's next-word distribution is
its counts smoothed by its suffix's: P(w | s) = (n(s, w) + m P(w | suffix)) / (n(s) + m); the root's is
(c + 0.1) / (N + 0.1 (V + 1)), where one share is left for all unknown words. A context is retained if it predicts
the words that follow it better than its suffix does, each word held out of the counts in turn: the sum of the log
ratios, an estimate of the count times the divergence from the suffix, must exceed `min_gain`. A text is scored
with the longest retained suffix at each word and at its end.

The corpus is cut into blocks of a few million words, stored once as a table bucketed by block. All work goes
between blocks and n-gram buckets as packed sorted arrays, so that nothing is joined word by word: (1) blocks send
the training counts of their distinct 1-, 2- and 3-grams to buckets by hash, buckets add them up and answer each
block with the totals of its own; (2) blocks send the gains of their contexts, buckets add them up and answer with
the retained ones; (3) blocks score their texts. A frequent n-gram comes once from each block, the number of
buckets follows the number of words, and no model is broadcast, so the work grows with the corpus and every task
stays of one size.

Words are counted by 64-bit hashes; 2- and 3-grams by 40 bits of hash within a bucket (two n-grams of a bucket
share a count with odds of about one in a million).

Cases: null and empty texts are their end alone; a null id is held out; very long texts make a block of their own
size; repeated rows count each; without training rows every token has probability 1 of the base; an empty table
gives an empty result. Only the id and text columns are read, so extra columns and clashing names do no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelocus.llm.common import field, fold, map_arrow, offsets_of, runs, stored, text_slices

BLOCK_TOKENS = 800_000
BUCKET_TOKENS = 2_000_000
FOLDS = 10
SMOOTHING = 4.0
MIN_GAIN = 1.0
END, START = 0, 1  # first two rows of a block's vocabulary
_SPECIAL = np.array([0x3C2F733E3C2F733E, 0x3C733E003C733E00], np.uint64)
HASH_BITS = 40


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes without the empty high ones; equal neighbours compress well."""
    v = values.astype("<u8")
    width = (int(v.max()).bit_length() + 7) // 8 if len(v) else 0
    return bytes([width]) + v.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if data[0]:
        out[:, : data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], n).T
    return out.view("<u8").ravel()


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Rows(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 2
        return n


def make_blocks(df: DataFrame, id_col: str, text_col: str, block_tokens: int) -> DataFrame:
    """(block, ids, held, sizes, vocabulary hashes, token rows): tokens are rows of the block's vocabulary."""
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(df.schema[id_col].dataType)), T.StructField("held", T.ArrayType(T.BooleanType())),
            T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("vocabulary", T.BinaryType()), T.StructField("tokens", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_train", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        rows, ids, held, sizes, tokens = _Rows(), [], [], [], []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            hashes = np.concatenate([_SPECIAL, np.array([xxhash.xxh64_intdigest(w) for w in rows], np.uint64)])
            lengths, mark = np.array(sizes), np.concatenate(held)
            columns = [(part << 24) + made, pa.chunked_array(ids).combine_chunks(), mark.tolist(), sizes, hashes.tobytes(), pack(np.concatenate(tokens)), int(lengths.sum()), int(lengths[~mark].sum())]
            made += 1
            id_list = pa.ListArray.from_arrays(pa.array([0, len(columns[1])], pa.int32()), columns[1])
            return pa.RecordBatch.from_arrays(
                [pa.array([columns[0]], pa.int64()), id_list, pa.array([columns[2]], pa.list_(pa.bool_())), pa.array([columns[3]], pa.list_(pa.int32())), pa.array([columns[4]], pa.binary()), pa.array([columns[5]], pa.binary()), pa.array([columns[6]], pa.int64()), pa.array([columns[7]], pa.int64())],
                names=schema.names,
            )

        for piece, texts in text_slices(batches, "_text"):
            ids.append(piece.column(0))
            held.append(np.array(piece.column(1).to_pylist(), bool))
            for t in texts:
                own = [*map(rows.__getitem__, t.encode().lower().split()), END]
                sizes.append(len(own))
                total += len(own)
                tokens.append(np.array(own, np.uint32))
            if total >= block_tokens:
                yield flush()
                rows, ids, held, sizes, tokens, total = _Rows(), [], [], [], [], 0
        if sizes:
            yield flush()

    return map_arrow(df.select(F.col(id_col), (fold(id_col, FOLDS) == 0).alias("_held"), F.col(text_col).alias("_text")), run, schema)


class Block:
    """One block's tokens with their contexts, and its distinct n-grams in the order of their hashes."""

    def __init__(self, sizes: np.ndarray, held: np.ndarray, vocabulary: bytes, tokens: bytes):
        self.sizes, self.at = sizes, offsets_of(sizes)
        n = int(self.at[-1])
        self.word = unpack(tokens, n).astype(np.int32)
        self.train = ~np.repeat(held, sizes)
        hashes = np.frombuffer(vocabulary, np.uint64)
        first = np.zeros(n, bool)
        first[self.at[:-1]] = True
        self.last = self.shifted(self.word, first, START)
        order = np.argsort(hashes)
        self.one_order = order
        self.keys = [hashes[order]]
        self.rows = [np.argsort(order).astype(np.int32)[self.word]]
        # One order of n-grams at a time: only the sorted keys and a short row number a token stay.
        grams = mixed(hashes[self.last], hashes[self.word])
        self.number(grams)
        before = self.shifted(self.last, first, START)
        self.number(mixed(mixed(hashes[before], hashes[self.last]), grams))
        #: The 2-gram that is a token's context of length 2; -1 at a text's start.
        self.pair = self.shifted(self.rows[1], first, -1)

    @staticmethod
    def shifted(rows: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
        """The row of the token before, `start` at the start of a text."""
        out = np.empty_like(rows)
        out[1:] = rows[:-1]
        out[first] = start
        return out

    def number(self, grams: np.ndarray) -> None:
        keys, rows = np.unique(grams, return_inverse=True)
        self.keys.append(keys)
        self.rows.append(rows.astype(np.int32))

    def asked(self, p: "Scored") -> tuple[np.ndarray, np.ndarray]:
        """Which words (in the order of their hashes) and 2-grams stand as contexts that training texts repeat."""
        use = p.n_last > 1
        one = np.bincount(self.last[use], minlength=len(self.one_order))[self.one_order] > 0
        use = (self.pair >= 0) & (p.n_pair > 1)
        return one, np.bincount(self.pair[use], minlength=len(self.keys[1])) > 0

    def counts(self, k: int) -> np.ndarray:
        return np.bincount(self.rows[k][self.train], minlength=len(self.keys[k]))


def bucket_edges(keys: np.ndarray, bits: int) -> np.ndarray:
    bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def short_keys(keys: np.ndarray, bits: int, exact: bool) -> np.ndarray:
    """What is left of the hashes within a bucket."""
    rest = keys << np.uint64(bits)
    return rest if exact else rest >> np.uint64(64 - HASH_BITS)


MESSAGE = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("block", T.LongType()), T.StructField("n", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("values", T.BinaryType())])
ANSWER = T.StructType([T.StructField("block", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.LongType()), T.StructField("n", T.LongType()), T.StructField("answer", T.BinaryType()), T.StructField("seen", T.LongType())])


def batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(arrow.types)], schema=arrow)


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block]]:
    for b in batches:
        for i in range(b.num_rows):
            row = {name: b.column(name)[i] for name in b.schema.names}
            held = row["held"].values.to_numpy(zero_copy_only=False).astype(bool)
            yield row, Block(row["sizes"].values.to_numpy().astype(np.int64), held, row["vocabulary"].as_py(), row["tokens"].as_py())


def messages(block: int, kind: int, keys: np.ndarray, values: np.ndarray, bits: int, exact: bool) -> list[tuple]:
    edges, short = bucket_edges(keys, bits), short_keys(keys, bits, exact)
    out = []
    for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if b > a:
            data = values[a:b].astype("<f4").tobytes() if values.dtype.kind == "f" else pack(values[a:b])
            out.append((kind, i, block, b - a, pack(np.diff(short[a:b], prepend=np.uint64(0))), data))
    return out


def summed(sent: DataFrame, name: str, answer) -> DataFrame:
    """Add up the messages of each bucket; `answer(sums)` goes back to each block, for its keys in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs(batches, 2):
            keys = np.concatenate([np.cumsum(unpack(r[4], r[3]), dtype=np.uint64) for r in unit])
            floats = unit[0][0] >= 10
            values = np.concatenate([np.frombuffer(r[5], "<f4").astype(float) if floats else unpack(r[5], r[3]).astype(float) for r in unit])
            _, row = np.unique(keys, return_inverse=True)
            sums = np.bincount(row, values)
            replies, at, out = answer(sums)[row], 0, []
            seen = int((sums > 0).sum())
            for r in unit:
                out.append((r[2], r[0], r[1], r[3], pack(replies[at : at + r[3]]), seen))
                at, seen = at + r[3], 0
            yield batch(out, ANSWER)

    dealt = sent.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "block")
    return stored(map_arrow(dealt, run, ANSWER), name)


def answers(row: dict, column: str, kind: int) -> np.ndarray:
    """The totals of a block's keys of one kind, in the order of the keys."""
    own = sorted((x for x in (row[column].as_py() or []) if x["kind"] == kind), key=lambda x: x["bucket"])
    return np.concatenate([np.zeros(0, np.uint64), *(unpack(x["answer"], x["n"]) for x in own)]).astype(np.int64)


class Scored:
    """Probabilities of a block's tokens in their three contexts."""

    def __init__(self, block: Block, row: dict, total: int, distinct: int, smoothing: float, leave_out: bool):
        one, two, three = (answers(row, "counts", k) for k in range(3))
        own = block.train.astype(float) if leave_out else 0.0
        self.count = one[block.rows[0]]
        self.root = (self.count + 0.1) / (total + 0.1 * (distinct + 1))
        by_word = np.empty(len(one), np.int64)
        by_word[block.one_order] = one
        self.n_last = np.where(block.last == START, row["n_start"].as_py(), by_word[block.last])
        self.n_pair = np.where(block.pair >= 0, two[block.pair] if len(two) else 0, 0)
        m = smoothing
        self.one = (np.maximum(two[block.rows[1]] - own, 0) + m * self.root) / (np.maximum(self.n_last - own, 0) + m)
        self.two = (np.maximum(three[block.rows[2]] - own, 0) + m * self.one) / (np.maximum(self.n_pair - own, 0) + m)


def score(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", smoothing: float = SMOOTHING, min_gain: float = MIN_GAIN, block_tokens: int = BLOCK_TOKENS, bucket_tokens: int = BUCKET_TOKENS
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_states) of every text.

    `n_states`: contexts by length used for the text, as an array of three counts. Runs its rounds while the result
    is built; the result is stored and the block table dropped.
    """
    spark = df.sparkSession
    table = f"carelocus_blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    make_blocks(df, id_col, text_col, block_tokens).write.format("parquet").option("compression", "zstd").bucketBy(buckets, "block").saveAsTable(table)
    blocks = spark.table(table)
    facts = blocks.agg(F.sum("n_tokens").alias("all"), F.sum("n_train").alias("train")).first()
    total = facts["train"] or 0
    bits = max(2, int(np.ceil(np.log2(max(1, (facts["all"] or 0) / bucket_tokens)))))

    def send_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, own in block_rows(batches):
            for k in range(3):
                out = messages(row["block"].as_py(), k, own.keys[k], own.counts(k), bits, exact=k == 0)
                yield batch(out, MESSAGE)

    counted = summed(map_arrow(blocks, send_counts, MESSAGE), "pst-counts", lambda sums: sums.astype(np.uint64))
    # The start mark is in every vocabulary and never a token, so it adds no distinct word.
    distinct = counted.filter("kind = 0").agg(F.sum("seen")).first()[0] or 0
    n_start = blocks.agg(F.sum(F.aggregate("held", F.lit(0), lambda n, h: n + (~h).cast("int"))).alias("n")).first()["n"] or 0

    def by_block(replies: DataFrame, name: str) -> DataFrame:
        return replies.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "n", "answer")).alias(name))

    known = blocks.join(by_block(counted, "counts"), "block").withColumn("n_start", F.lit(n_start))

    def send_gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, own in block_rows(batches):
            p = Scored(own, row, total, distinct, smoothing, leave_out=True)
            asked, pair_asked = own.asked(p)
            use = own.train & (p.n_last > 1)
            gain = np.bincount(own.last[use], np.log(p.one[use] / p.root[use]), len(own.one_order))[own.one_order]
            yield batch(messages(row["block"].as_py(), 10, own.keys[0][asked], gain[asked], bits, exact=True), MESSAGE)
            use = own.train & (own.pair >= 0) & (p.n_pair > 1)
            gain = np.bincount(own.pair[use], np.log(p.two[use] / p.one[use]), len(own.keys[1]))
            yield batch(messages(row["block"].as_py(), 11, own.keys[1][pair_asked], gain[pair_asked], bits, exact=False), MESSAGE)

    kept = summed(map_arrow(known, send_gains, MESSAGE), "pst-contexts", lambda sums: (sums > min_gain).astype(np.uint64))
    ready = known.join(by_block(kept, "contexts"), "block", "left")
    schema = T.StructType(
        [
            field(df, id_col), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")),
            T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("n_states", T.ArrayType(T.LongType())),
        ]
    )

    def score_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, own in block_rows(batches):
            p = Scored(own, row, total, distinct, smoothing, leave_out=False)
            asked, pair_asked = own.asked(p)
            good = np.zeros(len(own.one_order), bool)
            good[own.one_order[asked]] = answers(row, "contexts", 10) > 0
            pair_good = np.zeros(len(own.keys[1]), bool)
            pair_good[pair_asked] = answers(row, "contexts", 11) > 0
            deep = (own.pair >= 0) & (pair_good[own.pair] if len(pair_good) else False)
            mid = good[own.last]
            best = np.where(deep, p.two, np.where(mid, p.one, p.root))
            first = own.at[:-1]
            add = lambda x: np.add.reduceat(x, first)  # noqa: E731 - every text has its end, so none is empty
            states = np.stack([add((~deep & ~mid).astype(np.int64)), add((~deep & mid).astype(np.int64)), add(deep.astype(np.int64))], 1)
            yield pa.RecordBatch.from_arrays(
                [
                    row["ids"].values, row["held"].values, pa.array(own.sizes), pa.array(add((p.count > 0).astype(np.int64))), pa.array(np.full(len(first), total, np.int64)),
                    pa.array(add(np.log10(p.root))), pa.array(add(np.log10(best))), pa.array(states.tolist(), pa.list_(pa.int64())),
                ],
                names=schema.names,
            )

    scored = stored(map_arrow(ready, score_blocks, schema), "pst-scores")
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    return scored
