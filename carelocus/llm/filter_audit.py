"""Filter interaction audit: what each filter removes in every order of the filters.

Five filters judge every whole text (letters, in the order of `FILTERS`): A too few words, B too few distinct words,
C too many capitals, D a forbidden symbol, E the text of a smaller id. A to D come from one pass over the bytes.

The pass is a table-driven transducer. Its states are "between words" and "in a word"; a table gives for each state and
byte the next state, and another the marks to put out: a word starts, a word ends, a capital, a symbol, a code point
(every byte that does not continue a UTF-8 character). Every byte leads both states to the same next one, so the state
before a byte follows from the byte before it alone, and two gathers run the automaton over a slice of many texts; a
text starts between words. The spans between the marks of starts and ends go into one open-addressing hash table a
slice, keyed by text and word, in rounds: all spans that are left claim their slot at once, those that find another
span there compare their bytes with it (never the hash alone), and what differs goes on to the next slot. The number of
claimed slots of a text is its number of distinct words.

Each document leaves that pass as a short row: id, part, a 128-bit digest of its text and the failed filters as bits.
Equal texts meet by digest: the smallest id of a digest comes from a pre-aggregated minimum, and a document asks for
(digest, own id) among those, so that a text copied into a third of all rows makes no hot key. Counts by part and set
of failed filters are aggregated before the shuffle; at most 32 sets a part are then laid against the 600 steps.

Cases: a null text or part is an empty one, equal to empty ones; a null id is no smaller than any and never fails E;
rows that repeat an id each count, and those with the smallest id of their text all pass E; labels that repeat an id
count as 1 where one of them is 1; a very long text takes memory in proportion to it alone; without rows there is no
result. Only the named columns are read, so extra columns and clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelocus.llm.common import BLANKS, field, map_arrow, offsets_of, stored

FILTERS = "ABCDE"
SYMBOLS = "#$%&*|"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 50, 65, 5

BETWEEN, IN_WORD = 0, 1
START, END, CAPITAL, SYMBOL, POINT = 1, 2, 4, 8, 16
SLICE_BYTES = 1 << 20
#: Words beyond this many bytes are hashed and compared as a whole instead of eight bytes a round.
LONG_WORD = 256


def transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) for each state and byte."""
    byte = np.arange(256)
    blank = np.isin(byte, list(BLANKS.encode()))
    nexts = np.where(blank, BETWEEN, IN_WORD).astype(np.uint8)
    marks = np.zeros((2, 256), np.uint8)
    marks[BETWEEN][~blank] |= START
    marks[IN_WORD][blank] |= END
    for seen, mark in (((byte >= ord("A")) & (byte <= ord("Z")), CAPITAL), (np.isin(byte, list(SYMBOLS.encode())), SYMBOL), ((byte & 0xC0) != 0x80, POINT)):
        marks[:, seen] |= mark
    return np.stack([nexts, nexts]), marks


NEXT, MARKS = transducer()


def transduce(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marks of every byte, last state of every text) of texts that lie one after the other."""
    state = np.empty(len(data) + 1, np.uint8)
    state[0] = BETWEEN
    state[1:] = NEXT[BETWEEN][data]
    last = np.where(np.diff(offsets) > 0, state[offsets[1:]], BETWEEN)
    state[offsets[:-1]] = BETWEEN
    return MARKS.ravel()[(state[:-1].astype(np.uint16) << 8) | data], last


class Spans:
    """Words as spans of a slice's bytes: their hashes, and comparisons by their bytes."""

    _MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray):
        self.bytes, self.start, self.size, self.text = data, starts, ends - starts, text
        padded = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
        padded[: len(data)] = data
        self.eights = padded.view("<u8")
        h = text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + self.size.astype(np.uint64)
        todo, done = np.flatnonzero(self.size <= LONG_WORD), 0
        while len(todo):
            x = (h[todo] ^ self.eight(todo, done)) * np.uint64(0xBF58476D1CE4E5B9)
            h[todo] = x ^ (x >> np.uint64(29))
            done += 8
            todo = todo[self.size[todo] > done]
        for i in np.flatnonzero(self.size > LONG_WORD).tolist():
            h[i] ^= np.uint64(xxhash.xxh64_intdigest(self.whole(i)))
        h *= np.uint64(0x94D049BB133111EB)
        self.hash = h ^ (h >> np.uint64(31))

    def whole(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.start[i] + self.size[i]].tobytes()

    def eight(self, which: np.ndarray, skip: int) -> np.ndarray:
        """The eight bytes of each span after the first `skip`, zeros past its end."""
        at = self.start[which] + skip
        shift = ((at & 7) * 8).astype(np.uint64)
        low, high = self.eights[at >> 3] >> shift, (self.eights[(at >> 3) + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return (low | high) & self._MASK[np.minimum(self.size[which] - skip, 8)]

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether spans a[i] and b[i] are the same word of the same text, byte by byte."""
        equal = (self.hash[a] == self.hash[b]) & (self.text[a] == self.text[b]) & (self.size[a] == self.size[b])
        for i in np.flatnonzero(equal & (self.size[a] > LONG_WORD)).tolist():
            equal[i] = self.whole(a[i]) == self.whole(b[i])
        todo, done = np.flatnonzero(equal & (self.size[a] <= LONG_WORD)), 0
        while len(todo):
            ok = self.eight(a[todo], done) == self.eight(b[todo], done)
            equal[todo[~ok]] = False
            done += 8
            todo = todo[ok & (self.size[a[todo]] > done)]
        return equal

    def first_ones(self) -> np.ndarray:
        """One span of each distinct word of each text: those that claim a slot of the hash table."""
        n = len(self.start)
        slots = 1 << max(4, (2 * n).bit_length())
        table = np.full(slots, -1, np.int64)
        first = np.zeros(n, bool)
        left, at = np.arange(n), (self.hash & np.uint64(slots - 1)).astype(np.int64)
        while len(left):
            free = table[at] < 0
            table[at[free]] = left[free]  # of several that meet in a free slot one stays
            owner = table[at]
            own = owner == left
            first[left[own]] = True
            other = np.flatnonzero(~own)
            on = other[~self.same(owner[other], left[other])]
            left, at = left[on], (at[on] + 1) & (slots - 1)
        return first


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, symbols and code points of each text of a slice."""
    marks, last = transduce(data, offsets)

    def places(mark: int) -> np.ndarray:
        return np.flatnonzero(marks & mark)

    def a_text(at: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(at, offsets))

    starts, ends, open_ends = places(START), places(END), offsets[1:][last == IN_WORD]
    ends = np.insert(ends, np.searchsorted(ends, open_ends), open_ends)
    words = a_text(starts)
    text = np.repeat(np.arange(len(words)), words)
    distinct = np.bincount(text[Spans(data, starts, ends, text).first_ones()], minlength=len(words))
    return {"n_words": words, "n_distinct": distinct, "n_capitals": a_text(places(CAPITAL)), "n_symbols": a_text(places(SYMBOL)), "n_chars": a_text(places(POINT))}


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, target: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of about `target` bytes of text, at least one row; nothing is decoded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column).cast(pa.large_binary())
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        cuts = [0, *(np.flatnonzero(np.diff((ends[1:] - ends[0]) // target)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a), data[ends[a] : ends[b]], ends[a : b + 1] - ends[a]


def judged(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
    min_words: int = MIN_WORDS, min_distinct_percent: int = MIN_DISTINCT_PERCENT, max_capital_percent: int = MAX_CAPITAL_PERCENT,
) -> DataFrame:
    """(id, part, digest, measures, failed): `failed` has bit i for the i-th of the filters A to D."""
    names = ["n_words", "n_distinct", "n_capitals", "n_symbols", "n_chars"]
    schema = T.StructType([field(df, id_col), T.StructField("part", T.StringType()), T.StructField("digest", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in names), T.StructField("failed", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in byte_slices(batches, "_text"):
            m = measures(data, offsets)
            view = memoryview(data)
            digests = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            fails = [m["n_words"] < min_words, 100 * m["n_distinct"] < min_distinct_percent * m["n_words"], 100 * m["n_capitals"] > max_capital_percent * m["n_chars"], m["n_symbols"] > 0]
            bits = sum(f.astype(np.int32) << i for i, f in enumerate(fails))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(digests, pa.binary()), *(pa.array(m[c], pa.int64()) for c in names), pa.array(bits, pa.int32())], names=schema.names)

    rows = df.select(F.col(id_col), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("_part"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    return map_arrow(rows, run, schema)


def with_copies(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`judged` rows with bit 4 (filter E) set in `failed` where a smaller id has the same text."""
    firsts = rows.groupBy("digest").agg(F.min(id_col).alias(id_col)).select("digest", id_col, F.lit(True).alias("_first"))
    copy = F.col(id_col).isNotNull() & F.col("_first").isNull()
    return rows.join(firsts, ["digest", id_col], "left").withColumn("failed", F.col("failed").bitwiseOR(F.when(copy, 1 << FILTERS.index("E")).otherwise(0))).drop("_first")


def steps() -> str:
    """One record a filter order and step, as JSON: `own` is the bit of the step's filter, `before` the bits of those before it."""
    out = []
    for order in permutations(range(len(FILTERS))):
        for k, own in enumerate(order):
            out.append({"filter_order": "".join(FILTERS[i] for i in order), "step": k + 1, "own": 1 << own, "before": sum(1 << i for i in order[:k])})
    return json.dumps(out)


STEP = "array<struct<filter_order string, step int, own int, before int>>"


def filter_audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", **limits: int) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every part, order and step.

    `shapley` sums what the step's filter removes over all orders: a document that fails k filters is removed by each
    of them in one k-th of the orders. `limits` are those of `judged`. Stores one short row a document.
    """
    rows = with_copies(stored(judged(df, id_col, text_col, part_col, **limits), "audit-rows"), id_col)
    known = labels.groupBy(F.col("doc_id").alias(id_col)).agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    rows = rows.select(id_col, "part", "failed").join(known, id_col, "left")
    sets = rows.groupBy("part", "failed").agg(F.count("*").alias("n"), F.sum(F.coalesce("_good", F.lit(0))).alias("good"), F.sum(F.coalesce("_toxic", F.lit(0))).alias("toxic"))
    parts = sets.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("_sets"))  # at most 2 ** 5 a part
    at_steps = parts.select("part", "_sets", F.explode(F.from_json(F.lit(steps()), STEP)).alias("_step")).select("part", "_sets", "_step.*")
    orders = math.factorial(len(FILTERS))

    def total(of, where) -> Column:
        return F.aggregate(F.filter("_sets", where), F.lit(0).cast("long"), lambda a, s: a + of(s))

    def count(s: Column) -> Column:
        return s["n"]

    def fails(s: Column) -> Column:
        return s["failed"].bitwiseAND(F.col("own")) != 0

    def left(s: Column) -> Column:
        return s["failed"].bitwiseAND(F.col("before")) == 0

    def removed(s: Column) -> Column:
        return fails(s) & left(s)

    return at_steps.select(
        "part", "filter_order", "step",
        total(count, lambda s: left(s) & ~fails(s)).alias("kept"),
        total(count, removed).alias("removed"),
        total(count, lambda s: fails(s) & ~left(s)).alias("redundant"),
        total(count, lambda s: s["failed"] == F.col("own")).alias("unique_fails"),
        total(lambda s: s["good"], removed).alias("good_lost"),
        total(lambda s: s["toxic"], removed).alias("toxic_lost"),
        total(lambda s: s["n"] * F.element_at(F.array(*(F.lit(orders // k) for k in range(1, len(FILTERS) + 1))), F.bit_count(s["failed"])), fails).alias("shapley"),
    )
