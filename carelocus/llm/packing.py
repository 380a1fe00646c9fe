"""Mixture-controlled packing into fixed windows by deficit round-robin over source queues.

Every source is a queue of its documents' tokens. A window credits each queue its share of the window, serves the
whole tokens of the credit, and gives the tokens that rounding leaves to the queues whose deficits are largest;
what a queue was served too little or too much is carried to the next window. A queue that runs out leaves its
share to the others. The state after any number of served tokens has a closed form: token k of a source with
weight w is due at virtual time (k + 1/2) / w, and the tokens served so far are the first ones by due time. So
every task finds the deficits carried into its windows by itself, in whatever partition its documents lie, and no
task walks over the windows before. Both sides of a partition border use the same function, so each token is in
exactly one piece.

Steps: (1) tokenise once and write (partition, offset in the partition's queue, ids) as Parquet; (2) sum tokens by
(source, partition), prefix sums give each partition's place in its queue; (3) cut the stored ids at the window
borders. Only (2) shuffles, one row per source and partition. Without weights, sources are mixed in proportion to
their tokens, so all queues run out together and each window has the corpus mixture.

Every window is full; the tokens that remain at the very end go to windows of falling powers of two, which need
no padding. Cases: null and empty texts hold the end id alone; a null source is a queue of its own; very long
documents are cut over windows; repeated rows are packed each; an empty table gives no pieces. Only the id, source
and text columns are read. The mixture (one row per source) goes to the driver; more than `max_sources` sources
raise an error, as a mixture of that many has less than one token of most sources in a window.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array
from collections import OrderedDict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelocus.llm.common import field, hold, map_arrow, offsets_of, ragged_index, stored, text_slices

WINDOW = 4096
MAX_SOURCES = 65_536
#: Chunks of text kept by a Python worker between slices; bounds memory alone.
CACHED_CHUNKS = 400_000
#: Words of chunks kept by a Python worker; bounds memory alone.
CACHED_WORDS = 400_000
#: New chunks that are encoded together.
JOINED_CHUNKS = 256
GRID = 1 << 52
#: Numbers in a block of window borders, and bytes of such blocks kept by a task.
BORDER_NUMBERS, BORDER_BYTES = 1 << 16, 1 << 25


class ChunkTokenizer:
    """A tokenizer whose pre-tokens hold no white space, so blank-separated chunks are encoded one by one and equal
    chunks once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives a task its one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        self.tok = Tokenizer.from_file(path)
        #: Holds for: white space mapped to a blank, and words split by a pattern that no white space matches.
        self.by_chunk = (
            kind.get("post_processor") is None
            and (kind.get("normalizer") or {}).get("type") == "Sequence"
            and [n["type"] for n in kind["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
            and kind["pre_tokenizer"]["pretokenizers"][0].get("invert") is True
            and kind["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in kind["added_tokens"])
        )
        self.width = np.uint16 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.words = _Words(self.tok.model, "H" if self.width is np.uint16 else "I")
        self.special = re.compile("|".join(re.escape(t["content"].lower()) for t in kind["added_tokens"]) or "(?!)").search
        # The model is asked for words directly if that gives what the whole tokenizer gives.
        probe = "Straße's ÀÉ«x»² can't WE'LL a1b22 ¿Qué? 'tis-'re $$ naïve_x §5"
        self.by_word = self.by_chunk and self._word_ids(probe.split())[0].tolist() == self._ids([probe])[0]
        self._reset()

    def _reset(self) -> None:
        self.rows, self.flat, self.at = _Rows(), np.zeros(0, self.width), np.zeros(1, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunk_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each chunk)."""
        if not self.by_word:
            return self._joined_ids(chunks)
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        plain = np.fromiter(map(bool, map(PLAIN, chunks)), bool, len(chunks))
        if self.special("\n".join(chunks).lower()):
            plain &= np.fromiter((self.special(c.lower()) is None for c in chunks), bool, len(chunks))
        if plain.all():
            return self._word_ids(chunks)
        # Both kinds one after the other, then brought into the order of the chunks.
        kinds = [np.flatnonzero(plain), np.flatnonzero(~plain)]
        parts = [get([chunks[i] for i in own]) for get, own in zip((self._word_ids, self._joined_ids), kinds, strict=True) if len(own)]
        order = np.argsort(np.concatenate(kinds))
        counts = np.concatenate([c for _, c in parts])
        return np.concatenate([f for f, _ in parts])[ragged_index(offsets_of(counts)[:-1][order], counts[order])], counts[order]

    def _word_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain chunks, by the words of all of them: the separator has no ids, every word has some."""
        self.words["\n"] = b""
        packed = list(map(self.words.__getitem__, WORDS_IN("\n".join(chunks).lower())))
        sizes = np.fromiter(map(len, packed), np.int64, len(packed))
        borders = np.flatnonzero(sizes == 0)
        if len(borders) != len(chunks) - 1:
            return self._joined_ids(chunks)
        at = offsets_of(sizes)
        edges = np.concatenate([[0], at[borders], at[-1:]])
        return np.frombuffer(b"".join(packed), self.width), np.diff(edges) // np.dtype(self.width).itemsize

    def _joined_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same from the whole tokenizer: some chunks a call, told apart by where their tokens begin."""
        flat, counts = [], []
        for i in range(0, len(chunks), JOINED_CHUNKS):
            own = chunks[i : i + JOINED_CHUNKS]
            found = self.tok.encode(" ".join(own), add_special_tokens=False)
            begins = offsets_of(np.fromiter(map(len, own), np.int64, len(own)) + 1)
            at = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
            flat.append(np.array(found.ids, self.width))
            counts.append(np.bincount(np.searchsorted(begins, at, "right") - 1, minlength=len(own)))
        return np.concatenate(flat), np.concatenate(counts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets)."""
        if not self.by_chunk:
            ids = self._ids(texts)
            return np.array([x for r in ids for x in r], self.width), offsets_of(np.array([len(r) for r in ids], np.int64))
        if len(self.rows) > CACHED_CHUNKS:
            self._reset()
        had = len(self.rows)
        rows = [list(map(self.rows.__getitem__, t.replace("\n", " ").split(" "))) for t in texts]
        if len(self.rows) > had:
            new, lengths = self._chunk_ids(list(islice(self.rows, had, None)))
            self.at = np.concatenate([self.at, np.cumsum(lengths) + len(self.flat)])
            self.flat = np.concatenate([self.flat, new])
        counts = np.array([len(r) for r in rows], np.int64)
        row = np.fromiter(chain.from_iterable(rows), np.int64, int(counts.sum()))
        lengths = self.at[row + 1] - self.at[row]
        return self.flat[ragged_index(self.at[row], lengths)], offsets_of(lengths)[offsets_of(counts)]


class _Rows(dict):
    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        return n


class _Words(dict):
    """Lower-case words and their ids, packed: a few bytes a word instead of Python numbers. The model reads a word's UTF-8 bytes as the characters of the byte alphabet."""

    def __init__(self, model, kind: str):
        super().__init__()
        self.model, self.kind = model, kind

    def __missing__(self, word: str) -> bytes:
        own = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_ALPHABET)
        self[word] = ids = array(self.kind, [t.id for t in self.model.tokenize(own)]).tobytes()
        return ids


#: Visible Latin-1 characters stand for their byte; the other bytes, in order, for the characters from 256 on.
HIDDEN = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
BYTE_ALPHABET = {b: 256 + i for i, b in enumerate(HIDDEN)}
#: Printable Latin-1 text without white space: always in NFC, and its lower case is the same for all libraries.
PLAIN = re.compile("[!-~\u00a1-\u00ff]*").fullmatch
#: The word pattern of the tokenizer (see `by_chunk`) for lower-case Latin-1; a line feed stands by itself.
WORDS_IN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾\n]+|\n").findall


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


class Schedule:
    """Which token of which queue stands where: total tokens and weight of each source, in a fixed order."""

    def __init__(self, totals: list[int], weights: list[float], window: int = WINDOW):
        self.totals = np.array(totals, np.int64)
        self.weights = np.array(weights, np.float64)
        self.window = window
        self.total = int(self.totals.sum())
        self.horizon = float(((self.totals + 1) / self.weights).max()) if len(totals) else 0.0
        full, rest = divmod(self.total, window)
        tail = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.full, self.n_windows = full, full + len(tail)
        self.tail = offsets_of(np.array(tail, np.int64)) + full * window

    def begin(self, w: np.ndarray) -> np.ndarray:
        """Tokens served before window w."""
        return np.where(w <= self.full, w * self.window, self.tail[np.clip(w - self.full, 0, len(self.tail) - 1)])

    def served_at(self, tick: np.ndarray) -> np.ndarray:
        """Tokens of each queue that are due by a tick of virtual time; never falls as the tick grows."""
        time = tick[:, None].astype(np.float64) / GRID * self.horizon
        return np.minimum(np.floor(time * self.weights + 0.5).astype(np.int64), self.totals)

    def served(self, position: np.ndarray) -> np.ndarray:
        """Tokens of each queue among the first `position` served ones (rows: positions, columns: sources)."""
        low, high = np.full(len(position), -1, np.int64), np.full(len(position), GRID, np.int64)
        while (high - low > 1).any():  # the last tick at which no more than `position` tokens are due
            mid = (low + high) // 2
            fits = self.served_at(mid).sum(1) <= position
            low, high = np.where(fits, mid, low), np.where(fits, high, mid)
        base = np.where(low[:, None] < 0, 0, self.served_at(np.maximum(low, 0)))
        step = self.served_at(high) - base  # due at the same tick: the deficits are equal, first source first
        left = (position - base.sum(1))[:, None]
        before = np.cumsum(step, 1) - step
        return base + np.clip(left - before, 0, step)

    def window_of(self, source: int, token: int) -> int:
        """The window of a queue's token or one shortly before: whatever is due at a tick at which the token is not
        has been served before it. Ticks are as coarse as floats, so it takes a few of them back."""
        tick, back = int((token + 0.5) / self.weights[source] / self.horizon * GRID), 8
        while (due := self.served_at(np.array([max(min(tick, GRID) - back, 0)]))[0])[source] > token and back <= GRID:
            back *= 8
        return int(due.sum()) // self.window if due[source] <= token else 0


class Borders:
    """Tokens served of each queue at the borders of windows, block by block. A block's size depends on the number of
    sources alone; the blocks used last are kept, since the documents of all sources in a part share them."""

    def __init__(self, plan: Schedule):
        self.plan = plan
        self.step = int(np.clip(BORDER_NUMBERS // max(len(plan.totals), 1), 1, 64))
        self.keep = max(2, BORDER_BYTES // (8 * (self.step + 1) * max(len(plan.totals), 1)))
        self.blocks: OrderedDict[int, np.ndarray] = OrderedDict()

    def block(self, b: int) -> np.ndarray:
        """Rows: borders b * step to (b + 1) * step, or to the last one; columns: sources."""
        if b in self.blocks:
            self.blocks.move_to_end(b)
            return self.blocks[b]
        w = np.arange(b * self.step, min((b + 1) * self.step, self.plan.n_windows) + 1)
        self.blocks[b] = marks = self.plan.served(self.plan.begin(w))
        if len(self.blocks) > self.keep:
            self.blocks.popitem(last=False)
        return marks

    def pieces(self, source: int, first: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, start, length, window, offset) of rows that hold tokens first to first + n of a queue. Only blocks
        that a row touches are built, so rows from far ends of the queue may stand together."""
        rows = np.argsort(first, kind="stable")
        ends, b = first + n, -1
        while len(rows):
            b = max(b + 1, self.plan.window_of(source, int(first[rows[0]])) // self.step)
            if b * self.step >= self.plan.n_windows:
                raise AssertionError("a window border was missed")
            marks = self.block(b)
            edge, quota = marks[:, source], np.diff(marks, axis=0)
            here = rows[(first[rows] < edge[-1]) & (ends[rows] > edge[0])]
            if len(here):
                ahead = quota[:, :source].sum(1)
                from_w = np.maximum(np.searchsorted(edge, first[here], "right") - 1, 0)
                to_w = np.minimum(np.searchsorted(edge, ends[here] - 1, "right") - 1, len(quota) - 1)
                row = np.repeat(here, to_w - from_w + 1)
                w = ragged_index(from_w, to_w - from_w + 1)
                a, z = np.maximum(first[row], edge[w]), np.minimum(ends[row], edge[w + 1])
                some = z > a
                row, w, a, z = row[some], w[some], a[some], z[some]
                yield row, a - first[row], z - a, w + b * self.step, ahead[w] + a - edge[w]
            rows = rows[ends[rows] > edge[-1]]


def tokenised(df: DataFrame, tokenizer_file: str, end_id: int, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """Stored (part, source key, queue_start in the part, n, ids) of every document."""
    schema = T.StructType(
        [field(df, id_col), T.StructField("source_key", T.StringType()), T.StructField("part", T.LongType()), T.StructField("part_start", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("packing", tokenizer.cache_clear)
        tok, part, gone = tokenizer(tokenizer_file), TaskContext.get().partitionId(), {}
        for piece, texts in text_slices(batches, "_text"):
            ids, at = tok.encode(texts)
            starts, sizes, rows = [], [], []
            for key, a, b in zip(piece.column(1).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                starts.append(gone.get(key, 0))
                sizes.append(b - a + 1)
                gone[key] = starts[-1] + sizes[-1]
                rows.append(np.append(ids[a:b], tok.width(end_id)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array([part] * len(rows), pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(rows, pa.binary())], names=schema.names
            )

    key = F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    return stored(map_arrow(df.select(F.col(id_col), key.alias("_source"), F.col(text_col).alias("_text")), run, schema), "packing-ids")


def pack(
    df: DataFrame, tokenizer_file: str, end_id: int = 2, window: int = WINDOW, weights: dict[str | None, float] | None = None,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", max_sources: int = MAX_SOURCES,
) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source_key) of all documents.

    `weights`: target share of each source in a window, by source (None: the null source), all positive; sources
    without one get their share of the tokens. Runs two jobs (tokenise, totals) while the result is built.
    """
    ids = tokenised(df, tokenizer_file, end_id, id_col, source_col, text_col)
    sums = ids.groupBy("source_key", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("source_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = stored(sums.select("source_key", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base")), "packing-places")
    mixture = places.groupBy("source_key").agg(F.sum("n").alias("n")).orderBy("source_key").limit(max_sources + 1).collect()
    if len(mixture) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    wanted = {("-" if k is None else f"={k}"): w for k, w in (weights or {}).items()}
    if any(w <= 0 for w in wanted.values()):
        raise ValueError("weights must be positive")
    total = sum(r.n for r in mixture) or 1
    plan = Schedule([r.n for r in mixture], [wanted.get(r.source_key, r.n / total) for r in mixture], window)
    index = {r.source_key: i for i, r in enumerate(mixture)}
    bytes_each = tokenizer(tokenizer_file).width().itemsize

    schema = T.StructType([field(df, id_col), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), T.StructField("source_key", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("packing-cut", lambda: None)
        borders = Borders(plan)
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                yield from pieces(whole.slice(begin, 512), borders)

    def pieces(batch: pa.RecordBatch, borders: Borders) -> Iterator[pa.RecordBatch]:
        source = np.array([index[k] for k in batch.column(1).to_pylist()], np.int64)
        n, first = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
        found = []
        for s in np.unique(source):
            own = np.flatnonzero(source == s)
            found += [(own[row], *rest) for row, *rest in borders.pieces(int(s), first[own], n[own])]
        doc, start, length, w, offset = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((start, doc))
        doc, start, length, w, offset = (x[order] for x in (doc, start, length, w, offset))
        crc, held, last = [], None, -1
        column = batch.column(4)
        for d, a, k in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True):
            if d != last:
                held, last = np.frombuffer(column[d].as_buffer(), np.uint16 if bytes_each == 2 else np.uint32).astype("<u4"), d
            crc.append(zlib.crc32(held[a : a + k]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, n[doc], w, offset)), batch.column(1).take(pa.array(doc))], names=schema.names
        )

    placed = ids.join(places.select("source_key", "part", "part_base"), ["source_key", "part"])
    return map_arrow(placed.select(id_col, "source_key", "n", (F.col("part_base") + F.col("part_start")).alias("first"), "ids"), cut, schema)
