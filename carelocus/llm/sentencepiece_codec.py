"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut at spots that no piece spans (a blank after a non-blank, a line feed, two characters that never
stand side by side in a piece), so every word is encoded on its own and equal words share one encoding. All new
words of a slice lie in one flat numpy symbol array. Each round finds the smallest pair rank of every word
(`minimum.reduceat`), merges all its occurrences from the left at once, and drops finished words from the arrays;
it ends when no pair remains. The library pops one pair at a time, best score first and leftmost among equals;
merging several at once gives the same result unless a merge makes a pair that is at least as good, and then the
later occurrences of that word wait for the next round.

Cases: null and empty texts have no ids and decode to the empty text; very long texts need memory in proportion
to the one text; words of more than `LONG_WORD` symbols are merged with a priority queue (same order of merges),
as rounds would scan them once per merge. Repeated rows give repeated results, an empty table an empty one. Only
the id and the text column are read, so extra columns and clashing names do no harm.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelocus.llm.common import field, map_arrow, offsets_of, ragged_index, text_slices

SPACE = "▁"
LONG_WORD = 4096
#: Words kept by a Python worker between slices; the table starts anew beyond it, which bounds memory alone.
CACHED_WORDS = 300_000
NEVER = np.int64(1 << 40)


class PieceModel:
    """Vocabulary, pair ranks and byte tables of a SentencePiece BPE model with byte fallback and no normaliser."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        kind = pb.ModelProto.SentencePiece
        pieces = list(proto.pieces)
        normal = {p.piece: i for i, p in enumerate(pieces) if p.type == kind.NORMAL}
        if (
            proto.trainer_spec.model_type != pb.TrainerSpec.BPE
            or not proto.trainer_spec.byte_fallback
            or spec.precompiled_charsmap
            or not spec.add_dummy_prefix
            or spec.remove_extra_whitespaces
            or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in pieces)
            or any(SPACE in p.lstrip(SPACE) or (p[:2] == SPACE * 2 and p.strip(SPACE)) or ("\n" in p and len(p) > 1) for p in normal)
        ):
            raise ValueError("only BPE models with byte fallback, identity normaliser and dummy prefix, whose pieces hold blanks in front or alone, are supported")
        self.n_pieces = len(pieces)
        self.byte_id = np.zeros(256, np.int64)
        surface: list[bytes] = []
        for i, p in enumerate(pieces):
            if p.type == kind.BYTE:
                value = int(p.piece[3:-1], 16)
                self.byte_id[value] = i
                surface.append(bytes([value]))
            elif p.type == kind.CONTROL:
                surface.append(b"")
            elif p.type == kind.UNKNOWN:
                surface.append(" ⁇ ".encode())
            else:
                surface.append(p.piece.replace(SPACE, " ").encode())
        self.is_byte = np.array([p.type == kind.BYTE for p in pieces])
        self.is_hidden = np.array([p.type == kind.CONTROL for p in pieces])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_len = np.array([len(x) for x in surface], np.int64)
        self.surface_at = offsets_of(self.surface_len)
        digits = [b"%d," % i for i in range(self.n_pieces)]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.digits_len = np.array([len(x) for x in digits], np.int64)
        self.digits_at = offsets_of(self.digits_len)

        # Symbols: pieces by id, then characters that only stand inside pieces; other characters follow by code point.
        symbols = dict(normal)
        for p in normal:
            for c in p:
                symbols.setdefault(c, len(pieces) + len(symbols) - len(normal))
        self.n_symbols = len(pieces) + len(symbols) - len(normal)
        self.symbol_of = np.arange(0x110000, dtype=np.int64) + self.n_symbols
        for c, s in symbols.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = s
        scores = sorted({-pieces[i].score for i in normal.values()})
        rank = {s: r for r, s in enumerate(scores)}
        keys, merged, ranks, beside = [], [], [], set()
        for p, i in normal.items():
            beside.update(ord(a) << 21 | ord(b) for a, b in zip(p, p[1:], strict=False))
            if p[:2] == SPACE * 2:
                continue  # runs of blanks merge after all else, see run_ids
            for cut in range(1, len(p)):
                if p[:cut] in symbols and p[cut:] in symbols:
                    keys.append(symbols[p[:cut]] * self.n_symbols + symbols[p[cut:]])
                    merged.append(i)
                    ranks.append(rank[-pieces[i].score])
        order = np.argsort(np.array(keys, np.int64))
        self.pair_key = np.append(np.array(keys, np.int64)[order], np.int64(1) << 62)
        self.pair_to = np.append(np.array(merged, np.int64)[order], 0)
        self.pair_rank = np.append(np.array(ranks, np.int64)[order], NEVER)
        self.beside = np.array(sorted(beside), np.int64)
        self.space = symbols[SPACE]
        self.run_piece = {len(p): i for p, i in normal.items() if p[:2] == SPACE * 2} | {1: self.space}
        self.longest_run = max(self.run_piece)
        if any(pieces[i].score >= min(s for s in (pieces[j].score for p, j in normal.items() if p[:2] != SPACE * 2 and len(p) > 1)) for n, i in self.run_piece.items() if n > 1):
            raise ValueError("runs of blanks must have the lowest scores")
        if len({pieces[i].score for n, i in self.run_piece.items() if n > 1}) > 1:
            raise ValueError("runs of blanks must have one score")

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NEVER where the pair is no piece."""
        known = (left < self.n_symbols) & (right < self.n_symbols)
        key = np.where(known, left * self.n_symbols + right, -1)
        at = np.searchsorted(self.pair_key, key)
        found = self.pair_key[at] == key
        return np.where(found, self.pair_rank[at], NEVER), self.pair_to[at]

    @functools.lru_cache(maxsize=256)  # noqa: B019 - one model per process
    def _short_run(self, n: int) -> tuple[int, ...]:
        runs = [1] * n
        while True:  # all scores are equal: the leftmost pair that makes a piece
            i = next((i for i in range(len(runs) - 1) if runs[i] + runs[i + 1] in self.run_piece), None)
            if i is None:
                return tuple(self.run_piece[x] for x in runs)
            runs[i : i + 2] = [runs[i] + runs[i + 1]]

    def run_ids(self, n: int) -> list[int]:
        """Ids of n blanks in a row. The leftmost run grows to the longest piece and then merges no more."""
        full = max(0, n // self.longest_run - 2)
        return [self.run_piece[self.longest_run]] * full + list(self._short_run(n - full * self.longest_run))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets) of words as `split_text` gives them."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        bare = [w.lstrip(" ") for w in words]
        chars = [w if not w or w[0] == "\n" else SPACE + w for w in bare]
        lengths = np.array([len(c) for c in chars], np.int64)
        code = np.frombuffer("".join(chars).encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        symbols, word = self._merge(code, word)
        ids, owner = self._fallback(symbols, word)
        flat, offsets = ids, offsets_of(np.bincount(owner, minlength=len(words)))
        blanks = [(i, len(w) - len(b)) for i, (w, b) in enumerate(zip(words, bare, strict=True)) if len(w) != len(b)]
        if blanks:  # rare: put the run of blanks in front of its word
            parts = {}
            for i, n in blanks:
                own = flat[offsets[i] : offsets[i + 1]].tolist()
                parts[i] = [*self.run_ids(n + 1), *own[1:]] if own and own[0] == self.space and bare[i][:1] != "\n" else [*self.run_ids(n), *own]
            rows = [parts[i] if i in parts else flat[offsets[i] : offsets[i + 1]].tolist() for i in range(len(words))]
            flat, offsets = np.array([x for r in rows for x in r], np.int64), offsets_of(np.array([len(r) for r in rows], np.int64))
        return flat, offsets

    def _merge(self, code: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(code)
        symbols, done = self.symbol_of[code], np.zeros(n, bool)
        out = symbols.copy()
        if n < 2:
            return out, word
        pair = code[:-1] << 21 | code[1:]
        at = np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)
        joined = (self.beside[at] == pair) & (word[:-1] == word[1:])
        segment = np.concatenate([[0], np.cumsum(~joined)])
        size = np.bincount(segment)
        for s in np.flatnonzero(size > LONG_WORD):
            a, b = np.searchsorted(segment, [s, s + 1])
            where, what = self._merge_long(symbols[a:b].tolist())
            out[a + np.array(where)] = what
            done[a + np.array(where)] = True
        done |= size[segment] == 1
        keep = np.flatnonzero((size[segment] > 1) & (size[segment] <= LONG_WORD))
        place, sym, seg = keep, symbols[keep], segment[keep]
        if len(sym):
            rank = np.full(len(sym), NEVER)
            inner = np.flatnonzero(seg[:-1] == seg[1:])
            rank[inner] = self.pairs(sym[inner], sym[inner + 1])[0]
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            least = np.minimum.reduceat(rank, first)
            spread = np.repeat(least, np.diff(np.append(first, len(seg))))
            over = spread == NEVER
            if over.any():  # compaction: finished words leave the arrays
                out[place[over]] = sym[over]
                done[place[over]] = True
                stay = ~over
                place, sym, seg, rank, spread = place[stay], sym[stay], seg[stay], rank[stay], spread[stay]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == spread)
            # Overlapping occurrences: every other one of a chain, from the left.
            chain = np.concatenate([[True], (hit[1:] != hit[:-1] + 1)])
            start = np.maximum.accumulate(np.where(chain, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            low = rank[hit]
            new = self.pairs(sym[hit], sym[hit + 1])[1]
            # A merge that makes a pair at least as good ends this word's round.
            left = np.maximum(hit - 1, 0)
            touching = np.concatenate([[False], (hit[1:] == hit[:-1] + 2)])
            before = np.where(touching, np.concatenate([[0], new[:-1]]), sym[left])
            has_left = (hit > 0) & (seg[left] == seg[hit])
            right = np.minimum(hit + 2, len(sym) - 1)
            has_right = (hit + 2 < len(sym)) & (seg[right] == seg[hit])
            stop = (has_left & (self.pairs(before, new)[0] <= low)) | (has_right & (self.pairs(new, sym[right])[0] <= low))
            if stop.any():
                passed = np.cumsum(stop) - stop
                head = np.concatenate([[True], seg[hit][1:] != seg[hit][:-1]])
                since = np.maximum.accumulate(np.where(head, passed, 0))
                go = passed == since
                hit, new = hit[go], new[go]
            sym[hit] = new
            gone = np.ones(len(sym), bool)
            gone[hit + 1] = False
            moved = np.cumsum(gone) - 1
            place, sym, seg, rank = place[gone], sym[gone], seg[gone], rank[gone]
            at = moved[hit]
            changed = np.zeros(len(sym), bool)
            changed[at] = True
            changed[np.maximum(at - 1, 0)] = True
            redo = np.flatnonzero(changed)
            rank[redo] = NEVER
            redo = redo[redo + 1 < len(sym)]
            redo = redo[seg[redo] == seg[redo + 1]]
            rank[redo] = self.pairs(sym[redo], sym[redo + 1])[0]
        return out[done], word[done]

    def _merge_long(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """The library's order of merges for one very long word, with a priority queue."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        sym = np.array(symbols, np.int64)
        ranks, to = self.pairs(sym[:-1], sym[1:])
        queue = [(int(r), i, symbols[i], symbols[i + 1], int(t)) for i, (r, t) in enumerate(zip(ranks, to, strict=True)) if r < NEVER]
        heapq.heapify(queue)
        known: dict[tuple[int, int], tuple[int, int]] = {}
        alive = [True] * n
        while queue:
            _, i, a, b, t = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], alive[j], after[i] = t, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    pair = (symbols[x], symbols[y])
                    if pair not in known:
                        r, m = self.pairs(np.array([pair[0]]), np.array([pair[1]]))
                        known[pair] = int(r[0]), int(m[0])
                    if known[pair][0] < NEVER:
                        heapq.heappush(queue, (known[pair][0], x, *pair, known[pair][1]))
        where = [i for i in range(n) if alive[i]]
        return where, [symbols[i] for i in where]

    def _fallback(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces become the byte pieces of their UTF-8 form."""
        odd = np.flatnonzero(symbols >= self.n_pieces)
        if not len(odd):
            return symbols, word
        if not hasattr(self, "_inner"):
            self._inner = {int(s): c for c, s in enumerate(self.symbol_of) if self.n_pieces <= s < self.n_symbols}
        count = np.ones(len(symbols), np.int64)
        spelled = {}
        for s in np.unique(symbols[odd]).tolist():
            spelled[s] = self.byte_id[np.frombuffer(chr(self._inner[s] if s < self.n_symbols else s - self.n_symbols).encode(), np.uint8)]
        count[odd] = [len(spelled[s]) for s in symbols[odd].tolist()]
        ids = np.repeat(symbols, count)
        at = np.cumsum(count) - count
        ids[ragged_index(at[odd], count[odd])] = np.concatenate([spelled[s] for s in symbols[odd].tolist()])
        return ids, np.repeat(word, count)

    def decode_bytes(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 of the decoded texts of rows ids[offsets[i]:offsets[i+1]]; broken byte pieces become U+FFFD each."""
        lengths = self.surface_len[ids]
        flat = self.surface[ragged_index(self.surface_at[ids], lengths)].tobytes()
        ends = offsets_of(lengths)[offsets]
        shown = ~self.is_hidden[ids]
        out = []
        for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            row = flat[a:b]
            if self.is_byte[ids[offsets[i] : offsets[i + 1]]].any():
                try:
                    row.decode()
                except UnicodeDecodeError:
                    row = self._mended(ids[offsets[i] : offsets[i + 1]])
            if row[:1] == b" ":
                own = ids[offsets[i] : offsets[i + 1]][shown[offsets[i] : offsets[i + 1]]]
                if len(own) and own[0] != 0 and not self.is_byte[own[0]]:
                    row = row[1:]
            out.append(row)
        return out

    def _mended(self, ids: np.ndarray) -> bytes:
        out, run = bytearray(), bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.extend(run[at : at + n].decode().encode())
                    except UnicodeDecodeError:
                        continue
                    break
                else:
                    n = 1
                    out.extend("�".encode())
                at += n
            run.clear()

        for i in ids.tolist():
            a, b = self.surface_at[i], self.surface_at[i + 1]
            if self.is_byte[i]:
                run.extend(self.surface[a:b].tobytes())
            else:
                flush()
                out.extend(self.surface[a:b].tobytes())
        flush()
        return bytes(out)


def split_text(text: str) -> list[str]:
    """Words that can be encoded one by one: ``w`` stands for a blank and w, ``\\nw`` for itself, and ``k`` leading
    blanks for k more blanks in front."""
    if not text:
        return []
    words = text.replace(SPACE, " ").replace("\n", " \n").split(" ")
    if "" not in words:
        return words
    out, blanks = [], 0
    for w in words:
        if not w:
            blanks += 1
        elif w[0] == "\n" and blanks:
            out += [" " * blanks, w]
            blanks = 0
        else:
            out.append(" " * blanks + w)
            blanks = 0
    return [*out, " " * blanks] if blanks else out


class _Words(dict):
    """Word to its row in the encoder's table; new words get the next row."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Encodes slices of texts; keeps the encodings of recent words."""

    def __init__(self, model: PieceModel):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.words, self.flat, self.at = _Words(), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets) of the texts."""
        if len(self.words) > CACHED_WORDS:
            self._reset()
        had = len(self.words)
        rows = [list(map(self.words.__getitem__, split_text(t))) for t in texts]
        if len(self.words) > had:
            new, at = self.model.encode_words(list(self.words)[had:])
            self.flat, self.at = np.concatenate([self.flat, new]), np.concatenate([self.at, at[1:] + len(self.flat)])
        counts = np.array([len(r) for r in rows], np.int64)
        row = np.fromiter(chain.from_iterable(rows), np.int64, int(counts.sum()))
        lengths = self.at[row + 1] - self.at[row]
        return self.flat[ragged_index(self.at[row], lengths)], offsets_of(lengths)[offsets_of(counts)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(PieceModel(path))


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text, without begin or end ids."""
    schema = T.StructType([field(df, id_col), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        for piece, texts in text_slices(batches, text_col):
            ids, at = enc.encode(texts)
            yield pa.RecordBatch.from_arrays([piece.column(id_col), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], names=[id_col, "ids"])

    return map_arrow(df.select(id_col, text_col), run, schema)


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of id lists, as the library's decode gives it; a null list decodes to the empty text."""
    schema = T.StructType([field(df, id_col), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(model_path).model
        for batch in batches:
            rows = [x or [] for x in batch.column(ids_col).to_pylist()]
            ids = np.array([i for r in rows for i in r], np.int64)
            texts = model.decode_bytes(ids, offsets_of(np.array([len(r) for r in rows], np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array([t.decode() for t in texts], pa.string())], names=[id_col, "text"])

    return map_arrow(df.select(id_col, ids_col), run, schema)


def round_trip(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass; keeps the digests alone: (id, n_tokens, ids_sha256, decoded_sha256)."""
    schema = T.StructType([field(df, id_col), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        model = enc.model
        for piece, texts in text_slices(batches, text_col):
            ids, at = enc.encode(texts)
            decoded = model.decode_bytes(ids, at)
            lengths = model.digits_len[ids]
            digits = model.digits[ragged_index(model.digits_at[ids], lengths)]
            ends = offsets_of(lengths)[at]
            spelled = [hashlib.sha256(digits[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [piece.column(id_col), pa.array(np.diff(at)), pa.array(spelled, pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())],
                names=schema.names,
            )

    return map_arrow(df.select(F.col(id_col), F.col(text_col)), run, schema)
