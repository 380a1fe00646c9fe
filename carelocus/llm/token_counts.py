"""Token counts with overlap resynchronisation.

Texts of up to `chunk_chars` characters are encoded whole by the library. A huge text is encoded in overlapping
chunks with offsets, so memory follows the chunk and not the text. Two neighbouring chunks are spliced inside
their overlap, at a token boundary that both have and that is proven stable: no piece of the vocabulary holds the
two characters around it side by side, so no merge can ever cross it and the tokens on either side do not depend
on what lies beyond. Where the overlap has no such boundary the chunk is widened, twofold each time, up to the end
of the text.

Cases: null and empty texts have 0 tokens (null: 0 bytes too); a very long word without a stable boundary is
encoded whole; repeated rows give repeated results; an empty table gives an empty one. Only the id and the text
column are read, so extra columns and clashing names do no harm.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelocus.llm.common import field, map_arrow, text_slices

SPACE = "▁"
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256


class Counter:
    """Counts tokens of texts with a SentencePiece model that merges pieces and leaves characters as they are."""

    def __init__(self, path: str):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = spm.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        proto.ParseFromString(self.sp.serialized_model_proto())
        spec = proto.normalizer_spec
        #: Splicing needs offsets in the text itself and pieces that only merges make.
        self.splices = (
            proto.trainer_spec.model_type == pb.TrainerSpec.BPE
            and not spec.precompiled_charsmap
            and not spec.remove_extra_whitespaces
            and not any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in proto.pieces)
        )
        self.beside = {p.piece[i : i + 2] for p in proto.pieces if p.type == pb.ModelProto.SentencePiece.NORMAL for i in range(len(p.piece) - 1)}

    def stable(self, text: str, at: int) -> bool:
        """No piece spans the boundary before text[at]."""
        return text[at - 1 : at + 1].replace(" ", SPACE) not in self.beside

    def starts(self, chunk: str, base: int) -> list[int]:
        """Where the tokens of a chunk begin, as offsets in the text."""
        return [base + a for a, _ in self.sp.encode(chunk, return_type="offset_mapping")["offsets"]]

    def count(self, texts: list[str], chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> list[int]:
        short = [t for t in texts if len(t) <= chunk_chars or not self.splices]
        counts = iter([len(ids) for ids in self.sp.encode(short, return_type="numpy", num_threads=1)] if short else [])
        return [next(counts) if len(t) <= chunk_chars or not self.splices else self.spliced(t, chunk_chars, overlap_chars) for t in texts]

    def spliced(self, text: str, chunk_chars: int, overlap_chars: int) -> int:
        total, begin, valid = 0, 0, 0  # tokens before `valid` are counted; the present chunk starts at `begin`
        size, overlap = max(2, chunk_chars), max(2, overlap_chars)
        starts = None
        while True:
            end = min(len(text), begin + size)
            if starts is None:
                starts = self.starts(text[begin:end], begin)
            if end == len(text):
                return total + sum(s >= valid for s in starts)
            after = max(valid + 1, end - overlap)
            here = set(starts)
            marks = [p for p in range(end - 1, after, -1) if p in here and self.stable(text, p)]
            nxt = None
            if marks:  # the next chunk begins a little before the splice, inside this one
                begin_next = max(begin + 1, after - 1)
                end_next = min(len(text), begin_next + max(2, chunk_chars))
                nxt = self.starts(text[begin_next:end_next], begin_next)
                there = set(nxt)
                splice = next((p for p in marks if p in there and p > begin_next), None)
            if not marks or splice is None:
                size, overlap, starts = 2 * size, 2 * overlap, None  # alignment failed: widen
                continue
            total += sum(valid <= s < splice for s in starts)
            begin, valid, starts = begin_next, splice, nxt
            size, overlap = max(2, chunk_chars), max(2, overlap_chars)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(
    df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text."""
    schema = T.StructType([field(df, id_col), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_path)
        for piece, texts in text_slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(2), pa.array(own.count(texts, chunk_chars, overlap_chars), pa.int64())], names=schema.names
            )

    rows = df.select(F.col(id_col), F.col(text_col).alias("_text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("_bytes"))
    return map_arrow(rows, run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
