"""Helpers shared by the operators of this subpackage: tables, scratch tables, folds, ragged arrays."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelocus.session import ensure_checkpoint_dir

#: The white space that the word pattern ``[^\x20\x09-\x0D]+`` leaves out.
BLANKS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/carelocus-llm/{name}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application (Spark's file server copies it)."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="carelocus-zip-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """`mapInArrow` with this package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


_holder: list = []


def hold(owner: str, drop: Callable[[], object]) -> None:
    """Say, in a task, that this Python worker keeps caches of `owner` from now on; `drop` empties them. What another
    owner left is dropped: Spark reuses workers from stage to stage, so the caches of all would add up."""
    if _holder and _holder[0] != owner:
        _holder[1]()
    _holder[:] = [owner, drop]


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet into the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(id_col: str, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as remainder 0, so it is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(k), F.lit(0))


def field(df: DataFrame, name: str, alias: str | None = None) -> T.StructField:
    return T.StructField(alias or name, df.schema[name].dataType, True)


def lower_ascii(text: str) -> str:
    """Lower-case A-Z alone."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def text_slices(batches: Iterator[pa.RecordBatch], column: str, target: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches into slices of about `target` bytes of text (at least one row each); null text is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // target
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                piece = batch.slice(a, b - a)
                yield piece, [x or "" for x in piece.column(column).to_pylist()]


def ragged_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i]+1, ... of lengths[i] each, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """Neighbouring rows with equal first `n_keys` columns, over the borders of batches."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[-1][:n_keys] != row[:n_keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held
