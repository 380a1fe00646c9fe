"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length: a bucket holds lengths within a factor `1 + width`, and large buckets are cut into
blocks, longest vectors first. Every query carries the k-th best score found so far as its threshold. For a block
with longest vector L the local cosine threshold of query q is threshold / (|q| L): above 1, or below what the
block's shortest and longest vectors allow, the block is skipped; else the query prunes the block either by length
(only vectors of at least threshold / |q|) or by its focus coordinate (a vector whose coordinate there is too far
from the query's cannot reach the cosine), whichever keeps fewer. Only what is left is multiplied, in exact
integer arithmetic.

Starting thresholds come from the block of the longest vectors; each task then walks its blocks from long to
short and raises the thresholds as it goes. Tasks return k rows per query and block at most, and a window keeps
the best k.

Cases: null vectors, null ids, and vectors that hold null or non-finite components take no part; shorter vectors
count as filled up with zeros; all rows with a query's own id are its own and no candidates of it; equal scores
rank by id, repeated rows of one id each take a place; an empty table gives an empty result. Floats only prune, with
room for their rounding; what is left is multiplied and ranked in 64-bit integers. A table with a vector whose squared
length does not fit a long is refused before the search; below that no product nor sum of one can overflow. Only the id and vector columns are read, so extra columns and
clashing names do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelocus.llm.common import map_arrow, stored

BLOCK = 2048
QUERY_BLOCK = 512
WIDTH = 0.05


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(vec_id, v array<bigint>, squared length) of the rows that take part: floor(scale * x) of each component."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))
    return rows.withColumn("squared", F.aggregate("v", F.lit(0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")))


def blocks(rows: DataFrame, size: int, key: Column, name: str) -> DataFrame:
    """Rows packed into one row per block: ids, squared lengths, and the vectors one after the other. `key` decides the block; no block gets
    more than about `size` rows."""
    return rows.withColumn(name, key).groupBy(name).agg(F.sort_array(F.collect_list(F.struct((-F.col("squared")).alias("less"), "vec_id", "v"))).alias("rows"))


def unpack(rows: pa.Scalar, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, integer matrix) of one block; components beyond a vector's end are 0."""
    values = rows.values
    ids = values.field("vec_id").to_numpy(zero_copy_only=False)
    vectors = values.field("v")
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(ids), dims), np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        out[:] = flat.reshape(len(ids), dims)
    else:
        at = np.concatenate([[0], np.cumsum(lengths)])
        for i, n in enumerate(lengths.tolist()):
            out[i, :n] = flat[at[i] : at[i + 1]]
    return ids, out


class QueryBlock:
    """Queries with their thresholds and best rows so far."""

    def __init__(self, ids: np.ndarray, exact: np.ndarray, k: int, start: np.ndarray | None = None):
        vectors = exact.astype(float)
        self.ids, self.exact, self.vectors, self.k = ids, exact, vectors, k
        self.norm = np.sqrt((vectors * vectors).sum(1))
        self.threshold = np.full(len(ids), -math.inf) if start is None else start
        self.unit = np.divide(vectors, self.norm[:, None], out=np.zeros_like(vectors), where=self.norm[:, None] > 0)

    def search(self, ids: np.ndarray, exact: np.ndarray) -> list[tuple[int, int, int]]:
        """Rows (query, candidate, score) of the block's best k for each query that can still matter."""
        vectors = exact.astype(float)
        norm = np.sqrt((vectors * vectors).sum(1))  # falls
        unit = np.divide(vectors, norm[:, None], out=np.zeros_like(vectors), where=norm[:, None] > 0)
        longest = norm[0] if len(norm) else 0.0
        order = np.argsort(unit, 0, kind="stable")
        found = []
        for q in range(len(self.ids)):
            need, reach = self.threshold[q], self.norm[q] * longest
            if need > reach * (1 + 1e-9) + 1e-6:
                continue  # the local cosine threshold is above 1
            some = slice(None)
            if need > 0 and reach > 0:
                # Margins keep rounding from dropping a vector that just reaches the threshold.
                by_length = int(np.searchsorted(-norm, -(need / self.norm[q] * (1 - 1e-9) - 1e-6), "right"))
                cosine = min(1.0, need / reach)
                focus = int(np.abs(self.unit[q]).argmax())
                c = self.unit[q, focus]
                spread = math.sqrt(max(0.0, (1 - cosine * cosine) * (1 - c * c)))
                low, high = (c * cosine - spread, c * cosine + spread)
                if c >= cosine:
                    high = 1.0
                if c <= -cosine:
                    low = -1.0
                column = unit[order[:, focus], focus]
                a, b = np.searchsorted(column, [low - 1e-9, high + 1e-9], "left")
                some = slice(by_length) if by_length <= b - a else order[a:b, focus]
            room = reach * (self.vectors.shape[1] + 4) * 2.0**-52  # twice what a float product can be off
            near = vectors[some] @ self.vectors[q]
            good = (ids[some] != self.ids[q]) & (near >= need - room)
            if good.sum() > self.k:
                good &= near >= np.partition(near[good], -self.k)[-self.k] - 2 * room
            candidates, score = ids[some][good], exact[some][good] @ self.exact[q]
            if len(score) > self.k:
                best = np.lexsort((candidates, -score))[: self.k]
                candidates, score = candidates[best], score[best]
            if len(score) == self.k:
                self.threshold[q] = max(need, float(score.min()))
            found += [(int(self.ids[q]), int(i), int(s)) for i, s in zip(candidates, score, strict=True)]
        return found


def top_k(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = 50, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK, width: float = WIDTH
) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's best k. Queries: ids divisible by `query_every`."""
    spark = df.sparkSession
    rows = stored(integer_vectors(df, id_col, vector_col), "topk-vectors")
    longest = rows.agg(F.max("squared")).first()[0] or 0.0
    if longest >= 2.0**63 * (1 - 1e-9):
        raise ValueError(f"a vector's squared length of about {longest:.4g} is too large for products in 64 bits")
    bucket = F.when(F.col("squared") > 0, F.floor(F.log("squared") / 2 / math.log(1 + width))).otherwise(F.lit(-(1 << 40)))
    sized = rows.withColumn("bucket", bucket.cast("long"))
    sizes = sized.groupBy("bucket").agg(F.count("*").alias("in_bucket"))  # few rows: lengths span few factors
    spread = sized.join(F.broadcast(sizes), "bucket")  # at most log(2^63) / 2 / log(1 + width) buckets
    part = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.ceil(F.col("in_bucket") / block))
    candidates = stored(blocks(spread, block, F.struct("bucket", part.alias("part")), "place"), "topk-blocks")
    queries = rows.filter(F.pmod("vec_id", F.lit(query_every)) == 0)
    n_queries, dims = queries.agg(F.count("*")).first()[0], rows.agg(F.max(F.size("v"))).first()[0] or 0
    n_blocks = max(1, -(-n_queries // query_block))
    asked = stored(blocks(queries, query_block, F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(n_blocks)).cast("long"), "q").withColumnRenamed("rows", "asked"), "topk-queries")

    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks_seen: dict[int, QueryBlock] = {}
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                q = batch.column(names.index("q"))[i].as_py()
                if q not in blocks_seen:
                    if len(blocks_seen) >= 8:  # memory
                        blocks_seen.clear()
                    ids, vectors = unpack(batch.column(names.index("asked"))[i], dims)
                    start = None
                    if "floor" in names:
                        given = {r["query_id"]: r["least"] for r in batch.column(names.index("floor"))[i].as_py() or []}
                        start = np.array([given.get(x, -math.inf) for x in ids.tolist()], float)
                    blocks_seen[q] = QueryBlock(ids, vectors, k, start)
                found = blocks_seen[q].search(*unpack(batch.column(names.index("rows"))[i], dims))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], pa.int64()) for c in range(3)], names=schema.names)

    # A stated query set against all rows, in blocks: each block of candidates meets each block of queries once.
    met = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("q")
    first = candidates.orderBy(F.col("place.bucket").desc(), F.col("place.part")).limit(1).select("rows", met)
    started = map_arrow(first.join(asked, "q").select("q", "asked", "rows"), search, schema)
    floors = started.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k)
    keyed = floors.withColumn("q", F.pmod(F.xxhash64(F.col("query_id"), F.lit(5)), F.lit(n_blocks)).cast("long")).groupBy("q").agg(F.collect_list(F.struct("query_id", "least")).alias("floor"))
    ready = stored(asked.join(keyed, "q", "left"), "topk-started")
    pairs = candidates.select("place", "rows", met).join(ready, "q").sortWithinPartitions("q", F.col("place.bucket").desc())
    found = map_arrow(pairs.select("q", "asked", "floor", "rows"), search, schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
