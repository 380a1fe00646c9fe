"""Source divergence audit: how far the words of each source lie from those of the others and of their language.

A term's probability in a group (a source of a language, or the language) is p = 1 + floor(10^9 (count + 2) / (N + 2 V))
over the V terms the language keeps; two groups differ at a term by f = floor((p - q)^2 / (p + q)).

Method, run-length columns: the kept vocabulary of a language is cut into blocks in the order of its total counts, and
inside a block the terms are reordered by their counts in the largest sources, then in the others, so that equal counts
lie together; most counts are small, so a source's column of a block has far fewer runs of equal counts than terms.
Each column is run-length encoded. For a pair of sources the borders of both columns are merged; p, q and f are worked
out once a merged run and f is multiplied by its length. Sums of blocks add up to the pair's value.

Spark's part: tasks count terms in bounded tables and send (language, source, term) counts, which are summed before
the terms of a language meet; nothing else of the texts is shuffled. A block is the unit of all further work: a
language or source with a third of all rows only has more blocks. Every source of a language has a column in each of
its blocks (an absent one is a single run of zeros), so work and memory of a block follow the number of pairs asked
for, and no vocabulary, no list of groups and no column of a whole language is held in one place.

All numbers are whole and exact: probabilities beyond 64 bits on the way are worked out in Python's integers.

Cases: null text, language or source is an empty one; a group without terms has p from counts of zero; a language that
keeps no term has pairs of value 0 and no terms; repeated rows count each; a very long text takes memory in proportion
to it alone; without rows there is no result. Only the three named columns
are read, so extra columns and clashing names do no harm.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelocus.llm.common import map_arrow, runs, stored

MIN_DOCUMENTS, TOP_TERMS = 10, 10
SCALE, ADDED = 10**9, 2
#: Terms a block, and entries a task's tables of counts hold before they are sent.
BLOCK_TERMS, TABLE_ENTRIES = 1 << 14, 200_000
#: Sources by whose counts the terms of a block are ordered, from the largest on.
ORDER_COLUMNS = 12

#: Bytes of terms, A-Z lower-cased; all others become blanks. In UTF-8 every byte of a character beyond ASCII is 128 or more.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", entries: int = TABLE_ENTRIES) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, and a row with a null term for each group."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("docs", T.LongType())])

    def table(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            columns = [[lang] * (len(terms) + 1), [source] * (len(terms) + 1), [None, *(t.decode() for t in terms)], [0, *n.values()], [0, *(docs[t] for t in terms)]]
            for at in range(0, len(terms) + 1, 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)], t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(lambda: (Counter(), Counter()))
        size = 0
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, source, text in zip(langs, sources, batch.column(2), strict=True):
                n, docs = held[lang, source]
                before = len(n)
                terms = text.as_py().translate(_TERM_BYTES).split()
                n.update(terms)
                docs.update(set(terms))
                size += len(n) - before
                if size > entries:
                    yield from table(held)
                    held.clear()
                    size = 0
        yield from table(held)

    def of(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    rows = map_arrow(df.select(of(lang_col).alias("lang"), of(source_col).alias("source"), of(text_col).cast("binary").alias("text")), run, schema)
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, term, total, counts): the terms in enough documents of their language, with their counts by source."""
    terms = counts.filter(F.col("term").isNotNull()).groupBy("lang", "term")
    own = F.sort_array(F.collect_list(F.struct("source", "n")))  # one entry a source
    return terms.agg(F.sum("docs").alias("_docs"), F.sum("n").alias("total"), own.alias("counts")).filter(F.col("_docs") >= min_documents).drop("_docs")


def probabilities(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """1 + floor(SCALE (count + ADDED) / (n + ADDED v)), exact."""
    if not len(counts):
        return np.zeros(0, np.int64)
    if int(counts.max()) + ADDED < (1 << 62) // SCALE:
        return 1 + SCALE * (counts + ADDED) // (n + ADDED * v)
    return np.array([1 + SCALE * (c + ADDED) // (n + ADDED * v) for c in counts.tolist()], np.int64)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def run_length(rows: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, count) of the runs of equal counts of a column of `size` counts that is 0 but at the ascending `rows`."""
    starts = np.unique(np.concatenate([[0], rows, rows + 1]))
    starts = starts[starts < size]
    values = np.zeros(len(starts), np.int64)
    values[np.searchsorted(starts, rows)] = counts
    new = np.append(True, values[1:] != values[:-1])[: len(starts)]
    return starts[new], values[new]


def run_length_columns(kept: DataFrame, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(lang, block, source, size, starts, counts): the columns of each block, and a row with a null source for the block."""
    schema = T.StructType(
        [T.StructField("lang", T.StringType()), T.StructField("block", T.LongType()), T.StructField("source", T.StringType()), T.StructField("size", T.LongType()), T.StructField("starts", T.BinaryType()), T.StructField("counts", T.BinaryType())]
    )

    def encode(lang: str, block: int, terms: list[list[dict]]) -> pa.RecordBatch:
        rows, counts = defaultdict(list), defaultdict(list)
        for row, term in enumerate(terms):
            for own in term:
                rows[own["source"]].append(row)
                counts[own["source"]].append(own["n"])
        size = len(terms)
        largest = sorted(counts, key=lambda s: (-sum(counts[s]), s))[:ORDER_COLUMNS]
        dense = np.zeros((len(largest), size), np.int64)
        for column, source in zip(dense, largest, strict=True):
            column[rows[source]] = counts[source]
        place = np.empty(size, np.int64)
        place[np.lexsort(dense[::-1])] = np.arange(size)
        out = [(lang, block, None, size, None, None)]
        for source in sorted(rows):
            at = place[rows[source]]
            order = np.argsort(at)
            starts, values = run_length(at[order], np.array(counts[source], np.int64)[order], size)
            out.append((lang, block, source, size, starts.astype("<i4").tobytes(), values.astype("<i8").tobytes()))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, lang, held = TaskContext.get().partitionId() << 32, None, []
        for batch in batches:
            for own, terms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (own != lang or len(held) == block_terms):
                    yield encode(lang, block, held)
                    block, held = block + 1, []
                lang = own
                held.append(terms)
        if held:
            yield encode(lang, block, held)

    order = ["lang", "total", "_shape", "term"]  # equal counts next to each other, over tasks too
    dealt = kept.withColumn("_shape", F.xxhash64("counts")).repartitionByRange(*order).sortWithinPartitions(*order)
    return map_arrow(dealt.select("lang", "counts"), run, schema)


def pair_sums(columns: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): f summed over the kept terms, for every ordered pair of sources of a language."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("item", T.StringType()), T.StructField("value", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs(batches, 2):
            size, held = unit[0][3], []
            for _, _, source, _, n, v, starts, counts in unit:
                starts = np.zeros(1, np.int64) if starts is None else np.frombuffer(starts, "<i4").astype(np.int64)
                counts = np.zeros(1, np.int64) if counts is None else np.frombuffer(counts, "<i8").astype(np.int64)
                held.append((source, starts, probabilities(counts, n, v) if v else counts + 1))
            lang = unit[0][0]
            for k, (source, starts, p) in enumerate(held):
                others, values = [], []
                for other, borders, q in held[:k]:
                    merged = np.union1d(starts, borders)
                    f = divergence(p[np.searchsorted(starts, merged, "right") - 1], q[np.searchsorted(borders, merged, "right") - 1])
                    others.append(other)
                    values.append(int((f * np.diff(merged, append=size)).sum()))
                if others:
                    own = [source] * len(others)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * (2 * len(own))), pa.array(own + others), pa.array(others + own), pa.array(values + values, pa.int64())], names=schema.names)

    headers = columns.filter(F.col("source").isNull()).select("lang", "block", "size")
    none = groups.filter("v = 0").select("lang", F.lit(-1).cast("long").alias("block"), F.lit(0).cast("long").alias("size")).distinct()
    every = headers.unionByName(none).join(groups, "lang")
    runs_of = columns.filter(F.col("source").isNotNull()).select("lang", "block", "source", "starts", "counts")
    rows = every.join(runs_of, ["lang", "block", "source"], "left").select("lang", "block", "source", "size", "n", "v", "starts", "counts")
    dealt = rows.repartition("lang", "block").sortWithinPartitions("lang", "block", "source")
    return map_arrow(dealt, run, schema).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def group_sizes(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, n, v, n_lang) of every occurring group."""
    sums = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    groups = counts.filter(F.col("term").isNull()).select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    return groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "v", "n_lang")))


def over_used(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the kept terms that a group holds and has likelier than its language."""

    def p(count: str, n: str) -> Column:
        scaled = F.lit(SCALE).cast("decimal(12,0)") * (F.col(count) + ADDED).cast("decimal(20,0)")
        return F.lit(1).cast("long") + F.call_function("div", scaled, (F.col(n) + ADDED * F.col("v")).cast("decimal(20,0)"))

    rows = kept.select("lang", "term", "total", F.explode("counts").alias("c")).select("lang", F.col("c.source").alias("source"), "term", "total", F.col("c.n").alias("count"))
    rows = rows.filter("count > 0").join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p("count", "n").alias("p"), p("total", "n_lang").alias("q"))
    return rows.filter("p > q").select("lang", "source", "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))


def source_divergence(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language by its divergence, and the `top_terms`
    terms that set the source apart from its language. Stores the counts, the kept terms and their columns."""
    counts = stored(term_counts(df, text_col, lang_col, source_col), "divergence-counts")
    kept = stored(kept_terms(counts, min_documents), "divergence-terms")
    groups = stored(group_sizes(counts, kept), "divergence-groups")
    columns = stored(run_length_columns(kept, block_terms), "divergence-columns")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    return ranked(pair_sums(columns, groups), "pair").unionByName(ranked(over_used(kept, groups), "term").filter(F.col("rank") <= top_terms))
