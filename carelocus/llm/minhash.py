"""MinHash near-duplicates by a signature-coordinate inverted join.

Documents with equal shingle sets form one class, so copies meet once, in an aggregate. Each class is posted under
its first `POSTED` coordinate-value pairs. Pairs that no other class has cannot collide; a class with fewer than
`POSTED_MATCHES` shared ones cannot reach that many collisions and leaves. Of the shared ones a class is posted
under its rarest only, as many as two classes with `POSTED_MATCHES` collisions need to meet at least once (prefix
merging); frequent pairs, such as those of a line that thousands of texts hold, are skipped. Classes that meet and
agree in `MATCHES` of all `COORDINATES` are confirmed on their full sets.

Postings are worked off in two rounds, as links inside a component change nothing. First every class of a posting
list is held against the list's first class of like size (linear). The components of the links found split the
lists; then only classes of different components are compared, those outside a list's largest component with all of
the list, two blocks at a time, within tasks; what passes the counts goes to the same confirmation. So no list is expanded into all its pairs, and no pair of different
components that meets in a list is left out.

At a similarity of 0.8 the odds to miss a pair are about 2e-6: 14 or more of 32 and 80 or more of 128 coordinates agree.

Cases: texts with fewer words than a shingle are one shingle; null and empty texts have none and are linked with
nothing; rows with a null id get a null component and are not kept; an id on several rows is one node; ties go to
the smallest id; an empty table gives an empty result. Only the id and text columns are read, so extra columns and
clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelocus.llm.common import field, hold, map_arrow, offsets_of, runs, stored, text_slices
from carelocus.llm.components import components

WORDS = 4
PERCENT = 80
COORDINATES, MATCHES = 128, 80
POSTED, POSTED_MATCHES = 32, 14
BLOCK = 256
#: In longer lists pairs are refuted within the task by their sets; the result is the same.
LONG_LIST = 64
CACHED_WORDS = 300_000

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def forget() -> None:
    """Empty the cache of word hashes. A function of the module: a task's closure would hold a copy of the cache."""
    _hashes.clear()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles. Bytes are lower-cased and split as ASCII, which is
    just A-Z and the blanks of the word pattern."""
    rows = [t.encode().lower().split() for t in texts]
    sizes = np.array([len(r) for r in rows], np.int64)
    h = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(rows)), np.uint64, int(sizes.sum()))
    at = offsets_of(sizes)
    rolled = np.zeros(len(h), np.uint64)
    for k in range(words):
        n = len(h) - k
        if n > 0:
            rolled[:n] = mix(rolled[:n] * np.uint64(0x9E3779B97F4A7C15) + h[k:])
    out = []
    for a, n in zip(at[:-1].tolist(), sizes.tolist(), strict=True):
        if n >= words:
            out.append(np.unique(rolled[a : a + n - words + 1]))
        elif n:
            one = np.uint64(n)
            for x in h[a : a + n]:
                one = mix(np.array([one], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + x)[0]
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """Smallest value of each coordinate's hash function over each set (rows: sets that are not empty)."""
    flat = np.concatenate(sets)
    first = offsets_of(np.array([len(s) for s in sets], np.int64))[:-1]
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(((flat * _FACTORS[k] + _TERMS[k]) >> np.uint64(32)).astype(np.uint32), first)
    return out


def described(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, n, k1, k2, sig): size, identity and signature of each document's shingle set; sig is null if it is empty."""
    schema = T.StructType([field(df, id_col, "id"), *(T.StructField(c, T.LongType()) for c in ("n", "k1", "k2")), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("minhash", forget)
        for piece, texts in text_slices(batches, "_text"):
            sets = shingle_sets(texts, words)
            some = [s for s in sets if len(s)]
            sigs = iter(signature(some)) if some else iter(())
            k1 = np.array([s.sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).astype(np.int64)
            k2 = np.array([mix(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).astype(np.int64)
            n = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(n, pa.int64()), pa.array(k1), pa.array(k2), pa.array([next(sigs).tobytes() if x else None for x in n], pa.binary())], names=schema.names
            )

    return map_arrow(df.select(F.col(id_col), F.col(text_col).alias("_text")), run, schema)


def postings(classes: DataFrame) -> DataFrame:
    """(token, a) of each class's rarest shared coordinate-value pairs."""
    schema = T.StructType([classes.schema["a"], T.StructField("tokens", T.ArrayType(T.LongType()))])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = np.arange(POSTED, dtype=np.int64) << 32
        for batch in batches:
            if batch.num_rows:
                sigs = np.stack([np.frombuffer(x, np.uint32)[:POSTED] for x in batch.column(1).to_pylist()])
                flat = (sigs.astype(np.int64) | high).ravel()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1) * POSTED, pa.int32()), pa.array(flat))], names=schema.names)

    posted = map_arrow(classes.select("a", "sig"), spell, schema).select("a", F.explode("tokens").alias("token"))
    shared = posted.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    lists = posted.join(shared, "token").groupBy("a").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own"))  # at most POSTED
    lists = lists.filter(F.size("own") >= POSTED_MATCHES)
    return lists.select("a", F.explode(F.slice("own", F.lit(1), F.size("own") - F.lit(POSTED_MATCHES - 1))).alias("t")).select("a", F.col("t.token").alias("token"))


def like_sizes(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    left, right = sets.select("a", F.col("set").alias("set_a")), sets.select(F.col("a").alias("b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return pairs.join(right, "b").join(left, "a").filter(100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)).select("a", "b").distinct()


def block_units(lists: DataFrame) -> DataFrame:
    """Rows of posting lists dealt to units (token, low, high) in which all of a list's pairs of different components
    meet once, `own` being the row's block. The classes outside a list's largest component (minor) are cut into blocks
    0, 1, ..., the others into -1, -2, ...; a unit holds two blocks, at least one of them minor, or one minor block with
    itself, so about 2 x BLOCK rows, however long the list. A short list is one unit."""
    minors, majors = F.ceil(F.col("n_minor") / F.lit(BLOCK)).cast("int"), F.ceil((F.col("size") - F.col("n_minor")) / F.lit(BLOCK)).cast("int")
    short, spot = F.col("size") <= BLOCK, F.xxhash64("a", "token")
    own = F.when(short, F.lit(0)).when(F.col("major"), -1 - F.pmod(spot, majors)).otherwise(F.pmod(spot, minors)).cast("int")
    counts = {"low": F.sequence(F.lit(0), minors - 1), "high": F.when(majors > 0, F.sequence(-majors, F.lit(-1))).otherwise(F.array().cast("array<int>"))}
    others = F.when(short, F.array(F.lit(0))).when(F.col("major"), counts["low"]).otherwise(F.concat(counts["high"], counts["low"]))
    placed = lists.withColumn("own", own).withColumn("other", F.explode(others))
    return placed.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other")


def compare_blocks(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in one posting list whose signatures agree often enough, each pair in
    the first list that both are posted in.

    `lists`: token, a, n, sig, posted (all tokens of the class), part (component), major (of the list's largest
    component), size (of the list), n_minor (its classes that are not major). In long lists `short`, the
    set as 32-bit hashes, refutes pairs at once: a common shingle is common there too, so no true link is refuted."""
    row = ["own", "a", "part", "n", "sig", "posted", "short"]
    id_type = lists.schema["a"].dataType
    schema = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs(batches, 3):
            token, low, high = unit[0][:3]
            own, ids, part, n = (np.array([r[i] for r in unit]) for i in (3, 4, 5, 6))
            home, there = np.flatnonzero(own == low), np.flatnonzero(own == high)
            if not len(home) or not len(there):
                continue
            sigs = np.stack([np.frombuffer(r[7], np.uint32) for r in unit])
            left, right = [], []
            for x in home.tolist():
                y = there[part[there] != part[x]]
                if low == high:
                    y = y[ids[y] > ids[x]]
                y = y[100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])]
                y = y[(sigs[y] == sigs[x]).sum(1) >= MATCHES]
                y = [i for i in y.tolist() if min(set(unit[x][8]) & set(unit[i][8])) == token]
                if unit[x][9] is not None:
                    mine = np.frombuffer(unit[x][9], np.uint32)
                    kept = []
                    for i in y:
                        # Shingles of one set that share a hash count once; the sizes make up for it.
                        other = np.frombuffer(unit[i][9], np.uint32)
                        both = len(np.intersect1d(mine, other, assume_unique=True)) + int(n[x]) - len(mine) + int(n[i]) - len(other)
                        if 100 * both >= percent * (int(n[x]) + int(n[i]) - both):
                            kept.append(i)
                    y = kept
                left += [min(ids[x], ids[i]) for i in y]
                right += [max(ids[x], ids[i]) for i in y]
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=["a", "b"]).cast(pa.schema([("a", arrow_type), ("b", arrow_type)]))

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_type = to_arrow_type(id_type)
    dealt = block_units(lists).select("token", "low", "high", *row).repartition("token", "low", "high").sortWithinPartitions("token", "low", "high")
    return map_arrow(dealt, run, schema)


def mixed_lists(lists: DataFrame, found: DataFrame) -> DataFrame:
    """Posting lists that hold more than one component, each row with its component (part) and whether it is the list's largest."""
    parted = lists.join(found.select(F.col("node").alias("a"), "component"), "a", "left").withColumn("part", F.coalesce("component", "a")).drop("component")
    shares = parted.groupBy("token", "part").agg(F.count("*").alias("k"))
    mixed = shares.groupBy("token").agg(F.sum("k").alias("size"), F.count("*").alias("parts"), F.max(F.struct("k", "part")).alias("most")).filter("parts > 1")
    return parted.join(mixed.select("token", "size", (F.col("size") - F.col("most.k")).alias("n_minor"), F.col("most.part").alias("most")), "token").withColumn("major", F.col("part") == F.col("most"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every document. Runs its rounds while the result is built."""
    docs = stored(described(df, id_col, text_col, words), "minhash-docs")
    key = ["n", "k1", "k2"]
    classes = stored(docs.filter("n > 0 and id is not null").groupBy(*key).agg(F.min("id").alias("a"), F.first("sig").alias("sig")), "minhash-classes")
    lists = stored(postings(classes).join(classes.select("a", "n", "sig"), "a"), "minhash-postings")
    # Full sets of the classes that are posted at all.
    posted = lists.select(F.col("a").alias(id_col)).distinct()
    set_schema = T.StructType([field(df, id_col, "a"), T.StructField("set", T.ArrayType(T.LongType(), False)), T.StructField("short", T.BinaryType())])

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("minhash", forget)
        for piece, texts in text_slices(batches, "_text"):
            sets = shingle_sets(texts, words)
            at = offsets_of(np.array([len(s) for s in sets], np.int64))
            short = [np.unique((s & np.uint64(0xFFFFFFFF)).astype(np.uint32)).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(sets).astype(np.int64))), pa.array(short, pa.binary())], names=set_schema.names)

    texts = df.select(F.col(id_col), F.col(text_col).alias("_text")).join(posted, id_col, "left_semi")
    sets = stored(map_arrow(texts, full, set_schema), "minhash-sets")

    # Round 1: every class against the first of its list with a like size.
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(-np.log(percent / 100)))).cast("int")
    banded = lists.select("token", "a", "n", band.alias("band"))
    pivots = banded.groupBy("token", "band").agg(F.min(F.struct("a", "n")).alias("p")).select("token", "band", F.col("p.a").alias("pivot"), F.col("p.n").alias("pivot_n"))
    # A list's bands overlap: the first class of the band below is tried as well.
    tried = pivots.unionByName(pivots.withColumn("band", F.col("band") + 1))
    first = banded.join(tried, ["token", "band"]).filter((F.col("a") != F.col("pivot")) & like_sizes(F.col("n"), F.col("pivot_n"), percent))
    pairs = stored(first.select(F.least("a", "pivot").alias("a"), F.greatest("a", "pivot").alias("b")).distinct(), "minhash-pairs")
    links = stored(confirmed(pairs, sets, percent), "minhash-links")
    found = components(links)

    # Round 2: classes of one list and different components.
    tokens = lists.groupBy("a").agg(F.collect_list("token").alias("posted"))  # at most POSTED
    held = mixed_lists(lists, found).join(tokens, "a")
    long = held.filter(F.col("size") > LONG_LIST).join(sets.select("a", F.size("set").cast("long").alias("n"), "short").dropDuplicates(["a", "n"]), ["a", "n"])
    met = compare_blocks(long.unionByName(held.filter(F.col("size") <= LONG_LIST).withColumn("short", F.lit(None).cast("binary"))), percent)
    more = stored(met.join(pairs, ["a", "b"], "left_anti").distinct(), "minhash-pairs")
    # Each node's component stands for the links of the first round, so that few rounds are left.
    stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    found = components(stars.unionByName(stored(confirmed(more, sets, percent), "minhash-links")))

    named = classes.select(*key, "a").join(found.select(F.col("node").alias("a"), "component"), "a", "left").select(*key, F.coalesce("component", "a").alias("component_id"))
    out = docs.select("id", *key).join(named, key, "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
