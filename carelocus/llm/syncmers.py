"""Document fingerprints from closed syncmers, with DataFrame functions alone.

A text is a row of symbols: runs of up to `SYMBOL_CHARS` characters without blanks, counted from the start of a word,
and single characters from U+2E80 on, where scripts without blanks lie. A k-mer is `K` symbols in a row; its inner
substrings are the `K - S + 1` runs of `S` symbols. A k-mer is a closed syncmer if the smallest of its inner
substrings' hashes stands at its left or right edge. Whether it is one depends on the k-mer alone, not on what lies
around it, so two texts that share a passage share its syncmers; and of any `K - S + 1` k-mers in a row at least one is
a syncmer, so gaps between anchors are bounded. A text starts with blanks whose hash is below all others: its first
prefixes of 1 to `K - S` symbols are syncmers by the same rule, which gives the shortest texts anchors of their own.

The fingerprint is the text's anchors in order, eight hex digits each: 28 bits of the k-mer's hash and, as last digit,
its distance in symbols from the anchor before. So positions are in the fingerprint, and two anchors match if both k-mer
and distance agree. The likeness of two fingerprints is the Dice coefficient of their multisets of anchors; of two
empty ones it is 1.

`edited` joins each document with the next one by descending id: ids alone are sorted (ranges of ids, the next id inside
a range by a window, over its border by one row a range), then the next document sends its first characters, as many
as are asked for, and its anchors to the one before. Texts are shuffled once, by id.

Cases: a null text is an empty one, without anchors; a null id comes after all others; rows that repeat an id are
one place in the order: each is edited with the same next document, and of several with the next id the one with the
smallest first characters (then anchors) is taken; a single document is its own next one; equal texts have equal
fingerprints; a very long text takes memory in proportion to it alone; without rows there is no result. Only the id and
text columns are read, so extra columns and clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelocus.llm.common import stored

K, S, SYMBOL_CHARS = 9, 2, 4
INNER = K - S + 1  # inner substrings of a k-mer
#: Below every hash of an inner substring.
LEAST = -(1 << 63)


def symbols(text: Column) -> Column:
    wide = r"⺀-￿"
    return F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D{wide}]{{1,{SYMBOL_CHARS}}}|[{wide}]"), F.lit(0))


def ahead(array: Column, by: int) -> Column:
    """The array from element `by` on; zip_with lays it beside the array and pads it with nulls."""
    return F.slice(array, F.lit(by + 1), F.greatest(F.size(array), F.lit(1)))


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """`df` with `out`, the anchors of the text column: whole numbers of a k-mer's hash and the distance before it.

    One projection after the other, and each array is used at least twice in the next one, so that none is worked out
    inside a lambda again.
    """
    kept = df.columns
    rows = df.select(*kept, F.transform(symbols(F.col(text)), lambda x: F.xxhash64(x)).alias("_h"))
    # Element i is the inner substring that ends with symbol i, the first one beginning before the text.
    inner = F.zip_with(F.concat(F.array(F.lit(0).cast("long")), F.col("_h")), F.col("_h"), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    rows = rows.select(*kept, F.concat(F.array_repeat(F.lit(LEAST).cast("long"), INNER - 1), F.slice(inner, F.lit(1), F.size("_h"))).alias("_s"))

    def smaller(array: str, by: int) -> Column:
        return F.zip_with(F.col(array), ahead(F.col(array), by), lambda a, b: F.least(a, b))

    reach, last = 1, "_s"
    while reach < INNER:
        by = min(reach, INNER - reach)
        rows = rows.withColumn(f"_m{reach + by}", smaller(last, by))
        reach, last = reach + by, f"_m{reach + by}"
    s = F.col("_s")
    windows = F.slice(F.col(last), F.lit(1), F.size(s) - (INNER - 1))
    at_edge = F.transform(windows, lambda m, i: F.when((m == F.get(s, i)) | (m == F.get(s, i + (INNER - 1))), i))
    rows = rows.select(*kept, "_s", F.filter(at_edge, lambda i: i.isNotNull()).alias("_at"))
    at = F.col("_at")

    def anchor(i: Column, before: Column) -> Column:
        covering = [F.get(s, i + k) for k in sorted({*range(0, INNER, S), INNER - 1})]
        return (F.shiftright(F.xxhash64(*covering), 36) * 16 + (i - before)).cast("int")

    steps = F.slice(F.concat(F.array(F.lit(-1)), at), F.lit(1), F.size(at))
    return rows.select(*kept, F.zip_with(at, steps, anchor).alias(out))


def fingerprint(anchors: Column) -> Column:
    digits = F.transform(anchors, lambda a: F.lpad(F.hex(a.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    return F.lower(F.array_join(digits, ""))


def counted(df: DataFrame, anchors: str, out: str) -> DataFrame:
    """`df` with `out`: the anchors of a column, each with its number among equal ones. Sorts them and counts runs."""
    kept = df.columns
    rows = df.select(*kept, F.sort_array(anchors).alias("_v"))
    v = F.col("_v")
    starts = F.filter(F.transform(v, lambda x, i: F.when((i == 0) | (x != F.get(v, i - 1)), i)), lambda i: i.isNotNull())
    rows = rows.select(*kept, "_v", starts.alias("_runs"))
    runs = F.col("_runs")
    ends = F.slice(F.concat(runs, F.array(F.size(v))), F.lit(2), F.greatest(F.size(runs), F.lit(1)))
    each = F.zip_with(runs, ends, lambda a, b: F.transform(F.sequence(F.lit(0), b - a - 1), lambda k: F.shiftleft(F.get(v, a).cast("long"), 31) + k))
    return rows.select(*kept, F.when(F.size(runs) == F.size(v), F.transform(v, lambda x: F.shiftleft(x.cast("long"), 31))).otherwise(F.flatten(each)).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two arrays of distinct elements, 1 for two empty ones."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def next_ids(lengths: DataFrame) -> DataFrame:
    """(_id, _n, _next) of each id, with the next smaller id (nulls are smallest), for the smallest one the largest.

    `lengths` holds each id once. It is stored by ranges of ids.
    """
    ranges = stored(lengths.repartitionByRange(F.asc_nulls_first("_id")).withColumn("_range", F.spark_partition_id()), "syncmer-ids")
    inside = F.lead(F.struct("_id")).over(Window.partitionBy("_range").orderBy(F.desc_nulls_last("_id")))
    tops = ranges.groupBy("_range").agg(F.max("_id").alias("_top"))  # one row a range: a partition of the shuffle above
    down = Window.orderBy(F.desc("_range"))
    whole = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select("_range", F.coalesce(F.lead(F.struct("_top")).over(down), F.first(F.struct("_top")).over(whole)).alias("_below"))
    rows = ranges.withColumn("_inside", inside).join(tops, "_range")
    return rows.select("_id", "_n", F.when(F.col("_inside").isNull(), F.col("_below._top")).otherwise(F.col("_inside._id")).alias("_next"))


def edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id key columns `_id`, `_text`, `_edited`, `_next_anchors`): each text with its last third replaced by the start of the next one."""
    kind = df.schema[id_col].dataType
    # A null id as a value and a flag of its own, so that plain equality joins nulls too.
    key = [F.coalesce(F.col(id_col), F.lit(0).cast(kind)).alias("_k"), F.col(id_col).isNull().alias("_none")]
    docs = df.select(*key, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    lengths = df.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.coalesce(F.length(text_col), F.lit(0))).alias("_n"))
    asks = next_ids(lengths).select(
        F.coalesce("_id", F.lit(0).cast(kind)).alias("_to"), F.col("_id").isNull().alias("_to_none"), F.floor(F.col("_n") / 3).cast("int").alias("_need"),
        F.coalesce("_next", F.lit(0).cast(kind)).alias("_k"), F.col("_next").isNull().alias("_none"),
    )
    sent = with_anchors(docs.join(asks, ["_k", "_none"]), "_text", "_anchors")
    sent = sent.select(F.col("_to").alias("_k"), F.col("_to_none").alias("_none"), F.struct(F.left("_text", "_need").alias("start"), F.col("_anchors").alias("anchors")).alias("_sent"))
    rows = docs.join(sent.groupBy("_k", "_none").agg(F.min("_sent").alias("_sent")), ["_k", "_none"])
    third = F.floor(F.length("_text") / 3).cast("int")
    return rows.select(
        F.when(~F.col("_none"), F.col("_k")).alias("_id"), "_text",
        F.concat(F.left("_text", F.length("_text") - third), F.left("_sent.start", third)).alias("_edited"), F.col("_sent.anchors").alias("_next_anchors"),
    )


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document."""
    rows = with_anchors(with_anchors(edited(df, id_col, text_col), "_text", "_own"), "_edited", "_new")
    for anchors, sets in (("_own", "_own_set"), ("_new", "_new_set"), ("_next_anchors", "_next_set")):
        rows = counted(rows, anchors, sets)
    return rows.select(
        F.col("_id").alias(id_col), F.length("_text").cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("_own")).alias("fingerprint"), fingerprint(F.col("_new")).alias("edited_fingerprint"),
        likeness(F.col("_own_set"), F.col("_new_set")).alias("near_edited"), likeness(F.col("_own_set"), F.col("_next_set")).alias("near_next"),
    )
