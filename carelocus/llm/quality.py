"""Quality rules by distribution divergence, with DataFrame functions alone.

A document's histogram over character classes and its histogram over common words are compared with its
language's references by Jensen-Shannon distance (base 2, so between 0 and 1). The references are means of the
histograms of all documents of the language that are long enough, to which the mean of the whole corpus is added with
the weight of `shared_documents` documents: a rare language leans on the corpus, a common one on itself, and there is
no number of documents at which verdicts jump. A null language uses the mean of all documents. Short histograms are
noise, so a distance counts only from `min_chars` characters or `min_words` words on.

All counts are made row by row: a document's words, lines and windows stay in its row, so nothing but the small
histograms is shuffled and no group of documents can be hot. Repeated three-word windows are found by sorting
64-bit hashes of a document's windows with their positions (two different windows of one document with equal
hashes would count as a repeat; for a million windows the odds are below 1e-7).

Cases: null and empty texts have no words and fail the base rules; very long texts take memory in proportion to
the one text; equal rows get equal results; without rows there is no result and no reference. Only the id, text
and language columns are read, so extra columns and clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelocus.llm.common import stored

# Common words of four languages and the classes of characters.
COMMON_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "with", "as", "by", "this", "at", "are", "from", "be",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es",
    "de", "la", "le", "et", "les", "un", "une", "du", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "pas", "plus", "ce", "il",
    "el", "en", "y", "los", "se", "del", "las", "con", "por", "una", "su", "para", "no", "al", "lo", "como", "o", "sus", "ha", "si",
]
WORD_SEPARATOR = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CLASSES = {"upper": r"[^\p{Lu}]+", "digit": r"[^0-9]+", "punctuation": r"[^.,;:!?'\"()\-]+", "symbol": r"[^#*$%&|<>]+"}

MIN_CHARS, MIN_WORDS, SHARED_DOCUMENTS = 200, 50, 50
#: A document is rejected if its characters diverge this far, or its characters and its words both diverge further than these.
MAX_CHAR_DISTANCE, BOTH_CHAR_DISTANCE, BOTH_WORD_DISTANCE = 0.25, 0.14, 0.28


def shifted(array: Column, by: int) -> Column:
    """The array from element `by` on."""
    return F.slice(array, F.lit(by + 1), F.greatest(F.size(array), F.lit(1)))


def window_hashes(hashes: Column) -> Column:
    """Hash of each three-word window, in order, from the hashes of the words."""
    each = F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))
    return F.slice(each, F.lit(1), F.greatest(F.size(hashes) - 2, F.lit(0)))


def repeated(hashes: Column) -> Column:
    """The hashes that stand at least twice, each once."""
    ordered = F.sort_array(hashes)
    twice = F.zip_with(ordered, shifted(ordered, 1), lambda a, b: F.when(a == b, a))
    found = F.array_distinct(F.filter(twice, lambda h: h.isNotNull()))
    # Most texts repeat no window, which a set tells sooner than a sort.
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.array().cast("array<bigint>")).otherwise(found)


def covered(starts: Column) -> Column:
    """Words that three-word windows with these ascending starts cover."""
    gaps = F.zip_with(starts, F.slice(F.concat(F.array(F.lit(-3)), starts), F.lit(1), F.greatest(F.size(starts), F.lit(1))), lambda at, last: F.least(F.lit(3), at - last))
    return F.aggregate(gaps, F.lit(0), lambda n, x: n + x).cast("long")


def starts_by_lookup(hashes: Column, twice: Column) -> Column:
    """Where the windows of a few repeated hashes stand."""
    return F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda i: i.isNotNull())


def starts_by_sort(hashes: Column) -> Column:
    """The same for any number of repeated hashes: sort them with their positions, compare neighbours."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    beside = F.arrays_zip(placed.alias("own"), F.concat(none, placed).alias("last"), F.concat(shifted(placed, 1), none).alias("next"))
    twice = F.filter(beside, lambda x: (x["own"]["h"] == x["last"]["h"]) | (x["own"]["h"] == x["next"]["h"]))
    return F.sort_array(F.transform(twice, lambda x: x["own"]["i"]))


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts and histograms of each document, one projection after the other so that no array is built twice."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), text.alias("_text"))
    rows = rows.select(
        "_id", "_lang",
        F.length("_text").alias("_chars"),
        F.filter(F.split("_text", WORD_SEPARATOR), lambda w: w != "").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: ~x.rlike(r"^[\x20\x09-\x0D]*$")).alias("_lines"),
        # Without lower-case letters and blanks little is left to class.
        F.regexp_replace("_text", r"[\p{Ll}\x20]+", "").alias("_rest"),
    )
    code = F.lit(",".join(COMMON_WORDS))
    short = F.filter("_words", lambda w: F.octet_length(w) <= max(map(len, COMMON_WORDS)))
    places = F.filter(F.transform(short, lambda w: F.find_in_set(F.lower(w), code)), lambda k: k > 0)
    rows = rows.select(
        "_id", "_lang", "_chars",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
        # Each common word becomes one character, other words none.
        F.array_join(F.transform(places, lambda k: F.char((k + 32).cast("long"))), "").alias("_common"),
        *(F.length(F.regexp_replace("_rest", pattern, "")).alias(f"_{name}") for name, pattern in CLASSES.items()),
    )
    rows = rows.withColumn("_windows", window_hashes(F.col("_hashes"))).withColumn("_twice", repeated(F.col("_windows")))
    counted = F.transform(F.sequence(F.lit(1), F.lit(len(COMMON_WORDS))), lambda k: (F.length("_common") - F.length(F.replace(F.col("_common"), F.char((k + 32).cast("long")), F.lit("")))).cast("double"))
    return rows.select(
        "_id", "_lang", "n_words", "word_chars", F.col("_symbol").cast("long").alias("n_symbols"), "n_dup_lines", "_chars",
        F.when(F.size("_twice") == 0, F.lit(0).cast("long"))
        .when(F.size("_twice") <= 64, covered(starts_by_lookup(F.col("_windows"), F.col("_twice"))))
        .otherwise(covered(starts_by_sort(F.col("_windows")))).alias("n_repeat_words"),
        shares([*(F.col(f"_{c}") for c in CLASSES), F.col("_chars") - F.col("word_chars"), F.greatest(F.col("word_chars") - sum(F.col(f"_{c}") for c in CLASSES), F.lit(0))]).alias("_char_shares"),
        F.when(F.col("n_words") > 0, F.transform(F.concat(counted, F.array((F.col("n_words") - F.length("_common")).cast("double"))), lambda x: x / F.col("n_words"))).alias("_word_shares"),
    )


def shares(counts: list[Column]) -> Column:
    """A few counts as shares of their sum; null if all are 0."""
    total = sum(c.cast("double") for c in counts)
    return F.when(total > 0, F.array(*(c.cast("double") / total for c in counts)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def references(counted: DataFrame, min_chars: int, min_words: int) -> DataFrame:
    """(_lang, _docs, _c, _w): number of long enough documents by language, and the sums of their shares. One pass."""
    long_enough = counted.filter((F.col("_chars") >= min_chars) & (F.col("n_words") >= min_words))
    sizes = {"_char_shares": len(CLASSES) + 2, "_word_shares": len(COMMON_WORDS) + 1}
    sums = [F.array(*(F.sum(F.col(c)[i]) for i in range(n))).alias(c) for c, n in sizes.items()]
    return long_enough.groupBy("_lang").agg(F.count("*").alias("_docs"), *sums)


def whole(refs: DataFrame) -> DataFrame:
    """One row: the mean shares of the whole corpus, from the sums of the languages."""
    sizes = {"_char_shares": len(CLASSES) + 2, "_word_shares": len(COMMON_WORDS) + 1}
    total = F.sum("_docs")
    return refs.agg(F.lit(1).alias("_one"), *(F.array(*(F.sum(F.col(c)[i]) / total for i in range(n))).alias(f"_all{c}") for c, n in sizes.items()))


def reference(sums: Column, docs: Column, mean: Column, weight: int) -> Column:
    """A language's mean shares with the corpus's as so many more documents; rounded, as sums of floats vary in order."""
    return F.zip_with(sums, mean, lambda s, m: F.round((s + weight * m) / (docs + weight), 9))


def quality(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS,
    shared_documents: int = SHARED_DOCUMENTS, max_char_distance: float = MAX_CHAR_DISTANCE,
    both_char_distance: float = BOTH_CHAR_DISTANCE, both_word_distance: float = BOTH_WORD_DISTANCE,
) -> DataFrame:
    """(id, counts, base_failed, kept, char_distance, word_distance, lang) of every document.

    Stores the counts (one short row per document) while the result is built. A distance is null where the guard
    on length, or an empty corpus, leaves it out; such a document is judged by the base rules alone.
    """
    counted = stored(features(df, id_col, text_col, lang_col), "quality-counts")
    sums = stored(references(counted, min_chars, min_words), "quality-references")
    means = whole(sums)  # one row
    refs = sums.filter(F.col("_lang").isNotNull()).withColumn("_one", F.lit(1)).join(F.broadcast(means), "_one")
    refs = refs.select("_lang", *(reference(F.col(c), F.col("_docs"), F.col(f"_all{c}"), shared_documents).alias(f"_ref{c}") for c in ("_char_shares", "_word_shares")))
    rows = counted.withColumn("_one", F.lit(1)).join(refs, "_lang", "left").join(F.broadcast(means), "_one", "left")

    def distance(shares: str) -> Column:
        return js_distance(F.col(shares), F.coalesce(F.col(f"_ref{shares}"), F.transform(f"_all{shares}", lambda m: F.round(m, 9))))

    rows = rows.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("_lang").alias("lang"),
        F.when(F.col("_chars") >= min_chars, distance("_char_shares")).alias("char_distance"),
        F.when(F.col("n_words") >= min_words, distance("_word_shares")).alias("word_distance"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )
    both = (F.col("char_distance") > both_char_distance) & (F.col("word_distance") > both_word_distance)
    diverges = F.coalesce(F.col("char_distance") > max_char_distance, F.lit(False)) | F.coalesce(both, F.lit(False))
    return rows.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~diverges).alias("kept"), "char_distance", "word_distance", "lang"
    )
