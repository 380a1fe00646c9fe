"""S3-S5 with a term dictionary of the user's own: longest match by an equi-join on word n-grams.

The dictionary is a table (kind, variant, canonical, category, excluded) of any size. Every distinct term is spelled
as its word n-grams, up to the words of the longest variant, and joined to the variants; the match of most words wins,
of several the first in the term. So a variant matches whole words only ("bed" is not in "embedding"), a longer
variant beats a shorter one inside it, and category and exclusion come from the winner's row. Work is done once a
distinct list and once a distinct term, however many facilities repeat them.

Cases: a list that is null or no JSON array of strings gives NULL; blank terms are left out; terms without a match keep
their words in the form `unknown` gives (None drops them); of dictionary rows with one variant (upper and lower case
and white space do not count) a row that is not excluded comes first, then the smallest canonical name; a null
category writes the name alone; an empty dictionary matches nothing; facilities that repeat an id stay apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelocus.operators.enrich import _json_strings, _norm

DICTIONARY_SCHEMA = "kind string, variant string, canonical string, category string, excluded boolean"


def dictionary_entries(dictionary: DataFrame, kind: str) -> DataFrame:
    """One row per variant of a kind: (gram, entry)."""
    own = dictionary.where((F.col("kind") == kind) & F.col("canonical").isNotNull()).select(
        _norm(F.col("variant")).alias("gram"),
        F.struct(F.coalesce("excluded", F.lit(False)).alias("excluded"), "canonical", "category").alias("entry"))
    return own.where("gram != ''").groupBy("gram").agg(F.min("entry").alias("entry"))


def word_grams(terms: DataFrame, longest: int, term_col: str = "term") -> DataFrame:
    """(term, start, n, gram): all runs of up to `longest` words of each term."""
    words = F.split(term_col, " ")

    def run(i: Column) -> Column:
        lengths = F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - i + 1))
        return F.transform(lengths, lambda n: F.struct(i.alias("start"), n.alias("n"), F.array_join(F.slice(words, i, n), " ").alias("gram")))

    return terms.select(term_col, F.inline(F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), run))))


def match_terms(terms: DataFrame, entries: DataFrame, term_col: str = "term") -> DataFrame:
    """(term, gram, entry) of the terms that hold a variant, by longest match; `terms` are distinct and normalised."""
    longest = entries.agg(F.max(F.size(F.split("gram", " ")))).first()[0] or 1  # one number
    met = word_grams(terms, longest, term_col).join(entries, "gram")
    best = F.min(F.struct((-F.col("n")).alias("fewer"), "start", "gram", "entry")).alias("best")
    return met.groupBy(term_col).agg(best).select(term_col, "best.gram", "best.entry")


def standardize_terms(raw: DataFrame, dictionary: DataFrame, kind: str, col: str, out: str,
                      unknown: Callable[[Column], Column] | None = F.initcap, id_col: str = "unique_id") -> DataFrame:
    """(id, out): each list of raw terms as a JSON array of "canonical|category", in order, without repeats."""
    rows = raw.select(id_col, F.sha2(F.col(col), 256).alias("_key"), F.col(col).alias("_list"))
    lists = rows.where(F.col("_list").isNotNull()).groupBy("_key").agg(F.first("_list").alias("_list"))
    parsed = lists.select("_key", _json_strings(F.col("_list")).alias("_terms")).where(F.col("_terms").isNotNull())
    items = parsed.select("_key", F.posexplode("_terms").alias("_pos", "_raw")).select("_key", "_pos", _norm(F.col("_raw")).alias("term")).where("term != ''")
    found = match_terms(items.select("term").distinct(), dictionary_entries(dictionary, kind))
    named = F.concat_ws("|", "entry.canonical", "entry.category")
    other = F.lit(None).cast("string") if unknown is None else unknown(F.col("term"))
    # An excluded term is matched and has no name.
    name = F.when(F.col("entry").isNull(), other).when(~F.col("entry.excluded"), named)
    done = items.join(found, "term", "left").select("_key", "_pos", name.alias("_name")).where(F.col("_name").isNotNull())
    # A list's terms: bounded by the list.
    listed = done.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_pos", "_name"))).alias("_all"))
    names = F.coalesce(F.array_distinct(F.transform("_all", lambda x: x["_name"])), F.array().cast("array<string>"))
    answers = parsed.select("_key").join(listed, "_key", "left").select("_key", F.to_json(names).alias(out))
    asked = rows.where(F.col("_key").isNotNull()).join(answers, "_key", "left").select(id_col, out)
    # Lists that are missing stay out of the join, where they would all meet in one task.
    return asked.unionByName(rows.where(F.col("_key").isNull()).select(id_col, F.lit(None).cast("string").alias(out)))
