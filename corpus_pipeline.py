"""A corpus pipeline of four operators: quality rules, toxicity, near-duplicates, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame; it reads all its predecessor kept, and all but the last return
the columns of `documents`. Between the stages stands a Parquet table in the shared folder.

Every decision is made and applied row by row: rows with a null doc_id are judged as all others and stay if they are
clean, and of rows that repeat a doc_id each has its own verdict. The first two stages judge a row by itself, so the
whole row goes through the operator in place of the id and no text is shuffled. Of a group of near-duplicates, for
which the stage adds a row key, one row stays: the one with the smallest doc_id, a null id last, of several rows of
that id the first in the table. Texts without words are in no group and stay in that stage.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carelocus.llm import minhash, packing, quality, toxicity
from carelocus.llm.common import read, stored, tokenizer_path

WORDS = "word_bpe_49k.json"
#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def keyed(docs: DataFrame) -> DataFrame:
    """`docs` with `_row`, the place of each row in its files: the number of the file and the row in it. So every
    reading of the table gives a row the same key, however the files are split. A table that is not read from Parquet
    files is stored first."""
    place = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_index")]
    try:
        rows = docs.select("*", *place)
    except AnalysisException:
        docs = stored(docs, "pipeline-rows")
        rows = docs.select("*", *place)
    number = (F.row_number().over(Window.orderBy("_path")) - 1).cast("long")
    files = rows.select("_path").distinct().select("_path", number.alias("_file"))  # one short row per file
    # Broadcast whatever its estimate says, which is that of the whole table: else all texts are shuffled to meet it.
    return rows.join(F.broadcast(files), "_path").select(*docs.columns, F.shiftleft("_file", 40).bitwiseOR(F.col("_index")).alias("_row"))


def with_row(docs: DataFrame) -> DataFrame:
    """`docs` with `_whole`, the row itself."""
    return docs.withColumn("_whole", F.struct(*docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality(with_row(docs), id_col="_whole").filter("kept").select("_whole.*")


def toxic_content(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(with_row(docs), read(spark, sf_dir, "labels"), key_col="_whole").filter("predicted = 0").select("_whole.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    groups = minhash.near_duplicates(rows, id_col="_row", words=SHINGLE).select("_row", "component_id").join(rows.select("_row", "doc_id"), "_row")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first"))
    return rows.join(first.select("first._row"), "_row", "left_semi").select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(WORDS), end_id=2)


STAGES = [("quality rules", quality_rules), ("toxicity", toxic_content), ("near duplicates", near_duplicates), ("packing", pack_sequences)]

#: SQL can express neither the language model of the second stage nor the tokenizer of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
