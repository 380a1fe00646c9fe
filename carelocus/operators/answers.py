"""S2 with a memory: model answers kept in a table, so that a text is asked about once and not once a run.

The store is a folder of Parquet tables, one a run (`run=<name>`), with rows (kind, raw, response); `raw` is the
facility text, not the prompt, which is the same but for constants. A run anti-joins its distinct (kind, raw) with
what is stored, builds prompts for the rest alone, after the shuffle, and writes the answers to its own folder. A run
that is repeated under its name finds its answers stored; one that failed has left no committed files and asks again.
Of two runs that answered one text at the same time the first by name counts, for all readers.

Null texts are not asked about and get no response. A null answer is stored as an answer.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelocus.operators.enrich import PROMPTS

KEY = ["kind", "raw"]
SCHEMA = "kind string, raw string, response string"


def raw_requests(raw: DataFrame, id_col: str = "unique_id", kinds: list[str] | None = None) -> DataFrame:
    """One (id, kind, raw) row a facility and enrichment kind."""
    wanted = [(k, PROMPTS[k][0]) for k in (kinds or PROMPTS)]
    return raw.select(id_col, F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("raw")) for k, c in wanted])))


def prompt_of() -> Column:
    """The prompt of a (kind, raw) row."""
    text = F.lit(None).cast("string")
    for kind, (_, before, after) in PROMPTS.items():
        text = F.when(F.col("kind") == kind, F.concat(F.lit(before), F.col("raw"), F.lit(after))).otherwise(text)
    return text


class AnswerStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def answers(self) -> DataFrame:
        """(kind, raw, response), one row a text that was answered."""
        try:
            stored = self.spark.read.schema(SCHEMA + ", run string").parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMA)
        first = F.min(F.struct("run", "response"))
        return stored.groupBy(*KEY).agg(first["response"].alias("response"))

    def unanswered(self, requests: DataFrame) -> DataFrame:
        """Distinct (kind, raw) of `requests` without an answer."""
        return requests.where(F.col("raw").isNotNull()).select(*KEY).distinct().join(self.answers(), KEY, "left_anti")

    def ask(self, requests: DataFrame, model: Callable[[pd.Series], pd.Series], run: str) -> None:
        """Answer what is open with `model` (prompts in, responses out, called by Arrow batch) and store it as `run`.
        What an earlier attempt under that name stored stays."""
        asked = self.unanswered(requests).select(*KEY, prompt_of().alias("prompt"))

        def answer(batches):
            for pdf in batches:
                yield pdf[KEY].assign(response=model(pdf["prompt"]).astype("string"))

        asked.mapInPandas(answer, SCHEMA).write.mode("append").parquet(f"{self.path}/run={run}")

    def attach(self, requests: DataFrame) -> DataFrame:
        """`requests` with `response`. Requests without a text stay out of the join, where they would all meet in one
        task; a text on very many rows is a skewed key of the larger side, which adaptive execution splits."""
        found = requests.where(F.col("raw").isNotNull()).join(self.answers(), KEY, "left")
        silent = requests.where(F.col("raw").isNull()).withColumn("response", F.lit(None).cast("string"))
        return found.unionByName(silent)
