"""Searches arriving continuously, answered per micro-batch.

The interactive loop (one search at a time) becomes a Structured Streaming
query: new search rows (files in a folder, or any streaming source) are
planned and run against the static facility index in ``foreachBatch``, and
each micro-batch's result cards are written to ``<sink>/epoch=<id>`` with
overwrite, so a replayed epoch after a failure rewrites the same folder
(idempotent, exactly-once output). Planning is stateless, so no state store
or watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from carelocus.operators import plan as pl
from carelocus.operators import search as sr
from carelocus.operators.handoff import Handoff

SEARCH_SCHEMA = "search_id bigint, query string"


def read_search_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 100) -> DataFrame:
    """A streaming DataFrame of (search_id, query) rows from Parquet files dropped into `folder`."""
    return (spark.readStream.schema(SEARCH_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(folder))


def answer_batch(batch: DataFrame, index: DataFrame, handoff: Handoff | None = None) -> DataFrame:
    """Plan and run one batch of searches: the same jobs as the batch pipeline."""
    return sr.result_cards(pl.with_status(pl.fallback_plan(batch)), index, handoff=handoff)


def start_search_stream(searches: DataFrame, index: DataFrame, sink: str, checkpoint: str,
                        available_now: bool = False, interval: str = "10 seconds") -> StreamingQuery:
    """Answer the stream against `index`, which is stored for searching once, before the first batch, unless it is
    already. What a batch stores on the way is dropped when its answers are written."""
    store = index if sr.FACILITY_KEY in index.columns else sr.store_search_index(index, Handoff(index.sparkSession))

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        with Handoff(batch.sparkSession) as handoff:
            answer_batch(batch, store, handoff).write.mode("overwrite").parquet(f"{sink}/epoch={epoch_id}")

    writer = searches.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
