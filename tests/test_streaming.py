"""The streaming search runner gives the same cards as the batch job."""

import os
import tempfile

from carelocus.plans.registry import facility_index
from carelocus.sources import fixtures as fx
from carelocus.streaming import searches as st

from conftest import SF001


def test_stream_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="carelocus-stream-")
    src, sink, ckpt, idx_path = (os.path.join(base, x) for x in ("in", "out", "ckpt", "index"))
    facility_index(spark, SF001).write.parquet(idx_path)
    index = spark.read.parquet(idx_path)
    searches = fx.searches(spark, SF001)
    # two files arriving one after the other
    searches.filter("search_id % 2 = 0").write.parquet(os.path.join(src, "a"))
    searches.filter("search_id % 2 = 1").write.parquet(os.path.join(src, "b"))
    stream = spark.readStream.schema(st.SEARCH_SCHEMA).option("recursiveFileLookup", "true").parquet(src)
    q = st.start_search_stream(stream, index, sink, ckpt, available_now=True)
    q.awaitTermination(600)
    got = spark.read.parquet(sink).drop("epoch")
    want = st.answer_batch(searches, index)
    cols = ["search_id", "rank", "unique_id", "relevance_score", "distance_km"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())
    assert got.count() > 0
