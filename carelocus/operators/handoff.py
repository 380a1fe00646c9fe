"""Parquet hand-offs inside one job: stored where all executors can read them, dropped when the job's result is written."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from carelocus.session import work_dir

#: Spark's own setting: an execution's shuffle files go when it ends, not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Handoff:
    """Tables of one run under one folder of the shared scratch space (`spark.checkpoint.dir`).

    A stored table cuts the lineage: a lost executor recomputes at most one step. Results that are still lazy read
    these tables, so `drop` comes after they are written; as a context manager the folder goes at the end.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = work_dir(spark, f"handoff-{uuid.uuid4().hex}")
        self.tables: list[str] = []  # names in the catalog, which alone knows buckets; the files are under `root`

    @contextmanager
    def _shuffles_go(self) -> Iterator[None]:
        before = self.spark.conf.get(SHUFFLE_CLEANUP, None)
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")  # what is stored is read again, its shuffles are not
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(SHUFFLE_CLEANUP)
            else:
                self.spark.conf.set(SHUFFLE_CLEANUP, before)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with self._shuffles_go():
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def dealt(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """Stored in buckets of `key`: tables dealt alike join on it without a shuffle. Each is shuffled alone, so a join
        of many has the shuffle files of one at a time on disk, not those of all."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"{os.path.basename(self.root)}_{name}".replace("-", "_")
        self.tables.append(table)
        with self._shuffles_go():
            df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", f"{self.root}/{name}").saveAsTable(table)
        return self.spark.table(table)

    def drop(self) -> None:
        while self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop()}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Handoff:
        return self

    def __exit__(self, *error) -> None:
        self.drop()
