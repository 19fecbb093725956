"""Written intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove, ship, work_folder

#: Distinct 8-byte ids that a broadcast may hold, about 10 MB in memory; beyond it a join shuffles instead.
BROADCAST_IDS = 250_000
#: Rows and bytes of an Arrow batch, where the session has Spark's own settings: a batch of whole texts must stay small.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


#: Rows of a part of a table of few narrow rows, and the least number of parts: many small files cost more than they share out.
PART_ROWS, LEAST_PARTS = 250_000, 8


class Scratch:
    """Tables written under one folder of their own, to cut lineage and to compute shared inputs once.

    A lost executor then costs only the tasks of the job that is running. ``drop`` removes a table that no later plan
    reads; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        for setting, value in BATCHES.items():
            if not spark.conf.get(setting, None):
                spark.conf.set(setting, value)
        self.spark = spark
        self.folder = work_folder(spark, name)
        if not self.folder:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")

    def save(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """``df`` written and read again. ``rows`` bounds the number of its rows, where these are narrow and no Python makes them: it
        then has a part for each PART_ROWS of them, LEAST_PARTS at least."""
        path = f"{self.folder}/{name}"
        (df if rows is None else df.coalesce(max(LEAST_PARTS, -(-rows // PART_ROWS)))).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.folder}/{name}")


def _hinted(ids: DataFrame, on: str, bound: int) -> DataFrame:
    """``ids`` under the name ``on``, ready to be broadcast where a count has shown at most ``bound`` of them."""
    ids = ids.select(F.col(ids.columns[0]).alias(on))
    return F.broadcast(ids) if ids.count() <= bound else ids


def restrict(df: DataFrame, ids: DataFrame, on: str, bound: int = BROADCAST_IDS) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``ids`` (one column, distinct): by a broadcast of up to ``bound`` ids, else by a shuffle."""
    return df.join(_hinted(ids, on, bound), on, "left_semi")


def without(df: DataFrame, ids: DataFrame, on: str, bound: int = BROADCAST_IDS) -> DataFrame:
    """Rows of ``df`` whose ``on`` is not in ``ids``; see ``restrict``."""
    return df.join(_hinted(ids, on, bound), on, "left_anti")
