"""Streaming ingest of cells.

Versions are explicit, so late cells need no watermark for correctness: a read
ranks by version whatever the arrival order.  A watermark only bounds the state of
the running latest-cell view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wideframe.operators.order import age


def append(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends a stream of cells to a stored table.

    A micro-batch goes to its own folder, so a batch that is tried again replaces
    itself: each cell is stored exactly once.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(stream: DataFrame) -> DataFrame:
    """Running newest cell of each column (update or complete output); later writes win by ``seq``."""
    return stream.groupBy("key", "family", "qualifier").agg(F.max_by("value", age(stream.columns)).alias("value"), F.max("version").alias("version"))
