"""Batches from a folder of JSON lines, applied to an index as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.schema import RequestError
from ..sources.store import Catalog


def stream_items(catalog: Catalog, name: str, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each line {"seq": n, "item": "<json>"}; a micro-batch is one indexing batch in the order of seq.

    A batch that is refused whole is kept under checkpoint-refused, and the stream goes on.
    """
    lines = catalog.spark.readStream.schema("seq long, item string").json(folder)

    def apply(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        try:
            catalog.index_lines(name, batch.select("seq", F.col("item"))).unpersist()
        except RequestError:
            batch.write.mode("overwrite").json(f"{checkpoint}-refused/{number}")

    writer = lines.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
