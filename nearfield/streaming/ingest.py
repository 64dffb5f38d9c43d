"""New documents and vectors from a stream, appended to an index's delta tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from nearfield.operators.bm25 import Bm25Index
from nearfield.operators.ivf import IvfIndex


def into_bm25(stream: DataFrame, path: str, checkpoint: str, **columns: str) -> StreamingQuery:
    """Append each batch's postings to those stored at path. A batch that is run again overwrites its own part."""

    def write(batch: DataFrame, number: int) -> None:
        part = Bm25Index.of(batch, **columns)
        part.docs.write.mode("overwrite").parquet(f"{path}/docs/batch={number}")
        part.postings.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into_ivf(stream: DataFrame, index: IvfIndex, path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's vectors to their nearest lists."""

    def write(batch: DataFrame, number: int) -> None:
        index.assigned(batch).write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
