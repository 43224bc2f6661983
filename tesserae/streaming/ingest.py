"""Documents that arrive as files, indexed batch by batch; a batch that comes twice changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine

SCHEMA = "doc_id string, text string, source string, title string, metadata map<string,string>"


def ingest(engine: Engine, path: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """A query that indexes JSON lines of documents as they arrive at ``path``, until what is there is done."""
    stream = engine.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)

    def batch(rows: DataFrame, _: int) -> None:
        engine.index(rows.where("doc_id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["doc_id"]))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
