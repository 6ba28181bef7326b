"""Uploads as a stream: files that arrive in a folder become documents, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import processed, to_documents
from ..providers import Provider
from ..sinks import append_documents
from ..sources.files import entries

RAW = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, most_files: int = 1000) -> DataFrame:
    """New files of the folder, as entries; at most `most_files` a batch."""
    raw = spark.readStream.format("binaryFile").schema(RAW).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(most_files)).load(path)
    return entries(raw)


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str, provider: Provider, user_id: str, project_id: str, model: str | None = None, **trigger) -> StreamingQuery:
    """Process files as they come: the done ones are appended to out/documents, every file's status to out/status.

    The status of a batch is written under its number, so a batch that is run again replaces its own.
    """

    def write(batch: DataFrame, number: int) -> None:
        done = processed(batch, provider, user_id, project_id, model)
        status = f"{out}/status/batch={number}"
        done.write.mode("overwrite").parquet(status)  # also what a second look at this batch reads: models are asked once
        append_documents(to_documents(batch.sparkSession.read.parquet(status)), f"{out}/documents/batch={number}", "overwrite", returning=False)

    writer = arriving(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer.trigger(availableNow=True)).start()
