"""Incremental ingest of transaction extracts dropped into a landing folder.

The stream carries the paths of the files that arrive. Each micro-batch
reads its files by their own headers, checks and cleans their records, and
writes them. The checkpoint records which files were taken, so a restarted
query resumes where it stopped and a rerun over the same folder adds
nothing. Deliveries must land under new names (a file source ignores a file
rewritten under a name it has seen); replacing the whole data set is
``warehouse.refresh``.

``stream_into_warehouse`` brings the lines to the reports: each micro-batch
becomes one append commit of the warehouse, keyed by the stream's name and
the batch id. A batch that ran before but whose checkpoint was not written
runs again under the same id, finds its commit and adds nothing.

``ingest_stream`` writes a plain folder: each micro-batch is the sub-folder
``batch=<id>``, replaced as a whole when the batch runs again.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from tillroll.operators import cleaning
from tillroll.sources import warehouse as store
from tillroll.sources.csv_extracts import read_extract, stream_files


def _start(spark: SparkSession, landing: str, add, checkpoint: str, available_now: bool, processing_time: str,
           max_files_per_trigger: int | None) -> StreamingQuery:
    def run(batch, batch_id: int) -> None:
        paths = sorted(r["path"] for r in batch.collect())     # names of the batch's files
        if paths:
            add(paths, int(batch_id))

    trigger = {"availableNow": True} if available_now else {"processingTime": processing_time}
    return (stream_files(spark, landing, max_files_per_trigger).writeStream.foreachBatch(run)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def ingest_stream(spark: SparkSession, landing: str, out: str, checkpoint: str | None = None,
                  available_now: bool = True, processing_time: str = "1 minute",
                  max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the ingest query; ``available_now`` processes what is there and stops.

    ``max_files_per_trigger`` bounds each micro-batch, so a large backlog is
    taken in steps (each committed on its own) rather than in one batch.
    """
    def add(paths: list[str], batch_id: int) -> None:
        rows = cleaning.checked(read_extract(spark, *paths), "transactions")
        cleaning.kept(rows, "transactions").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    # beside the output: a restart finds it, whatever the process
    return _start(spark, landing, add, checkpoint or out.rstrip("/") + "/_checkpoint", available_now,
                  processing_time, max_files_per_trigger)


def stream_into_warehouse(spark: SparkSession, landing: str, warehouse: str, stream: str = "lines",
                          checkpoint: str | None = None, available_now: bool = True,
                          processing_time: str = "1 minute",
                          max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Append the cleaned lines of each micro-batch to the warehouse; ``read_current`` then holds them.

    ``stream`` names the source in the commit log. Its checkpoint lies beside
    the warehouse's tables unless another place is given.
    """
    def add(paths: list[str], batch_id: int) -> None:
        store.append_files(spark, paths, warehouse, stream, batch_id)

    return _start(spark, landing, add, checkpoint or f"{warehouse}/_streams/{stream}", available_now,
                  processing_time, max_files_per_trigger)
