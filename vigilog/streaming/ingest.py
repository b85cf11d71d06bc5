"""Incremental ingest: only files that are new since the last run are parsed.

The file source's checkpoint remembers what has been read, in place of comparing file times.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vigilog.operators.normalize import format_of_heads, normalize
from vigilog.session import discard_stored, stored, stored_so_far
from vigilog.sources.files import read_heads, read_lines
from vigilog.sources.sinks import write_logs

MAX_FILES = 10_000  # per batch; bounds the list of paths the driver handles


def ingest_new(
    spark: SparkSession, path: str, log_table: str, checkpoint: str, *,
    compat: bool = False, reference_ts: datetime | None = None, broken_table: str | None = None,
) -> StreamingQuery:
    """Append the entries of new files to the log table, then stop.

    Files that could not be read to their end go to ``broken_table`` (path, error, bytes_read), by
    default a folder beside the checkpoint.

    The stream discovers files only; each batch of them is read, its formats are detected and its
    lines are parsed by the batch operators, so the table equals one full run over all files.
    """
    files = (
        spark.readStream.format("binaryFile").schema(
            "path string, modificationTime timestamp, length bigint, content binary"
        )
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", MAX_FILES).load(path).select("path")
    )

    def append(batch: DataFrame, batch_id: int) -> None:
        paths = [row.path for row in batch.distinct().collect()]
        if not paths:
            return
        before = stored_so_far()
        lines = read_lines(spark, stored(format_of_heads(read_heads(spark, paths)).drop("error")))
        parsed = normalize(lines.rows, kinds=lines.kinds, compat=compat, reference_ts=reference_ts)
        # A batch repeated after a failure replaces its own folder instead of adding to it.
        write_logs(parsed, f"{log_table}/batch={batch_id}", mode="overwrite")
        lines.broken().write.mode("overwrite").parquet(f"{broken_table or checkpoint + '-broken'}/batch={batch_id}")
        discard_stored(spark, before)

    return (
        files.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

