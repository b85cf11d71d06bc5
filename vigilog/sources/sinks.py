"""Writers. The log table is partitioned by day; ``timeline.filter_window`` opens only a window's days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog import schema


def write_logs(logs: DataFrame, path: str, *, format: str = "parquet", mode: str = "append") -> None:
    """Normalised entries by day (``dt``; undated rows under the null partition), or as JSON lines.

    Rows are rebalanced by day: Spark gathers small days in few files and splits busy ones over
    tasks, by the bytes that it measures.
    """
    dated = logs.withColumn("dt", F.to_date("ts")).hint("rebalance", "dt")
    dated.write.mode(mode).format(format).partitionBy("dt").save(path)


def read_log_table(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``write_logs`` wrote, even if it has no rows and so no files."""
    return spark.read.schema(f"{schema.LOG}, dt date").parquet(path)


def write_timeline(timeline: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; file order is time order, as the timeline is range-partitioned."""
    timeline.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_results(
    results: dict[str, DataFrame], path: str, *, format: str = "parquet", mode: str = "overwrite"
) -> None:
    """A folder per result set: coverage, correlations, findings."""
    for name, result in results.items():
        result.write.mode(mode).format(format).save(f"{path}/{name}")


def write_contexts(contexts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Finding context blocks as text, a folder per job."""
    contexts.select("job_id", F.concat("context", F.lit("\n")).alias("value")).write.mode(
        mode
    ).partitionBy("job_id").text(path)
