"""Per-job acquisition summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.operators.normalize import iso_timestamp


def acquisition_summary(acquisition: DataFrame) -> DataFrame:
    """Duration, counts and the closed flag of each job's acquisition log."""
    seconds = F.floor(
        (F.unix_micros(iso_timestamp(F.col("end"))) - F.unix_micros(iso_timestamp(F.col("start")))) / 1e6
    )
    minutes = F.floor(seconds / 60)
    size = lambda name: F.coalesce(F.array_size(name), F.lit(0)).cast("bigint")
    return acquisition.select(
        "job_id", "start", "end",
        F.when(seconds.isNotNull(), F.format_string("%dm %ds", minutes, seconds - minutes * 60))
        .otherwise("N/A").alias("duration"),
        size("commands").alias("commands_logged"), size("artifacts").alias("artifacts_acquired"),
        size("errors").alias("errors"), F.coalesce("connection_closed", F.lit(False)).alias("connection_closed"),
    )


def acquisition_errors(acquisition: DataFrame) -> DataFrame:
    """Number of errors per job and phase."""
    return (
        acquisition.select("job_id", F.explode("errors").alias("e"))
        .groupBy("job_id", F.col("e.phase").alias("phase"))
        .agg(F.count("*").alias("errors"))
    )
