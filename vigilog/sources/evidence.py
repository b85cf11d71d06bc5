"""Readers for evidence trees: ``<root>/<job>/01_evidence/raw/...``, one folder per job.

A job folder is named ``YYYYMMDD_HHMMSS_host``; job id, time and host are columns made from the path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog import schema
from vigilog.operators.integrity import ROW_BYTES, hash_large_files, manifest_of
from vigilog.sources.files import JOB_DIR

JSON_FILES = {
    "system_info": ("system_info.json", schema.SYSTEM_INFO),
    "services": ("services_inventory.json", schema.SERVICES),
    "acquisition": ("acquisition_log.json", schema.ACQUISITION),
    "manifest": ("MANIFEST.json", schema.MANIFEST),
    "signature": ("MANIFEST.sig.json", schema.SIGNATURE),
}


def job_id(path: Column) -> Column:
    return F.regexp_extract(path, JOB_DIR, 1)


def job_host(job: Column) -> Column:
    return F.substring(job, 17, 1_000)


def job_time(job: Column) -> Column:
    return F.try_to_timestamp(F.left(job, F.lit(15)), F.lit("yyyyMMdd_HHmmss"))


def read_logs(
    spark: SparkSession, path: str | list[str], *, exact_line_numbers: bool = False
) -> DataFrame:
    """Lines of text and gzip files, in the columns of ``schema.LINE``.

    ``line_no`` orders the lines of a file. By default it is the byte offset of the split plus the
    row's position in its task: distinct and ascending within a file, at no cost. With
    ``exact_line_numbers`` it counts from 1; that reads the files twice and joins a row per split.
    A gzip file cannot be split, so its lines are one task's work until the next shuffle. What can be
    read of a broken file is read, and the others go on; ``files.read_lines`` also says which files
    are broken, and has many tasks parse a large gzip file.
    """
    lines = (
        spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").text(path)
        .select(
            "value", F.col("_metadata.file_path").alias("source_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    if exact_line_numbers:
        from pyspark.sql import Window

        earlier = Window.partitionBy("source_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
        splits = (
            lines.groupBy("source_file", "_start")
            .agg(F.min("_row").alias("_first"), F.count("*").alias("_count"))
            .withColumn("_before", F.coalesce(F.sum("_count").over(earlier), F.lit(0)))
        )
        lines = lines.join(splits, ["source_file", "_start"])
        number = F.col("_before") + F.col("_row") - F.col("_first") + 1
    else:
        number = F.col("_start") + F.col("_row").bitwiseAND((1 << 33) - 1) + 1
    job = job_id(F.col("source_file"))
    return lines.select(
        job.alias("job_id"), job_host(job).alias("host"), "source_file",
        number.alias("line_no"), "value",
    )


def read_job_json(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """System info, services inventory, acquisition log, manifest or signature, a row per job."""
    name, ddl = JSON_FILES[kind]
    found = (
        spark.read.schema(ddl).option("recursiveFileLookup", "true").option("multiLine", "true")
        .option("pathGlobFilter", name).json(root)
        .select("*", F.col("_metadata.file_path").alias("_path"))
    )
    return found.withColumn("job_id", job_id(F.col("_path"))).drop("_path")


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Stored manifests, a row per artifact."""
    return read_job_json(spark, root, "manifest").select("job_id", F.inline("artifacts"))


def read_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(job_id, relative_path, path, length, content) of every evidence file.

    The content is read only if used.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(
        job_id(F.col("path")).alias("job_id"),
        F.regexp_extract("path", JOB_DIR + "(.*)$", 2).alias("relative_path"),
        "path", "length", "content",
    ).filter((F.col("job_id") != "") & F.startswith("relative_path", F.lit("01_evidence/raw/")))


def build_manifest(spark: SparkSession, root: str, row_bytes: int = ROW_BYTES) -> DataFrame:
    """SHA-256, size and name of every evidence file below a root of jobs.

    Files too large for a row are hashed in chunks; the length filter reaches the file listing, so
    their content is never loaded.
    """
    files = read_artifacts(spark, root)
    small = manifest_of(files.filter(F.col("length") <= row_bytes))
    return small.unionByName(hash_large_files(files.filter(F.col("length") > row_bytes)))
