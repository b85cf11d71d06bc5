"""Hash manifests of evidence files, their signature and verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.operators import merkle

# Files up to this size are hashed by Spark from their content; larger ones exceed a sensible row.
ROW_BYTES = 256 * 1024 * 1024
CHUNK = 1 << 20


def manifest_of(artifacts: DataFrame) -> DataFrame:
    """(job_id, filename, relative_path, size_bytes, sha256) from (job_id, relative_path, content)."""
    return artifacts.select(
        "job_id",
        F.substring_index("relative_path", "/", -1).alias("filename"),
        "relative_path",
        F.octet_length("content").cast("bigint").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


def hash_large_files(paths: DataFrame) -> DataFrame:
    """The same for (job_id, relative_path, path, length): each file is read in chunks by one task.

    SHA-256 cannot be computed in parts, so a file is the smallest unit of work there is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            digests = []
            for uri in batch["path"]:
                filesystem, path = fs.FileSystem.from_uri(uri)
                digest = hashlib.sha256()
                with filesystem.open_input_stream(path, compression=None) as stream:
                    while chunk := stream.read(CHUNK):
                        digest.update(chunk)
                digests.append(digest.hexdigest())
            yield batch.assign(sha256=digests)

    hashed = paths.select("job_id", "relative_path", "path", "length").mapInPandas(
        run, "job_id string, relative_path string, path string, length bigint, sha256 string"
    )
    return hashed.select(
        "job_id", F.substring_index("relative_path", "/", -1).alias("filename"), "relative_path",
        F.col("length").alias("size_bytes"), "sha256",
    )


def manifest_totals(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("job_id").agg(
        F.count("*").alias("artifact_count"), F.sum("size_bytes").alias("total_size_bytes")
    )


def sign(manifest: DataFrame) -> DataFrame:
    """(job_id, manifest_sha256): the root of a hash tree over the job's manifest rows.

    No list of the tree exceeds its fan-out; ``merkle`` has the tree itself, proofs for single files,
    and the branches in which two manifests differ.
    """
    return merkle.root(merkle.tree(manifest))


def verify(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """Status of every file of the manifest against fresh hashes: passed, failed or missing."""
    fresh = current.select("job_id", "relative_path", F.col("sha256").alias("actual"))
    joined = manifest.join(fresh, ["job_id", "relative_path"], "left")
    status = (
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("actual") == F.col("sha256"), "passed")
        .otherwise("failed")
    )
    return joined.select(
        "job_id", "relative_path", "filename", F.col("sha256").alias("expected"), "actual",
        status.alias("status"),
    )


def file_signature(manifest_files: DataFrame) -> DataFrame:
    """(job_id, manifest_sha256) of manifest files as they are stored: (job_id, content)."""
    return manifest_files.select("job_id", F.sha2("content", 256).alias("manifest_sha256"))


def verify_signature(manifest_files: DataFrame, signatures: DataFrame) -> DataFrame:
    """Signatures (job_id, manifest_sha256) against the bytes of the manifest files (job_id, content)."""
    return _compared(file_signature(manifest_files), signatures)


def verify_row_signature(manifest: DataFrame, signatures: DataFrame) -> DataFrame:
    """The same for ``sign``, which hashes a manifest's rows."""
    return _compared(sign(manifest), signatures)


def _compared(fresh: DataFrame, signatures: DataFrame) -> DataFrame:
    fresh = fresh.withColumnRenamed("manifest_sha256", "actual")
    return signatures.join(fresh, "job_id", "left").select(
        "job_id", F.col("manifest_sha256").alias("expected"), "actual",
        F.coalesce(F.col("manifest_sha256") == F.col("actual"), F.lit(False)).alias("valid"),
    )
