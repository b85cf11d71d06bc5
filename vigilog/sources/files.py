"""Whole files to lines: heads, then one pass that keeps what can be read and says what cannot.

Tasks read files by name, so the format of a file travels as a column and neither names nor lines
go through the driver. A plain file is read in ranges. A gzip file can only be inflated from its
start, by one task; its lines are written as a table of many small files, from which many tasks
parse, and the errors met on the way are rows of the same table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vigilog.session import ship_code, stored

JOB_DIR = r"/(\d{8}_\d{6}_[^/]+)/"
#: Bytes of a plain file that one range holds, of lines sent at once, and of a gzip file inflated at once.
RANGE, CHUNK, COMPRESSED = 64 << 20, 1 << 20, 1 << 16
#: For dealing files to tasks: a compressed byte counts as so many, and a file as so many at least.
INFLATES, LEAST = 8, 1 << 20
#: Lines in a file of the table of inflated lines, the least that one task can parse of it.
PART_LINES = 200_000

HEADS = "path string, uri string, length bigint, head string, error string"
READ = "path string, source_file string, format string, line_no bigint, value string, error string, bytes_read bigint"


def _opened(uri: str):
    """(file system, path in it); the stores' names as Spark writes them."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def escaped(path: str) -> str:
    """A file's name as a pattern that only it matches."""
    return re.sub(r"([\\{}\[\]*?,])", r"\\\1", path)


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, uri, length) of all files, spread over tasks; contents are not read.

    A list names files as they are. A single path may hold wildcards; if nothing is there, there are no rows.
    """
    ship_code(spark)
    if not isinstance(path, str):
        path = [escaped(name) for name in path]
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except AnalysisException as problem:
        if not isinstance(path, str) or problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, uri string, length bigint")
    files = files.select("path", F.col("_metadata.file_path").alias("uri"), "length")
    return files.repartition(spark.sparkContext.defaultParallelism, "path")


def read_heads(spark: SparkSession, path: str | list[str], chars: int = 2000) -> DataFrame:
    """(path, uri, length, head, error) of every file: its first characters, by one bounded read per file.

    A file whose head cannot be read has what came before the error as head, and says why.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            heads, errors = [], []
            for uri, length in zip(batch["uri"], batch["length"], strict=True):
                head, error = b"", None
                try:
                    for chunk in _chunks(uri, 0, length, COMPRESSED):
                        head += chunk
                        if len(head) >= 4 * chars:
                            break
                except (OSError, EOFError, zlib.error) as problem:
                    error = _said(problem)
                heads.append(head.decode("utf-8", "replace")[:chars].replace("\0", "�"))
                errors.append(error)
            yield batch.assign(head=heads, error=errors)

    return list_files(spark, path).mapInPandas(run, HEADS)


@dataclass
class Lines:
    """``rows`` are lines in the columns of ``schema.LINE`` with their format; ``kinds`` the formats there are."""

    rows: DataFrame
    kinds: list[str]
    _zipped: DataFrame
    _plain: DataFrame
    _count: Observation | None

    def broken(self) -> DataFrame:
        """(path, error, bytes_read) of files that could not be read to their end; call it after the rows were used.

        Gzip files left their errors beside their lines. Ranges of plain files were counted when the
        rows were read, and only if any failed are they read again, for the errors alone. bytes_read
        counts inflated bytes.
        """
        errors = self._zipped.filter("error IS NOT NULL").select("path", "error", "bytes_read")
        if self._count is None or not self._count.get["broken"]:
            return errors
        plain = self._plain.filter("error IS NOT NULL").groupBy("path").agg(
            F.min("error").alias("error"), F.max("bytes_read").alias("bytes_read"))
        return errors.unionByName(plain)


def read_lines(spark: SparkSession, files: DataFrame, *, span: int = RANGE, part_lines: int = PART_LINES) -> Lines:
    """The lines of files (path, uri, length, format): what can be read of each, and the errors.

    ``line_no`` orders the lines of a file: the first byte of the range they are read from, plus the
    row's place in it. Pass ``files`` stored; they are read more than once. No files give no lines.
    """
    ship_code(spark)
    zipped = F.endswith("uri", F.lit(".gz"))
    weight = F.greatest(F.when(zipped, F.col("length") * INFLATES).otherwise(F.col("length")), F.lit(LEAST))
    sizes = files.groupBy("format").agg(  # a row per format
        F.sum(F.when(zipped, weight)).alias("zipped"), F.sum(F.when(~zipped, weight)).alias("plain")).collect()

    def total(kind: str) -> int:
        return sum(row[kind] or 0 for row in sizes)

    def spread(rows: DataFrame, kind: str) -> DataFrame:
        few = min(spark.sparkContext.defaultParallelism, total(kind) // LEAST)
        return rows.repartition(max(1, few, -(-total(kind) // span)))

    columns = ("path", "uri", "format")
    whole = files.filter(zipped).select(*columns, F.lit(0).cast("bigint").alias("start"), F.col("length").alias("stop"))
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(span).cast("bigint")))
    ranges = files.filter(~zipped).select(*columns, "length", starts.alias("start")).select(
        *columns, "start", F.least(F.col("start") + span, "length").alias("stop"))
    inflated = spark.createDataFrame([], READ)
    if total("zipped"):
        inflated = stored(spread(whole, "zipped").mapInArrow(_read_splits, READ), maxRecordsPerFile=part_lines)
    plain = spread(ranges, "plain").mapInArrow(_read_splits, READ)
    rows, count = inflated, None
    if total("plain"):
        count = Observation()
        rows = plain.observe(count, F.count_if(F.col("error").isNotNull()).alias("broken"))
        rows = rows.unionByName(inflated) if total("zipped") else rows
    job = F.regexp_extract("source_file", JOB_DIR, 1)
    lines = rows.filter("value IS NOT NULL").select(
        job.alias("job_id"), F.substring(job, 17, 1_000).alias("host"), "source_file", "line_no", "value", "format")
    return Lines(lines, sorted(row.format for row in sizes), inflated, plain, count)


# --------------------------------------------------------------------------- inside tasks


def _said(problem: Exception) -> str:
    return (str(problem) or type(problem).__name__)[:500]


def _read_splits(batches):
    import pyarrow as pa

    for batch in batches:
        for split in batch.to_pylist():
            for number, values, error, size in _split_lines(split["uri"], split["start"], split["stop"]):
                n = len(values)
                yield pa.RecordBatch.from_arrays([
                    pa.repeat(pa.scalar(split["path"], pa.string()), n), pa.repeat(pa.scalar(split["uri"], pa.string()), n),
                    pa.repeat(pa.scalar(split["format"], pa.string()), n),
                    pa.array(range(number, number + n), pa.int64()), pa.array(values, pa.string()),
                    pa.repeat(pa.scalar(error, pa.string()), n), pa.repeat(pa.scalar(size, pa.int64()), n),
                ], names=["path", "source_file", "format", "line_no", "value", "error", "bytes_read"])


def _split_lines(uri: str, start: int, stop: int) -> Iterator[tuple]:
    """(first line number, lines, None, None) again and again; at an error (0, [None], error, bytes read)."""
    number, pending, size, error = start + 1, [], 0, None
    chunks = _chunks(uri, start, stop)
    while True:
        try:
            chunk = next(chunks, None)
        except (OSError, EOFError, zlib.error) as problem:
            chunk, error = None, _said(problem)
        at = -1 if chunk is None else chunk.rfind(b"\n")
        if chunk is not None:
            size += len(chunk)
            pending.append(chunk if at < 0 else chunk[:at + 1])
        if chunk is None or at >= 0:
            text = b"".join(pending).decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
            pending = [] if chunk is None else [chunk[at + 1:]]
            values = text.split("\n")
            if not values[-1]:
                values.pop()  # the text ended with its line
            if values:
                yield number, values, None, None
                number += len(values)
        if chunk is None:
            break
    if error is not None:
        yield 0, [None], error, size


def _chunks(uri: str, start: int, stop: int, size: int = CHUNK) -> Iterator[bytes]:
    """The bytes of a gzip file, inflated, or of the lines of a plain one that begin from start to before stop."""
    system, path = _opened(uri)
    if uri.endswith(".gz"):
        with system.open_input_stream(path, compression=None) as stream:
            yield from _inflated(stream)
        return
    with system.open_input_file(path) as file:
        at = max(0, start - 1)  # a line begins after a line break, which may be the last byte before start
        file.seek(at)
        inside = start == 0
        while chunk := file.read(size):
            if not inside:
                cut = chunk.find(b"\n") + 1
                if not cut:
                    at += len(chunk)
                    if at >= stop:
                        return
                    continue
                inside, at, chunk = True, at + cut, chunk[cut:]
            if at >= stop:
                return
            if at + len(chunk) >= stop and (cut := chunk.find(b"\n", stop - 1 - at if stop - 1 > at else 0) + 1):
                yield chunk[:cut]
                return
            if chunk:
                yield chunk
            at += len(chunk)
            if at >= stop:
                yield from _rest_of_line(file, size)
                return


def _rest_of_line(file, size: int) -> Iterator[bytes]:
    while chunk := file.read(size):
        cut = chunk.find(b"\n") + 1
        yield chunk[:cut] if cut else chunk
        if cut:
            return


def _inflated(stream) -> Iterator[bytes]:
    """All members of a gzip stream; before an error, every byte that comes before the bad one."""
    engine = None
    while raw := stream.read(COMPRESSED):
        while raw:
            if engine is None or engine.eof:
                raw = raw if engine is None else raw.lstrip(b"\0")  # zeros may follow a member
                if not raw:
                    break
                engine = zlib.decompressobj(31)
            saved = engine.copy()
            try:
                out = engine.decompress(raw)
            except zlib.error:
                for i in range(len(raw)):
                    if out := saved.decompress(raw[i:i + 1]):
                        yield out
                raise
            if out:
                yield out
            raw = engine.unused_data
    if engine is not None and not engine.eof:
        raise EOFError("the file ends within a gzip member")
