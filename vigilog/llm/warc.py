"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some whole WARC records, and a
last skippable frame with the seek table of the public seekable format: for each frame its
compressed and decompressed size and a checksum, then a footer. Any Zstandard program reads it as
one stream. An index maps record ids to a frame and the offset of the record in it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.llm.common import Scratch, table
from vigilog.llm.files import read_bytes, read_range, write_bytes

FRAME_BYTES = 1 << 20
#: A bundle is closed after this many compressed bytes; it fits in a task's memory.
BUNDLE_BYTES = 32 << 20
SMALLEST_REVISIT = 0
DATE = "2024-01-01T00:00:00Z"
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the seekable format
INDEX = "record_id string, page_id bigint, bundle string, frame int, frame_offset bigint, frame_bytes bigint, record_offset bigint, record_bytes bigint"


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, copy: int = 1) -> tuple[str, bytes]:
    """(record id, bytes) of one WARC/1.1 record. A revisit repeats the digest, not the payload.

    Rows that repeat have records of their own, told apart by the number of the ``copy``.
    """
    again = f":{copy}" if copy > 1 else ""
    rid = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{url}:{digest}{again}')}>"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {DATE}",
             f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}",
             f"X-Payload-Length: {len(payload)}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return rid, ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """(headers, block, offset of the next record) of the record that begins at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    first, *rest = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in rest)
    size = int(headers["Content-Length"])
    block = data[end + 4:end + 4 + size]
    if len(block) != size or data[end + 4 + size:end + 8 + size] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} is cut")
    return headers, block, end + 8 + size


class Bundle:
    """Collects records into frames, and frames into one file with a seek table."""

    def __init__(self, level: int = 3):
        import zstandard

        self.packer = zstandard.ZstdCompressor(level=level)
        self.frames, self.table, self.rows, self.raw, self.size, self.waiting = [], [], [], bytearray(), 0, []

    def add(self, rid: str, page_id, data: bytes) -> None:
        self.waiting.append((rid, page_id, len(self.raw), len(data)))
        self.raw += data
        if len(self.raw) >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if not self.waiting:
            return
        raw = bytes(self.raw)
        frame = self.packer.compress(raw)
        self.rows += [(rid, page, len(self.table), self.size, len(frame), at, n) for rid, page, at, n in self.waiting]
        self.frames.append(frame)
        self.table.append((len(frame), len(raw), zlib.crc32(raw)))
        self.size += len(frame)
        self.raw, self.waiting = bytearray(), []

    def finish(self) -> bytes:
        self.close_frame()
        body = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(body)) + body


def seek_table(tail: bytes) -> list[tuple[int, int, int]]:
    """[(compressed bytes, bytes, checksum)] from a bundle's last bytes (all of the table, or more)."""
    count, flags, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE or not flags & 0x80:
        raise ValueError("no seek table with checksums")
    start = len(tail) - 9 - 12 * count
    return list(struct.iter_unpack("<III", tail[start:start + 12 * count]))


def frames(bundle: bytes) -> Iterator[bytes]:
    """The content of each frame, checked against the seek table."""
    import zstandard

    at, unpack = 0, zstandard.ZstdDecompressor()
    for packed, size, check in seek_table(bundle):
        raw = unpack.decompress(bundle[at:at + packed], max_output_size=size) if size else b""
        if len(raw) != size or zlib.crc32(raw) != check:
            raise ValueError(f"frame at {at} is damaged")
        yield raw
        at += packed


def fetch(bundle: str, frame_offset: int, frame_bytes: int, record_offset: int) -> tuple[dict, bytes]:
    """One record by its index row: reads and unpacks only its frame."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompressobj().decompress(read_range(bundle, frame_offset, frame_bytes))
    headers, block, _ = parse(raw, record_offset)
    return headers, block


def write_bundles(pages: DataFrame, folder: str, smallest_revisit: int = SMALLEST_REVISIT, scratch: Scratch | None = None) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) and return the index, a written table.

    Of rows with equal payloads of at least ``smallest_revisit`` bytes, the one with the smallest
    page_id is the response and the others revisit it. A NULL html is empty. A NULL page_id comes
    after all others; where the same page_id repeats, the row with the smallest url is the response, and
    of rows that repeat altogether one; each has a record and an id of its own. A task writes bundles under names of its own attempt; only those that the index
    names count, so a lost or repeated task leaves no wrong record. Empty tables give no bundle.
    """
    spark = pages.sparkSession
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select(
        "page_id", "url", payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("same"),
        F.octet_length(payload).cast("bigint").alias("n"))
    # Names the row's contents; a NULL url and an empty one are written alike.
    keyed = keyed.withColumn("row", F.unhex(F.sha2(F.to_json(F.struct("page_id", F.coalesce("url", F.lit("")).alias("url"), F.hex("same").alias("same"))), 256)))
    scratch = scratch or Scratch(spark, "warc")
    # One small row per payload; minima are taken before the shuffle.
    first = keyed.groupBy("same").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id"), F.coalesce("url", F.lit("")).alias("url"))).alias("first"))
    first = first.select("same", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    # Written, so that the joins below are free to split the rows of a payload that many pages share.
    first = scratch.keep(first, "first")
    # Rows that repeat are taken once, with their number, which combines before the shuffle.
    repeated = scratch.keep(keyed.groupBy("row").agg(F.count("*").alias("copies")).filter("copies > 1"), "repeated")
    once = keyed.join(repeated, "row", "left_anti").withColumn("copy", F.lit(1).cast("bigint"))
    if not repeated.isEmpty():
        again = keyed.join(repeated.select("row"), "row", "left_semi").groupBy("row").agg(
            *[F.first(c).alias(c) for c in ("page_id", "url", "payload", "same", "n")])
        again = again.join(repeated, "row").withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
        once = once.unionByName(again.drop("copies"))
    joined = once.join(first, "same", "left")
    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) & F.coalesce("url", F.lit("")).eqNullSafe(F.col("first_url")) & (F.col("copy") == 1)
    rows = joined.select(
        "page_id", "url", "payload", (~is_first & (F.col("n") >= smallest_revisit)).alias("revisit"), "first_id", "copy")

    def write(batches):
        bundle = Bundle()

        def close():
            data = bundle.finish()
            name = f"{folder}/bundle-{uuid.uuid4().hex}.warc.zst"
            write_bytes(name, data)
            return pd.DataFrame(
                [(rid, page, name, *rest) for rid, page, *rest in bundle.rows],
                columns=["record_id", "page_id", "bundle", "frame", "frame_offset", "frame_bytes", "record_offset", "record_bytes"],
            ).astype({"page_id": "Int64"})

        for batch in batches:
            for page, url, payload, revisit, first_id, copy in zip(*(
                    batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "revisit", "first_id", "copy")), strict=True):
                data = payload.encode("utf-8", "surrogatepass")
                digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
                rid, made = record(page, url, data, digest, "revisit" if revisit else "response", first_id, copy)
                bundle.add(rid, page, made)
                if bundle.size >= BUNDLE_BYTES:
                    yield close()
                    bundle = Bundle()
        if bundle.rows or bundle.waiting:
            yield close()

    def arrow(batches):
        import pyarrow as pa

        for pdf in write(batches):
            yield pa.RecordBatch.from_pandas(pdf, preserve_index=False, schema=INDEX_ARROW())

    index = rows.mapInArrow(arrow, INDEX)
    path = f"{folder}/index"
    index.write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def INDEX_ARROW():
    import pyarrow as pa

    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in INDEX.split(", "))])


def read_bundles(index: DataFrame) -> DataFrame:
    """(record_id, page_id, url, payload_bytes, payload_digest, record_type, refers_to, frame, record_offset,
    payload) of every record in the bundles that an index names, read from the files frame by frame.

    A damaged or cut file raises an error. A revisit's payload is NULL.
    """
    spark: SparkSession = index.sparkSession
    bundles = index.select("bundle").distinct()
    schema = ("record_id string, page_id bigint, url string, payload_bytes bigint, payload_digest string, "
              "record_type string, refers_to bigint, frame int, record_offset bigint, payload binary")

    def read(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        arrow = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                for number, raw in enumerate(frames(read_bytes(name))):
                    at, rows = 0, []
                    while at < len(raw):
                        head, block, after = parse(raw, at)
                        body = block[block.index(b"\r\n\r\n") + 4:]
                        page, kind = head["X-Page-Id"], head["WARC-Type"]
                        refers = head.get("X-Refers-To-Page")
                        rows.append((
                            head["WARC-Record-ID"], int(page) if page else None, head.get("WARC-Target-URI"), int(head["X-Payload-Length"]),
                            head["WARC-Payload-Digest"].removeprefix("sha1:"), kind,
                            int(refers) if refers and refers != "None" else None, number, at, None if kind == "revisit" else body))
                        if kind == "response" and (
                            len(body) != int(head["X-Payload-Length"]) or
                            base64.b32encode(hashlib.sha1(body).digest()).decode() != rows[-1][4]):
                            raise ValueError(f"the payload of {rows[-1][0]} does not match its digest")
                        at = after
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # By a hash of the name, so that the names, a tiny table, are not put together again.
    return bundles.repartition(tasks, F.xxhash64("bundle")).mapInArrow(read, schema)


def query(spark, folder: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    index = write_bundles(table(spark, folder, "pages"), scratch.root, scratch=scratch)
    return read_bundles(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html,
         row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST, coalesce(url, '')) AS place,
         first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST, coalesce(url, '')) AS first_id
  FROM pages),
d AS (SELECT *, sha1(html) AS hex FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
          (CAST('0x' || substr(hex, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INTEGER), 1), '' ORDER BY k)
        FROM range(32) t(k)) AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN first_id END AS refers_to
FROM d
"""
