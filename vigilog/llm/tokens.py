"""Token-id files coded by a static range asymmetric numeral system (rANS).

One frequency table over all ids is shared by all files. Ids are cut into blocks of whole documents
that decode independently. In a block, lane j codes ids j, j + lanes, j + 2 lanes, ...; all lanes
write to one stream of 32-bit words. Every ``CHECKPOINT`` steps the block records the lanes' states
and the place in the stream, so that several workers can decode one block from different places.

File: the magic, the table's checksum, blocks, a directory of (offset, bytes, ids, documents) for each
block, the number of blocks, the magic again. Numbers are little-endian.
"""

from __future__ import annotations

import struct
import unicodedata
import uuid
import zlib
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilog.llm.common import Scratch, table
from vigilog.llm.files import read_bytes, write_bytes

MAGIC = b"RANSIDS1"
SCALE = 20  # frequencies add up to 1 << SCALE, which bounds the vocabulary
LOW = np.uint64(1 << 31)  # least state between steps
LANES = 1024
CHECKPOINT = 128
BLOCK_IDS = 1 << 18
FILE_BYTES = 32 << 20
VOCABULARY = "word_bpe_49k.json"
END_ID = 2
#: White space separated pieces that a worker remembers; they are never joined by this vocabulary.
MEMORY = 1 << 20
#: Documents that are cut into pieces together; each different piece of them is looked up once.
SLICE = 1024


class Table:
    """Frequencies of the ids in use, scaled to a power of two; each at least 1."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        order = np.argsort(ids)
        self.ids, counts = np.asarray(ids, np.uint32)[order], np.asarray(counts, np.float64)[order]
        total = 1 << SCALE
        if len(ids) > total:
            raise ValueError(f"{len(ids)} different ids; a table holds {total}")
        freq = np.maximum(1, np.floor(counts / max(1.0, counts.sum()) * total)).astype(np.int64)
        # What rounding left over or took goes to or from the largest, in order of size.
        rest = total - int(freq.sum())
        for i in np.lexsort((self.ids, -counts)) if len(ids) else ():
            give = max(rest, 1 - int(freq[i]))
            freq[i] += give
            rest -= give
            if rest >= 0:
                break
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.int32), freq)

    def places(self, ids: np.ndarray) -> np.ndarray:
        if not len(ids):
            return np.zeros(0, np.int64)
        if not len(self.ids) or int(ids.max()) > int(self.ids[-1]):
            raise ValueError("an id is not in the table")
        if int(self.ids[-1]) < 1 << (SCALE + 2):  # a look-up costs a fraction of a search
            where = np.full(int(self.ids[-1]) + 1, -1, np.int32)
            where[self.ids] = np.arange(len(self.ids), dtype=np.int32)
            at = where[ids]
            known = at >= 0
        else:
            at = np.searchsorted(self.ids, ids)
            known = self.ids[at] == ids
        if not known.all():
            raise ValueError("an id is not in the table")
        return at

    def to_bytes(self) -> bytes:
        return struct.pack("<I", len(self.ids)) + self.ids.astype("<u4").tobytes() + self.freq.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        (n,) = struct.unpack_from("<I", data)
        out = cls.__new__(cls)
        out.ids = np.frombuffer(data, "<u4", n, 4).astype(np.uint32)
        out.freq = np.frombuffer(data, "<u4", n, 4 + 4 * n).astype(np.uint64)
        out.start = np.cumsum(out.freq) - out.freq
        out.slots = np.repeat(np.arange(n, dtype=np.int32), out.freq.astype(np.int64))
        return out

    def checksum(self) -> int:
        return zlib.crc32(self.to_bytes())


def encode_ids(ids: np.ndarray, shared: Table) -> bytes:
    """lanes, words, checkpoints, then each checkpoint's place and states, then the words."""
    n = len(ids)
    lanes = max(1, min(LANES, n // 16))
    steps = -(-n // lanes)
    at = shared.places(ids)
    freq, start = shared.freq[at], shared.start[at]
    state = np.full(lanes, LOW, np.uint64)
    words, count, marks = [], 0, []
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        x, f = state[:b - a], freq[a:b]
        full = x >= (f << np.uint64(63 - SCALE))
        if full.any():
            out = x[full]
            words.append((out & np.uint64(0xFFFFFFFF)).astype("<u4"))
            count += len(out)
            x[full] = out >> np.uint64(32)
        div = x // f
        state[:b - a] = (div << np.uint64(SCALE)) + (x - div * f) + start[a:b]
        if step % CHECKPOINT == 0:
            marks.append((count, state.astype("<u8").tobytes()))
    head = struct.pack("<III", lanes, count, len(marks))
    body = b"".join(struct.pack("<I", count - c) + s for c, s in reversed(marks))
    return head + body + b"".join(w.tobytes() for w in reversed(words))


def decode_ids(data: bytes, n: int, shared: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids from checkpoint ``first`` up to checkpoint ``last`` (to the end if None) of n coded ids."""
    lanes, count, marks = struct.unpack_from("<III", data)
    steps = -(-n // lanes)
    until = steps if last is None else min(steps, last * CHECKPOINT)
    words = np.frombuffer(data, "<u4", count, 12 + marks * (4 + 8 * lanes)).astype(np.uint64)
    out = np.empty(max(0, min(n, until * lanes) - first * CHECKPOINT * lanes), np.int32)
    if not len(out):
        return out.astype(np.uint32)
    mark = 12 + first * (4 + 8 * lanes)
    (place,) = struct.unpack_from("<I", data, mark)
    state = np.frombuffer(data, "<u8", lanes, mark + 4).astype(np.uint64)
    mask, done = np.uint64((1 << SCALE) - 1), 0
    for step in range(first * CHECKPOINT, until):
        k = min(n - step * lanes, lanes)
        x = state[:k]
        slot = x & mask
        symbol = shared.slots[slot.astype(np.int64)]
        x = shared.freq[symbol] * (x >> np.uint64(SCALE)) + slot - shared.start[symbol]
        low = np.flatnonzero(x < LOW)
        if len(low):
            x[low] = (x[low] << np.uint64(32)) | words[place:place + len(low)]
            place += len(low)
        state[:k] = x
        out[done:done + k] = symbol
        done += k
    return shared.ids[out]


def encode_block(doc_ids: list, lengths: list[int], ids: np.ndarray, shared: Table) -> bytes:
    """Documents, their ids, and a checksum of both."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = struct.pack("<II", len(ids), len(doc_ids)) + known.tobytes() + np.array(
        [d or 0 for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<u4").tobytes()
    check = zlib.crc32(ids.astype("<u4").tobytes(), zlib.crc32(docs))
    return docs + struct.pack("<I", check) + encode_ids(ids, shared)


def decode_block(data: bytes, shared: Table) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids); raises ValueError if the checksum does not fit."""
    n, docs = struct.unpack_from("<II", data)
    known = np.frombuffer(data, np.uint8, docs, 8)
    names = np.frombuffer(data, "<i8", docs, 8 + docs)
    lengths = np.frombuffer(data, "<u4", docs, 8 + 9 * docs)
    head = 8 + 13 * docs
    (check,) = struct.unpack_from("<I", data, head)
    ids = decode_ids(data[head + 4:], n, shared)
    if zlib.crc32(ids.astype("<u4").tobytes(), zlib.crc32(data[:head])) != check:
        raise ValueError("a block is damaged")
    return [int(d) if k else None for d, k in zip(names, known, strict=True)], lengths, ids


def pack_file(blocks: list[tuple[bytes, int, int]], shared: Table) -> bytes:
    """A file of (block, ids, documents)."""
    out, at, directory = [MAGIC + struct.pack("<I", shared.checksum())], 12, []
    for block, ids, docs in blocks:
        out.append(block)
        directory.append(struct.pack("<QQQQ", at, len(block), ids, docs))
        at += len(block)
    return b"".join(out + directory + [struct.pack("<I", len(blocks)), MAGIC])


def unpack_file(data: bytes, shared: Table) -> list[bytes]:
    """The blocks, from the directory."""
    if data[:8] != MAGIC or data[-8:] != MAGIC or struct.unpack_from("<I", data, 8)[0] != shared.checksum():
        raise ValueError("not a file of this table")
    (n,) = struct.unpack_from("<I", data, len(data) - 12)
    rows = struct.iter_unpack("<QQQQ", data[len(data) - 12 - 32 * n:len(data) - 12])
    return [data[at:at + size] for at, size, _, _ in rows]


_PIECES: dict = {}
#: Marks that end a word; the vocabulary never joins them to the Latin letters and digits before them, and
#: white space after them ends them.
_ENDING = r"([a-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}])([.,!?;:#$%&*]+)([\x20\x09-\x0D]|$)"


def _byte_letters() -> dict[int, str]:
    """Latin letters as byte-level vocabularies write them: a printable Latin-1 byte stands for itself,
    the others for the characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    name = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(name[b] for b in chr(c).encode()) for c in range(0x80, 0x250)}


_LATIN = _byte_letters()


def pieces_of(texts):
    """Pieces of an Arrow array of texts that are tokenized by themselves: words in lower case, endings apart.

    A text that may hold the name of a special token is only split.
    """
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "")
    cut = pc.replace_substring_regex(pc.ascii_lower(texts), _ENDING, r"\1 \2\3")
    return pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, cut))


class Pieces:
    """The ids of all pieces that a worker has met, one after another in one array."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.coder = Tokenizer.from_file(vocabulary)
        # For words of plain Latin letters, which need no normalizing.
        self.words = Tokenizer(self.coder.model)
        self.words.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, pieces: list[str]) -> None:
        plain, latin, rest = [], [], []
        for word in pieces:
            if not (word.isalpha() and word.islower()):
                rest.append(word)
            elif word.isascii():
                plain.append(word)
            elif max(word) < "\u0250" and unicodedata.is_normalized("NFC", word):
                latin.append(word)
            else:
                rest.append(word)
        sizes, ids = [], []
        for words, letters in ((plain, None), (latin, _LATIN)):
            some = [words[at:at + 256] for at in range(0, len(words), 256)]
            whole = [" ".join(x).translate(letters) if letters else " ".join(x) for x in some]
            for x, found in zip(some, self.words.encode_batch(whole, add_special_tokens=False), strict=True):
                sizes.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(x)))
                ids.append(np.array(found.ids, np.uint32))
        found = [x.ids for x in self.coder.encode_batch_fast(rest, add_special_tokens=False)]
        sizes.append(np.array([len(x) for x in found], np.int64))
        ids.append(np.array([i for x in found for i in x], np.uint32))
        self.known.update(zip(plain + latin + rest, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        sizes = np.concatenate(sizes).astype(np.int64)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, *ids])

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow array of texts, and where those of each text end."""
        pieces = pieces_of(texts)
        coded = pieces.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > MEMORY:
            self.clear()
        at = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        if len(new):
            self._learn([names[i] for i in new])
            at[new] = [self.known[names[i]] for i in new]
        at = at[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.starts[at] - ends[:-1], sizes) + np.arange(ends[-1])]
        offsets = pieces.offsets.to_numpy()
        return ids, ends[offsets[1:] - offsets[0]]


def id_blocks(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """(part, block, doc_ids, lengths, ids, counts): whole documents in ascending doc_id order, tokenized.

    Documents are dealt by ranges of doc_id. ids holds 32-bit numbers. The last row of each part holds no
    documents but counts, 64-bit numbers: the ids in use there and how often each is. White space never joins
    pieces in these vocabularies, so a piece between white space is tokenized once per worker.
    """
    def tokenize(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("ids", pa.binary()), ("counts", pa.binary())])
        if vocabulary not in _PIECES:
            _PIECES[vocabulary] = Pieces(vocabulary)
        known = _PIECES[vocabulary]
        end = np.array([end_id], "<u4").tobytes()
        names, lengths, made, held, block, part = [], [], [], 0, 0, 0
        total = np.zeros(0, np.int64)

        def row(*values):
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        def counted(ids):
            one = np.bincount(ids, minlength=len(total))
            one[:len(total)] += total
            return one

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = batch.slice(at, SLICE)
                ids, ends = known.encode(rows.column(1))
                total = counted(ids)
                first = 0
                for name, last, where in zip(rows.column(0).to_pylist(), ends.tolist(), rows.column(2).to_pylist(), strict=True):
                    size, part = last - first + 1, where
                    if held and held + size > BLOCK_IDS:
                        yield row(part, block, names, lengths, b"".join(made), None)
                        names, lengths, made, held, block = [], [], [], 0, block + 1
                    names.append(name)
                    lengths.append(size)
                    made += [ids[first:last].astype("<u4", copy=False).tobytes(), end]
                    held += size
                    first = last
                total = counted(np.full(rows.num_rows, end_id))
        if held:
            yield row(part, block, names, lengths, b"".join(made), None)
            used = np.flatnonzero(total)
            yield row(part, block + 1, [], [], b"", np.stack([used, total[used]]).astype("<i8").tobytes())

    text_order = F.xxhash64("text")  # rows that repeat a doc_id keep one order
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange("doc_id")
    rows = rows.sortWithinPartitions("doc_id", text_order).select("doc_id", "text", F.spark_partition_id().alias("part"))
    return rows.mapInArrow(tokenize, "part int, block int, doc_ids array<bigint>, lengths array<int>, ids binary, counts binary")


def count_ids(blocks: DataFrame) -> Table:
    """The shared table from all ids; at most one row for each id of the vocabulary reaches the driver."""
    def count(batches):
        import pyarrow as pa

        schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            for x in batch.column(0):
                used, n = np.frombuffer(x.as_py(), "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(n, pa.int64())], schema=schema)

    rows = blocks.filter("counts IS NOT NULL").select("counts").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return Table(np.array([r.id for r in rows], np.uint32), np.array([r.n for r in rows], np.int64))


def write_ids(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, scratch: Scratch | None = None) -> DataFrame:
    """Write the ids of docs (doc_id, text) as files; returns (file, start, n_ids, n_docs), a written table.

    Each document's ids are followed by ``end_id``. Files hold documents in ascending doc_id order, rows
    without doc_id first, and ``start`` is the number of ids in all files before. The shared
    table is ``folder/table.bin``. A NULL text is empty. Rows that repeat are documents of their own. An
    empty table gives no files. Tasks write under names of their own attempt, and only files that
    the returned table names count.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "ids")
    blocks = scratch.keep(id_blocks(docs, vocabulary, end_id), "blocks")
    shared = count_ids(blocks)
    write_bytes(f"{folder}/table.bin", shared.to_bytes())
    sent = spark.sparkContext.broadcast(shared)

    def write(batches):
        import pyarrow as pa

        schema = pa.schema([("file", pa.string()), ("part", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("n_docs", pa.int64())])
        waiting, size, first, last = [], 0, None, None

        def close():
            name = f"{folder}/ids-{uuid.uuid4().hex}.rans"
            write_bytes(name, pack_file(waiting, sent.value))
            return pa.RecordBatch.from_pylist([{
                "file": name, "part": first[0], "block": first[1], "n_ids": sum(x[1] for x in waiting), "n_docs": sum(x[2] for x in waiting)}], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                part, block, names, lengths, ids = (batch.column(c)[i].as_py() for c in range(5))
                if waiting and (size >= FILE_BYTES or (part, block) != (last[0], last[1] + 1)):
                    yield close()
                    waiting, size = [], 0
                if not waiting:
                    first = (part, block)
                last = (part, block)
                ids = np.frombuffer(ids, "<u4")
                packed = encode_block(names, lengths, ids, sent.value)
                waiting.append((packed, len(ids), len(names)))
                size += len(packed)
        if waiting:
            yield close()

    files = scratch.keep(blocks.filter("counts IS NULL").drop("counts").mapInArrow(write, "file string, part int, block int, n_ids bigint, n_docs bigint"), "files")
    scratch.drop(blocks)
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("base"))
    inside = files.withColumn("inside", before(Window.partitionBy("part").orderBy("block")))
    return inside.join(parts, "part").select("file", (F.col("base") + F.col("inside")).alias("start"), "n_ids", "n_docs")


def read_ids(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary, block) of every document in the files, decoded and checked."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"

    def read(batches):
        import pyarrow as pa

        kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        shared = None
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shared = shared or Table.from_bytes(read_bytes(f"{folder}/table.bin"))
                for block in unpack_file(read_bytes(name), shared):
                    names, lengths, ids = decode_block(block, shared)
                    ends = np.cumsum(lengths, dtype=np.int64)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    cut = [bytes(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(names, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(cut, pa.binary())], schema=kinds)
                    start += len(ids)

    tasks = max(files.sparkSession.sparkContext.defaultParallelism, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.select("file", "start").repartition(tasks, "file").mapInArrow(read, schema)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write docs, read the files back, and return doc_id, start, n_tokens and ids_crc32."""
    scratch = Scratch(docs.sparkSession, "ids")
    folder = scratch.root
    files = write_ids(docs, folder, vocabulary or vocabulary_path(), end_id, scratch)
    return read_ids(files, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def query(spark, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents"))
