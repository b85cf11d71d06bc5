"""Near-duplicate embeddings by collision-counting projections.

Each of ``TABLES`` tables sorts the vectors by one random projection inside coarse cells of
``CELL_DIMS`` others. Two vectors collide in a table if they share the cell and lie in each other's
window of the sorted projection. A pair is verified if it collides in enough tables; that count
is set so that pairs at the threshold reach it with probability ``RECALL``. The collisions of
a pair are counted where it first collides, so it is verified and counted once. Before vectors move,
the signs of 64 further projections are counted: who agrees with nobody in the cell on at least
``SIGNS`` of them leaves it.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import Scratch, components, table

COSINE = 0.95
TABLES, CELL_DIMS = 48, 16
#: In units of the standard deviation of a coordinate of a random unit vector.
CELL_WIDTH, WINDOW = 2.0, 0.64
RECALL = 0.97
#: Two vectors at the threshold agree on 57.5 of 64 signs, give or take 2.4; unrelated ones on 32.
SIGNS = 44
#: A cell with more vectors is compared in pairs of blocks of about this size, each its own group.
BLOCK = 1024
PAIRS = 1 << 15


def collision_rate(cosine: float) -> float:
    """Probability that two vectors at this cosine collide in a table."""
    spread = math.sqrt(2 - 2 * cosine)  # of a projection's difference, in units of one coordinate
    same_cell = 1 - spread * math.sqrt(2 / math.pi) / CELL_WIDTH
    return same_cell**CELL_DIMS * math.erf(WINDOW / spread / math.sqrt(2))


def least_collisions(cosine: float, recall: float = RECALL) -> int:
    """The largest count that pairs at this cosine reach with the wanted probability."""
    q, miss, count = collision_rate(cosine), 0.0, 0
    while True:
        miss += math.comb(TABLES, count) * q**count * (1 - q) ** (TABLES - count)
        if miss > 1 - recall:
            return max(1, count)
        count += 1


class Projections:
    """The fixed random directions for vectors of one length."""

    def __init__(self, length: int):
        rng = np.random.default_rng([7, length])
        lines = rng.standard_normal((length, TABLES * (CELL_DIMS + 1) + 64))
        self.lines = lines / np.linalg.norm(lines, axis=0) * math.sqrt(length)
        self.shift = rng.uniform(0, CELL_WIDTH, TABLES * CELL_DIMS)
        self.odd = rng.integers(1, 2**62, CELL_DIMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = np.array([length], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(TABLES, dtype=np.uint64)

    def __call__(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, place on the sorted line) of each vector in each table, and its signs."""
        made = unit @ self.lines
        signs = np.packbits(made[:, -64:] > 0, axis=1).view(np.int64).ravel()
        split = TABLES * CELL_DIMS
        cells = np.floor((made[:, :split] + self.shift) / CELL_WIDTH).astype(np.int64).view(np.uint64)
        cells = cells.reshape(len(unit), TABLES, CELL_DIMS)
        name = np.broadcast_to(self.salt, (len(unit), TABLES)).copy()
        for i in range(CELL_DIMS):
            name = (name ^ cells[:, :, i]) * self.odd[i]
            name ^= name >> np.uint64(31)
        return name.view(np.int64), made[:, split:-64], signs


@lru_cache(maxsize=4)
def projections(length: int) -> Projections:
    return Projections(length)


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable place of each of n places over links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def counted(names, lines, i, j, at: int, enough: int):
    """The pairs (i, j) that collide first in table ``at`` and in at least ``enough`` tables."""
    meets = lambda t: (names[i, t] == names[j, t]) & (np.abs(lines[i, t] - lines[j, t]) <= WINDOW)
    for t in range(at):
        new = ~meets(t)
        i, j = i[new], j[new]
    ready, count = [], np.ones(len(i), np.int64)
    for t in range(at + 1, TABLES):
        done = count >= enough
        if done.any():
            ready.append((i[done], j[done]))
            i, j, count = i[~done], j[~done], count[~done]
        count += meets(t)
    ready.append((i[count >= enough], j[count >= enough]))
    return tuple(np.concatenate(x) for x in zip(*ready, strict=True))


def link(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """Each row of vectors (vec_id, embedding) with n_links, component_id and kept.

    n_links is the number of other rows found with a cosine of at least ``cosine`` in double
    precision. Equal vectors are compared once and count as often as they occur. Vectors of different
    lengths do not link. A vector that is NULL, empty, zero, or holds NULL or non-finite components links
    with nothing and is its own component. A row without vec_id takes no part: no links, no component,
    not kept. Rows that repeat a vec_id link as two vectors under one id. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")

    def read(batches):
        import pyarrow as pa
        import xxhash

        schema = pa.schema([("vec_id", pa.int64()), ("digest", pa.binary()), ("raw", pa.binary())])
        for batch in batches:
            digests, raws = [], []
            for vec_id, x in zip(*(batch.column(i) for i in range(2)), strict=True):
                raw = digest = None
                if x.is_valid and vec_id.is_valid and not x.values.null_count and len(x.values):
                    x = x.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no negative zero
                    if np.isfinite(x).all() and x.any():
                        raw = x.tobytes()
                        digest = xxhash.xxh3_128_digest(raw)
                digests.append(digest)
                raws.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(raws, pa.binary())], schema=schema)

    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    rows = scratch.keep(rows.mapInArrow(read, "vec_id bigint, digest binary, raw binary"), "rows")
    sized = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    classes = scratch.keep(sized.join(
        rows.select(F.col("digest").alias("d"), F.col("vec_id").alias("v"), "raw").dropDuplicates(["d", "v"]),
        (F.col("digest") == F.col("d")) & (F.col("node") == F.col("v"))).select("digest", "node", "copies", "raw"), "classes")

    def spots(batches):
        import pyarrow as pa

        schema = pa.schema([("cell", pa.int64()), ("digest", pa.binary()), ("at", pa.int32()), ("signs", pa.int64())])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                digests, raws = part.column(0).to_pylist(), part.column(1).to_pylist()
                for length in {len(r) for r in raws}:
                    here = [i for i, r in enumerate(raws) if len(r) == length]
                    cells, _, signs = projections(length // 8)(_unit([raws[i] for i in here]))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(cells.ravel()), pa.array([digests[i] for i in here for _ in range(TABLES)], pa.binary()),
                        pa.array(np.tile(np.arange(TABLES, dtype=np.int32), len(here))), pa.array(np.repeat(signs, TABLES))], schema=schema)

    places = scratch.keep(classes.select("digest", "raw").mapInArrow(spots, "cell bigint, digest binary, at int, signs bigint"), "places")
    others = places.select(F.col("cell").alias("c"), F.col("digest").alias("d"), F.col("signs").alias("s"))
    alike = F.bit_count(F.col("signs").bitwiseXOR(F.col("s"))) <= 64 - SIGNS
    places = scratch.keep(places.join(others, (F.col("cell") == F.col("c")) & (F.col("digest") != F.col("d")) & alike, "left_semi").drop("signs"), "likely")
    cells = places.groupBy("cell").agg(F.count("*").alias("size"))
    shared = places.join(cells, "cell")
    # A crowded cell is cut into blocks, and each pair of blocks is a group of its own.
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    shared = shared.withColumn("own", F.pmod(F.xxhash64("digest"), blocks).cast("int"))
    shared = shared.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    shared = shared.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "at", "digest")
    members = shared.join(classes.select("digest", "node", "copies", "raw"), "digest").select("cell", "i", "j", "own", "at", "node", "copies", "raw", "digest")
    enough = least_collisions(cosine, recall)

    def compare(key, pdf):
        import pandas as pd

        _, low, high = key
        none = pd.DataFrame({"digest": pd.Series(dtype=object), "node": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
        if len(pdf) < 2:
            return none
        unit = _unit(list(pdf["raw"]))
        names, lines, _ = projections(unit.shape[1])(unit)
        at = int(pdf["at"].iloc[0])
        order = np.argsort(lines[:, at], kind="stable")
        pdf, unit, names, lines = pdf.iloc[order], unit[order], names[order], lines[order]
        own, copies, node = pdf["own"].to_numpy(), pdf["copies"].to_numpy(), pdf["node"].to_numpy()
        until = np.searchsorted(lines[:, at], lines[:, at] + WINDOW, side="right")
        links, found = np.zeros(len(pdf), np.int64), []
        begin = 0
        while begin < len(pdf):
            # As many queries as their windows fit into one round.
            end, total = begin, 0
            while end < len(pdf) and (end == begin or total + until[end] - end - 1 <= PAIRS):
                total += until[end] - end - 1
                end += 1
            width = until[begin:end] - np.arange(begin, end) - 1
            i = np.repeat(np.arange(begin, end), width)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width)
            begin = end
            if low != high:
                cross = own[i] != own[j]
                i, j = i[cross], j[cross]
            if not len(i):
                continue
            i, j = counted(names, lines, i, j, at, enough)
            good = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
            i, j = i[good], j[good]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            found.append((i, j))
        if not links.any():
            return none
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        # Roots by smallest id, so places are ranked by node.
        rank = np.argsort(np.argsort(node, kind="stable"), kind="stable")
        by_rank = np.sort(node)
        root = by_rank[_roots(len(node), rank[i], rank[j])][rank]
        hit = links > 0
        return pd.DataFrame({"digest": pdf["digest"][hit], "node": node[hit], "links": links[hit], "root": root[hit]})

    found = scratch.keep(members.groupBy("cell", "i", "j").applyInPandas(compare, "digest binary, node bigint, links bigint, root bigint"), "found")
    scratch.drop(places)
    counts = found.groupBy("digest").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    out = classes.select("digest", "node", "copies").join(counts, "digest", "left").join(comps, "node", "left").select(
        F.col("digest").alias("d"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component_id"))
    out = scratch.keep(out, "answer")  # so that the join may split the rows of a hot vector
    out = rows.select("vec_id", "digest").join(out, F.col("digest") == F.col("d"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def query(spark, folder: str) -> DataFrame:
    return link(table(spark, folder, "embeddings"))
