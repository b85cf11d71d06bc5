"""N-gram Jaccard join of whole texts: an exact metric-space join over pivots.

Jaccard distance between shingle sets is a metric. The space is cut in two levels.

1. *Single shingles as pivots.* Of all sets with one shingle, a document's nearest is the shingle it
   holds that weighs most, where rare ones weigh more: that pivot's Voronoi region is its home. A
   partner within the radius differs from the document in at most ``n - ceil(t n)`` of its own n
   shingles, so the partner's home is among the document's ``n - ceil(t n) + 1`` nearest pivots. The
   document is replicated to those regions and no others. (With documents as first pivots this
   would not work: nearly all pairs of texts are at distance 1, so no window excludes anything.)
2. *Documents as pivots*, within a region of more than a few documents: distances to some pivots,
   a Voronoi cell for each, and copies of a document in all cells whose pivot is at most two radii
   farther than its nearest (triangle inequality). Cells are regions again, and so on. Distances
   here are between sketches, one parity bit for each class of shingles: they are a metric, never
   above the size of the symmetric difference, and cost no text.

Before a pair's texts are read, its sizes and sketches must allow a link. Pairs are only compared
while their documents are in different components, which is all that the result needs.

Weights steer the size of the regions, never the result. A shingle is no more frequent than its
rarest word; where that word occurs fewer than ``RARE`` times it decides. A document that has too
few such shingles has its others counted, over all such documents. Shingles are 64-bit hashes, and
equal sets are joined by 128 bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilog.llm.common import Scratch, components, table

SHINGLE, PERCENT = 3, 90
#: Words whose counts weigh; all others count as rare.
COMMON_WORDS = 1 << 16
#: Shingles with a rarer word than this need no count.
RARE = 64
#: In a region up to this size each sketch meets every other; texts are read of those that may link.
SMALL = 4096
#: Pivots of a larger one, and how often a document may stand in its cells on average.
PIVOTS, SPREAD = 128, 2.0
#: Longs of a sketch.
SKETCH = 8
#: Distinct words that a task remembers at a time.
MEMORY = 1 << 19
SETS = "doc_id bigint, n bigint, digest binary, keys array<bigint>, need int, rest array<bigint>, wide binary, " + ", ".join(f"k{i} bigint" for i in range(SKETCH))


class Words(dict):
    """word -> place of its hash and count, remembered up to a bound."""

    def __init__(self, common: dict[int, int]):
        self.common, self.hashes, self.counts = common, np.empty(1024, np.uint64), np.empty(1024, np.int64)

    def __missing__(self, word: bytes) -> int:
        import xxhash

        i = len(self)
        if i == len(self.hashes):
            self.hashes, self.counts = np.resize(self.hashes, 2 * i), np.resize(self.counts, 2 * i)
        self.hashes[i] = h = xxhash.xxh3_64_intdigest(word)
        self.counts[i] = self.common.get(h, 0)
        self[word] = i
        return i

    def places(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMORY:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def split_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased words; bytes split at just the six ASCII white space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingle_set(words: list[bytes], k: int, memory: Words) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes of the distinct shingles, count of each one's rarest word)."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = memory.places(words)
    h, c = memory.hashes[at], memory.counts[at]
    width = min(k, len(words))
    last = len(words) - width + 1
    made, rare = np.full(last, width, np.uint64), c[:last]
    for i in range(width):
        made = _mixed(made * np.uint64(0x9E3779B97F4A7C15) + h[i:i + last])
        rare = np.minimum(rare, c[i:i + last])
    made, first = np.unique(made, return_index=True)
    return made, rare[first]


def word_counts(docs: DataFrame, scratch: Scratch, limit: int = COMMON_WORDS) -> dict[int, int]:
    """Hash -> occurrences of the most frequent words of all texts, at most ``limit`` of them.

    Every occurrence is counted. Words are told apart by levels of their counts, quarters of a power
    of two; only those of the highest levels that fit reach the driver.
    """
    def count(batches):
        from collections import Counter

        import pyarrow as pa
        import xxhash

        schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

        def flush(seen):
            h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in seen), np.uint64, len(seen)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.fromiter(seen.values(), np.int64, len(seen)))], schema=schema)

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(split_words(text.as_py()))
                if len(seen) > MEMORY:
                    yield flush(seen)
                    seen.clear()
        yield flush(seen)

    words = docs.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    words = scratch.keep(words.withColumn("level", F.floor(F.log2("n") * 4).cast("int")), "words")
    room, lowest = limit, 1 << 30
    for row in sorted(words.groupBy("level").agg(F.count("*").alias("words")).collect(), reverse=True):
        room -= row.words
        if room < 0:
            break
        lowest = row.level
    rows = words.filter(F.col("level") >= lowest).collect()
    scratch.drop(words)
    return {r.word & (2**64 - 1): r.n for r in rows}


def sketch(made: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of 64 * SKETCH classes."""
    classes = ((made >> np.uint64(17)) % np.uint64(64 * SKETCH)).astype(np.int64)
    odd = (np.bincount(classes, minlength=64 * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def wide_sketch(made: np.ndarray) -> bytes:
    """The same for a power of two of classes, at least twice as many as shingles.

    Halves that are combined by exclusive or make the sketch for half as many classes.
    """
    bits = max(8, 1 << (2 * len(made) - 1).bit_length()) if len(made) else 8
    classes = ((made >> np.uint64(17)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(classes, minlength=bits) & 1).astype(np.uint8)).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """No more than the number of shingles in just one of two sets, from their wide sketches."""
    a, b = (np.frombuffer(v, np.uint8) for v in sorted((x, y), key=len))
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def hopeful(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that wide sketches allow to link. They take a fraction of the texts' room."""
    def check(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                keep.append(least_difference(x, y) * (100 + percent) <= (n + m) * (100 - percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: heads.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "wide_a", "wide_b")
    return both.mapInArrow(check, "a bigint, b bigint").distinct()


def shingle_sets(docs: DataFrame, k: int, percent: int, common) -> DataFrame:
    """SETS: set size, name of the set, its nearest single-shingle pivots, and its sketch.

    ``need`` more pivots are to be chosen from ``rest``, which is empty if keys are enough.
    """
    def make(batches):
        import pyarrow as pa
        import xxhash

        memory = Words(common.value)
        empty = np.empty(0, np.uint64)

        def lists(parts):
            ends = np.cumsum([0] + [len(p) for p in parts])
            flat = np.concatenate([empty, *parts]).view(np.int64)
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sizes, digests, keys, need, rest, wide, bits = [], [], [], [], [], [], []
                for text in batch.column(1):
                    made, rare = shingle_set(split_words(text.as_py()), k, memory)
                    n = len(made)
                    reach = n - -(-percent * n // 100) + 1 if n else 0
                    order = np.argsort(rare, kind="stable")
                    sure = min(reach, int((rare < RARE).sum()))
                    keys.append(made[order[:sure]])
                    need.append(reach - sure)
                    rest.append(made[order[sure:]] if sure < reach else empty)
                    sizes.append(n)
                    digests.append(xxhash.xxh3_128_digest(made.tobytes()) if n else None)
                    wide.append(wide_sketch(made))
                    bits.append(sketch(made))
                bits = np.array(bits).reshape(-1, SKETCH)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists(keys), pa.array(need, pa.int32()), lists(rest), pa.array(wide, pa.binary())]
                    + [pa.array(bits[:, i], pa.int64()) for i in range(SKETCH)],
                    names=["doc_id", "n", "digest", "keys", "need", "rest", "wide"] + [f"k{i}" for i in range(SKETCH)])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(make, SETS)


def measured(pairs: DataFrame, heads: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b, shared, total) of those pairs (a, b) that can link: sizes of intersection and union."""
    def measure(batches):
        from collections import OrderedDict

        import pyarrow as pa

        schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "shared", "total")])
        memory, known = Words({}), OrderedDict()
        held = 0

        def made(node, text):
            nonlocal held
            key = (node, hash(text))
            if key not in known:
                known[key] = shingle_set(split_words(text), k, memory)[0]
                held += len(known[key])
                while held > 1 << 21 and len(known) > 2:  # 16 MB
                    held -= len(known.popitem(last=False)[1])
            return known[key]

        for batch in batches:
            out = []
            for a, b, ta, tb in zip(*(batch.column(i) for i in range(4)), strict=True):
                x, y = made(a.as_py(), ta.as_py()), made(b.as_py(), tb.as_py())
                if len(x) > len(y):
                    x, y = y, x
                shared = 0
                if len(x):
                    at = np.searchsorted(y, x)
                    shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                out.append((a.as_py(), b.as_py(), shared, len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema=schema)

    pairs = scratch.keep(hopeful(pairs, heads, percent), "pairs")
    # Only the texts of these pairs move.
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = scratch.keep(docs.select(F.col("doc_id").cast("bigint").alias("node"), "text").join(nodes, "node", "left_semi").distinct(), "texts")
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
    # An id with several texts has several sizes; the closest count.
    ratio = F.col("shared") / F.col("total")
    out = both.mapInArrow(measure, "a bigint, b bigint, shared bigint, total bigint").groupBy("a", "b").agg(
        F.max_by("shared", ratio).alias("shared"), F.max_by("total", ratio).alias("total"))
    out = scratch.keep(out, "measured")
    scratch.drop(texts, pairs)
    return out


def join(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Each row of docs (doc_id, text) with n_shingles, component_id and class_id.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a document's set holds its
    distinct shingles of ``k`` words, or its whole sequence if it has fewer. Two documents link when
    100 * shared >= percent * union. component_id is the smallest doc_id that links reach, the
    document included; class_id is the smallest doc_id with an equal set.

    A NULL or wordless text has no shingles and links with nothing. Each row goes by its own text;
    only texts whose sets have the same smallest doc_id count as one document. A row without doc_id
    gets the component of an equal set, or NULL. An empty table gives no rows. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    common = spark.sparkContext.broadcast(word_counts(docs, scratch))
    sets = scratch.keep(shingle_sets(docs, k, percent, common), "sets")
    classes = scratch.keep(
        sets.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node")).filter("node IS NOT NULL"), "classes")
    heads = sets.join(classes.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("node")), "left_semi")
    heads = scratch.keep(heads.dropDuplicates(["doc_id", "digest"]).withColumnRenamed("doc_id", "node"), "heads")
    bits = [f"k{i}" for i in range(SKETCH)]

    # Regions of single shingles.
    rest = heads.filter("need > 0").select("node", "digest", "need", F.explode("rest").alias("region"))
    weights = rest.groupBy("region").agg(F.count("*").alias("weight"))
    nearest = F.row_number().over(Window.partitionBy("node", "digest").orderBy("weight", "region"))
    chosen = rest.join(weights, "region").withColumn("place", nearest).filter("place <= need").select("node", "region")
    spots = heads.select("node", F.explode("keys").alias("region")).union(chosen)
    shared = spots.groupBy("region").agg(F.min("node").alias("head"), F.max("node").alias("tail")).filter("head <> tail")
    info = heads.select("node", "n", *bits)
    regions = scratch.keep(spots.join(shared.select("region", "head"), "region").join(info, "node"), "regions")

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    # The other side of a pair: its node, size and sketch under other names.
    other = lambda t, *more: t.select("region", F.col("node").alias("other"), F.col("n").alias("m"), *[F.col(f"k{i}").alias(f"l{i}") for i in range(SKETCH)], *more)
    apart = sum((F.bit_count(F.col(f"k{i}").bitwiseXOR(F.col(f"l{i}"))) for i in range(1, SKETCH)), F.bit_count(F.col("k0").bitwiseXOR(F.col("l0"))))
    fits = (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & (
        apart * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent))

    # First every document against the smallest of each of its regions, which settles nearly all.
    first = regions.filter("node <> head").join(other(regions.filter("node = head")), "region").filter(fits)
    known = measured(first.select(*pair(F.col("node"), F.col("other"))).distinct(), heads, docs, k, percent, scratch)
    linked = lambda t: t.filter(F.col("shared") * 100 >= F.col("total") * percent).select("a", "b")
    comps = components(linked(known), scratch)
    live, rounds = regions.filter("node <> head").select("region", "node", "n", *bits), 0
    while True:
        rounds += 1
        named = live.join(comps, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        stats = named.groupBy("region").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("size"))
        now = scratch.keep(named.join(stats.filter("c0 <> c1").select("region", "size"), "region"), "open")
        if now.isEmpty():
            break
        few, many = now.filter(F.col("size") <= SMALL), now.filter(F.col("size") > SMALL)
        want = few.join(other(few, F.col("c").alias("c2")), "region").filter((F.col("node") < F.col("other")) & (F.col("c") != F.col("c2")) & fits)
        want = want.select(*pair(F.col("node"), F.col("other")))
        # A bounded list of pivots for each large region; a document meets them in one row.
        slot = F.pmod(F.xxhash64("node", F.lit(rounds)), F.lit(PIVOTS))
        chosen = many.groupBy("region", slot.alias("slot")).agg(F.min("node").alias("node")).select("region", "node")
        pivots = many.join(chosen, ["region", "node"]).groupBy("region").agg(F.collect_list(F.struct(
            "node", "n", "c", F.array(*bits).alias("bits"))).alias("pivots"))
        own = F.array(*bits)
        far = lambda p: F.aggregate(F.zip_with(p["bits"], own, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        met = many.join(pivots, "region").withColumn("pivots", F.transform("pivots", lambda p: F.struct(
            p["node"].alias("node"), p["n"].alias("n"), p["c"].alias("c"), far(p).alias("far"))))
        met = scratch.keep(met, "met")
        close = F.filter("pivots", lambda p: (p["c"] != F.col("c")) & (p["node"] != F.col("node"))
                         & (F.least(p["n"], F.col("n")) * 100 >= F.greatest(p["n"], F.col("n")) * percent)
                         & (p["far"] * (100 + percent) <= (p["n"] + F.col("n")) * (100 - percent)))
        spokes = met.select("node", F.explode(F.transform(close, lambda p: p["node"])).alias("other"))
        want = want.union(spokes.select(*pair(F.col("node"), F.col("other")))).distinct()
        fresh = measured(want.join(known, ["a", "b"], "left_anti"), heads, docs, k, percent, scratch)
        links = linked(fresh)
        if not links.isEmpty():
            known = known.union(fresh)
            comps = components(linked(known), scratch)
        else:
            known = known.union(fresh)
        if met.isEmpty():
            break
        # Pivots have met all of their region and leave it. The others go to the cell of the nearest
        # pivot, and to those that a partner's nearest may be: twice the radius farther at most.
        rest = met.filter(~F.exists("pivots", lambda p: p["node"] == F.col("node")))
        near = F.array_min(F.transform("pivots", lambda p: p["far"]))
        window = F.floor(F.col("n") * (100 - percent) / percent) * 2
        cells = F.transform(F.filter("pivots", lambda p: p["far"] <= near + window), lambda p: p["node"])
        rest = rest.withColumn("cells", cells)
        load = rest.groupBy("region").agg(F.avg(F.size("cells")).alias("load"))
        rest = rest.join(load, "region")
        alone = F.array(F.lit(-rounds).cast("bigint"))
        rest = rest.withColumn("cell", F.explode(F.when(F.col("load") <= SPREAD, F.col("cells")).otherwise(alone)))
        live = scratch.keep(rest.select(F.xxhash64("region", "cell").alias("region"), "node", "n", *bits), "live")
    out = classes.join(comps.withColumnRenamed("component", "c"), "node", "left").select(
        "digest", F.col("node").alias("class_id"), F.coalesce("c", "node").alias("component"))
    out = scratch.keep(out, "answer")  # so that the join may split the rows of a hot set
    rows = sets.select("doc_id", "n", F.col("digest").alias("own")).join(out, F.col("own") == F.col("digest"), "left")
    return rows.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("class_id", "doc_id").alias("class_id"))


def query(spark, folder: str) -> DataFrame:
    return join(table(spark, folder, "documents"))
