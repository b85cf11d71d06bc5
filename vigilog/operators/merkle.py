"""A hash tree over a job's manifest: its root signs the manifest, and proofs and comparisons follow branches.

Files are placed by the hash of their path, a few hex digits of it per level. A node of at most
``16 ** digits`` files lists them; a larger one lists its children, of which there are no more than
that either. So no list exceeds the fan-out, however many files a job has, and a file's place does
not depend on how many others there are besides those of its own branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.session import stored

#: Hex digits of the path's hash per level: 256 children or files a node.
DIGITS = 2
NAME_DIGITS = 64


def _name(path: Column) -> Column:
    return F.sha2(path, 256)


def _entry() -> Column:
    """What stands for a file of (relative_path, size_bytes, sha256) in its node."""
    row = F.concat_ws("\t", "relative_path", F.col("size_bytes").cast("string"), "sha256")
    return F.concat(_name(F.col("relative_path")), F.lit(":"), F.sha2(row, 256))


def _hash(kind: Column, entries: Column) -> Column:
    return F.sha2(F.concat(kind, F.lit("\n"), F.array_join(entries, "\n")), 256)


def tree(manifest: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(job_id, depth, prefix, kind, files, entries, hash) of every node, the root at depth 0.

    Rows that repeat count once. A ``leaf`` lists the files below it, a ``node`` its children as
    digits:hash. Each level is one grouped aggregate, and a written table, of the one below it.
    """
    most = 16 ** digits
    rest = stored(manifest.select("job_id", _entry().alias("entry")).distinct())
    leaves: list[DataFrame] = []  # by depth
    while True:
        at = len(leaves) * digits
        here = rest.withColumn("prefix", F.left("entry", F.lit(at)))
        crowded = here.groupBy("job_id", "prefix").count().filter(F.col("count") > most).select("job_id", "prefix")
        crowded = stored(crowded)
        last = at + digits > NAME_DIGITS or crowded.isEmpty()
        stay = here if last else here.join(crowded, ["job_id", "prefix"], "left_anti")
        listed = F.array_sort(F.collect_list("entry"))
        leaves.append(stay.groupBy("job_id", "prefix").agg(listed.alias("entries"), F.count("*").alias("files")).select(
            "job_id", "prefix", F.lit("leaf").alias("kind"), "files", "entries"))
        if last:
            break
        rest = stored(here.join(crowded, ["job_id", "prefix"], "left_semi").select("job_id", "entry"))
    levels: list[DataFrame] = []
    for depth in reversed(range(len(leaves))):
        nodes = leaves[depth]
        if levels:
            child = F.concat(F.substring("prefix", depth * digits + 1, digits), F.lit(":"), "hash")
            nodes = nodes.unionByName(levels[-1].groupBy("job_id", F.left("prefix", F.lit(depth * digits)).alias("prefix")).agg(
                F.array_sort(F.collect_list(child)).alias("entries"), F.sum("files").alias("files"),
            ).withColumn("kind", F.lit("node")))
        levels.append(stored(nodes.select(
            "job_id", F.lit(depth).alias("depth"), "prefix", "kind", "files", "entries",
            _hash(F.col("kind"), F.col("entries")).alias("hash"))))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def root(nodes: DataFrame) -> DataFrame:
    """(job_id, manifest_sha256): the signature of each job's manifest."""
    return nodes.filter("depth = 0").select("job_id", F.col("hash").alias("manifest_sha256"))


def prove(nodes: DataFrame, files: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(job_id, relative_path, depth, kind, digits, entries): the nodes on the way to files (job_id, relative_path).

    That is all it takes to check a file against a signature: a list of bounded length per level.
    """
    deepest = F.lit(NAME_DIGITS // digits)
    asked = files.select("job_id", "relative_path", _name(F.col("relative_path")).alias("name")).distinct()
    depths = nodes.groupBy("job_id").agg(F.least(F.max("depth"), deepest).alias("most"))
    ways = asked.join(depths, "job_id").select("*", F.explode(F.sequence(F.lit(0), F.col("most"))).alias("depth"))
    ways = ways.withColumn("prefix", F.expr(f"left(name, depth * {digits})"))
    return ways.join(nodes.select("job_id", "depth", "prefix", "kind", "entries"), ["job_id", "depth", "prefix"]).select(
        "job_id", "relative_path", "depth", "kind", F.right("prefix", F.lit(digits)).alias("digits"), "entries")


def verify_proofs(proofs: DataFrame, files: DataFrame, signatures: DataFrame) -> DataFrame:
    """(job_id, relative_path, valid): whether a proof leads from the file's hash to the signature.

    ``files`` (job_id, relative_path, size_bytes, sha256) are as they are now, ``signatures`` (job_id,
    manifest_sha256) as they were made. The tree itself is not needed. A file without proof is not valid.
    """
    hashed = proofs.withColumn("hash", _hash(F.col("kind"), F.col("entries")))
    way = Window.partitionBy("job_id", "relative_path").orderBy("depth")
    below = F.concat(F.lead("digits").over(way), F.lit(":"), F.lead("hash").over(way))
    now = files.select("job_id", "relative_path", _entry().alias("entry"))
    steps = hashed.withColumn("below", below).join(now, ["job_id", "relative_path"])
    leaf = F.col("below").isNull()
    holds = F.array_contains("entries", F.coalesce("below", "entry")) & (F.col("kind") == F.when(leaf, "leaf").otherwise("node"))
    told = steps.groupBy("job_id", "relative_path").agg(
        F.bool_and(holds).alias("holds"), F.max(F.when(F.col("depth") == 0, F.col("hash"))).alias("root"),
        (F.max("depth") + 1 == F.count("*")).alias("whole"))
    told = told.join(signatures, "job_id", "left").select(
        "job_id", "relative_path", (F.col("holds") & F.col("whole") & (F.col("root") == F.col("manifest_sha256"))).alias("ok"))
    return files.select("job_id", "relative_path").distinct().join(told, ["job_id", "relative_path"], "left").select(
        "job_id", "relative_path", F.coalesce("ok", F.lit(False)).alias("valid"))


def changed_branches(before: DataFrame, after: DataFrame) -> DataFrame:
    """(job_id, prefix, change) of the branches, by the leaf nodes of either tree, in which two trees differ.

    ``change`` is changed, added or removed. Files whose path's hash begins with a prefix are the
    ones to look at; all others are as they were.
    """
    leaves = lambda nodes: nodes.filter("kind = 'leaf'").select("job_id", "prefix", "hash")
    was, now = leaves(before), leaves(after).withColumnRenamed("hash", "hash2")
    change = F.when(F.col("hash").isNull(), "added").when(F.col("hash2").isNull(), "removed").otherwise("changed")
    both = was.join(now, ["job_id", "prefix"], "full").filter(~F.col("hash").eqNullSafe(F.col("hash2")))
    return both.select("job_id", "prefix", change.alias("change"))


def files_below(manifest: DataFrame, branches: DataFrame) -> DataFrame:
    """The manifest rows that lie in branches (job_id, prefix)."""
    few = branches.select("job_id", F.length("prefix").alias("n")).distinct()
    named = manifest.withColumn("_name", _name(F.col("relative_path")))
    placed = named.join(few, "job_id").withColumn("prefix", F.expr("left(_name, n)"))
    return placed.join(branches.select("job_id", "prefix").distinct(), ["job_id", "prefix"], "left_semi").select(*manifest.columns)
