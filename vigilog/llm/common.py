"""Helpers shared by the operators: the shared work folder, written tables, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.session import shared_folder, ship_code

#: A word is a run of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Scratch:
    """Tables of one run, written to the shared folder, so that lost executors lose nothing.

    ``keep`` writes a table and reads it back; ``drop`` deletes one that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship_code(spark)  # the operators' Python functions import this package
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._count = 0

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._scratch_path = path  # keeps id() from being reused while the table is in use
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(self._paths.pop(id(df)))
            path.getFileSystem(conf).delete(path, True)


def same(a: Column | str, b: Column | str) -> Column:
    """Equal, with NULL equal to NULL."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a.eqNullSafe(b)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node of edges (a, b): the smallest node that links reach.

    Labels spread to neighbours and then jump to the label's own label, so rounds grow with the
    logarithm of the longest chain. Each round is a written table. Minima are taken before the
    shuffle; a hub's rows are the large side of a join with one row, which Spark can split.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.keep(both.filter("a <> b").distinct(), "edges")
    labels = scratch.keep(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        .select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        )
        step = labels.join(near, "node", "left").select(
            "node", F.col("label").alias("was"), F.least("label", "other").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = scratch.keep(
            step.join(jump, "label", "left")
            .select("node", "was", F.least("label", "root").alias("label")), "labels")
        scratch.drop(labels)
        labels = new
        if labels.filter("was <> label").isEmpty():
            scratch.drop(both)
            return labels.select("node", F.col("label").alias("component"))
