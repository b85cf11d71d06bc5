"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilog.llm.common import WORD, Scratch, same, table

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: No source, and so no document, is taken more often than this.
MAX_REPEATS = 3
#: Shuffled documents of a source are summed in this many ranges before one range is walked.
RANGES = 4096
#: Cells per unit of virtual time, in two steps, for finding the cut without one sorted task.
CELLS = (1 << 10, 1 << 20)


def source_targets(sized: DataFrame, weights=WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, rank, target): one row per source.

    Targets share the sum of all sizes by weight. None exceeds ``repeats`` times its source; what
    is above goes to the others by weight. With sources in order of size / weight, the first whose
    limit is not below the level of those that remain fixes the level of all others.
    The windows run over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(by_name))
    cycle = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, (F.col("rank") - 1) % len(weights) + 1).cast("bigint"))
    limit = F.col("source_size") * repeats
    per = per.withColumn("level_at", limit / F.col("weight"))
    ordered = Window.orderBy("level_at", "rank")
    up_to = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    per = per.withColumn("level", (
        F.sum("source_size").over(everything) - (F.sum(limit).over(up_to) - limit)
    ) / (F.sum("weight").over(everything) - (F.sum("weight").over(up_to) - F.col("weight"))))
    first = F.when(F.col("level_at") >= F.col("level"), F.struct("level_at", "rank", "level"))
    per = per.withColumn("level", F.min(first).over(everything)["level"])
    target = F.when(F.col("level_at") < F.col("level"), limit.cast("double")).otherwise(F.col("level") * F.col("weight"))
    return per.select("source", "source_size", "weight", "rank", target.alias("target"))


def mix(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """Each row of docs (doc_id, text, source) with size, source_size, target and taken.

    A source's documents are shuffled by a hash of seed and doc_id and lined up up to ``repeats``
    times. A copy's virtual finish time is the words of its source up to and with it, divided by
    the source's target. Copies of all sources are taken in order of finish time until their words
    reach the sum of all sizes. ``taken`` is the words of a document's taken copies together.

    A NULL source is a source of its own, last in order. A document without words has size 0 and
    takes 0. A NULL doc_id is hashed as the empty text. Rows that repeat are documents of their
    own; rows alike in doc_id and size may swap places, which no result shows. An empty table gives
    no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    sized = scratch.keep(docs.select(
        "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("turn"),
    ), "sized")
    sources = scratch.keep(source_targets(sized, weights, repeats), "sources")

    # Running sums of a source in two steps, so that a hot source is spread over its ranges.
    cell = (F.conv(F.substring("turn", 1, 3), 16, 10).cast("int") % RANGES).alias("cell")
    placed = sized.select("*", cell)
    sums = placed.groupBy("source", "cell").agg(F.sum("size").alias("in_cell"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("cell").alias("c"),
                       F.coalesce(F.sum("in_cell").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "cell").orderBy("turn", F.col("doc_id").asc_nulls_first(), "size")
    within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    queue = placed.select("*", F.sum("size").over(within).alias("inside"))
    queue = queue.join(sums, same("source", "s") & (F.col("cell") == F.col("c")))
    info = sources.select(F.col("source").alias("s"), "source_size", "rank", "target")
    queue = queue.drop("s", "c").join(info, same("source", "s")).select(
        "doc_id", "size", "turn", "rank", "source_size", "target", (F.col("before") + F.col("inside")).alias("upto"))
    queue = scratch.keep(queue, "queue")

    def finish(turn_no):
        return (F.col("source_size") * turn_no + F.col("upto")).cast("double") / F.col("target")

    def key(turn_no):
        return F.struct(finish(turn_no).alias("finish"), F.col("rank"), F.col("turn"),
                        F.col("doc_id"), F.col("size"), turn_no.cast("int").alias("copy"))

    copies = queue.filter("size > 0").withColumn(
        "copy", F.explode(F.array(*[F.lit(i) for i in range(repeats)]))
    ).select("size", key(F.col("copy")).alias("key"))
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    last = _cut(copies, budget)
    taken = F.lit(0).cast("bigint")
    if last is not None:
        at = F.struct(F.lit(last.finish), F.lit(last.rank), F.lit(last.turn), F.lit(last.doc_id).cast(docs.schema["doc_id"].dataType),
                      F.lit(last.size).cast("bigint"), F.lit(last.copy))
        for i in range(repeats):
            taken = taken + F.when((F.col("size") > 0) & (key(F.lit(i)) <= at), F.col("size")).otherwise(F.lit(0))
    scratch.drop(sized)
    return queue.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def _cut(copies: DataFrame, budget: int):
    """The key of the last copy that the budget takes; None if it takes none.

    Sums per cell of virtual time narrow the range twice; only one small cell is sorted by itself.
    """
    spent, inside = 0, copies
    for cells in CELLS:
        cell = F.floor(F.col("key.finish") * cells)
        per = inside.groupBy(cell.alias("cell")).agg(F.sum("size").alias("words"))
        running = per.select("cell", "words", F.sum("words").over(Window.orderBy("cell")).alias("upto"))
        hit = running.filter(F.col("upto") > budget - spent).orderBy("cell").first()
        if hit is None:
            break  # the budget reaches beyond the last copy of this range
        spent += hit.upto - hit.words
        inside = inside.filter(cell == hit.cell)
    walk = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if hit is None:
        found = copies.agg(F.max("key").alias("key")).first()
        return found and found.key
    found = inside.select("key", F.sum("size").over(walk).alias("upto")).filter(
        F.col("upto") <= budget - spent).agg(F.max("key").alias("key")).first().key
    if found is None:  # the cell's first copy is already beyond: the cut is just before the cell
        found = copies.filter(F.floor(F.col("key.finish") * CELLS[-1]) < hit.cell).agg(F.max("key").alias("key")).first().key
    return found


def query(spark, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS turn FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM sized GROUP BY source),
weighed AS (SELECT *, (rank - 1) % 3 + 1 AS weight, source_size * 3 / CAST((rank - 1) % 3 + 1 AS DOUBLE) AS level_at FROM per),
levels AS (
  SELECT *, (SELECT sum(source_size) - coalesce((SELECT sum(x.source_size * 3) FROM weighed x
               WHERE (x.level_at, x.rank) < (w.level_at, w.rank)), 0) FROM weighed)
          / CAST((SELECT sum(y.weight) FROM weighed y WHERE (y.level_at, y.rank) >= (w.level_at, w.rank)) AS DOUBLE) AS own
  FROM weighed w),
final AS (SELECT *, (SELECT max(own) FROM levels) AS level FROM levels),
targets AS (
  SELECT source, rank, source_size,
         CASE WHEN level_at < level THEN CAST(source_size * 3 AS DOUBLE) ELSE level * weight END AS target
  FROM final),
queue AS (
  SELECT d.doc_id, d.size, d.turn, t.rank, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.turn, d.doc_id NULLS FIRST, d.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         row_number() OVER () AS row_id
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, CAST(source_size * copy + upto AS DOUBLE) / target AS finish
  FROM queue, (SELECT unnest([0, 1, 2]) AS copy) WHERE size > 0),
walked AS (
  SELECT row_id, size, sum(size) OVER (ORDER BY finish, rank, turn, doc_id NULLS FIRST, size, copy
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS words
  FROM copies),
won AS (SELECT row_id, sum(size) AS taken FROM walked WHERE words <= (SELECT sum(size) FROM sized) GROUP BY row_id)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM queue LEFT JOIN won USING (row_id)
"""
