"""Filter interaction audit: what each filter removes, under every order of the filters.

A document is a mask of the filters it fails. Orders are ranked lexicographically (by their Lehmer
codes), so all orders that begin alike are an interval of ranks. A mask is removed at a step by exactly
the orders that begin with filters it passes and then one it fails: intervals again. Counts are
added where these begin, taken off where they end, and prefix sums over the ranks give every
order's counts. Nothing is evaluated order by order.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.llm.common import WORD, Scratch, table

#: The filters' letters; filter number i is bit i of a mask.
LETTERS = "ABCDE"
#: A: fewer words than this. B: fewer distinct words than this percentage. C: more capitals than this one.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SYMBOLS = r"[#$%&*|]"


def first_rank(begins: tuple[int, ...], n: int) -> int:
    """Rank of the first order of n filters that begins so: its Lehmer code, weighed by factorials."""
    smaller_left = [sum(x < f for x in range(n) if x not in begins[:i]) for i, f in enumerate(begins)]
    return sum(code * factorial(n - 1 - i) for i, code in enumerate(smaller_left))


def intervals(n: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) of the orders that remove a mask at a step."""
    out = []
    for mask in range(1, 1 << n):
        passes = [f for f in range(n) if not mask >> f & 1]
        fails = [f for f in range(n) if mask >> f & 1]
        for before in range(len(passes) + 1):
            for begins in permutations(passes, before):
                for f in fails:
                    start = first_rank((*begins, f), n)
                    out.append((mask, before + 1, start, start + factorial(n - before - 1)))
    return out


def audit(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Counts for each part, order of the filters and step, from masks (part, mask, n, good, toxic).

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley; kept counts after the step, removed at it, redundant what fails its filter but went earlier,
    and shapley is what the step's filter removes summed over all orders. Several rows of a part
    and mask add up. Each part that occurs has all its rows; an empty table has none. A part's
    rows are summed to one per mask before anything is expanded.
    """
    spark, n = masks.sparkSession, len(letters)
    orders = ["".join(p) for p in permutations(letters)]
    cells = masks.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    # One row per interval: a few hundred for five filters, whatever the data.
    spans = F.broadcast(spark.createDataFrame(intervals(n), "mask int, step int, start int, stop int"))
    counts = ("n", "good", "toxic")
    hits = cells.join(spans, "mask")
    ends = hits.select("part", "step", F.explode(F.array(
        F.struct(F.col("start").alias("rank"), *counts),
        F.struct(F.col("stop").alias("rank"), *[(-F.col(c)).alias(c) for c in counts]))).alias("end"))
    ends = ends.select("part", "step", "end.*")
    bits = {i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0 for i in range(n)}
    whole = cells.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.array(*[F.sum(F.when(bits[i], F.col("n")).otherwise(0)) for i in range(n)]).alias("fails"),
        F.array(*[F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(n)]).alias("only"))
    zero = F.lit(0).cast("bigint")
    grid = whole.select("part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    grid = grid.select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("rank"),
                       *[zero.alias(c) for c in counts])
    changes = grid.unionByName(ends).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in counts])
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sums = changes.withColumns({c: F.sum(c).over(along) for c in counts}).filter(F.col("rank") < len(orders))
    order = F.element_at(F.array(*[F.lit(o) for o in orders]), F.col("rank") + 1)
    sums = sums.withColumn("filter_order", order).withColumn("letter", F.expr("substring(filter_order, step, 1)"))
    down = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumns({
        "gone": F.sum("n").over(down), "shapley": F.sum("n").over(Window.partitionBy("part", "letter"))})
    place = F.instr(F.lit(letters), F.col("letter"))
    return sums.join(whole, "part").select(
        "part", "filter_order", "step", (F.col("total") - F.col("gone")).alias("kept"), F.col("n").alias("removed"),
        (F.element_at("fails", place) - F.col("n")).alias("redundant"), F.element_at("only", place).alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")


def _conditions(text: Column) -> Column:
    """Mask of the filters A to D; both counts of words come from one pass over the text."""
    words = F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), lambda w: F.struct(
        F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("bigint")
    fails = (
        words["all"] < LEAST_WORDS,
        F.lit(100) * words["distinct"].cast("bigint") < F.lit(LEAST_DISTINCT) * words["all"].cast("bigint"),
        F.lit(100) * capitals > F.lit(MOST_CAPITALS) * F.length(text).cast("bigint"),
        F.regexp(text, F.lit(SYMBOLS)),
    )
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))


def document_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """masks for ``audit`` of docs (doc_id, text, lang) and labels (doc_id, quality, toxic).

    Part is lang, NULL the empty string; a NULL text is empty. E fails where another row with a smaller
    doc_id has the same text; rows without doc_id neither fail E nor make others fail it. Repeated
    rows count each. Of several labels of a document, any of quality 1 or toxic 1 decides; labels that
    are NULL, or of no document, count nothing. Other columns are ignored. Texts are read whole, once;
    from then on there are digests. No step needs the copies of one text together: their smallest
    doc_id is a sum that forms before the shuffle, and the join is by doc_id as well as digest.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    text = F.coalesce("text", F.lit(""))
    rows = scratch.keep(docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"),
        _conditions(text).alias("mask")), "rows")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL")
    told = labels.groupBy("doc_id").agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("bigint"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("bigint"), F.lit(0))).alias("toxic"))
    told = told.filter("doc_id IS NOT NULL AND good + toxic > 0")
    # Repeated rows become one before they meet their labels.
    rows = rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    dated = rows.filter("doc_id IS NOT NULL").join(firsts.withColumn("first", F.lit(True)), ["doc_id", "digest"], "left")
    dated = dated.join(told, "doc_id", "left").select(
        "part", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + 16).alias("mask"), "n",
        *[(F.coalesce(c, F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic")])
    zero = F.lit(0).cast("bigint")
    return dated.unionByName(rows.filter("doc_id IS NULL").select("part", "mask", "n", zero.alias("good"), zero.alias("toxic")))


def query(spark, folder: str) -> DataFrame:
    return audit(document_masks(table(spark, folder, "documents"), table(spark, folder, "labels")))


#: Every order is walked filter by filter here, without ranks or intervals.
SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
told AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
         FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (CASE WHEN len(words) < 100 THEN 'A' ELSE '' END)
         || (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
  FROM docs LEFT JOIN told USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
met AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, n, good, toxic,
         contains(fails, substr(filter_order, step, 1)) AS failing, length(fails) = 1 AS single,
         length(translate(substr(filter_order, 1, step - 1), fails, '')) < step - 1 AS gone
  FROM cells, steps),
counted AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, letter,
         CAST(coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (gone AND failing), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (failing AND single), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (NOT gone AND failing), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (NOT gone AND failing), 0) AS BIGINT) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted
"""
