"""Years of logs whose times have none, from the order of the lines.

A file's last line is of the reference's year or the one before. Going back through the file, the year
falls wherever the date jumps from a late day to an early one. Blocks of lines are looked through on
their own; each tells the dates of its first and last line and its own jumps, and a pass over
the blocks finds the jumps between them. What comes out is a row per file.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.functions import lookups as L
from vigilog.functions import text as X

#: Line numbers that one block spans; ``files.read_lines`` numbers lines by their bytes.
BLOCK = 1 << 24
#: A line may be so many days older than the one before it, and is then late rather than of a new year.
LATE_DAYS = 7
#: A file whose year seems to change more often than this has no order of dates; it gets no row.
MOST_CHANGES = 10_000
#: Days of a year of twelve months of 31; only differences of dates are taken of it.
YEAR_DAYS = 372


def _step(before: Column, day: Column) -> Column:
    """Change of the year from one line's day to the next line's."""
    onward = F.pmod(day - before, F.lit(YEAR_DAYS))
    late = onward >= YEAR_DAYS - LATE_DAYS
    return F.when(late & (day > before), -1).when(~late & (day < before), 1).otherwise(0)


def syslog_years(lines: DataFrame, reference_ts: datetime | None = None, *, block: int = BLOCK) -> DataFrame:
    """(source_file, last_year, changes) of each syslog file in lines (source_file, line_no, value, format).

    ``changes`` holds struct<line_no, years>: at which lines the year goes up by one, or down where a
    late line of the old year follows one of the new. A silence of a year less a week between two
    lines is taken for a late line; files with more than ``MOST_CHANGES`` changes are left out. Only the number and date of each line are shuffled, by file and block.
    """
    stamp = X.fields(X.strip_cr(F.col("value")), r"^(\w{3})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})\s", 5)
    dated = lines.filter("format = 'syslog'").select("source_file", "line_no", stamp.alias("p")).filter("size(p) = 5")
    month = X.lookup(L.MONTHS, F.lower(F.get("p", F.lit(0))))
    day = (month - 1) * 31 + F.get("p", F.lit(1)).cast("int")
    clock = F.array_join(F.slice("p", 3, 3), ":")
    dated = dated.select(
        "source_file", "line_no", F.expr(f"line_no div {block}").alias("block"), day.alias("day"),
        F.concat_ws(" ", month.cast("string"), F.get("p", F.lit(1)), clock).alias("stamp"),
    ).filter("day IS NOT NULL")
    inside = Window.partitionBy("source_file", "block").orderBy("line_no")
    steps = dated.withColumn("years", F.coalesce(_step(F.lag("day").over(inside), F.col("day")), F.lit(0)))
    jump = F.when(F.col("years") != 0, F.struct("line_no", "years"))
    steps = steps.withColumn("nth", F.count(jump).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # One row per block: its ends and the few lines at which the year changes inside.
    blocks = steps.groupBy("source_file", "block").agg(
        F.min(F.struct("line_no", "day")).alias("first"), F.max(F.struct("line_no", "day", "stamp")).alias("last"),
        F.max("nth").alias("n"), F.collect_list(F.when(F.col("nth") <= MOST_CHANGES, jump)).alias("jumps"),
    )
    every = Window.partitionBy("source_file")
    between = F.coalesce(_step(F.lag("last.day").over(every.orderBy("block")), F.col("first.day")), F.lit(0))
    blocks = blocks.withColumn("entry", between).withColumn(
        "total", F.sum(F.col("n") + F.abs("entry")).over(every)).filter(F.col("total") <= MOST_CHANGES)
    entry = F.array(F.struct(F.col("first.line_no").alias("line_no"), F.col("entry").alias("years")))
    files = blocks.groupBy("source_file").agg(
        F.max("last").alias("last"),
        F.array_sort(F.flatten(F.collect_list(F.concat("jumps", F.filter(entry, lambda e: e["years"] != 0))))).alias("changes"),
    )
    return files.select("source_file", _last_year(F.split("last.stamp", " "), reference_ts).alias("last_year"), "changes")


def _last_year(stamp: Column, reference_ts: datetime | None) -> Column:
    """The reference's year, or the one before if the date would be more than a day after the reference."""
    ref = F.lit(reference_ts).cast("timestamp") if reference_ts else F.current_timestamp()
    clock = F.split(F.get(stamp, F.lit(2)), ":")
    month, day = F.get(stamp, F.lit(0)), F.get(stamp, F.lit(1))
    ordinal = month.cast("int") * 31 + day.cast("int")
    limit = F.timestamp_micros(F.unix_micros(ref) + F.lit(86_400_000_000))
    time = F.get(clock, F.lit(0)).cast("int") * 3600 + F.get(clock, F.lit(1)).cast("int") * 60 + F.get(clock, F.lit(2)).cast("int")
    of_limit = F.hour(limit) * 3600 + F.minute(limit) * 60 + F.second(limit)
    last_day = F.month(limit) * 31 + F.dayofmonth(limit)
    after = (ordinal > last_day) | ((ordinal == last_day) & (time > of_limit))
    return F.year(ref) - (after & (F.year(limit) == F.year(ref))).cast("int")


def with_years(lines: DataFrame, years: DataFrame) -> DataFrame:
    """The lines with their ``year``, NULL for files that ``years`` has no row of; for ``normalize``.

    One row per file meets its lines; Spark sends them along if they are small.
    """
    later = F.filter("changes", lambda c: c["line_no"] > F.col("line_no"))
    passed = F.aggregate(later, F.lit(0), lambda total, c: total + c["years"])
    joined = lines.join(years.select("source_file", "last_year", "changes"), "source_file", "left")
    return joined.withColumn("year", F.col("last_year") - passed).drop("last_year", "changes")
