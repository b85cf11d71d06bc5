"""Unified timeline, its most severe events, log statistics, time window and per-source cap."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.functions import lookups as L
from vigilog.functions.text import base_name, iso_time, lookup
from vigilog.session import stored

#: Lines in a block of a source, as many as Spark's bitmaps have bits.
CAP_BLOCK = 32_768
#: Cuts that are broadcast at most, a path and a number each.
MOST_CUTS = 200_000


def _order(compat: bool = False) -> list:
    # The reference point for undated rows is 1970 in compat mode, the end of time otherwise.
    ts = F.col("ts").asc_nulls_first() if compat else F.col("ts").asc_nulls_last()
    return [ts, F.asc("source_file"), F.asc("line_no")]


def timeline(logs: DataFrame, *, compat: bool = False) -> DataFrame:
    """All rows in time order, by a range-partitioned sort: no task sees more than its range."""
    lifted = lambda name: F.coalesce(F.try_element_at("extracted", F.lit(name)), F.lit("")).alias(name)
    # Cut to what stays before the sort; the order's own columns go along and are dropped after it.
    rows = logs.select(
        F.col("ts"), F.col("source_file").alias("_path"), "line_no",
        "timestamp", "ts_epoch", "hostname", "service", "pid", "level",
        lifted("src_ip"), lifted("user"),
        F.left(F.coalesce(F.try_element_at("extracted", F.lit("uri")), F.lit("")), F.lit(L.LIMITS["timeline_uri"])).alias("uri"),
        lifted("http_status"),
        F.left("message", F.lit(L.LIMITS["timeline_message"])).alias("message"),
        base_name(F.col("source_file")).alias("source_file"),
    )
    ts, _, line_no = _order(compat)
    return rows.orderBy(ts, F.asc("_path"), line_no).drop("ts", "_path", "line_no")


def top_events(logs: DataFrame, limit: int = 50, *, compat: bool = False) -> DataFrame:
    """The first events of level warn or worse; ``compat`` keeps at most 100 for any limit."""
    rank = F.coalesce(lookup(L.LEVEL_RANKS, F.col("level")), F.lit(L.UNKNOWN_LEVEL_RANK))
    rows = (
        logs.filter(rank <= L.TOP_EVENT_MAX_RANK)
        .orderBy(*_order(compat))
        .limit(min(limit, L.TOP_EVENT_POOL) if compat else limit)
    )
    field = lambda name: F.coalesce(F.try_element_at("extracted", F.lit(name)), F.lit("")).alias(name)
    return rows.select(
        F.coalesce("timestamp", F.lit("N/A")).alias("timestamp"), "service", "level",
        F.left("message", F.lit(L.LIMITS["top_event_message"])).alias("message"),
        field("src_ip"), field("user"),
    )


def log_stats(parsed: DataFrame) -> DataFrame:
    """Counts by source, service and level and in total, in one pass over ``parse_lines``.

    (dimension, value, entries, parse_errors, earliest, latest); lines that do not parse count as
    errors only.
    """
    good = ~F.col("parse_error")
    rows = parsed.select(
        base_name(F.col("source_file")).alias("source"),
        F.when(good, F.col("service")).alias("service"), F.when(good, F.col("level")).alias("level"),
        "ts", "parse_error",
    )
    sets = [[F.col("source")], [F.col("service")], [F.col("level")], []]
    grouped = rows.groupingSets(sets, "source", "service", "level").agg(
        F.count_if(~F.col("parse_error")).alias("entries"),
        F.count_if("parse_error").alias("parse_errors"),
        F.min("ts").alias("earliest"), F.max("ts").alias("latest"),
        F.grouping_id("source", "service", "level").alias("gid"),
    )
    dimension = (
        F.when(F.col("gid") == 3, "source").when(F.col("gid") == 5, "service")
        .when(F.col("gid") == 6, "level").otherwise("total")
    )
    return grouped.filter((F.col("entries") > 0) | F.col("gid").isin(3, 7)).select(
        dimension.alias("dimension"),
        F.coalesce("source", "service", "level", F.lit("")).alias("value"),
        "entries", "parse_errors",
        iso_time(F.col("earliest")).alias("earliest"), iso_time(F.col("latest")).alias("latest"),
    )


def filter_window(
    logs: DataFrame, hours: int = L.DEFAULT_WINDOW_HOURS, reference_ts: datetime | None = None,
    undated: bool = False,
) -> DataFrame:
    """Only the last hours before the reference time: a plain comparison, which reaches the scan.

    Undated rows are left out unless ``undated`` asks for them. A table stored by day (``dt``) is read
    from the first day of the window on, with the folder of undated rows if they are wanted.
    """
    ref = F.lit(reference_ts).cast("timestamp") if reference_ts else F.current_timestamp()
    first = ref - F.make_interval(hours=F.lit(hours))
    wanted = F.col("ts") >= first
    if "dt" in logs.columns:
        wanted = wanted & (F.col("dt") >= F.to_date(first))
        return logs.filter(wanted | F.col("dt").isNull()) if undated else logs.filter(wanted)
    return logs.filter(wanted | F.col("ts").isNull()) if undated else logs.filter(wanted)


def cap_per_source(
    df: DataFrame, n: int = L.MAX_LINES_PER_SOURCE, which: str = "last",
    source: str = "source_file",
) -> DataFrame:
    """The last (or first) n line numbers of each source; rows that repeat a number stay together.

    Only numbers are shuffled: each block of them is a bitmap, a bit per line, that combines before
    the shuffle. Sources with more than n lines get the number of their cut, and the rows are
    filtered by it where they are. The cuts are broadcast if there are at most ``MOST_CUTS`` of them;
    beyond that Spark joins as it sees fit.
    """
    if which not in ("first", "last"):
        raise ValueError("which is 'first' or 'last'")
    cuts = stored(source_cuts(df, n, which, source))
    cuts = F.broadcast(cuts) if cuts.count() <= MOST_CUTS else cuts
    outside = F.col("line_no") < F.col("_cut") if which == "last" else F.col("line_no") > F.col("_cut")
    rows = df.join(cuts.withColumnRenamed(source, "_of"), F.col(source).eqNullSafe(F.col("_of")), "left")
    return rows.filter(~F.coalesce(outside, F.lit(False))).select(*df.columns)


def source_cuts(df: DataFrame, n: int, which: str = "last", source: str = "source_file") -> DataFrame:
    """(source, _cut): the outermost line number that stays, of each source with more than n of them."""
    nearest = F.desc if which == "last" else F.asc
    blocks = (
        df.filter("line_no IS NOT NULL")
        .groupBy(source, F.expr(f"line_no div {CAP_BLOCK}").alias("_block"))
        .agg(F.bitmap_construct_agg(F.expr(f"line_no % {CAP_BLOCK}")).alias("_lines"))
        .withColumn("_size", F.bitmap_count("_lines"))
    )
    before = Window.partitionBy(source).orderBy(nearest("_block")).rowsBetween(Window.unboundedPreceding, -1)
    # The block of the cut: so many of its lines stay, and not all.
    edges = blocks.select(
        source, "_block", "_size", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(Window.partitionBy(source)).alias("_all"), "_lines",
    ).filter((F.col("_all") > n) & (F.col("_before") < n) & (F.col("_before") + F.col("_size") >= n))
    nth = F.lit(n) - F.col("_before") if which == "first" else F.col("_size") - (n - F.col("_before")) + 1
    return edges.select(source, (F.col("_block") * CAP_BLOCK + _nth_bit(F.col("_lines"), nth)).alias("_cut"))


def _nth_bit(bits: Column, nth: Column) -> Column:
    """Position of the nth bit set in a bitmap."""
    def byte(i):
        return F.conv(F.hex(F.substr(bits, i + 1, F.lit(1))), 16, 10).cast("int")

    state = "struct<left:bigint,at:int>"
    start = F.struct(nth.cast("bigint").alias("left"), F.lit(-1).alias("at")).cast(state)

    def step(s, i):
        here = F.bit_count(byte(i))
        return F.when((s["at"] >= 0), s).when(s["left"] > here, F.struct((s["left"] - here).alias("left"), s["at"].alias("at"))).otherwise(
            F.struct(s["left"].alias("left"), i.alias("at"))).cast(state)

    found = F.aggregate(F.sequence(F.lit(0), F.lit(CAP_BLOCK // 8 - 1)), start, step)
    ones = lambda f: F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: byte(f["at"]).bitwiseAND(F.pow(F.lit(2), k).cast("int")) != 0)
    return F.transform(F.array(found), lambda f: f["at"] * 8 + F.element_at(ones(f), f["left"].cast("int")))[0].cast("bigint")


def dedupe(logs: DataFrame) -> DataFrame:
    """Each event once that several sources of a job carry, and every repeat that one source carries.

    Entries alike in second, host, service, process and message are copies if they stand in different
    sources. The source that has most of them keeps all of its own, and the others lose theirs; a
    journal goes before log files, then the first name. Entries are told apart by a 128-bit hash,
    and only hashes and counts are grouped. Undated rows are all kept and take no part: nothing tells a
    copy from another event. Copies on either side of a full second are two entries.
    """
    same = F.md5(F.to_json(F.struct(
        F.date_trunc("second", "ts").alias("s"), "hostname", "service", "pid", "message")))
    keyed = logs.filter("ts IS NOT NULL").withColumn("_key", same)
    counts = keyed.groupBy("job_id", "_key", "source_file").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("format") == "journal", 0).otherwise(1)).alias("kind"))
    place = F.row_number().over(Window.partitionBy("job_id", "_key").orderBy(F.desc("n"), "kind", "source_file"))
    lost = counts.withColumn("place", place).filter("place > 1").select("job_id", "_key", "source_file")
    kept = keyed.join(lost, ["job_id", "_key", "source_file"], "left_anti").select(*logs.columns)
    return kept.unionByName(logs.filter("ts IS NULL"))
