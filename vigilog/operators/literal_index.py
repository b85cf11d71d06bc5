"""An index of the log table's files by the trigrams they hold, so that searches open only some.

For each file there is a bitmap of hashed trigrams of its messages, digits taken as alike. A pattern
names literals that every match must contain; a file that lacks a trigram of each of them cannot
match. Nothing else is decided here: the files that stay are searched as ever. Files without an
entry, written since, are always opened.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog import schema
from vigilog.functions import regex as R
from vigilog.functions.regex import Pattern
from vigilog.operators.detect import search_rules
from vigilog.sources.files import escaped, list_files
from vigilog.sources.rules import Rule, RuleSet
from vigilog.sources.sinks import read_log_table

#: Trigrams are hashed to so many bits, in maps of the size that Spark's bitmap functions have.
MAPS, MAP_BITS = 8, 32_768
INDEX = "file string, map int, bits binary"
#: So many names at most go through the driver; if more files stay, the table is read whole.
MOST_FILES = 100_000


def _trigrams(text: Column) -> Column:
    """Bit numbers of all trigrams of a lower-case text."""
    masked = F.translate(text, "123456789", "0" * 9)
    found = F.array_distinct(F.regexp_extract_all(masked, F.lit("(?s)(?=(...))"), F.lit(1)))
    return F.transform(found, lambda t: F.pmod(F.xxhash64(t), F.lit(MAPS * MAP_BITS)).cast("int"))


def build_index(spark: SparkSession, log_table: str, index: str) -> None:
    """Add entries for those files of the log table that the index at ``index`` does not have yet.

    Each row's trigrams combine to one bitmap per file and map before the shuffle.
    """
    line = F.when(F.col("format") == "access", F.col("raw"))
    logs = read_log_table(spark, log_table).select(
        F.col("_metadata.file_path").alias("file"), F.concat_ws("\n", "message", line).alias("_both"))
    known = read_index(spark, index)
    if known is not None:
        logs = logs.join(known.select("file").distinct(), "file", "left_anti")
    bits = logs.select("file", F.explode_outer(_trigrams(F.expr(R.prefilter_text("_both")))).alias("bit"))
    maps = bits.groupBy("file", (F.expr(f"bit div {MAP_BITS}").cast("int")).alias("map")).agg(
        F.bitmap_construct_agg(F.col("bit") % MAP_BITS).alias("bits"))
    maps.write.mode("append").option("compression", "zstd").parquet(index)


def read_index(spark: SparkSession, index: str) -> DataFrame | None:
    return spark.read.schema(INDEX).parquet(index) if not list_files(spark, index).isEmpty() else None


def _needs(patterns: list[Pattern]) -> list[list[list[str]]]:
    """For each pattern its clauses of literals that have trigrams; a literal without makes a clause void."""
    return [[list(c) for c in p.required if all(len(lit) >= 3 for lit in c)] for p in patterns]


def _searched(rule: Rule, compat: bool) -> list[Pattern]:
    return list(rule.used_steps(compat)) if rule.type == "sequence" else list(rule.patterns)


def split_rules(rules: RuleSet, compat: bool = False) -> tuple[RuleSet, RuleSet]:
    """(rules all of whose patterns name literals, the others)."""
    named = [r for r in rules.active() if all(_needs(_searched(r, compat)))]
    others = [r for r in rules.active() if r not in named]
    return RuleSet(named, rules.errors, rules.compat), RuleSet(others, rules.errors, rules.compat)


def possible_files(spark: SparkSession, log_table: str, index: str, rules: RuleSet, compat: bool = False) -> DataFrame:
    """(path) of the table's files that may hold a match of any of the rules, all of which name literals."""
    listed = list_files(spark, log_table).filter(F.endswith("path", F.lit(".parquet")))
    known = read_index(spark, index)
    if known is None:
        return listed.select("path")
    needs = [n for rule in rules.active() for n in _needs(_searched(rule, compat))]
    literals = sorted({lit for clauses in needs for c in clauses for lit in c})
    number = {lit: i for i, lit in enumerate(literals)}
    # The literals' bits, by the same hash; there are as many as rules name.
    rows = spark.createDataFrame([(i, lit) for i, lit in enumerate(literals)], "id int, literal string")
    bits = {r.id: r.bits for r in rows.select("id", _trigrams(F.col("literal")).alias("bits")).collect()}
    wanted = F.from_json(F.lit(json.dumps([{"id": i, "bits": bits[i]} for i in range(len(literals))])),
                         F.lit("array<struct<id:int,bits:array<int>>>"))
    clauses = F.from_json(F.lit(json.dumps([[[number[lit] for lit in c] for c in n] for n in needs])),
                          F.lit("array<array<array<int>>>"))
    maps = known.groupBy("file").agg(F.map_from_entries(F.collect_list(
        F.when(F.col("map").isNotNull(), F.struct("map", "bits")))).alias("maps"))  # MAPS of them at most

    def has(bit):
        held = F.try_element_at("maps", F.floor(bit / MAP_BITS).cast("int"))
        byte = F.substr(held, F.floor(bit % MAP_BITS / 8).cast("int") + 1, F.lit(1))
        return F.coalesce(F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0, F.lit(False))

    present = F.transform(F.filter(wanted, lambda w: F.forall(w["bits"], has)), lambda w: w["id"])
    judged = maps.select("file", present.alias("present")).select(
        F.col("file").alias("uri"),
        F.exists(clauses, lambda n: F.forall(n, lambda c: F.arrays_overlap(c, F.col("present")))).alias("possible"))
    return listed.join(judged, "uri", "left").filter(F.coalesce("possible", F.lit(True))).select("path")


def read_possible(spark: SparkSession, log_table: str, files: DataFrame) -> DataFrame:
    """The log table's rows in files (path) alone."""
    names = [row.path for row in files.limit(MOST_FILES + 1).collect()]
    if len(names) > MOST_FILES:
        return read_log_table(spark, log_table)
    if not names:
        return spark.createDataFrame([], f"{schema.LOG}, dt date")
    return spark.read.schema(f"{schema.LOG}, dt date").option("basePath", log_table).parquet(*map(escaped, names))


def search_table(spark: SparkSession, log_table: str, index: str, rules: RuleSet, *, compat: bool = False, **options) -> DataFrame:
    """``search_rules`` over the log table, with rules that name literals tried on their possible files only.

    Rules without literals are tried on all files.
    """
    named, others = split_rules(rules, compat)
    found = []
    if named.rules:
        logs = read_possible(spark, log_table, possible_files(spark, log_table, index, named, compat))
        found.append(search_rules(logs, named, compat=compat, **options))
    if others.rules or not found:
        found.append(search_rules(read_log_table(spark, log_table), others, compat=compat, **options))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])
