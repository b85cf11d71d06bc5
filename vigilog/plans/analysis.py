"""The whole analysis of an evidence tree, from raw files to findings and correlations."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from vigilog.operators import findings as fnd
from vigilog.operators.correlate import correlate
from vigilog.operators.coverage import coverage
from vigilog.operators.detect import detect, search_rules
from vigilog.operators.normalize import format_of_heads, normalize
from vigilog.operators.timeline import timeline, top_events
from vigilog.operators.years import syslog_years, with_years
from vigilog.session import configure, discard_stored, stored, stored_so_far
from vigilog.sources.evidence import read_job_json
from vigilog.sources.files import read_heads, read_lines
from vigilog.sources.rules import RuleSet
from vigilog.sources.sinks import read_log_table, write_logs

JOB = ("job_id",)


@dataclass
class Analysis:
    logs: DataFrame
    matches: DataFrame
    findings: DataFrame
    risk: DataFrame
    priorities: DataFrame
    coverage: DataFrame
    timeline: DataFrame
    top_events: DataFrame
    correlations: dict[str, DataFrame]
    first_stored: int = 0
    #: Files that could not be read to their end: path, error, bytes_read. NULL without an evidence tree.
    broken: DataFrame | None = None

    def close(self) -> None:
        """Delete the intermediate tables, once all results that are wanted have been written."""
        discard_stored(self.logs.sparkSession, self.first_stored)


def find_matches(
    logs: DataFrame, rules: RuleSet, keys: tuple = JOB, *, compat: bool = False,
    sequence_key: str | None = None,
) -> DataFrame:
    """Matches of all rules, stored. The logs are searched once; hits are few and are kept."""
    hits = stored(search_rules(logs, rules, compat=compat))
    # No more pairs than patterns. Stages for kinds of rules without any hit are then not planned.
    pairs = hits.select("rule_path", "pattern_idx").distinct().collect()
    left = rules.with_hits({(row.rule_path, row.pattern_idx) for row in pairs}, compat)
    matches = detect(hits, left, keys, sequence_key=sequence_key, compat=compat)
    return stored(matches) if left.active("threshold", "sequence") else matches


def analyse(
    spark: SparkSession, root: str, rules: RuleSet, log_table: str, *,
    keys: tuple = JOB, compat: bool = False, reference_ts: datetime | None = None, scan_years: bool = False,
) -> Analysis:
    """Parse the files below ``root`` into the Parquet table ``log_table``, then work on that.

    ``scan_years`` reads syslog files once more before, for logs that span several years.

    What can be read of a broken file takes part, and ``broken`` of the result names it. A tree
    without files has an analysis without rows.
    """
    configure(spark)
    before = stored_so_far()
    heads = read_heads(spark, f"{root}/*/01_evidence/raw/logs")
    lines = read_lines(spark, stored(format_of_heads(heads).drop("error")))
    rows = lines.rows
    if scan_years and "syslog" in lines.kinds:
        rows = with_years(rows, stored(syslog_years(rows, reference_ts)))
    # The plan then holds the parsers that are needed.
    parsed = normalize(rows, kinds=lines.kinds, compat=compat, reference_ts=reference_ts)
    write_logs(parsed, log_table, mode="overwrite")
    result = analyse_logs(
        read_log_table(spark, log_table), rules, read_job_json(spark, root, "services"),
        keys=keys, compat=compat,
    )
    result.broken, result.first_stored = lines.broken(), before
    return result


def analyse_logs(
    logs: DataFrame, rules: RuleSet, inventories: DataFrame, *, keys: tuple = JOB,
    compat: bool = False,
) -> Analysis:
    before = stored_so_far()
    matches = find_matches(logs, rules, keys, compat=compat)
    found = stored(fnd.build_findings(matches, rules, keys))
    paths = rules.dataframe(logs.sparkSession).select("rule_path")
    return Analysis(
        logs=logs,
        matches=matches,
        findings=fnd.order_findings(found),
        risk=fnd.risk(found, keys),
        priorities=fnd.prioritise(found, keys),
        coverage=coverage(inventories, paths, rules),
        timeline=timeline(logs, compat=compat),
        top_events=top_events(logs, compat=compat),
        correlations=correlate(logs, keys),
        first_stored=before,
    )
