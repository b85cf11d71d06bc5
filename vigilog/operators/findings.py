"""Matches to findings, and what is derived from findings: risk, priorities, remediation, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.functions import lookups as L
from vigilog.functions.text import lookup
from vigilog.sources.rules import RuleSet

JOB = ("job_id",)


def _order() -> Column:
    """Total order of log rows; undated ones last."""
    return F.struct(
        F.col("ts").isNull().alias("undated"), F.col("ts"), F.col("source_file"), F.col("line_no")
    )


def finding_status(confidence: Column, count: Column) -> Column:
    return (
        F.when((confidence == "high") & (count >= 3), "confirmed")
        .when(confidence.isin("high", "medium") & (count >= 1), "highly_probable")
        .when(confidence == "medium", "suspicious")
        .otherwise("insufficient_evidence")
    )


def severity_rank(severity: Column) -> Column:
    return F.coalesce(lookup(L.SEVERITY_RANKS, severity), F.lit(99))


def _total(weights: str) -> Column:
    """Sum of weights; what exceeds a long is given as the largest one."""
    return F.coalesce(F.try_sum(weights), F.lit(2**63 - 1))


def match_counts(matches: DataFrame, keys: tuple = JOB) -> DataFrame:
    """(keys, rule_path, match_count, first_seen, last_seen); undated matches have no say in times."""
    dated = F.when(F.col("ts").isNotNull(), F.struct("ts", "source_file", "line_no"))
    return matches.groupBy(*keys, "rule_path").agg(
        _total("weight").alias("match_count"),
        F.min_by("timestamp", dated).alias("first_seen"),
        F.max_by("timestamp", dated).alias("last_seen"),
    )


def affected_entities(
    matches: DataFrame, keys: tuple = JOB, top: int = L.ENTITY_TOP_K
) -> DataFrame:
    """(keys, rule_path, field, value, count, rank): the most frequent values per entity field.

    Counts combine before the shuffle, and the rank filter drops all but the top rows of each
    partition before the second one, so a rule with very many values stays cheap.
    """
    fields = F.array(
        *[
            F.struct(F.lit(name).alias("field"), F.try_element_at("captured", F.lit(name)).alias("value"))
            for name in L.ENTITY_FIELDS
        ]
    )
    exploded = matches.select(
        *keys, "rule_path", "weight", "ts", "source_file", "line_no", F.inline(fields)
    ).filter((F.col("value") != "") & (F.col("value") != "-"))
    counted = exploded.groupBy(*keys, "rule_path", "field", "value").agg(
        _total("weight").alias("count"), F.min(_order()).alias("_first")
    )
    by_field = Window.partitionBy(*keys, "rule_path", "field").orderBy(F.desc("count"), "_first")
    return (
        counted.withColumn("rank", F.row_number().over(by_field))
        .filter(F.col("rank") <= top)
        .drop("_first")
    )


def sample_matches(matches: DataFrame, keys: tuple = JOB, size: int = L.SAMPLE_SIZE) -> DataFrame:
    """The first matches of each rule in time order; as above, most rows never leave their task."""
    by_rule = Window.partitionBy(*keys, "rule_path").orderBy(
        F.col("ts").asc_nulls_last(), "source_file", "line_no", "pattern_idx"
    )
    return (
        matches.select(
            *keys, "rule_path", "ts", "timestamp", "service", "hostname", "source_file", "line_no",
            "pattern_idx", F.left("message", F.lit(L.LIMITS["sample_message"])).alias("message"),
            "captured",
        )
        .withColumn("rank", F.row_number().over(by_rule))
        .filter(F.col("rank") <= size)
        .drop("pattern_idx")
    )


def build_findings(matches: DataFrame, rules: RuleSet, keys: tuple = JOB) -> DataFrame:
    """One row per rule that matched (and job). Reads ``matches`` three times: pass a stored table."""
    on = [*keys, "rule_path"]
    by_field = (
        affected_entities(matches, keys)
        .groupBy(*on, "field")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "value", "count"))).alias("top"))
        .select(
            *on, "field",
            F.transform("top", lambda t: F.struct(t["value"].alias("value"), t["count"].alias("count"))).alias("top"),
        )
    )
    entities = by_field.groupBy(*on).agg(
        F.map_from_entries(F.collect_list(F.struct("field", "top"))).alias("affected_entities")
    )
    sample = F.struct("rank", "timestamp", "service", "hostname", "message", "captured")
    samples = (
        sample_matches(matches, keys)
        .groupBy(*on)
        .agg(F.collect_list(sample).alias("s"))
        .select(
            *on,
            F.transform(
                F.array_sort("s", lambda a, b: a["rank"] - b["rank"]),
                lambda s: F.struct(*[s[c].alias(c) for c in ("timestamp", "service", "hostname", "message", "captured")]),
            ).alias("sample_matches"),
        )
    )
    meta = rules.dataframe(matches.sparkSession).drop("patterns", "steps", "agg", "within_seconds", "enabled", "type")
    joined = (
        match_counts(matches, keys)
        .join(F.broadcast(meta), "rule_path")
        .join(entities, on, "left")
        .join(samples, on, "left")
    )
    status = finding_status(F.col("confidence"), F.col("match_count"))
    return joined.withColumn("status", status).withColumn(
        "status_label", lookup(L.STATUS_LABELS, F.col("status"))
    )


def order_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")), "rule_path")


def risk(findings: DataFrame, keys: tuple = JOB) -> DataFrame:
    """Findings per severity and the overall risk, the highest severity present."""
    counts = findings.groupBy(*keys).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in L.SEVERITY_RANKS]
    )
    level = F.lit("none")
    for severity in ("low", "medium", "high", "critical"):
        level = F.when(F.col(severity) > 0, severity).otherwise(level)
    return counts.withColumn("overall", level).withColumn(
        "overall_label", lookup(L.OVERALL_RISK_LABELS, F.col("overall"))
    )


def prioritise(findings: DataFrame, keys: tuple = JOB) -> DataFrame:
    """Findings numbered per job: critical and high, then medium, then low and info."""
    severity = F.col("severity")
    group = (
        F.when(severity.isin("critical", "high"), 1)
        .when(severity == "medium", 2)
        .when(severity.isin("low", "info"), 3)
    )
    reason = (
        F.when(group == 1, F.concat(F.lit("Severity and "), F.col("confidence"), F.lit(" confidence")))
        .when(group == 2, "Requires investigation")
        .otherwise("Preventive hardening")
    )
    order = Window.partitionBy(*keys).orderBy(group, severity_rank(severity), "rule_path")
    return (
        findings.filter(group.isNotNull())
        .withColumn("priority", F.row_number().over(order))
        .select(*keys, "priority", "rule_path", "rule_id", "title", "severity", "confidence", reason.alias("reason"))
    )


def remediation(findings: DataFrame, keys: tuple = JOB) -> DataFrame:
    return findings.filter(F.col("severity").isin("critical", "high", "medium")).select(
        *keys, "rule_path", "rule_id", "title", "severity", "recommendation"
    )


def finding_context(findings: DataFrame, system_info: DataFrame) -> DataFrame:
    """One text block per finding for a reader without access to the data.

    ``system_info`` holds a row per job. Both sides are small: findings are bounded by jobs x rules.
    """
    joined = findings.join(system_info.withColumnRenamed("hostname", "system_hostname"), "job_id", "left")

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(label.ljust(17) + " : "), F.coalesce(value.cast("string"), F.lit("N/A")))

    entities = F.array_join(
        F.flatten(
            F.transform(
                F.filter(
                    F.array(*[
                        F.struct(F.lit(f).alias("field"), F.try_element_at("affected_entities", F.lit(f)).alias("top"))
                        for f in L.ENTITY_FIELDS
                    ]),
                    lambda e: e["top"].isNotNull(),
                ),
                lambda e: F.concat(
                    F.array(F.concat(e["field"], F.lit(":"))),
                    F.transform(
                        e["top"],
                        lambda v: F.format_string("  - %s (%d event(s))", v["value"], v["count"]),
                    ),
                ),
            )
        ),
        "\n",
    )
    samples = F.array_join(
        F.transform(
            "sample_matches",
            lambda s, i: F.concat(
                F.format_string("[%d] %s | %s\n    ", i + 1, F.coalesce(s["timestamp"], F.lit("N/A")), s["service"]),
                F.left(s["message"], F.lit(L.LIMITS["context_message"])),
            ),
        ),
        "\n",
    )
    text = F.concat_ws(
        "\n",
        line("Operating system", F.concat_ws(" ", "distro_name", "version_id")),
        line("Hostname", F.col("system_hostname")),
        line("Kernel", F.col("kernel")),
        line("Architecture", F.col("architecture")),
        line("Init system", F.col("init_system")),
        line("Rule", F.concat(F.col("rule_id"), F.lit(" - "), F.col("title"))),
        line("Category", F.concat(F.col("category"), F.lit(" / "), F.col("subcategory"))),
        line("Severity", F.upper("severity")),
        line("Confidence", F.upper("confidence")),
        line("MITRE technique", F.col("mitre_technique")),
        line("MITRE tactic", F.col("mitre_tactic")),
        line("Total events", F.col("match_count")),
        line("First seen", F.col("first_seen")),
        line("Last seen", F.col("last_seen")),
        F.trim("description"),
        entities,
        samples,
        F.trim("recommendation"),
        F.array_join(F.transform("false_positives", lambda f: F.concat(F.lit("- "), f)), "\n"),
    )
    return joined.select("job_id", "rule_path", "rule_id", "severity", text.alias("context"))
