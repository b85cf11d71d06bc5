"""Services found on the hosts and the rules that cover them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.functions import lookups as L
from vigilog.functions.regex import sql_string

SPACE = r"\s+"


def unit_listing(inventories: DataFrame) -> DataFrame:
    """Service-manager listings (job_id, raw_systemctl) to one row per unit, with its position.

    Header lines are skipped; the first blank line after the first unit ends the list. That line is
    a minimum over the job's own listing, found inside the array: no shuffle.
    """
    lines = F.split(F.coalesce("raw_systemctl", F.lit("")), r"\r?\n")
    return (
        inventories.select("job_id", _unit_rows(lines).alias("units"))
        .select("job_id", F.inline("units"))
        .select(
            "job_id", "pos", F.left("unit", F.lit(L.LIMITS["unit"])).alias("unit"),
            "load", "active", "sub",
            F.left("description", F.lit(L.LIMITS["description"])).alias("description"),
        )
    )


def _unit_rows(lines: Column) -> Column:
    part = lambda p, i: F.coalesce(F.get(p, F.lit(i)), F.lit(""))

    def parse(line, i):
        text = F.trim(line)
        p = F.split(text, SPACE, 5)
        ok = (
            ~F.startswith(text, F.lit("UNIT")) & ~F.startswith(text, F.lit("Legend"))
            & (F.size(p) >= 3) & F.contains(part(p, 0), F.lit("."))
        )
        return F.struct(
            i.alias("pos"), (text == "").alias("blank"), ok.alias("ok"), part(p, 0).alias("unit"),
            part(p, 1).alias("load"), part(p, 2).alias("active"), part(p, 3).alias("sub"),
            part(p, 4).alias("description"),
        )

    parsed = F.transform(lines, parse)
    first = F.array_min(F.transform(F.filter(parsed, lambda r: r["ok"]), lambda r: r["pos"]))
    end = F.coalesce(
        F.array_min(F.transform(F.filter(parsed, lambda r: r["blank"] & (r["pos"] > first)), lambda r: r["pos"])),
        F.size(parsed),
    )
    return F.filter(parsed, lambda r: r["ok"] & (r["pos"] < end))


def process_listing(inventories: DataFrame) -> DataFrame:
    """Process lists (job_id, raw_ps) to candidate service names, with their position."""
    lines = inventories.select(
        "job_id", F.posexplode(F.split(F.coalesce("raw_ps", F.lit("")), r"\r?\n")).alias("pos", "line")
    )
    raw = F.get(F.split(F.trim("line"), SPACE), F.lit(10))
    command = F.regexp_replace(F.substring_index(F.ltrim(raw, F.lit("/")), "/", -1), ":+$", "")
    return (
        lines.select("job_id", "pos", raw.alias("raw"), command.alias("name"))
        .filter(
            F.col("raw").isNotNull() & ~F.startswith("raw", F.lit("["))
            & (F.char_length("name") >= 2) & ~F.startswith("name", F.lit("-"))
            & ~F.contains("name", F.lit("]")) & ~F.lower("name").isin(*L.PROCESS_STOP_LIST)
        )
        .select("job_id", "pos", "name")
    )


def detected_services(inventories: DataFrame) -> DataFrame:
    """(job_id, pos, service): units named ``.service``; the process list only for jobs without any.

    Names that differ in case only count once, in their first spelling. ``inventories`` may hold
    parsed units already (``parsed``); otherwise the raw listing is read.
    """
    if "parsed" in inventories.columns:
        units = inventories.select("job_id", F.posexplode("parsed").alias("pos", "u")).select(
            "job_id", "pos", F.col("u.unit").alias("unit")
        )
    else:
        units = unit_listing(inventories)
    named = units.filter(F.endswith("unit", F.lit(".service"))).select(
        "job_id", "pos", F.expr("left(unit, char_length(unit) - 8)").alias("name")
    )
    others = process_listing(inventories).join(named.select("job_id").distinct(), "job_id", "left_anti")
    return (
        named.unionByName(others)
        .withColumn("key", F.lower(F.trim("name")))
        .filter(F.col("key") != "")
        .groupBy("job_id", "key")
        .agg(F.min_by("name", "pos").alias("service"), F.min("pos").alias("pos"))
        .select("job_id", "pos", "service")
    )


def normalise_service(name: Column) -> Column:
    """Lower case, without a common suffix when what remains is a mapped service."""
    name = F.lower(F.trim(name))
    known = list(L.SERVICE_RULES)
    chain = None
    for suffix in L.SERVICE_SUFFIXES:
        base = F.left(name, F.char_length(name) - len(suffix))
        test = (
            F.endswith(name, F.lit(suffix)) & (F.char_length(name) > len(suffix) + 2) & base.isin(*known)
        )
        chain = F.when(test, base) if chain is None else chain.when(test, base)
    return chain.otherwise(name)


def is_infrastructure(name: Column) -> Column:
    words = "|".join(re.escape(word) for word in L.INFRASTRUCTURE)
    return F.rlike(name, F.lit(words))


def _mapped(condition: str) -> Column:
    """Rule files of the first entry of the service map that meets a condition on ``k.known``."""
    entries = ", ".join(
        f"named_struct('known', {sql_string(name)}, 'rules', "
        f"CAST(array({', '.join(map(sql_string, rules))}) AS array<string>))"
        for name, rules in L.SERVICE_RULES.items()
    )
    return F.expr(f"get(filter(array({entries}), k -> {condition}), 0).rules")


def _by_rules(rules) -> Column:
    """Files of the rules in use whose own service field applies to ``service``, as in the search."""
    tests = [
        f"CASE WHEN contains(service, {sql_string(rule.service)}) THEN {sql_string(rule.path)} END"
        for rule in (rules.active() if rules else ()) if rule.service not in ("*", "linux")
    ]
    return F.expr(f"array_compact(array({', '.join(tests)}))" if tests else "CAST(array() AS array<string>)")


def map_services(services: DataFrame, rule_paths: DataFrame, rules=None) -> DataFrame:
    """(service, rules, missing_rule_files) per distinct normalised name.

    The rules are those mapped to the name, else to the first known name that contains it or is
    part of it, else ``services/<name>.yaml``; then those of ``rules``, the rule set in use, whose own
    service field applies. A mapped file is only missed if no rule in use applies. The map is a
    constant inside the expression. ``rule_paths`` is small by nature; Spark measures it before it
    broadcasts it.
    """
    names = services.select("service").distinct()
    candidate = F.concat(F.lit("services/"), F.col("service"), F.lit(".yaml"))
    mapped = names.select(
        "service",
        F.coalesce(
            _mapped("k.known = service"),
            _mapped("contains(service, k.known) OR contains(k.known, service)"),
        ).alias("listed"),
        F.array(candidate).alias("own"),
    )
    paths = mapped.select(
        "service", F.col("listed").isNotNull().alias("listed"),
        F.posexplode_outer(F.coalesce("listed", "own")).alias("ord", "rule_path"),
    )
    existing = rule_paths.select("rule_path", F.lit(True).alias("exists")).distinct()
    checked = paths.join(existing, "rule_path", "left")
    row = F.struct("ord", "rule_path")
    # A file that is merely guessed from the name is not missed.
    found = F.array_sort(F.collect_list(F.when(F.col("exists"), row)))
    missing = F.array_sort(F.collect_list(F.when(F.col("exists").isNull() & F.col("listed"), row)))
    mapped = checked.groupBy("service").agg(
        found["rule_path"].alias("rules"),
        F.filter(missing["rule_path"], lambda p: p.isNotNull()).alias("missing_rule_files"),
    )
    own = _by_rules(rules)
    missed = F.when(F.size(own) == 0, F.col("missing_rule_files")).otherwise(F.expr("CAST(array() AS array<string>)"))
    return mapped.select("service", F.array_union("rules", own).alias("rules"), missed.alias("missing_rule_files"))


def coverage(inventories: DataFrame, rule_paths: DataFrame, rules=None) -> DataFrame:
    """(job_id, pos, service, rules, missing_rule_files, covered), infrastructure left out.

    ``rule_paths`` (rule_path) lists the rule files that exist; ``rules`` is the rule set in use, whose
    service fields count beside the fixed map.
    """
    services = (
        detected_services(inventories)
        .withColumn("service", normalise_service(F.col("service")))
        .filter(~is_infrastructure(F.col("service")))
    )
    return services.join(map_services(services, rule_paths, rules), "service").select(
        "job_id", "pos", "service", "rules", "missing_rule_files", (F.size("rules") > 0).alias("covered")
    )


def coverage_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("job_id").agg(
        F.count_if("covered").alias("services_with_rules"),
        F.count_if(~F.col("covered")).alias("services_without_rules"),
        F.sum(F.size("rules")).alias("total_applicable_rules"),
    )


def coverage_gaps(report: DataFrame) -> DataFrame:
    """Services without rules, with the id and path a new rule would have."""
    slug = F.replace(F.left(F.upper("service"), F.lit(20)), F.lit("-"), F.lit("_"))
    return report.filter(~F.col("covered")).select(
        "job_id", "service", F.concat(F.lit("SVC-"), slug, F.lit("-001")).alias("proposed_rule_id"),
        F.concat(F.lit("services/"), F.col("service"), F.lit(".yaml")).alias("proposed_path"),
    )
