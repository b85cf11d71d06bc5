"""Rule files to a rule table.

Rules are configuration: a few thousand small files at most, read once by the driver. The detection
operators turn them into expressions of the plan, so no rule travels with the data.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from vigilog import schema
from vigilog.functions import lookups as L
from vigilog.functions.regex import Pattern, compile_pattern

try:
    import yaml
except ImportError:  # RuleSet.from_dicts works without it
    yaml = None

TYPES = ("pattern", "threshold", "sequence")
MAX_RULES = 20_000


@dataclass(frozen=True)
class Rule:
    path: str
    id: str
    type: str
    service: str
    enabled: bool
    patterns: tuple[Pattern, ...]
    steps: tuple[Pattern, ...]
    field: str
    count: int
    window_seconds: float
    within_seconds: float
    meta: dict

    def used_steps(self, compat: bool) -> tuple[Pattern, ...]:
        """The steps that are evaluated; ``compat`` looks at the first two only."""
        return self.steps[:2] if compat else self.steps

    def row(self) -> tuple:
        text = lambda key, default="": str(self.meta.get(key, default) or default)
        many = lambda key: [str(v) for v in self.meta.get(key) or []]
        return (
            self.path, self.id, text("title", "Unknown"), text("category", "unknown"),
            text("subcategory"), text("mitre_technique"), text("mitre_tactic"),
            text("severity", "medium"), text("confidence", "medium"), self.enabled,
            text("description"), text("service", "*"), self.type,
            _pattern_rows(self.patterns), _pattern_rows(self.steps),
            (self.field, self.count, self.window_seconds), self.within_seconds,
            many("false_positives"), text("recommendation"), many("references"), many("tags"),
        )


def _pattern_rows(patterns) -> list:
    return [
        (i, p.source, p.java, dict(p.groups), [list(clause) for clause in p.required])
        for i, p in enumerate(patterns)
    ]


@dataclass
class RuleSet:
    rules: list[Rule] = field(default_factory=list)
    errors: list[tuple] = field(default_factory=list)
    compat: bool = False

    @classmethod
    def from_dicts(cls, rules: dict[str, dict], compat: bool = False) -> RuleSet:
        """Rules given as path -> content."""
        out = cls(compat=compat)
        for path, content in rules.items():
            out._add(path, content)
        return out

    def _add(self, path: str, content) -> None:
        if not isinstance(content, dict) or not content.get("id"):
            self.errors.append((path, None, "not a rule: no id"))
            return
        detection = content.get("detection") or {}
        kind = detection.get("type", "pattern")
        if kind not in TYPES:
            self.errors.append((path, None, f"unknown detection type {kind!r}"))
            return
        agg = detection.get("aggregation") or {}
        listed = detection.get("patterns") or []
        steps = detection.get("steps") or []
        windows = [agg.get("window_seconds"), None if self.compat else agg.get("window_sec")]
        within = [detection.get("within_seconds")]
        if kind == "sequence" and not self.compat:
            steps = steps or listed
            within += [detection.get("window_sec"), *windows]
        try:
            rule = Rule(
                path=path,
                id=str(content["id"]),
                type=kind,
                service=str(content.get("service", "*") or "*").lower().strip(),
                enabled=bool(content.get("enabled", True)),
                patterns=self._compile(path, listed) if kind != "sequence" else (),
                steps=self._compile(path, steps) if kind == "sequence" else (),
                field=str(agg.get("field", "src_ip")),
                count=int(agg.get("count", L.DEFAULT_THRESHOLD_COUNT)),
                window_seconds=_first_number(windows),
                within_seconds=_first_number(within),
                meta=content,
            )
        except (TypeError, ValueError) as error:
            self.errors.append((path, None, str(error)))
            return
        if rule.type == "threshold" and rule.count < 1:
            self.errors.append((path, None, "threshold count below 1"))
        elif rule.type == "sequence" and not self.compat and len(rule.steps) < len(steps):
            self.errors.append((path, None, "a sequence with a step that is empty or does not compile"))
        else:
            self.rules.append(rule)

    def _compile(self, path: str, listed) -> tuple:
        """Bad patterns are reported and left out; the rest of the rule stays in force."""
        out = []
        for i, item in enumerate(listed):
            source = item.get("regex", "") if isinstance(item, dict) else str(item)
            if not source:
                continue
            try:
                out.append(compile_pattern(source))
            except (re.error, ValueError) as error:
                self.errors.append((path, i, str(error)))
        return tuple(out)

    def active(self, *types: str) -> list[Rule]:
        """Enabled rules that have something to search for."""
        return [
            r for r in self.rules
            if r.enabled and r.type in (types or TYPES)
            and (len(r.steps) >= 2 if r.type == "sequence" else r.patterns)
        ]

    def with_hits(self, hit: set, compat: bool = False) -> RuleSet:
        """The rules that can still match, given the (path, pattern index) pairs that were found."""
        def possible(rule: Rule) -> bool:
            if rule.type == "sequence":
                return {(rule.path, i) for i in range(len(rule.used_steps(compat)))} <= hit
            return any((rule.path, i) in hit for i in range(len(rule.patterns)))

        return RuleSet([r for r in self.rules if possible(r)], self.errors, self.compat)

    def dataframe(self, spark: SparkSession) -> DataFrame:
        """One row per rule; ``MAX_RULES`` bounds it, so joins may broadcast it."""
        if len(self.rules) > MAX_RULES:
            raise ValueError(f"{len(self.rules)} rules exceed the limit of {MAX_RULES}")
        return spark.createDataFrame([r.row() for r in self.rules], schema.RULE).coalesce(1)

    def errors_dataframe(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.errors, schema.RULE_ERROR)


def _first_number(values) -> float:
    for value in values:
        if value is not None:
            return float(value)
    return float(L.DEFAULT_WINDOW_SECONDS)


def load_rules(directory: str | Path, compat: bool = False) -> RuleSet:
    """Read ``*.yaml`` and ``*.yml`` below a directory (``compat``: ``*.yaml`` only), path-sorted.

    A file that cannot be read as a rule becomes a row of ``errors``, never a silent gap.
    """
    if yaml is None:
        raise RuntimeError("reading rule files needs PyYAML; use RuleSet.from_dicts instead")
    root = Path(directory)
    suffixes = {".yaml"} if compat else {".yaml", ".yml"}
    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    out = RuleSet(compat=compat)
    for path in sorted(p for p in root.rglob("*") if p.suffix in suffixes and p.is_file()):
        relative = path.relative_to(root).as_posix()
        try:
            content = yaml.load(path.read_text(encoding="utf-8"), Loader=loader)
        except (yaml.YAMLError, UnicodeDecodeError) as error:
            out.errors.append((relative, None, f"unreadable: {error}"))
            continue
        out._add(relative, content)
    return out
