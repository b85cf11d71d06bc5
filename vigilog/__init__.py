"""Security-log analytics on Spark: parse host logs, apply detection rules, correlate, summarise."""

from vigilog.session import build_session, configure
from vigilog.sources.rules import RuleSet, load_rules

__all__ = ["build_session", "configure", "RuleSet", "load_rules"]
