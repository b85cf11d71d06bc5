"""Headline timings on ``$BENCH_SF_DIR`` with ``$BENCH_CPUS`` cores; prints one JSON line.

The stages are those of a full analysis: parse the lines into a stored table, apply the rule pack
to it, correlate, summarise. Each result is forced completely.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vigilog import build_session, load_rules  # noqa: E402
from vigilog.operators import correlate as cor  # noqa: E402
from vigilog.operators import findings as fnd  # noqa: E402
from vigilog.operators import timeline as tml  # noqa: E402
from vigilog.operators.detect import search_rules  # noqa: E402
from vigilog.operators.normalize import normalize  # noqa: E402
from vigilog.plans import adapter as A  # noqa: E402
from vigilog.plans.analysis import find_matches  # noqa: E402
from vigilog.plans.queries import QUERIES  # noqa: E402
from vigilog.session import spread  # noqa: E402

REGISTERED = (
    "document_patterns", "threshold_fired", "sequence_pairs", "parse_audit", "cap_per_source",
    "coverage", "manifest_verify",
)


def force(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    rules_dir = os.environ.get("BENCH_RULES", os.path.join(os.path.dirname(os.path.abspath(__file__)), "vigilog", "rules"))
    spark = build_session(f"local[{cpus}]", int(cpus), quiet=True)
    spark.sparkContext.setLogLevel("OFF")
    rules = load_rules(rules_dir)
    work = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    times: dict[str, float] = {}
    cold: dict[str, float] = {}  # first runs, which pay for class loading and code generation

    def timed(name, function, into=times):
        start = time.perf_counter()
        result = function()
        into[name] = round(time.perf_counter() - start, 3)
        return result

    def parse():
        lines = A.event_lines(spread(A.read(spark, folder, "events")))
        normalize(lines, kinds=A.EVENT_FORMATS, reference_ts=A.REFERENCE_TS).write.mode("overwrite").parquet(f"{work}/logs")

    timed("normalise", parse, cold)
    timed("normalise", parse)
    logs = spark.read.parquet(f"{work}/logs")
    entries = logs.count()
    timed("normalised_reread", lambda: force(logs))
    timed("rule_search", lambda: force(search_rules(logs, rules)), cold)
    timed("rule_search", lambda: force(search_rules(logs, rules)))
    timed("rule_engine", lambda: fnd.build_findings(find_matches(logs, rules), rules).collect())
    for name, correlation in cor.CORRELATIONS.items():
        timed(name, lambda c=correlation: c(logs).collect())
    timed("timeline", lambda: force(tml.timeline(logs)))
    timed("top_events", lambda: tml.top_events(logs).collect())
    for name in REGISTERED:
        timed(name, lambda n=name: force(QUERIES[n](spark, folder)))
    print(json.dumps({
        "metric": "log_analysis_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "cold": cold, "sf": folder.rstrip("/").split("sf")[-1], "entries": entries,
        "rules": len(rules.active()), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
