"""What the plans and the shipped pack promise."""

from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from vigilog import load_rules
from vigilog.operators import coverage as cov
from vigilog.operators import timeline as tml
from vigilog.sources.sinks import write_logs

PACK = Path(__file__).resolve().parent.parent / "vigilog" / "rules"


def test_time_windows_open_only_their_days(spark, make_logs, tmp_path):
    logs = make_logs([(86400 * d + i, "s", "m") for d in range(6) for i in range(50)] + [(None, "s", "m")] * 3)
    write_logs(logs.repartition(6), str(tmp_path / "logs"))
    stored = spark.read.parquet(str(tmp_path / "logs"))
    window = tml.filter_window(stored, 24, datetime(1970, 1, 6, 12))
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and ">= 1970-01-05" in plan
    assert window.count() == 50
    assert tml.filter_window(stored, 24, datetime(1970, 1, 6, 12), undated=True).count() == 53
    assert len(list((tmp_path / "logs").rglob("*.parquet"))) <= 14  # not tasks x days


def test_the_timeline_sorts_no_more_than_it_shows(make_logs):
    rows = tml.timeline(make_logs([(1, "s", "m" * 2000)]))
    plan = rows._jdf.queryExecution().optimizedPlan()
    sort = plan.children().head() if plan.nodeName() == "Project" else plan
    names = [a.name() for a in _each(sort.output())]
    assert sort.nodeName() == "Sort" and "extracted" not in names and "raw" not in names
    assert len(rows.first().message) == 512


def _each(seq):
    return [seq.apply(i) for i in range(seq.length())]


def test_the_shipped_pack_covers_common_services(spark):
    rules = load_rules(PACK)
    units = ["sshd", "nginx", "crond", "mysqld", "postfix", "postgresql", "vsftpd", "unheard-of"]
    listing = "\n".join(f"  {u}.service loaded active running Unit {u}" for u in units)
    inventory = spark.createDataFrame([("j", listing, "")], "job_id string, raw_systemctl string, raw_ps string")
    paths = spark.createDataFrame([(r.path,) for r in rules.rules], "rule_path string")
    got = {r.service: r.covered for r in cov.coverage(inventory, paths, rules).collect()}
    assert {s for s, covered in got.items() if not covered} == {"unheard-of"}
    assert any(r.missing_rule_files for r in cov.coverage(inventory, paths).collect())


def test_default_search_finds_all_that_message_search_finds(spark, make_logs):
    from vigilog.operators.detect import search_rules

    rules = load_rules(PACK)
    texts = ["GET /a/../../etc/passwd HTTP/1.1 -> 200", "Failed password for u1 from 10.0.0.9 port 22 ssh2", "POST /login.php HTTP/1.1 -> 401",
             "GET /?q=union+select+1 HTTP/1.1 -> 200", "GET /cgi?cmd=;wget%20x HTTP/1.1 -> 500"]
    logs = make_logs([(i, "nginx", t) for i, t in enumerate(texts * 4)]).withColumns(
        {"format": F.lit("access"), "raw": F.concat(F.lit('1.2.3.4 - - "'), "message", F.lit('" 200 1 "-" "sqlmap"'))})
    keys = lambda df: {(r.rule_path, r.line_no) for r in df.collect()}
    message, default = keys(search_rules(logs, rules, match_on="message")), keys(search_rules(logs, rules))
    assert message and message < default
    # All literals in one pass, or each by itself: the same hits.
    assert default == keys(search_rules(logs, rules, one_pass=False)) == keys(search_rules(logs, rules, use_prefilter=False))


def test_literals_are_found_in_one_pass(spark):
    from vigilog.functions import literals

    words = tuple(sorted({"a", "ab", "abc", "bc", "é", "漢", "'\\"} | {f"w{i}x" for i in range(150)}))
    texts = [None, "", "abc", "xab", "É é", "漢w7x", "w149xw0xw62x", "it's '\\", "w1 x", "😀 bc \0 w61x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("held", literals.held(F.col("t"), words))
    numbers = {w: i for i, w in enumerate(words)}
    for clause in [("abc",), ("é", "漢"), ("w61x", "w62x", "w149x"), ("'\\",), ("w1x",)]:
        got = df.select("t", F.expr(literals.holds_any("held", numbers, clause)).alias("any")).collect()
        assert [r["any"] for r in got] == [any(w in (r.t or "") for w in clause) for r in got]
