"""Reading, writing, coverage, integrity and the whole analysis, on small evidence trees."""

import gzip
import hashlib
import json
import random
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vigilog import RuleSet
from vigilog.operators import coverage as cov
from vigilog.operators import integrity, summary
from vigilog.operators import normalize as nrm
from vigilog.operators import timeline as tml
from vigilog.plans.analysis import analyse
from vigilog.session import stored
from vigilog.sources import evidence, files, sinks
from vigilog.streaming.ingest import ingest_new

JOB = "20260413_080000_web_1"
REF = datetime(2026, 4, 20)
RULES = RuleSet.from_dicts({"linux/auth/ssh_brute_force.yaml": {
    "id": "A", "severity": "high", "confidence": "medium", "service": "sshd",
    "detection": {"type": "threshold", "patterns": [{"regex": r"Failed password for (?P<user>\S+) from (?P<src_ip>\S+)"}],
                  "aggregation": {"count": 3, "window_seconds": 60}}}})


@pytest.fixture()
def tree(tmp_path):
    raw = tmp_path / "jobs" / JOB / "01_evidence" / "raw"
    logs = raw / "logs"
    logs.mkdir(parents=True)
    lines = [f"Apr 13 08:01:{i:02d} web sshd[1]: Failed password for root from 10.0.0.9 port 22 ssh2" for i in range(5)]
    (logs / "auth.log").write_text("\n".join(lines) + "\n")
    with gzip.open(logs / "nginx_access.log.gz", "wt") as out:
        out.write('1.1.1.1 - - [13/Apr/2026:08:00:00 +0000] "GET /a?cmd=1 HTTP/1.1" 404 1 "-" "x"\n')
    (raw / "services_inventory.json").write_text(json.dumps({"raw_systemctl": "", "raw_ps": "", "parsed": [
        {"unit": "sshd.service", "load": "loaded", "active": "active", "sub": "running", "description": "d"},
        {"unit": "odd-thing.service", "load": "loaded", "active": "active", "sub": "running", "description": "d"}]}, indent=1))
    (raw / "system_info.json").write_text(json.dumps({"hostname": "web", "kernel": "6"}))
    return tmp_path / "jobs"


def test_read_logs(spark, tree):
    for exact in (False, True):
        rows = evidence.read_logs(spark, str(tree), exact_line_numbers=exact).filter("source_file like '%auth.log'").orderBy("line_no").collect()
        assert [r.value[11:15] for r in rows] == ["1:00", "1:01", "1:02", "1:03", "1:04"]
        assert {(r.job_id, r.host) for r in rows} == {(JOB, "web_1")}
    assert [r.line_no for r in rows] == [1, 2, 3, 4, 5]


def test_line_numbers_across_splits(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(3000)))
    (tmp_path / "small.log").write_text("a\nb\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        for exact in (False, True):
            read = evidence.read_logs(spark, str(tmp_path), exact_line_numbers=exact)
            assert read.rdd.getNumPartitions() > 4
            rows = read.filter("source_file like '%big.log'").orderBy("line_no").collect()
            assert [int(r.value.split()[1]) for r in rows] == list(range(3000))
            assert len({r.line_no for r in rows}) == 3000
        assert [r.line_no for r in rows] == list(range(1, 3001))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_whole_analysis(spark, tree, tmp_path):
    result = analyse(spark, str(tree), RULES, str(tmp_path / "logs"), reference_ts=REF)
    assert result.logs.count() == 6
    finding = result.findings.first()
    assert (finding.match_count, finding.status) == (5, "highly_probable")
    assert finding.affected_entities["user"][0].value == "root"
    assert result.risk.first().overall == "high"
    assert [r.src_ip for r in result.timeline.collect()] == ["1.1.1.1"] + ["10.0.0.9"] * 5
    assert result.top_events.count() == 1
    assert {k: v.count() for k, v in result.correlations.items()}["auth_failures_by_ip"] == 1
    report = {r.service: r.covered for r in result.coverage.collect()}
    assert report == {"sshd": True, "odd-thing": False}
    sinks.write_results({"findings": result.findings, **result.correlations}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "findings")).count() == 1
    sinks.write_timeline(result.timeline, str(tmp_path / "tl"))
    assert spark.read.option("header", True).csv(str(tmp_path / "tl")).count() == 6
    sinks.write_logs(result.logs, str(tmp_path / "jl"), format="json")
    assert spark.read.json(str(tmp_path / "jl")).count() == 6
    kept = result.findings.inputFiles()
    result.close()
    assert kept and not any(Path(f.removeprefix("file://")).exists() for f in kept)


def test_job_json(spark, tree):
    assert evidence.read_job_json(spark, str(tree), "system_info").first().job_id == JOB
    assert evidence.read_job_json(spark, str(tree), "services").first().parsed[0].unit == "sshd.service"
    jobs = spark.createDataFrame([(JOB,)], "j string")
    row = jobs.select(evidence.job_host(F.col("j")), evidence.job_time(F.col("j"))).first()
    assert row[0] == "web_1" and row[1] == datetime(2026, 4, 13, 8)


def test_manifest_and_tampering(spark, tree):
    before = evidence.build_manifest(spark, str(tree))
    stored = spark.createDataFrame(before.collect(), before.schema)
    log = tree / JOB / "01_evidence" / "raw" / "logs" / "auth.log"
    row = {r.filename: r for r in stored.collect()}["auth.log"]
    assert row.sha256 == hashlib.sha256(log.read_bytes()).hexdigest()
    assert row.relative_path == "01_evidence/raw/logs/auth.log" and row.size_bytes == log.stat().st_size
    in_chunks = evidence.build_manifest(spark, str(tree), row_bytes=10)
    assert sorted(map(tuple, in_chunks.collect())) == sorted(map(tuple, stored.collect()))
    signature = integrity.sign(stored)
    signature = spark.createDataFrame(signature.collect(), signature.schema)
    assert integrity.verify_row_signature(stored, signature).first().valid
    log.write_bytes(log.read_bytes().replace(b"root", b"r00t", 1))
    (log.parent.parent / "system_info.json").unlink()
    now = evidence.build_manifest(spark, str(tree))
    status = {r.filename: r.status for r in integrity.verify(stored, now).collect()}
    assert status == {"auth.log": "failed", "system_info.json": "missing", "nginx_access.log.gz": "passed", "services_inventory.json": "passed"}
    assert not integrity.verify_row_signature(now, signature).first().valid
    totals = integrity.manifest_totals(stored).first()
    assert totals.artifact_count == 4


def test_ingest_only_new_files(spark, tree, tmp_path):
    table, state = str(tmp_path / "table"), str(tmp_path / "state")
    logs = str(tree / JOB / "01_evidence" / "raw" / "logs")
    run = lambda: ingest_new(spark, logs, table, state, reference_ts=REF).awaitTermination()
    run()
    assert spark.read.parquet(table).count() == 6
    run()
    assert spark.read.parquet(table).count() == 6
    (tree / JOB / "01_evidence" / "raw" / "logs" / "var_log_cron").write_text("Apr 13 08:01:00 web cron[1]: job\n")
    run()
    assert spark.read.parquet(table).count() == 7


LISTING = """
UNIT LOAD ACTIVE SUB DESCRIPTION

Sshd.service   loaded active running OpenBSD Secure Shell server
sshd.service loaded active running again
dbus.socket loaded active running D-Bus
short.service loaded
mysql-server.service loaded active running

LOAD = Reflects
late.service loaded active running after the footer
"""


def test_services(spark):
    inventory = spark.createDataFrame([("j", LISTING, "")], "job_id string, raw_systemctl string, raw_ps string")
    units = cov.unit_listing(inventory).orderBy("pos").collect()
    assert [u.unit for u in units] == ["Sshd.service", "sshd.service", "dbus.socket", "mysql-server.service"]
    assert units[0].description == "OpenBSD Secure Shell server" and units[3].description == ""
    assert [r.service for r in cov.detected_services(inventory).orderBy("pos").collect()] == ["Sshd", "mysql-server"]
    names = {"redis-server": "redis", "crond": "cron", "sshd": "sshd", "abcd": "abcd", "NGINX": "nginx", "clamav-daemon": "clamav-daemon"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.s for r in df.select("n", cov.normalise_service(F.col("n")).alias("s")).collect()} == names


def test_time_window_and_cap(spark, make_logs):
    logs = make_logs([(i * 3600, "s", "m") for i in range(10)] + [(None, "s", "m")])
    assert tml.filter_window(logs, 3, datetime(1970, 1, 1, 9)).count() == 4
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source_file"), F.col("id").alias("line_no"))
    df = df.withColumn("value", F.lit("v" * 50)).unionByName(spark.sql(
        "SELECT 'c' source_file, 70000 * id + 5 line_no, 'x' value FROM range(30)"))
    for which, n in (("last", 1), ("last", 5000), ("first", 4096), ("first", 7000), ("last", 13333), ("first", 13334)):
        rows = tml.cap_per_source(df, n, which).collect()
        for source in "ab":
            every = [i for i in range(20000) if (i % 3 == 0) == (source == "a")]
            expected = every[-n:] if which == "last" else every[:n]
            assert sorted(r.line_no for r in rows if r.source_file == source) == expected
        expected = [70000 * i + 5 for i in range(30)]
        assert sorted(r.line_no for r in rows if r.source_file == "c") == (expected[-n:] if which == "last" else expected[:n])
    plan = tml.cap_per_source(df, 10)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not any("value" in line for line in plan.splitlines() if "Exchange" in line)


def test_dedupe(make_logs, spark):
    logs = make_logs([(1, "s", "m"), (1.2, "s", "m"), (2, "s", "m"), (None, "s", "m"), (None, "s", "m")])
    assert sorted(r.line_no for r in tml.dedupe(logs).collect()) == [1, 2, 3, 4, 5]  # one source: real repeats
    journal = make_logs([(1.25, "s", "m"), (2.5, "s", "m"), (3, "s", "m")]).withColumns(
        {"source_file": F.lit("/j"), "format": F.lit("journal"), "line_no": F.col("line_no") + 10})
    assert sorted(r.line_no for r in tml.dedupe(logs.unionByName(journal)).collect()) == [1, 2, 4, 5, 12, 13]


def test_top_events_and_order(make_logs):
    logs = make_logs([(i, "s", "m") for i in (3, 1, 2)] + [(None, "s", "undated")]).withColumn("level", F.lit("crit"))
    assert [r.message for r in tml.top_events(logs, 4).collect()][-1] == "undated"
    assert [r.message for r in tml.top_events(logs, 4, compat=True).collect()][0] == "undated"
    assert tml.top_events(logs.withColumn("level", F.lit("warning"))).count() == 0


def test_acquisition(spark):
    df = spark.createDataFrame(
        [("j", "2026-04-13T08:00:00+00:00", "2026-04-13T08:02:05.9Z", [("1", "a", "ok")], None, [(2, "c", "e"), (2, "d", "e")], True),
         ("k", "bad", None, None, None, None, None)],
        "job_id string, start string, end string, commands array<struct<phase:string,artifact:string,status:string>>, "
        "artifacts array<string>, errors array<struct<phase:int,cmd:string,error:string>>, connection_closed boolean")
    rows = {r.job_id: r for r in summary.acquisition_summary(df).collect()}
    assert (rows["j"].duration, rows["j"].commands_logged, rows["j"].errors) == ("2m 5s", 1, 2)
    assert (rows["k"].duration, rows["k"].connection_closed) == ("N/A", False)
    assert [tuple(r) for r in summary.acquisition_errors(df).collect()] == [("j", 2, 2)]


LINE = "Apr 13 08:01:00 web cron[1]: job {}\n"


def _split(path, start, stop):
    return list(files._split_lines(f"file://{path}", start, stop))


def _texts(parts):
    return [v for _, values, error, _ in parts for v in values if error is None]


def test_ranges_share_out_every_line(tmp_path):
    random.seed(7)
    path = tmp_path / "x.log"
    for ends in (["\n"], ["\n", "\r\n", "\r"], ["\n", ""]):
        text = "".join(random.choice(["", "a", "bé", "ccc" * 9]) + random.choice(ends) for _ in range(60))
        path.write_bytes(text.encode() + b"\xff tail")
        raw = path.read_bytes()
        want = [line.decode("utf-8", "replace") for line in raw.splitlines()]
        assert _texts(_split(path, 0, len(raw))) == want
        for span in (1, 2, 3, 7, 50):
            parts = [p for s in range(0, len(raw), span) for p in _split(path, s, min(s + span, len(raw)))]
            assert _texts(parts) == want
            numbers = [n + i for n, values, _, _ in parts for i in range(len(values))]
            assert numbers == sorted(set(numbers)) or "\r" in ends[1:]


def test_gzip_is_read_to_the_bad_byte(tmp_path):
    lines = [f"line {i * 7919}" for i in range(5000)]
    one, two = (gzip.compress("".join(f"{x}\n" for x in part).encode()) for part in (lines[:3000], lines[3000:]))
    path = tmp_path / "x.gz"

    def read(data):
        path.write_bytes(data)
        parts = _split(path, 0, len(data))
        return _texts(parts), [(error, size) for _, _, error, size in parts if error is not None]

    assert read(one + two) == (lines, []) and read(one + two + b"\0" * 512) == (lines, []) and read(b"") == ([], [])
    got, errors = read(one + two[:len(two) // 2])
    plain = "\n".join(lines)
    assert len(got) > 3500 and plain.startswith("\n".join(got)) and errors == [("the file ends within a gzip member", len("\n".join(got)))]
    got, errors = read(one + b"not gzip")
    assert got == lines[:3000] and len(errors) == 1
    bad = bytearray(one + two)
    bad[-5] ^= 255  # a wrong checksum: all lines are there, and the error is told
    got, errors = read(bytes(bad))
    assert got == lines and len(errors) == 1 and errors[0][1] == len(plain) + 1
    assert read(b"no gzip at all")[0] == []
    path.unlink()
    assert _split(path, 0, 5)[0][1] == [None]


@pytest.fixture()
def broken_tree(tmp_path):
    logs = tmp_path / "jobs" / "20260413_080000_web" / "01_evidence" / "raw" / "logs"
    logs.mkdir(parents=True)
    (logs / "good.log").write_text("".join(LINE.format(i) for i in range(10)))
    whole = gzip.compress("".join(LINE.format(i * 7919) for i in range(20000)).encode())
    (logs / "cut.log.gz").write_bytes(whole[:len(whole) // 2])
    (logs / "none.log.gz").write_bytes(b"no gzip at all")
    (logs / "empty.log").write_text("")
    (logs / "odd {name},[x].log").write_text("\n" * 250 + '{"__REALTIME_TIMESTAMP": "1744531200000000", "MESSAGE": "m"}\n')
    return tmp_path / "jobs"


def test_broken_files_do_not_end_the_job(spark, broken_tree, tmp_path):
    heads = files.read_heads(spark, f"{broken_tree}/*/01_evidence/raw/logs")
    found = {r.path.rsplit("/", 1)[1]: (r.format, r.error is None) for r in nrm.format_of_heads(heads).collect()}
    assert found["good.log"] == found["cut.log.gz"] == ("syslog", True) and found["odd {name},[x].log"] == ("journal", True)
    assert found["none.log.gz"] == ("generic", False)
    result = analyse(spark, str(broken_tree), RULES, str(tmp_path / "logs"), reference_ts=REF)
    counts = {r.source_file.rsplit("/", 1)[1]: r["count"] for r in result.logs.groupBy("source_file").count().collect()}
    assert counts["good.log"] == 10 and 9900 < counts["cut.log.gz"] < 10100 and len(counts) == 3
    broken = {r.path.rsplit("/", 1)[1]: r for r in result.broken.collect()}
    assert set(broken) == {"cut.log.gz", "none.log.gz"} and result.broken.columns == ["path", "error", "bytes_read"]
    assert broken["cut.log.gz"].bytes_read > 300_000 and broken["none.log.gz"].bytes_read == 0


def test_plain_files_that_fail_are_told_too(spark, broken_tree):
    listed = nrm.format_of_heads(files.read_heads(spark, f"{broken_tree}/*/01_evidence/raw/logs")).drop("error")
    rows = [(r.path, r.uri, r.length, r.format) for r in listed.collect()]
    rows += [("/gone.log", f"file://{broken_tree}/gone.log", 100, "syslog")]
    lines = files.read_lines(spark, spark.createDataFrame(rows, listed.schema))
    assert lines.rows.filter("source_file LIKE '%good.log'").count() == 10
    assert {r.path.rsplit("/", 1)[1] for r in lines.broken().collect()} == {"cut.log.gz", "none.log.gz", "gone.log"}


def test_lines_of_a_gzip_file_are_parsed_by_many_tasks(spark, tmp_path):
    with gzip.open(tmp_path / "big.log.gz", "wt") as out:
        out.writelines(LINE.format(f"{i} {'x' * (i % 90)}") for i in range(120_000))
    (tmp_path / "plain.log").write_text("".join(LINE.format(i) for i in range(20_000)))
    listed = stored(nrm.format_of_heads(files.read_heads(spark, str(tmp_path))).drop("error"))
    lines = files.read_lines(spark, listed, span=100_000, part_lines=10_000)
    parsed = nrm.normalize(lines.rows, kinds=lines.kinds, reference_ts=REF)
    for name, count in (("big.log.gz", 120_000), ("plain.log", 20_000)):
        mine = parsed.filter(F.endswith("source_file", F.lit(name)))
        tasks = mine.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) > 3 and sum(r["count"] for r in tasks) == count
        jobs = [r.message for r in mine.orderBy("line_no").collect()]
        assert [m.split()[1] for m in jobs] == [str(i) for i in range(count)]
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    assert all("value" not in line for line in plan.splitlines() if "Exchange" in line)
    assert lines.broken().collect() == []


def test_an_empty_tree_has_an_empty_analysis(spark, tmp_path):
    (tmp_path / "jobs").mkdir()
    result = analyse(spark, str(tmp_path / "jobs"), RULES, str(tmp_path / "logs"), reference_ts=REF)
    assert [df.count() for df in (result.logs, result.findings, result.timeline, result.broken, result.coverage)] == [0] * 5
    assert all(df.count() == 0 for df in result.correlations.values())


def test_ingest_names_broken_files(spark, broken_tree, tmp_path):
    table, state = str(tmp_path / "table"), str(tmp_path / "state")
    ingest_new(spark, str(broken_tree), table, state, reference_ts=REF).awaitTermination()
    assert spark.read.parquet(table).filter("source_file LIKE '%good.log'").count() == 10
    broken = spark.read.parquet(f"{state}-broken").collect()
    assert {r.path.rsplit("/", 1)[1] for r in broken} == {"cut.log.gz", "none.log.gz"}
