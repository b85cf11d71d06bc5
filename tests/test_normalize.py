"""Parsing, one fixture file per format and every documented edge case."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigilog import schema
from vigilog.operators import normalize as nrm
from vigilog.operators import timeline as tml
from vigilog.operators import years

REF = datetime(2026, 4, 20)
FILES = {
    "auth.log": [
        "Apr  3 08:01:12 h1 sshd[12]: Failed password for root from 10.0.0.9 port 22 ssh2\r",
        "Feb 29 08:01:12 h1 cron: no such day",
        "Dec 31 23:01:12 h1 cron: last year",
        "nonsense",
        "",
        "Foo  3 08:01:12 h1 app: month unknown",
    ],
    "nginx_access.log": [
        '10.0.0.8 - u8 [13/Apr/2026:14:30:00 +0200] "GET /a?k=1 HTTP/1.1" 404 12 "-" "curl"',
        '10.0.0.8 - - [31/Foo/2026:14:30:00 +0000] "GET /a HTTP/1.1" 200 -',
        "not an access line",
    ],
    "apache_error.log": ["[Mon Apr 13 14:30:00 2026] [ERROR] [client 10.0.0.8] File does not exist", "plain"],
    "audit.log": [
        "type=USER_AUTH msg=audit(1744531200.123:42): ppid=3 pid=77 uid=0 res=failed",
        "type=ANOM_X msg=audit(1744531200.123:42): a=1",
        "continued",
    ],
    "app.log": [
        "2026-04-13T14:30:00Z ERROR disk full", "2026-04-13 14:30:00.5+0530 text", "[   12.3] plain",
        "2026-13-45T14:30:00Z INFO bad date", "x" * 5000, "préfixe accentué",
    ],
    "journal_sys_72h.json": [
        '{"__REALTIME_TIMESTAMP":"1744531200123456","_HOSTNAME":"hh","SYSLOG_IDENTIFIER":"sshd","_PID":"12","PRIORITY":"3","MESSAGE":["a","b"]}',
        '{"__REALTIME_TIMESTAMP":"1744531200000000","_SYSTEMD_UNIT":"x.service","MESSAGE":"[bracket] text"}',
        '{"MESSAGE": "no time", "PRIORITY": "9"}',
        "{bad json",
        "no object",
    ],
    "nginx_site.jsonl": [
        '{"timestamp": null, "ts_epoch": 0, "hostname": null, "service": "unknown", "pid": null, "level":"info","message":"m","source_file":"s","raw":"10.0.0.8 - u8 [13/Apr/2026:14:30:00 +0000] \\"GET /a HTTP/1.1\\" 500 12 \\"-\\" \\"curl\\"","extracted":{}}',
        '{"timestamp": "t", "ts_epoch": 1744531200, "hostname": "h", "service": "sshd", "pid": "1", "level":"info","message":"m","source_file":"s","raw":"r","extracted":{"a":"b","c":null}}',
        '{"ts_epoch": 0, "hostname": "h", "service": "unknown", "pid": null, "message":"m", "raw":"free text", "source_file":"s"}',
    ],
}


@pytest.fixture(scope="module")
def lines(spark):
    rows = [
        ("j", "h", f"/nginx_dir/{name}", i + 1, text)
        for name, texts in FILES.items() for i, text in enumerate(texts)
    ]
    return spark.createDataFrame(rows, schema.LINE)


def _parse(lines, **options):
    formats = nrm.detect_format(lines)
    rows = nrm.parse_lines(lines, formats, reference_ts=REF, **options).collect()
    return {(r.source_file.split("/")[-1], r.line_no): r for r in rows}


@pytest.fixture(scope="module")
def parsed(lines):
    return _parse(lines)


@pytest.fixture(scope="module")
def compat(lines):
    return _parse(lines, compat=True)


def test_formats(lines):
    found = {r.source_file.split("/")[-1]: r.format for r in nrm.detect_format(lines).collect()}
    assert found == {
        "auth.log": "syslog", "nginx_access.log": "access", "apache_error.log": "error",
        "audit.log": "audit", "app.log": "generic", "journal_sys_72h.json": "journal",
        "nginx_site.jsonl": "entry_jsonl",
    }


def test_syslog(parsed):
    r = parsed["auth.log", 1]
    assert (r.hostname, r.service, r.pid, r.level) == ("h1", "sshd", "12", "info")
    assert r.timestamp == "2026-04-03T08:01:12+00:00" and r.ts_epoch == 1775203272.0
    assert r.message.endswith("ssh2")
    assert r.extracted == {"src_ip": "10.0.0.9", "user": "root"}


def test_syslog_dates(parsed, compat):
    assert parsed["auth.log", 2].ts is None and parsed["auth.log", 2].message == "no such day"
    assert parsed["auth.log", 3].ts.year == 2025
    assert compat["auth.log", 3].ts.year == 2026
    assert parsed["auth.log", 6].ts.month == 1


def test_leap_day_of_last_year(spark):
    line = spark.createDataFrame(
        [("j", "h", "/a", 1, "Feb 29 08:01:12 h1 cron: x", "syslog")], schema.LINE + ", format string"
    )
    row = nrm.normalize(line, reference_ts=datetime(2025, 1, 5)).first()
    assert row.timestamp == "2024-02-29T08:01:12+00:00"


def test_errors_and_blank_lines(parsed):
    assert parsed["auth.log", 4].parse_error and ("auth.log", 5) not in parsed
    assert parsed["nginx_access.log", 3].parse_error
    assert parsed["journal_sys_72h.json", 4].parse_error
    assert ("journal_sys_72h.json", 5) not in parsed
    assert parsed["audit.log", 3].parse_error


def test_compat_leaves_auth_fields_empty(compat):
    assert compat["auth.log", 1].extracted == {}


def test_access(parsed):
    r = parsed["nginx_access.log", 1]
    assert (r.service, r.hostname, r.level) == ("nginx", "webserver", "error")
    assert r.message == "GET /a?k=1 HTTP/1.1 -> 404"
    assert r.timestamp == "2026-04-13T14:30:00+02:00" and r.ts.hour == 12
    assert r.extracted == {
        "src_ip": "10.0.0.8", "http_method": "GET", "uri": "/a?k=1", "http_status": "404",
        "user": "u8", "user_agent": "curl",
    }
    other = parsed["nginx_access.log", 2]
    assert other.ts is None and other.timestamp is None and "user" not in other.extracted


def test_error_log(parsed, compat):
    r = parsed["apache_error.log", 1]
    assert (r.service, r.level, r.message) == ("apache2_error", "error", " [client 10.0.0.8] File does not exist")
    assert r.ts.hour == 14
    old = compat["apache_error.log", 1]  # the whole path counts there, and the time is not read
    assert old.service == "nginx_error" and old.ts is None


def test_audit(parsed):
    r = parsed["audit.log", 1]
    assert (r.service, r.pid, r.level, r.ts_epoch) == ("pam", "77", "info", 1744531200.0)
    assert r.message == "type=USER_AUTH ppid=3 pid=77 uid=0 res=failed"
    assert (parsed["audit.log", 2].service, parsed["audit.log", 2].level) == ("auditd", "warn")


def test_generic(parsed):
    r = parsed["app.log", 1]
    assert (r.service, r.level, r.message, r.timestamp) == ("app", "error", "disk full", "2026-04-13T14:30:00Z")
    assert parsed["app.log", 2].ts_epoch == 1776070800.5
    assert parsed["app.log", 3].ts is None and parsed["app.log", 3].message == "[   12.3] plain"
    assert parsed["app.log", 4].ts is None and parsed["app.log", 4].timestamp == "2026-13-45T14:30:00Z"
    assert len(parsed["app.log", 5].message) == 4096 and len(parsed["app.log", 5].raw) == 1024
    assert parsed["app.log", 6].message == "préfixe accentué"


def test_journal(parsed):
    r = parsed["journal_sys_72h.json", 1]
    assert (r.service, r.hostname, r.pid, r.level, r.message) == ("sshd", "hh", "12", "error", "a b")
    assert r.timestamp == "2025-04-13T08:00:00.123456+00:00"
    assert parsed["journal_sys_72h.json", 2].service == "x"
    assert parsed["journal_sys_72h.json", 2].message == "[bracket] text"
    third = parsed["journal_sys_72h.json", 3]
    assert (third.ts, third.level, third.service) == (None, "info", "sys")


def test_entry_jsonl(parsed, compat):
    again = parsed["nginx_site.jsonl", 1]
    assert (again.format, again.level, again.extracted["http_status"]) == ("access", "error", "500")
    old = compat["nginx_site.jsonl", 1]
    assert (old.format, old.service, old.pid, old.hostname) == ("entry_jsonl", "nginx", "None", "None")
    second = parsed["nginx_site.jsonl", 2]
    assert second.extracted == {"a": "b"} and second.ts_epoch == 1744531200.0
    third = parsed["nginx_site.jsonl", 3]
    assert (third.format, third.service, third.pid, third.ts) == ("entry_jsonl", "nginx", "", None)


SYSLOG_TEXT = """\
Apr 13 08:01:12 server sshd[1234]: Accepted publickey for admin from 10.0.0.5 port 54321 ssh2
Apr 13 08:02:00 server sshd[1236]: Failed password for invalid user ghost from 10.0.0.99 port 44444 ssh2

2026-04-13 14:30:00 h1 app[9]: started
[    1.234567] EXT4-fs (sda1): mounted filesystem with ordered data mode
"""


def test_structure_text(spark):
    rows = [("j", "h", "/t", i, line) for i, line in enumerate(SYSLOG_TEXT.splitlines())]
    out = nrm.structure_text(spark.createDataFrame(rows, schema.LINE), "dflt", reference_ts=REF)
    assert out.columns == schema.LOG_COLUMNS
    got = {r.line_no: r for r in out.collect()}
    assert sorted(got) == [0, 1, 3, 4]
    assert (got[0].service, got[0].pid, got[0].hostname) == ("sshd", "1234", "server")
    assert got[3].message == "started" and got[3].ts.hour == 14
    assert (got[4].service, got[4].hostname, got[4].ts) == ("unknown", "dflt", None)


def test_infer_service(spark):
    from pyspark.sql import functions as F

    cases = {
        "/x/httpd_error": "apache2_error", "/x/apache2.log": "apache2", "/x/nginx.log": "nginx",
        "/x/nginx_error.log": "nginx_error", "/var_log_secure": "sshd", "/x/var_log_auth": "sshd",
        "/x/messages": "syslog", "/x/other": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r.p: r.s for r in df.select("p", nrm.infer_service(F.col("p")).alias("s")).collect()}
    assert got == cases


def test_filters_on_parsed_columns_run_each_regex_once(lines):
    plan = nrm.normalize(lines, nrm.detect_format(lines), reference_ts=REF).filter("service = 'sshd'")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("ppid") == 0 and text.count(r"\bpid=(\d+)") == 1


def test_stats(lines):
    stats = tml.log_stats(nrm.parse_lines(lines, nrm.detect_format(lines), reference_ts=REF)).collect()
    by = {(r.dimension, r.value): r for r in stats}
    assert by["total", ""].entries == sum(r.entries for r in stats if r.dimension == "source")
    assert by["source", "auth.log"].entries == 4 and by["source", "auth.log"].parse_errors == 1
    assert by["total", ""].parse_errors == 5
    assert by["level", "warn"].entries == 1


@pytest.mark.parametrize("block", [1, 13, 10_000])
def test_years_follow_the_order_of_lines(spark, block, monkeypatch):
    """Four years in one file, with late lines around New Year, cut into blocks; the true years come out."""
    rng = random.Random(block)
    rows, truth = [], {}

    def add(name, times):
        for i, t in enumerate(times):
            truth[name, 7 * i + 3] = t
            rows.append((name, 7 * i + 3, f"{t:%b} {t.day:2d} {t:%H:%M:%S} h app[1]: m", "syslog"))

    def climb(start, days, most):
        at, out = start, []
        while at < start + timedelta(days=days):
            late = timedelta(days=rng.choice([0, 0, 0, 1, 5])) if rng.random() < 0.2 else timedelta()
            out.append(at - late)
            at += timedelta(seconds=rng.uniform(0, most * 86400))
        return [t.replace(microsecond=0) for t in out]

    add("/a", climb(datetime(2022, 3, 1), 1490, 20))
    add("/b", climb(datetime(2023, 12, 20), 20, 1))
    add("/c", climb(datetime(2024, 2, 1), 800, 200))
    add("/leap", [datetime(2024, 2, 28, 1), datetime(2024, 2, 29, 1), datetime(2024, 3, 1, 1)] + [datetime(2025, 1, 1), datetime(2025, 12, 20)])
    for i in range(100):
        rows.append(("/noise", i, f"{'Jan' if i % 2 else 'Jul'}  1 00:00:00 h app[1]: m", "syslog"))
    rows += [("/a", 5, "no date here", "syslog"), ("/a", 6, "Foo  3 00:00:00 h app: m", "syslog"), ("/web", 1, "Jan  1 00:00:00 x", "access")]
    monkeypatch.setattr(years, "MOST_CHANGES", 30)
    lines = spark.createDataFrame(rows, "source_file string, line_no bigint, value string, format string").repartition(5)
    found = years.syslog_years(lines, REF, block=block)
    table = {r.source_file: r for r in found.collect()}
    assert set(table) == {"/a", "/b", "/c", "/leap"} and table["/a"].last_year == 2026
    ends = {name: max(n for f, n in truth if f == name) for name, _ in truth}
    want = {k: t for k, t in truth.items() if truth[k[0], ends[k[0]]].year == table[k[0]].last_year}
    assert {k[0] for k in want} >= {"/a", "/leap"}
    got = nrm.normalize(
        years.with_years(lines, found).withColumns({"job_id": F.lit("j"), "host": F.lit("h")}), kinds=["syslog"], reference_ts=REF)
    times = {(r.source_file, r.line_no): r.ts for r in got.collect() if r.ts is not None}
    assert {k: times[k] for k in want} == want
    assert ("/noise", 3) in times  # by the reference alone
