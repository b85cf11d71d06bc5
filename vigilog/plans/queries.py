"""The registered queries: every operator over whole tables, each with the SQL that must agree.

Log lines are rendered from the tables and parsed back by the real operators, while the SQL states
the expected fields straight from the tables.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilog.functions import lookups as L
from vigilog.operators import correlate as cor
from vigilog.operators import coverage as cov
from vigilog.operators import detect as det
from vigilog.operators import findings as fnd
from vigilog.operators import integrity, merkle, summary
from vigilog.operators import literal_index as lix
from vigilog.operators import normalize as nrm
from vigilog.operators import timeline as tml
from vigilog.operators import years as yrs
from vigilog.plans import adapter as A
from vigilog.plans.analysis import find_matches
from vigilog.session import configure, shared_folder, spread, stored
from vigilog.sources.rules import RuleSet
from vigilog.sources.sinks import write_logs


def _rule(rule_id, severity, confidence, service, detection, **more) -> dict:
    return {
        "id": rule_id, "title": f"Rule {rule_id}", "category": "test", "subcategory": "tables",
        "mitre_technique": "T0000", "mitre_tactic": "discovery", "severity": severity,
        "confidence": confidence, "service": service, "detection": detection,
        "description": f"About {rule_id}.", "recommendation": f"Look into {rule_id}.",
        "false_positives": ["Routine work"], **more,
    }


def _patterns(*regexes, **more) -> dict:
    return {"patterns": [{"regex": r} for r in regexes], **more}


RULES = RuleSet.from_dicts({
    "auth/burst.yaml": _rule("AUTH-1", "high", "medium", "sshd", _patterns(
        r"^Failed password for (?P<user>u[0-9]+) from (?P<src_ip>10\.0\.[0-9]+\.[0-9]+) port (?P<port>22) ssh2$",
        type="threshold", aggregation={"field": "user", "count": 3, "window_seconds": 86400},
    )),
    "auth/then_purchase.yaml": _rule("SEQ-1", "info", "high", "*", {
        "type": "sequence", "within_seconds": 3600,
        "steps": [{"regex": "failed PASSWORD for"}, {"regex": r'"POST /purchase\?'}],
    }),
    "web/agent.yaml": _rule("WEB-1", "low", "low", "nginx", _patterns(
        r'"agent/(?P<short>\d)"', r'"agent/(?P<long>\d+)"', type="pattern",
    )),
    "web/command.yaml": _rule("WEB-2", "critical", "medium", "*", _patterns(
        r"[?&]cmd=(?P<cmd>\d+) HTTP", type="pattern",
    )),
    "web/denied.yaml": _rule("WEB-3", "medium", "low", "nginx", _patterns(
        r'" 401 \d+ ', type="threshold",
        aggregation={"field": "src_ip", "count": 4, "window_sec": 172800},
    )),
    "web/disabled.yaml": _rule("WEB-4", "high", "high", "*", _patterns("HTTP", type="pattern"), enabled=False),
    "web/traversal.yaml": _rule("WEB-5", "high", "high", "nginx", _patterns(
        r"(?:GET|HEAD) (?P<path>\S*\.\./\S*) HTTP", type="pattern",
    )),
    "web/nobody.yaml": _rule("WEB-6", "high", "high", "tomcat", _patterns("GET", type="pattern")),
})
DOCUMENT_RULES = RuleSet.from_dicts({
    "text/address.yaml": _rule("TXT-1", "low", "low", "*", _patterns(
        r"\b(?P<src_ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b", type="pattern",
    )),
    "text/secret.yaml": _rule("TXT-2", "high", "medium", "text", _patterns(
        r'token = "(?P<token>[0-9a-f]+)', r"(?:password|passwd|secret)\W+(?P<secret>\w+)", type="pattern",
    )),
    "text/words.yaml": _rule("TXT-3", "info", "low", "*", _patterns(
        r"copyright|licensed under", r"^the .* and the", type="pattern",
    )),
})


def _lines(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    return A.event_lines(spread(A.read(spark, d, "events")))


def _logs(spark: SparkSession, d: str) -> DataFrame:
    return nrm.normalize(_lines(spark, d), kinds=A.EVENT_FORMATS, reference_ts=A.REFERENCE_TS)


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return find_matches(_logs(spark, d), RULES)


def _hits(spark: SparkSession, d: str, *types: str) -> DataFrame:
    return stored(det.search_rules(_logs(spark, d), RULES, types))


# --------------------------------------------------------------------------- SQL parts

EVENTS = """
ev AS (
  SELECT event_id AS line_no, date_trunc('second', ts) AS ts, user_id, event_type,
         CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k,
         '20240131_000000_h' || (user_id % 4) AS job_id, event_type = 'error' AS err
  FROM events
),
lg AS (
  SELECT line_no, ts, job_id, event_type, k, err,
         CAST(epoch(ts) AS DOUBLE) AS ts_epoch,
         strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS "timestamp",
         CASE WHEN err THEN 'h' || (user_id % 4) ELSE 'webserver' END AS hostname,
         CASE WHEN err THEN 'sshd' ELSE 'nginx' END AS service,
         CASE WHEN err THEN CAST(user_id + 1000 AS VARCHAR) ELSE '' END AS pid,
         CASE WHEN event_type = 'signup' THEN 'error' ELSE 'info' END AS level,
         '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS src_ip,
         'u' || user_id AS usr,
         CASE event_type WHEN 'view' THEN '/view/' || k WHEN 'click' THEN '/click?k=' || k
              WHEN 'purchase' THEN '/purchase?cmd=' || k WHEN 'signup' THEN '/signup/../etc/' || k END AS uri,
         CASE event_type WHEN 'view' THEN '200' WHEN 'click' THEN '302'
              WHEN 'purchase' THEN '201' WHEN 'signup' THEN '401' END AS status,
         CASE WHEN event_type = 'purchase' THEN 'POST' WHEN err THEN NULL ELSE 'GET' END AS method,
         '/jobs/' || job_id || '/01_evidence/raw/logs/' ||
           CASE WHEN err THEN 'var_log_auth.log' ELSE 'nginx_access.log' END AS source_file
  FROM ev
),
logs AS (
  SELECT *, CASE WHEN err THEN 'Failed password for ' || usr || ' from ' || src_ip || ' port 22 ssh2'
            ELSE method || ' ' || uri || ' HTTP/1.1 -> ' || status END AS message
  FROM lg
)"""

MATCHES = EVENTS + """,
burst AS (
  SELECT DISTINCT job_id, usr FROM (
    SELECT job_id, usr, ts, lead(ts, 2) OVER (PARTITION BY job_id, usr ORDER BY ts) AS nth
    FROM logs WHERE err)
  WHERE epoch(nth) - epoch(ts) <= 86400
),
denied AS (
  SELECT DISTINCT job_id, src_ip FROM (
    SELECT job_id, src_ip, ts, lead(ts, 3) OVER (PARTITION BY job_id, src_ip ORDER BY ts) AS nth
    FROM logs WHERE status = '401')
  WHERE epoch(nth) - epoch(ts) <= 172800
),
pair_count AS (
  SELECT a.job_id, a.line_no AS line_a, b.line_no AS line_b
  FROM (SELECT * FROM logs WHERE err) a JOIN (SELECT * FROM logs WHERE event_type = 'purchase') b
    ON a.job_id = b.job_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 3600 SECOND
),
matches AS (
  SELECT 'auth/burst.yaml' AS rule_path, 0 AS pattern_idx, 1 AS weight, '22' AS port, logs.*
    FROM logs SEMI JOIN burst USING (job_id, usr) WHERE err
  UNION ALL
  SELECT 'web/agent.yaml', CASE WHEN length(k) = 1 THEN 0 ELSE 1 END, 1, NULL, logs.* FROM logs WHERE NOT err
  UNION ALL
  SELECT 'web/command.yaml', 0, 1, NULL, logs.* FROM logs WHERE event_type = 'purchase'
  UNION ALL
  SELECT 'web/denied.yaml', 0, 1, NULL, logs.* FROM logs SEMI JOIN denied USING (job_id, src_ip) WHERE status = '401'
  UNION ALL
  SELECT 'web/traversal.yaml', 0, 1, NULL, logs.* FROM logs WHERE event_type = 'signup'
  UNION ALL
  SELECT 'auth/then_purchase.yaml', 0, n, NULL, logs.* FROM logs
    JOIN (SELECT line_a, count(*) AS n FROM pair_count GROUP BY 1) ON line_a = line_no
  UNION ALL
  SELECT 'auth/then_purchase.yaml', 1, n, NULL, logs.* FROM logs
    JOIN (SELECT line_b, count(*) AS n FROM pair_count GROUP BY 1) ON line_b = line_no
),
rules(rule_path, rule_id, severity, confidence, sev_rank) AS (VALUES
  ('auth/burst.yaml', 'AUTH-1', 'high', 'medium', 1),
  ('auth/then_purchase.yaml', 'SEQ-1', 'info', 'high', 4),
  ('web/agent.yaml', 'WEB-1', 'low', 'low', 3),
  ('web/command.yaml', 'WEB-2', 'critical', 'medium', 0),
  ('web/denied.yaml', 'WEB-3', 'medium', 'low', 2),
  ('web/traversal.yaml', 'WEB-5', 'high', 'high', 1)
),
found AS (
  SELECT job_id, rule_path, CAST(sum(weight) AS BIGINT) AS match_count,
         arg_min("timestamp", (ts, source_file, line_no)) AS first_seen,
         arg_max("timestamp", (ts, source_file, line_no)) AS last_seen
  FROM matches GROUP BY 1, 2
),
findings AS (
  SELECT found.*, rule_id, severity, confidence, sev_rank,
         CASE WHEN confidence = 'high' AND match_count >= 3 THEN 'confirmed'
              WHEN confidence IN ('high', 'medium') AND match_count >= 1 THEN 'highly_probable'
              WHEN confidence = 'medium' THEN 'suspicious' ELSE 'insufficient_evidence' END AS status
  FROM found JOIN rules USING (rule_path)
)"""

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


# --------------------------------------------------------------------------- parsing

PARSED = """SELECT job_id, line_no, ts_epoch, "timestamp", hostname, service, pid, level, message,
  source_file, src_ip, usr AS "user", uri, status AS http_status, method AS http_method,
  CASE WHEN err THEN NULL ELSE 'agent/' || k END AS user_agent FROM logs"""
FIELDS = ("src_ip", "user", "uri", "http_status", "http_method", "user_agent")
BASE = ("job_id", "line_no", "ts_epoch", "timestamp", "hostname", "service", "pid", "level", "message")


def _flat(logs: DataFrame, *more) -> DataFrame:
    return logs.select(
        *BASE, *more, *[F.try_element_at("extracted", F.lit(f)).alias(f) for f in FIELDS]
    )


@query("parse_syslog", f"WITH {EVENTS} {PARSED} WHERE err")
def parse_syslog(spark, d):
    return _flat(_logs(spark, d).filter(F.col("format") == "syslog"), "source_file")


@query("parse_access", f"WITH {EVENTS} {PARSED} WHERE NOT err")
def parse_access(spark, d):
    return _flat(_logs(spark, d).filter(F.col("format") == "access"), "source_file")


@query("detect_format", f"""WITH {EVENTS} SELECT DISTINCT source_file,
  CASE WHEN err THEN 'syslog' ELSE 'access' END AS format FROM lg""")
def detect_format(spark, d):
    return nrm.detect_format(_lines(spark, d).drop("format"))


#: Name and first lines of a file, by the customer's number, and the format that they mean.
SAMPLES = (
    ("auth", "Apr  3 08:01:12 h1 sshd[12]: Failed password", "syslog"),
    ("site_access", "anything at all", "access"),
    ("nginx_error", "[Mon Apr 13 14:30:00 2026] [error] no such file", "error"),
    ("db_error", "Apr  3 08:01:12 h1 db: stopped", "syslog"),
    ("trail", "type=USER_AUTH msg=audit(1744531200.123:42): pid=77", "audit"),
    ("dump", '\n\n  {"ts_epoch": 1, "source_file": "x"}', "entry_jsonl"),
    ("journal_x.json.gz", "not even JSON", "journal"),
    ("export", '{"__REALTIME_TIMESTAMP": "1"}\n{}', "journal"),
    ("app", "2026-04-13T14:30:00Z ERROR disk full", "generic"),
    ("notes", "to do\nApr  3 08:01:12 h1 sshd[12]: later lines do not count", "generic"),
    ("access_error", "type=X msg=audit(1.1:1): names come first", "access"),
    ("httpd_error", '{"ts_epoch": 1, "source_file": "content comes first"}', "entry_jsonl"),
)


@query("detect_all_formats", "SELECT '/logs/' || c_custkey || '/' || CASE c_custkey % 12 "
       + " ".join(f"WHEN {i} THEN '{name}'" for i, (name, _, _) in enumerate(SAMPLES)) + " END AS source_file, CASE c_custkey % 12 "
       + " ".join(f"WHEN {i} THEN '{fmt}'" for i, (_, _, fmt) in enumerate(SAMPLES)) + " END AS format FROM customer")
def detect_all_formats(spark, d):
    """A file per customer, of every kind that detection tells apart."""
    configure(spark)
    kinds = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(head).alias("head")) for name, head, _ in SAMPLES])
    kind = F.element_at(kinds, (F.col("c_custkey") % len(SAMPLES) + 1).cast("int"))
    files = A.read(spark, d, "customer").select(
        F.concat(F.lit("/logs/"), "c_custkey", F.lit("/"), kind["name"]).alias("source_file"),
        F.posexplode(F.split(kind["head"], "\n")).alias("line_no", "value"))
    return nrm.detect_format(files.withColumn("line_no", F.col("line_no").cast("bigint")))


def _table_lines(df: DataFrame, key, value, name: str, fmt: str) -> DataFrame:
    return df.select(
        F.lit("20240131_000000_db").alias("job_id"), F.lit("db").alias("host"),
        F.lit(f"/jobs/20240131_000000_db/01_evidence/raw/logs/{name}").alias("source_file"),
        key.cast("bigint").alias("line_no"), value.alias("value"), F.lit(fmt).alias("format"),
    )


@query("parse_journal", """SELECT conv_id * 1000 + turn AS line_no,
  CAST(1704067200 + conv_id * 60 + turn AS DOUBLE) + 0.5 AS ts_epoch,
  strftime(to_timestamp(1704067200 + conv_id * 60 + turn) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '.500000+00:00' AS "timestamp",
  'c' || (conv_id % 4) AS hostname, role AS service, CAST(turn AS VARCHAR) AS pid,
  ['emerg','alert','crit','error','warn','notice','info','debug'][(turn % 8) + 1] AS level,
  left(text, 4096) AS message FROM conversations""")
def parse_journal(spark, d):
    configure(spark)
    c = spread(A.read(spark, d, "conversations"))
    seconds = F.col("conv_id") * 60 + F.col("turn") + 1704067200
    record = F.to_json(F.struct(
        (seconds * 1_000_000 + 500_000).cast("string").alias("__REALTIME_TIMESTAMP"),
        F.concat(F.lit("c"), F.col("conv_id") % 4).alias("_HOSTNAME"),
        F.col("role").alias("SYSLOG_IDENTIFIER"), F.col("turn").cast("string").alias("_PID"),
        (F.col("turn") % 8).cast("string").alias("PRIORITY"), F.col("text").alias("MESSAGE"),
    ))
    lines = _table_lines(c, F.col("conv_id") * 1000 + F.col("turn"), record, "journal_system_72h.json", "journal")
    return nrm.normalize(lines, kinds=["journal"]).select(
        "line_no", "ts_epoch", "timestamp", "hostname", "service", "pid", "level", "message"
    )


@query("parse_entry_jsonl", """SELECT o_orderkey AS line_no, CAST(epoch(o_orderdate) AS DOUBLE) AS ts_epoch,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS "timestamp", 'n' || (o_custkey % 7) AS hostname,
  CASE o_orderstatus WHEN 'F' THEN 'nginx' ELSE o_orderstatus END AS service,
  CAST(o_custkey AS VARCHAR) AS pid, 'info' AS level, o_orderpriority AS message,
  CAST(o_orderkey AS VARCHAR) AS field FROM orders""")
def parse_entry_jsonl(spark, d):
    configure(spark)
    o = spread(A.read(spark, d, "orders"))
    ts = F.col("o_orderdate").cast("timestamp")
    service = F.when(F.col("o_orderstatus") == "F", "unknown").otherwise(F.col("o_orderstatus"))
    record = F.to_json(F.struct(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.unix_seconds(ts).alias("ts_epoch"),
        F.concat(F.lit("n"), F.col("o_custkey") % 7).alias("hostname"), service.alias("service"),
        F.col("o_custkey").cast("string").alias("pid"), F.lit("info").alias("level"),
        F.col("o_orderpriority").alias("message"), F.lit("x").alias("source_file"),
        F.lit("not an access line").alias("raw"),
        F.create_map(F.lit("field"), F.col("o_orderkey").cast("string")).alias("extracted"),
    ))
    lines = _table_lines(o, F.col("o_orderkey"), record, "nginx_orders.jsonl", "entry_jsonl")
    return nrm.normalize(lines, kinds=["entry_jsonl"]).select(
        "line_no", "ts_epoch", "timestamp", "hostname", "service", "pid", "level", "message",
        F.try_element_at("extracted", F.lit("field")).alias("field"),
    )


AUDIT_TYPES = ("USER_AUTH", "SYSCALL", "AVC", "ANOM_ABEND", "EOE", "USER_CMD", "KERN_MODULE")


@query("parse_audit", """SELECT l_orderkey * 10 + l_linenumber AS line_no,
  CAST(epoch(l_shipdate) AS DOUBLE) AS ts_epoch,
  strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS "timestamp",
  ['pam','audit-syscall','selinux','auditd','auditd','sudo','kernel'][(l_linenumber % 7) + 1] AS service,
  CAST(l_partkey AS VARCHAR) AS pid,
  CASE WHEN l_linenumber % 7 IN (2, 3, 6) THEN 'warn' ELSE 'info' END AS level,
  'type=' || ['USER_AUTH','SYSCALL','AVC','ANOM_ABEND','EOE','USER_CMD','KERN_MODULE'][(l_linenumber % 7) + 1]
    || ' ppid=1 pid=' || l_partkey || ' uid=' || l_suppkey || ' res=' || l_returnflag AS message
  FROM lineitem""")
def parse_audit(spark, d):
    configure(spark)
    li = spread(A.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_returnflag"))
    kind = F.element_at(F.array(*[F.lit(t) for t in AUDIT_TYPES]), F.col("l_linenumber") % 7 + 1)
    record = F.concat(
        F.lit("type="), kind, F.lit(" msg=audit("), F.unix_seconds(F.col("l_shipdate").cast("timestamp")),
        F.lit(".123:"), F.col("l_orderkey"), F.lit("): ppid=1 pid="), F.col("l_partkey"), F.lit(" uid="),
        F.col("l_suppkey"), F.lit(" res="), F.col("l_returnflag"),
    )
    lines = _table_lines(li, F.col("l_orderkey") * 10 + F.col("l_linenumber"), record, "audit.log", "audit")
    return nrm.normalize(lines, kinds=["audit"]).select("line_no", "ts_epoch", "timestamp", "service", "pid", "level", "message")


@query("parse_error_log", """SELECT c_custkey AS line_no, 'apache2_error' AS service, lower(c_mktsegment) AS level,
  ' [client 10.1.0.' || c_nationkey || '] ' || c_name AS message,
  CAST(1704067200 + c_custkey AS DOUBLE) AS ts_epoch FROM customer""")
def parse_error_log(spark, d):
    configure(spark)
    c = spread(A.read(spark, d, "customer"))
    at = F.timestamp_seconds(F.col("c_custkey") + 1704067200)
    record = F.concat(
        F.lit("["), F.date_format(at, "EEE MMM dd HH:mm:ss yyyy"), F.lit("] ["), F.col("c_mktsegment"),
        F.lit("] [client 10.1.0."), F.col("c_nationkey"), F.lit("] "), F.col("c_name"),
    )
    lines = _table_lines(c, F.col("c_custkey"), record, "apache2_error.log", "error")
    return nrm.normalize(lines, kinds=["error"]).select("line_no", "service", "level", "message", "ts_epoch")


@query("parse_generic", """SELECT o_orderkey AS line_no, 'app' AS service,
  CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'O' THEN 'info' ELSE 'warning' END AS level,
  CASE o_orderstatus WHEN 'F' THEN '' WHEN 'O' THEN 'order ' ELSE '' END || o_orderpriority AS message,
  CAST(epoch(o_orderdate) AS DOUBLE) - 7200 + 0.25 AS ts_epoch FROM orders""")
def parse_generic(spark, d):
    configure(spark)
    o = spread(A.read(spark, d, "orders"))
    word = F.when(F.col("o_orderstatus") == "F", "[ERROR] ").when(F.col("o_orderstatus") == "O", "order ").otherwise("Warning ")
    at = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    record = F.concat(at, F.lit(".25+0200 "), word, F.col("o_orderpriority"))
    lines = _table_lines(o, F.col("o_orderkey"), record, "app.log", "generic")
    return nrm.normalize(lines, kinds=["generic"]).select("line_no", "service", "level", "message", "ts_epoch")


@query("text_to_entries", f"""WITH {EVENTS} SELECT job_id, line_no,
  CASE WHEN err THEN ts_epoch END AS ts_epoch, CASE WHEN err THEN hostname ELSE 'host0' END AS hostname,
  CASE WHEN err THEN 'sshd' ELSE 'unknown' END AS service, pid,
  CASE WHEN err THEN message ELSE src_ip || ' - ' || usr || strftime(ts, ' [%d/%b/%Y:%H:%M:%S +0000] "') || method || ' ' || uri
    || ' HTTP/1.1" ' || status || ' 12 "-" "agent/' || k || '"' END AS message FROM logs""")
def text_to_entries(spark, d):
    rows = nrm.structure_text(_lines(spark, d), "host0", reference_ts=A.REFERENCE_TS)
    return rows.select("job_id", "line_no", "ts_epoch", "hostname", "service", "pid", "message")


YEARS_REF = datetime(2002, 3, 1)


@query("syslog_years", """SELECT 'app' || (o_custkey % 4) AS host,
  epoch_us(o_orderdate + INTERVAL (o_orderkey % 80000) SECOND) // 1000000 AS second, count(*) AS entries
  FROM orders GROUP BY 1, 2""")
def syslog_years(spark, d):
    """Orders of seven years as syslog lines without years, four files in order of time."""
    orders = A.read(spark, d, "orders")
    host = F.concat(F.lit("app"), F.expr("o_custkey % 4"))
    at = F.expr("CAST(o_orderdate AS timestamp) + make_interval(0, 0, 0, 0, 0, 0, o_orderkey % 80000)")
    lines = orders.select(
        F.lit("20020301_000000_app").alias("job_id"), host.alias("host"),
        F.concat(F.lit("/jobs/20020301_000000_app/01_evidence/raw/logs/var_log_"), host).alias("source_file"),
        (F.unix_micros(at) + F.col("o_orderkey") % 1_000_000).alias("line_no"),
        F.concat(F.date_format(at, "MMM dd HH:mm:ss "), host, F.lit(" app[1]: order "), "o_orderkey").alias("value"),
        F.lit("syslog").alias("format"),
    )
    years = yrs.syslog_years(lines, YEARS_REF, block=10 * 86_400_000_000)
    logs = nrm.normalize(yrs.with_years(lines, years), kinds=["syslog"], reference_ts=YEARS_REF)
    return logs.groupBy(F.col("hostname").alias("host"), F.unix_seconds("ts").alias("second")).agg(F.count("*").alias("entries"))


@query("log_stats", f"""WITH {EVENTS}, s AS (
  SELECT CASE WHEN grouping(src) = 0 THEN 'source' WHEN grouping(service) = 0 THEN 'service'
              WHEN grouping(level) = 0 THEN 'level' ELSE 'total' END AS dimension,
         coalesce(src, service, level, '') AS "value", count(*) AS entries,
         CAST(0 AS BIGINT) AS parse_errors, min("timestamp") AS earliest, max("timestamp") AS latest
  FROM (SELECT *, CASE WHEN err THEN 'var_log_auth.log' ELSE 'nginx_access.log' END AS src FROM logs)
  GROUP BY GROUPING SETS ((src), (service), (level), ()))
  SELECT * FROM s""")
def log_stats(spark, d):
    return tml.log_stats(nrm.parse_lines(_lines(spark, d), kinds=A.EVENT_FORMATS, reference_ts=A.REFERENCE_TS))


# --------------------------------------------------------------------------- correlations


@query("top_ips", f"""WITH {EVENTS} SELECT src_ip, count(*) AS event_count, count(DISTINCT service) AS services_touched,
  min("timestamp") AS first_seen, max("timestamp") AS last_seen FROM logs
  GROUP BY src_ip ORDER BY event_count DESC, src_ip LIMIT 25""")
def top_ips(spark, d):
    return cor.top_ips_by_activity(_logs(spark, d))


@query("top_ips_offsets", f"""WITH {EVENTS} SELECT src_ip, count(*) AS event_count,
  count(DISTINCT service) AS services_touched,
  strftime(min(ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS first_seen,
  strftime(max(ts), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS last_seen FROM logs
  GROUP BY src_ip ORDER BY event_count DESC, src_ip LIMIT 25""")
def top_ips_offsets(spark, d):
    """Web servers of three time zones: times must be compared as instants."""
    configure(spark)
    lines = A.event_lines(spread(A.read(spark, d, "events")), offsets=True)
    return cor.top_ips_by_activity(nrm.normalize(lines, kinds=A.EVENT_FORMATS, reference_ts=A.REFERENCE_TS))


LONG_URI = """long AS (
  SELECT page_id, '/' || repeat('p', CAST(least(greatest(length(html), 0), 3000) AS INTEGER)) || '/../../etc/passwd' AS uri FROM pages)"""


@query("long_line_matches", f"""WITH {LONG_URI} SELECT page_id AS line_no, 'LONG-' || n AS rule_id FROM long,
  (SELECT unnest([1, 2, 3]) AS n)""")
def long_line_matches(spark, d):
    """Access lines whose URI alone may exceed 1,024 characters: nothing after it may be missed."""
    configure(spark)
    uri = F.concat(F.lit("/"), F.repeat(F.lit("p"), F.least(F.length("html"), F.lit(3000))), F.lit("/../../etc/passwd"))
    lines = A.read(spark, d, "pages").select(
        F.lit("20240131_000000_web").alias("job_id"), F.lit("web").alias("host"),
        F.lit("/jobs/web/01_evidence/raw/logs/nginx_access.log").alias("source_file"), F.col("page_id").alias("line_no"),
        F.concat(F.lit('10.0.0.8 - - [13/Jan/2024:14:30:00 +0000] "GET '), uri, F.lit(' HTTP/1.1" 200 12 "-" "scanner/1"')).alias("value"),
        F.lit("access").alias("format"))
    rules = RuleSet.from_dicts({f"long/{n}.yaml": _rule(f"LONG-{n}", "high", "high", "*", _patterns(p, type="pattern")) for n, p in (
        (1, r"/\.\./\.\./etc/passwd HTTP"), (2, r'"scanner/\d"$'), (3, r"^GET .* -> 200"))})
    logs = nrm.normalize(lines, kinds=["access"], reference_ts=A.REFERENCE_TS)
    return det.search_rules(logs, rules).select("line_no", "rule_id")


@query("top_users", f"""WITH {EVENTS} SELECT usr AS username, count(*) AS event_count, count(DISTINCT service) AS services_touched,
  min("timestamp") AS first_seen, max("timestamp") AS last_seen FROM logs
  WHERE usr NOT IN ('', '-', 'root') GROUP BY usr ORDER BY event_count DESC, usr LIMIT 20""")
def top_users(spark, d):
    return cor.top_users_by_events(_logs(spark, d))


@query("top_ips_by_job", f"""WITH {EVENTS} SELECT job_id, src_ip, count(*) AS event_count, count(DISTINCT service) AS services_touched,
  min("timestamp") AS first_seen, max("timestamp") AS last_seen FROM logs
  GROUP BY job_id, src_ip QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY count(*) DESC, src_ip) <= 25""")
def top_ips_by_job(spark, d):
    return cor.top_ips_by_activity(_logs(spark, d), ("job_id",))


@query("events_by_service", f"""WITH {EVENTS} SELECT service, count(*) AS total, count(DISTINCT hostname) AS hosts
  FROM logs GROUP BY service""")
def events_by_service(spark, d):
    return cor.events_by_service(_logs(spark, d))


@query("events_by_level", f"WITH {EVENTS} SELECT level, count(*) AS total FROM logs GROUP BY level")
def events_by_level(spark, d):
    return cor.events_by_level(_logs(spark, d))


ERRORS = """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS hour_bucket, count(*) AS error_count
  FROM logs WHERE level IN ('error', 'crit', 'alert', 'emerg', 'warn') GROUP BY 1"""


@query("errors_over_time", f"WITH {EVENTS} {ERRORS} ORDER BY 1 LIMIT 72")
def errors_over_time(spark, d):
    return cor.errors_over_time(_logs(spark, d))


@query("latest_error_hours", f"WITH {EVENTS} {ERRORS} ORDER BY 1 DESC LIMIT 72")
def latest_error_hours(spark, d):
    return cor.errors_over_time(_logs(spark, d), latest=True)


@query("auth_failures_by_ip", f"""WITH {EVENTS} SELECT src_ip, count(*) AS failure_count,
  min("timestamp") AS first_seen, max("timestamp") AS last_seen FROM logs
  WHERE message ILIKE '%failed password%' OR message ILIKE '%invalid user%'
     OR message ILIKE '%authentication failure%' OR message ILIKE '%failed login%'
  GROUP BY src_ip HAVING count(*) >= 3 ORDER BY failure_count DESC, src_ip LIMIT 30""")
def auth_failures_by_ip(spark, d):
    return cor.auth_failures_by_ip(_logs(spark, d))


@query("suspicious_uris", f"""WITH {EVENTS} SELECT uri, count(*) AS hit_count, status AS last_status FROM logs
  WHERE uri ILIKE '%../%' OR uri ILIKE '%/etc/%' OR uri ILIKE '%/proc/%' OR uri ILIKE '%union%select%'
     OR uri ILIKE '%<script%' OR uri ILIKE '%cmd=%' OR uri ILIKE '%exec(%'
  GROUP BY uri, status ORDER BY hit_count DESC, uri, last_status LIMIT 30""")
def suspicious_uris(spark, d):
    return cor.suspicious_uris(_logs(spark, d))


@query("suspicious_uri_outcomes", f"""WITH {EVENTS} SELECT uri, count(*) AS hit_count,
  arg_max(status, (ts, source_file, line_no)) AS last_status FROM logs
  WHERE uri ILIKE '%../%' OR uri ILIKE '%cmd=%' GROUP BY uri ORDER BY hit_count DESC, uri LIMIT 30""")
def suspicious_uri_outcomes(spark, d):
    return cor.suspicious_uri_outcomes(_logs(spark, d))


@query("http_status_distribution", f"""WITH {EVENTS} SELECT status AS status_code, count(*) AS count FROM logs
  WHERE status IS NOT NULL GROUP BY status""")
def http_status_distribution(spark, d):
    return cor.http_status_distribution(_logs(spark, d))


# --------------------------------------------------------------------------- timeline


@query("timeline", f"""WITH {EVENTS} SELECT "timestamp", ts_epoch, hostname, service, pid, level, src_ip, usr AS "user",
  coalesce(uri, '') AS uri, coalesce(status, '') AS http_status, message,
  CASE WHEN err THEN 'var_log_auth.log' ELSE 'nginx_access.log' END AS source_file FROM logs""")
def timeline(spark, d):
    return tml.timeline(_logs(spark, d))


@query("top_events", f"""WITH {EVENTS} SELECT "timestamp", service, level, message, src_ip, usr AS "user" FROM logs
  WHERE level = 'error' ORDER BY ts, source_file, line_no LIMIT 50""")
def top_events(spark, d):
    return tml.top_events(_logs(spark, d))


@query("window_filter", f"""WITH {EVENTS} SELECT job_id, line_no, "timestamp" FROM logs
  WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 72 HOUR""")
def window_filter(spark, d):
    rows = tml.filter_window(_logs(spark, d), 72, A.REFERENCE_TS)
    return rows.select("job_id", "line_no", "timestamp")


def _cap_sql(direction: str) -> str:
    return f"""WITH {EVENTS} SELECT source_file, line_no FROM logs
      QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY line_no {direction}) <= 300"""


@query("cap_per_source", _cap_sql("DESC"))
def cap_per_source(spark, d):
    return tml.cap_per_source(_lines(spark, d).select("source_file", "line_no"), 300)


@query("cap_per_source_first", _cap_sql("ASC"))
def cap_per_source_first(spark, d):
    return tml.cap_per_source(_lines(spark, d).select("source_file", "line_no"), 300, "first")


@query("dedupe", f"""WITH {EVENTS},
  told AS (
    SELECT job_id, ts, hostname, service, pid, message, line_no, 'log' AS source FROM logs
    UNION ALL SELECT job_id, ts, hostname, service, pid, message, line_no + 1000000000, 'log' FROM logs WHERE line_no % 5 = 0
    UNION ALL SELECT job_id, ts, hostname, service, pid, message, line_no, 'journal' FROM logs WHERE err AND line_no % 2 = 0),
  counted AS (
    SELECT *, count(*) FILTER (source = 'log') OVER w AS logged, count(*) FILTER (source = 'journal') OVER w AS journaled
    FROM told WINDOW w AS (PARTITION BY job_id, date_trunc('second', ts), hostname, service, pid, message))
  SELECT job_id, line_no, source, message FROM counted WHERE (source = 'log') = (logged > journaled)""")
def dedupe(spark, d):
    # Half of the failed logins stand in a journal too, a moment later; some lines of the log repeat.
    logs = stored(_logs(spark, d))
    again = logs.filter("line_no % 5 = 0").withColumn("line_no", F.col("line_no") + 1000000000)
    journal = logs.filter("service = 'sshd' AND line_no % 2 = 0").withColumns({
        "source_file": F.lit("/jobs/journal.json"), "format": F.lit("journal"),
        "ts": F.date_trunc("second", "ts") + F.make_dt_interval(secs=F.lit(0.25)),
    })
    kept = tml.dedupe(logs.unionByName(again).unionByName(journal))
    source = F.when(F.col("format") == "journal", "journal").otherwise("log")
    return kept.select("job_id", "line_no", source.alias("source"), "message")


# --------------------------------------------------------------------------- detection


@query("service_scope", """SELECT * FROM (VALUES
  ('sshd', 'auth/burst.yaml'), ('sshd', 'auth/then_purchase.yaml'), ('sshd', 'web/command.yaml'),
  ('nginx', 'auth/then_purchase.yaml'), ('nginx', 'web/agent.yaml'), ('nginx', 'web/command.yaml'),
  ('nginx', 'web/denied.yaml'), ('nginx', 'web/traversal.yaml')) t(service, rule_path)
  WHERE service IN (SELECT CASE WHEN event_type = 'error' THEN 'sshd' ELSE 'nginx' END FROM events)""")
def service_scope(spark, d):
    return det.scope(_logs(spark, d), RULES)


_PATTERN_SQL = f"""WITH {EVENTS}
  SELECT job_id, 'web/agent.yaml' AS rule_path, 'WEB-1' AS rule_id, line_no,
         CASE WHEN length(k) = 1 THEN 0 ELSE 1 END AS pattern_idx, k AS captured_value, src_ip FROM logs WHERE NOT err
  UNION ALL SELECT job_id, 'web/command.yaml', 'WEB-2', line_no, 0, k, src_ip FROM logs WHERE event_type = 'purchase'
  UNION ALL SELECT job_id, 'web/traversal.yaml', 'WEB-5', line_no, 0, uri, src_ip FROM logs WHERE event_type = 'signup'"""


def _pattern_columns(hits: DataFrame) -> DataFrame:
    value = F.coalesce(*[F.try_element_at("captured", F.lit(n)) for n in ("short", "long", "cmd", "path")])
    return hits.select(
        "job_id", "rule_path", "rule_id", "line_no", "pattern_idx", value.alias("captured_value"),
        F.try_element_at("captured", F.lit("src_ip")).alias("src_ip"),
    )


@query("pattern_matches", _PATTERN_SQL)
def pattern_matches(spark, d):
    return _pattern_columns(det.detect_pattern(_logs(spark, d), RULES))


@query("pattern_matches_indexed", _PATTERN_SQL)
def pattern_matches_indexed(spark, d):
    """The same from a stored table, of which only the files are opened that the trigrams allow."""
    _lines(spark, d)
    folder = f"{shared_folder(spark)}/vigilog-indexed-{uuid.uuid4().hex}"
    write_logs(_logs(spark, d), f"{folder}/logs")
    lix.build_index(spark, f"{folder}/logs", f"{folder}/index")
    return _pattern_columns(lix.search_table(spark, f"{folder}/logs", f"{folder}/index", RULES, types=("pattern",)))


DOC_LINES = """ln AS (
  SELECT '/docs/' || "source" || '/' || doc_id || '.txt' AS source_file,
         unnest(string_split(text, chr(10))) AS value,
         CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS line_no FROM documents)"""


@query("document_patterns", f"""WITH {DOC_LINES}
  SELECT source_file, line_no, 'TXT-1' AS rule_id, 0 AS pattern_idx,
    regexp_extract(value, '\\b(\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}})\\b', 1) AS captured_value
  FROM ln WHERE regexp_matches(value, '\\b\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\b')
  UNION ALL
  SELECT source_file, line_no, 'TXT-2', CASE WHEN regexp_matches(value, '(?i)token = "[0-9a-f]+') THEN 0 ELSE 1 END,
    CASE WHEN regexp_matches(value, '(?i)token = "[0-9a-f]+') THEN regexp_extract(value, '(?i)token = "([0-9a-f]+)', 1)
         ELSE regexp_extract(value, '(?i)(?:password|passwd|secret)[^\\pL\\pN_]+([\\pL\\pN_]+)', 1) END
  FROM ln WHERE regexp_matches(value, '(?i)token = "[0-9a-f]+|(?:password|passwd|secret)[^\\pL\\pN_]+[\\pL\\pN_]+')
  UNION ALL
  SELECT source_file, line_no, 'TXT-3', CASE WHEN regexp_matches(value, '(?i)copyright|licensed under') THEN 0 ELSE 1 END, NULL
  FROM ln WHERE regexp_matches(value, '(?i)copyright|licensed under|^the .* and the')""")
def document_patterns(spark, d):
    configure(spark)
    lines = A.document_lines(spread(A.read(spark, d, "documents")))
    value = F.coalesce(*[F.try_element_at("captured", F.lit(n)) for n in ("src_ip", "token", "secret")])
    hits = det.detect_pattern(A.lines_as_logs(lines, "text"), DOCUMENT_RULES)
    return hits.select("source_file", "line_no", "rule_id", "pattern_idx", value.alias("captured_value"))


@query("threshold_fired", f"""WITH {MATCHES}
  SELECT job_id, 'auth/burst.yaml' AS rule_path, usr AS key FROM burst
  UNION ALL SELECT job_id, 'web/denied.yaml', src_ip FROM denied""")
def threshold_fired(spark, d):
    hits = _hits(spark, d, "threshold")
    return det.fired_keys(hits, RULES).select("job_id", "rule_path", "key")


@query("threshold_matches", f"""WITH {MATCHES} SELECT job_id, rule_path, line_no, src_ip FROM matches
  WHERE rule_path IN ('auth/burst.yaml', 'web/denied.yaml')""")
def threshold_matches(spark, d):
    rows = det.detect_threshold(_hits(spark, d, "threshold"), RULES)
    return rows.select("job_id", "rule_path", "line_no", F.try_element_at("captured", F.lit("src_ip")).alias("src_ip"))


@query("threshold_keys", f"""WITH {EVENTS}, keyed AS (
  SELECT job_id, 'page' AS rule_path, CASE WHEN event_type = 'view' THEN k END AS key, ts, 2 AS n, 7200 AS w
  FROM logs WHERE event_type IN ('view', 'click')
  UNION ALL SELECT job_id, 'nobody', 'unknown', ts, 4, 14400 FROM logs WHERE status = '401'),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY job_id, rule_path, key ORDER BY ts) AS place FROM keyed)
  SELECT DISTINCT a.job_id, a.rule_path, a.key FROM placed a JOIN placed b
  ON a.job_id = b.job_id AND a.rule_path = b.rule_path AND a.key IS NOT DISTINCT FROM b.key AND b.place = a.place + a.n - 1
  WHERE epoch(b.ts) - epoch(a.ts) <= a.w""")
def threshold_keys(spark, d):
    """Keys of groups that took no part (NULL) and of groups that the rule does not have ('unknown')."""
    rules = RuleSet.from_dicts({
        "page": _rule("KEY-1", "low", "low", "nginx", _patterns(
            r'"GET /(?:view/(?P<page>\d+) |click)', type="threshold", aggregation={"field": "page", "count": 2, "window_sec": 7200})),
        "nobody": _rule("KEY-2", "low", "low", "nginx", _patterns(
            '" 401 ', type="threshold", aggregation={"field": "nobody", "count": 4, "window_sec": 14400}))})
    return det.fired_keys(stored(det.search_rules(_logs(spark, d), rules)), rules).select("job_id", "rule_path", "key")


@query("sequence_pairs", f"""WITH {MATCHES} SELECT job_id, 'auth/then_purchase.yaml' AS rule_path,
  count(*) AS pairs FROM pair_count GROUP BY job_id""")
def sequence_pairs(spark, d):
    return det.sequence_pairs(_hits(spark, d, "sequence"), RULES)


@query("sequence_pairs_fleet", f"""WITH {EVENTS} SELECT 'auth/then_purchase.yaml' AS rule_path, count(*) AS pairs
  FROM (SELECT ts FROM logs WHERE err) a JOIN (SELECT ts FROM logs WHERE event_type = 'purchase') b
  ON b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 3600 SECOND""")
def sequence_pairs_fleet(spark, d):
    return det.sequence_pairs(_hits(spark, d, "sequence"), RULES, ())


@query("sequence_by_user", f"""WITH {EVENTS}, p AS (
  SELECT a.line_no AS x, b.line_no AS y FROM (SELECT * FROM logs WHERE err) a
  JOIN (SELECT * FROM logs WHERE event_type = 'purchase') b ON a.src_ip = b.src_ip
   AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 3600 SECOND)
  SELECT x AS line_no, 0 AS pattern_idx, count(*) AS weight FROM p GROUP BY x
  UNION ALL SELECT y, 1, count(*) FROM p GROUP BY y""")
def sequence_by_user(spark, d):
    rules = RuleSet.from_dicts({"s": _rule("SEQ-2", "info", "high", "*", {
        "type": "sequence", "window_sec": 3600, "patterns": [
            {"regex": r"Failed password for \S+ from (?P<src_ip>\S+)"},
            {"regex": r'^(?P<src_ip>\S+) .*"POST /purchase'},
        ]})})
    hits = stored(det.search_rules(_logs(spark, d), rules))
    rows = det.detect_sequence(hits, rules, (), key="src_ip")
    return rows.select("line_no", "pattern_idx", "weight")


_THREE_SQL = f"""{EVENTS}, s AS (
  SELECT line_no, job_id, ts, CASE WHEN err THEN 0 WHEN event_type = 'signup' THEN 1 WHEN event_type = 'purchase' THEN 2 END AS step
  FROM logs),
three AS (
  SELECT a.job_id, a.line_no AS x, b.line_no AS y, c.line_no AS z
  FROM (SELECT * FROM s WHERE step = 0) a
  JOIN (SELECT * FROM s WHERE step = 1) b ON b.job_id = a.job_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 21600 SECOND
  JOIN (SELECT * FROM s WHERE step = 2) c ON c.job_id = b.job_id AND c.ts >= b.ts AND c.ts <= b.ts + INTERVAL 21600 SECOND)"""


def _three_steps(spark, d):
    """A failed login, then a sign-up, then a purchase, each within six hours of the one before."""
    rules = RuleSet.from_dicts({"three": _rule("SEQ-3", "info", "high", "*", {
        "type": "sequence", "window_sec": 21600, "patterns": [
            {"regex": "Failed password"}, {"regex": r'"GET /signup/'}, {"regex": r'"POST /purchase'}]})})
    return stored(det.search_rules(_logs(spark, d), rules)), rules


@query("sequence_three_steps", f"""WITH {_THREE_SQL}
  SELECT job_id, 'three' AS rule_path, count(*) AS pairs FROM three GROUP BY job_id""")
def sequence_three_steps(spark, d):
    return det.sequence_pairs(*_three_steps(spark, d))


@query("sequence_three_steps_hits", f"""WITH {_THREE_SQL}
  SELECT job_id, x AS line_no, 0 AS pattern_idx, count(*) AS weight FROM three GROUP BY job_id, x
  UNION ALL SELECT job_id, y, 1, count(*) FROM three GROUP BY job_id, y
  UNION ALL SELECT job_id, z, 2, count(*) FROM three GROUP BY job_id, z""")
def sequence_three_steps_hits(spark, d):
    return det.detect_sequence(*_three_steps(spark, d)).select("job_id", "line_no", "pattern_idx", "weight")


# --------------------------------------------------------------------------- findings


@query("findings", f"""WITH {MATCHES} SELECT job_id, rule_path, rule_id, severity, confidence, match_count,
  first_seen, last_seen, status FROM findings""")
def findings(spark, d):
    return fnd.order_findings(fnd.build_findings(_matches(spark, d), RULES)).select(
        "job_id", "rule_path", "rule_id", "severity", "confidence", "match_count", "first_seen",
        "last_seen", "status",
    )


ENTITIES = """ent AS (
  SELECT job_id, rule_path, 'src_ip' AS field, src_ip AS "value", weight, ts, source_file, line_no FROM matches WHERE rule_path <> 'auth/then_purchase.yaml'
  UNION ALL SELECT job_id, rule_path, 'user', usr, weight, ts, source_file, line_no FROM matches WHERE rule_path <> 'auth/then_purchase.yaml'
  UNION ALL SELECT job_id, rule_path, 'port', port, weight, ts, source_file, line_no FROM matches WHERE rule_path <> 'auth/then_purchase.yaml'
  UNION ALL SELECT job_id, rule_path, 'uri', uri, weight, ts, source_file, line_no FROM matches WHERE rule_path <> 'auth/then_purchase.yaml'),
ranked AS (
  SELECT job_id, rule_path, field, "value", CAST(sum(weight) AS BIGINT) AS count,
    CAST(row_number() OVER (PARTITION BY job_id, rule_path, field ORDER BY sum(weight) DESC, min((ts, source_file, line_no))) AS INTEGER) AS rank
  FROM ent WHERE "value" IS NOT NULL GROUP BY job_id, rule_path, field, "value")"""


@query("affected_entities", f"""WITH {MATCHES}, {ENTITIES} SELECT * FROM ranked WHERE rank <= 20""")
def affected_entities(spark, d):
    return fnd.affected_entities(_matches(spark, d))


@query("samples", f"""WITH {MATCHES} SELECT job_id, rule_path, line_no, "timestamp", service, hostname, message,
    CAST(row_number() OVER (PARTITION BY job_id, rule_path ORDER BY ts, source_file, line_no) AS INTEGER) AS rank
  FROM matches QUALIFY rank <= 5""")
def samples(spark, d):
    return fnd.sample_matches(_matches(spark, d)).select(
        "job_id", "rule_path", "line_no", "timestamp", "service", "hostname", "message", "rank"
    )


@query("status", f"""WITH {MATCHES} SELECT status, CASE status WHEN 'confirmed' THEN 'Confirmado'
  WHEN 'highly_probable' THEN 'Altamente probable' WHEN 'suspicious' THEN 'Sospechoso'
  ELSE 'Sin evidencia suficiente' END AS status_label, count(*) AS findings FROM findings GROUP BY status""")
def status(spark, d):
    found = fnd.build_findings(_matches(spark, d), RULES)
    return found.groupBy("status", "status_label").agg(F.count("*").alias("findings"))


@query("risk", f"""WITH {MATCHES} SELECT job_id, count(*) FILTER (severity = 'critical') AS critical,
  count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
  count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'info') AS info,
  ['critical','high','medium','low','none'][CAST(min(sev_rank) + 1 AS INTEGER)] AS overall FROM findings GROUP BY job_id""")
def risk(spark, d):
    return fnd.risk(fnd.build_findings(_matches(spark, d), RULES)).drop("overall_label")


@query("priority", f"""WITH {MATCHES} SELECT job_id, rule_id, severity,
  CAST(row_number() OVER (PARTITION BY job_id ORDER BY
    CASE WHEN sev_rank <= 1 THEN 1 WHEN sev_rank = 2 THEN 2 ELSE 3 END, sev_rank, rule_path) AS INTEGER) AS priority,
  CASE WHEN sev_rank <= 1 THEN 'Severity and ' || confidence || ' confidence'
       WHEN sev_rank = 2 THEN 'Requires investigation' ELSE 'Preventive hardening' END AS reason FROM findings""")
def priority(spark, d):
    return fnd.prioritise(fnd.build_findings(_matches(spark, d), RULES)).select(
        "job_id", "rule_id", "severity", "priority", "reason"
    )


@query("remediation", f"""WITH {MATCHES} SELECT job_id, rule_path, rule_id, 'Rule ' || rule_id AS title, severity,
  'Look into ' || rule_id || '.' AS recommendation FROM findings WHERE severity IN ('critical', 'high', 'medium')""")
def remediation(spark, d):
    return fnd.remediation(fnd.build_findings(_matches(spark, d), RULES))


def _system_info(spark, d) -> DataFrame:
    host = F.concat(F.lit("h"), F.col("user_id") % 4)
    return A.read(spark, d, "events").select(
        F.concat(F.lit("20240131_000000_"), host).alias("job_id"), host.alias("hostname"),
        F.lit("Debian").alias("distro_name"), F.lit("12").alias("version_id"),
        F.lit("6.1").alias("kernel"), F.lit("x86_64").alias("architecture"),
        F.lit("systemd").alias("init_system"),
    ).distinct()


@query("finding_context", f"""WITH {MATCHES}, {ENTITIES},
  lines AS (
    SELECT job_id, rule_path, field, field || ':' || chr(10) || string_agg('  - ' || "value" || ' (' || count || ' event(s))', chr(10) ORDER BY rank) AS block
    FROM ranked WHERE rank <= 20 GROUP BY job_id, rule_path, field),
  blocks AS (
    SELECT job_id, rule_path, string_agg(block, chr(10) ORDER BY CASE field WHEN 'src_ip' THEN 1 WHEN 'user' THEN 2 WHEN 'port' THEN 3 ELSE 4 END) AS entities
    FROM lines GROUP BY job_id, rule_path),
  smp AS (
    SELECT job_id, rule_path, "timestamp", service, message,
      row_number() OVER (PARTITION BY job_id, rule_path ORDER BY ts, source_file, line_no) AS rank
    FROM matches QUALIFY rank <= 5),
  texts AS (
    SELECT job_id, rule_path, string_agg('[' || rank || '] ' || "timestamp" || ' | ' || service || chr(10) || '    ' || left(message, 400), chr(10) ORDER BY rank) AS samples
    FROM smp GROUP BY job_id, rule_path)
  SELECT job_id, rule_path, rule_id, severity, concat_ws(chr(10),
    'Operating system  : Debian 12', 'Hostname          : ' || substr(job_id, 17), 'Kernel            : 6.1',
    'Architecture      : x86_64', 'Init system       : systemd',
    'Rule              : ' || rule_id || ' - Rule ' || rule_id, 'Category          : test / tables',
    'Severity          : ' || upper(severity), 'Confidence        : ' || upper(confidence),
    'MITRE technique   : T0000', 'MITRE tactic      : discovery', 'Total events      : ' || match_count,
    'First seen        : ' || first_seen, 'Last seen         : ' || last_seen, 'About ' || rule_id || '.',
    coalesce(entities, ''), samples, 'Look into ' || rule_id || '.', '- Routine work') AS context
  FROM findings LEFT JOIN blocks USING (job_id, rule_path) LEFT JOIN texts USING (job_id, rule_path)""")
def finding_context(spark, d):
    found = fnd.build_findings(_matches(spark, d), RULES)
    return fnd.finding_context(found, _system_info(spark, d))


# --------------------------------------------------------------------------- coverage

UNITS = (
    "sshd", "nginx", "mysql-server", "crond", "systemd-logind", "postgresql@14-main", "dockerd",
    "php-fpm", "Custom-App", "redis-server", "haproxy", "abrt-oops", "suricata",
)
MISSING_FILES = ("services/docker.yaml", "services/haproxy.yaml")
UNIT_SQL = "[" + ", ".join(f"'{u}'" for u in UNITS) + "][(user_id % 13) + 1]"
INVENTORY = f"""seen AS (SELECT DISTINCT '20240131_000000_h' || (user_id % 4) AS job_id, {UNIT_SQL} AS unit FROM events)"""
WEB_SQL = "'web/sqli.yaml','web/path_traversal.yaml','web/lfi_rfi.yaml','web/rce.yaml','web/ssrf.yaml','web/web_scanning.yaml','web/xss.yaml'"
EXPECTED = f"""expected(unit, service, rules, missing) AS (VALUES
  ('sshd', 'sshd', ['linux/auth/ssh_brute_force.yaml','linux/auth/ssh_success_from_new_ip.yaml','linux/auth/failed_logins_spike.yaml'], []),
  ('nginx', 'nginx', ['services/nginx.yaml',{WEB_SQL}], []),
  ('mysql-server', 'mysql', ['services/mysql.yaml'], []),
  ('crond', 'cron', ['linux/process/cron_abuse.yaml'], []),
  ('postgresql@14-main', 'postgresql@14-main', ['services/postgresql.yaml'], []),
  ('dockerd', 'docker', [], ['services/docker.yaml']),
  ('php-fpm', 'php-fpm', ['services/php-fpm.yaml'], []),
  ('Custom-App', 'custom-app', [], []),
  ('redis-server', 'redis', ['services/redis.yaml'], []),
  ('haproxy', 'haproxy', [], ['services/haproxy.yaml']),
  ('abrt-oops', 'abrt-oops', ['services/abrt-oops.yaml'], []),
  ('suricata', 'suricata', ['linux/auth/privilege_escalation.yaml'], []))"""


def _inventories(spark, d) -> DataFrame:
    """Listings of the services whose users appear in the events of each host."""
    configure(spark)
    unit = F.element_at(F.array(*[F.lit(u) for u in UNITS]), (F.col("user_id") % 13 + 1).cast("int"))
    job = F.concat(F.lit("20240131_000000_h"), F.col("user_id") % 4)
    units = A.read(spark, d, "events").select(job.alias("job_id"), unit.alias("unit")).distinct()
    body = F.array_join(F.array_sort(F.collect_list(
        F.concat(F.lit("  "), "unit", F.lit(".service loaded active running Unit "), "unit")
    )), "\n")
    process = F.concat(
        F.lit("root 1 0.0 0.1 1 1 ? Ss 10:00 0:01 /usr/sbin/"), F.lower("unit"), F.lit(": worker")
    )
    noise = F.array(
        F.lit("root 2 0.0 0.1 1 1 ? Ss 10:00 0:01 [kworker/0:0H]"),
        F.lit("root 3 0.0 0.1 1 1 ? Ss 10:00 0:01 -bash"), F.lit("too short"),
        F.lit("root 4 0.0 0.1 1 1 ? Ss 10:00 0:01 /usr/bin/Python3 x.py"),
    )
    return units.groupBy("job_id").agg(
        F.concat(
            F.lit("UNIT LOAD ACTIVE SUB DESCRIPTION\n"), body,
            F.lit("\n\nLOAD = Reflects whether.\nnot.a.unit loaded units listed"),
        ).alias("raw_systemctl"),
        F.array_join(F.concat(noise, F.array_sort(F.collect_list(process))), "\n").alias("raw_ps"),
    )


def _rule_paths(spark) -> DataFrame:
    paths = sorted({p for rules in L.SERVICE_RULES.values() for p in rules} - set(MISSING_FILES))
    return spark.createDataFrame([(p,) for p in paths], "rule_path string").coalesce(1)


@query("service_inventory", f"""WITH {INVENTORY} SELECT job_id, unit || '.service' AS unit, 'loaded' AS load,
  'active' AS active, 'running' AS sub, 'Unit ' || unit AS description FROM seen""")
def service_inventory(spark, d):
    return cov.unit_listing(_inventories(spark, d)).drop("pos")


@query("process_inventory", f"""WITH {INVENTORY} SELECT job_id, lower(unit) AS name FROM seen""")
def process_inventory(spark, d):
    return cov.process_listing(_inventories(spark, d)).drop("pos")


@query("detected_services", f"""WITH {INVENTORY} SELECT job_id,
  CASE WHEN job_id LIKE '%h0' THEN lower(unit) ELSE unit END AS service FROM seen""")
def detected_services(spark, d):
    # On one host the service manager lists nothing, so its process list is read.
    silent = F.when(~F.endswith("job_id", F.lit("h0")), F.col("raw_systemctl"))
    return cov.detected_services(_inventories(spark, d).withColumn("raw_systemctl", silent)).drop("pos")


@query("coverage", f"""WITH {INVENTORY}, {EXPECTED} SELECT job_id, service, array_to_string(rules, ',') AS rules,
  array_to_string(missing, ',') AS missing_rule_files, len(rules) > 0 AS covered FROM seen JOIN expected USING (unit)""")
def coverage(spark, d):
    report = cov.coverage(_inventories(spark, d), _rule_paths(spark))
    return report.select(
        "job_id", "service", F.array_join("rules", ",").alias("rules"),
        F.array_join("missing_rule_files", ",").alias("missing_rule_files"), "covered",
    )


@query("coverage_summary", f"""WITH {INVENTORY}, {EXPECTED} SELECT job_id, count(*) FILTER (len(rules) > 0) AS services_with_rules,
  count(*) FILTER (len(rules) = 0) AS services_without_rules, CAST(sum(len(rules)) AS BIGINT) AS total_applicable_rules
  FROM seen JOIN expected USING (unit) GROUP BY job_id""")
def coverage_summary(spark, d):
    return cov.coverage_summary(cov.coverage(_inventories(spark, d), _rule_paths(spark)))


@query("coverage_gaps", f"""WITH {INVENTORY}, {EXPECTED} SELECT job_id, service,
  'SVC-' || replace(left(upper(service), 20), '-', '_') || '-001' AS proposed_rule_id,
  'services/' || service || '.yaml' AS proposed_path FROM seen JOIN expected USING (unit) WHERE len(rules) = 0""")
def coverage_gaps(spark, d):
    return cov.coverage_gaps(cov.coverage(_inventories(spark, d), _rule_paths(spark)))


OWN_RULES = RuleSet.from_dicts({path: _rule(path, "low", "low", service, _patterns("x", type="pattern"), enabled=path != "own/off.yaml")
    for path, service in {
        "own/all.yaml": "*", "own/app.yaml": "custom", "own/off.yaml": "docker", "own/proxy.yaml": "HAProxy",
        "own/shell.yaml": "ssh", "services/nginx.yaml": "nginx", "own/web.yaml": "ngin"}.items()})
BY_RULES = f"""{INVENTORY}, {EXPECTED}, own_rules(pos, path, field) AS (VALUES
  (1, 'own/app.yaml', 'custom'), (2, 'own/proxy.yaml', 'haproxy'), (3, 'own/shell.yaml', 'ssh'),
  (4, 'services/nginx.yaml', 'nginx'), (5, 'own/web.yaml', 'ngin')),
matched AS (
  SELECT unit, e.service, e.rules, e.missing, coalesce(list(path ORDER BY pos) FILTER (path IS NOT NULL), []) AS own
  FROM expected e LEFT JOIN own_rules ON contains(e.service, field) GROUP BY unit, e.service, e.rules, e.missing),
report AS (
  SELECT job_id, service, list_concat(rules, list_filter(own, lambda x: NOT list_contains(rules, x))) AS rules,
    CASE WHEN len(own) = 0 THEN missing ELSE [] END AS missing FROM seen JOIN matched USING (unit))"""


def _coverage_by_rules(spark, d) -> DataFrame:
    return cov.coverage(_inventories(spark, d), _rule_paths(spark), OWN_RULES)


@query("coverage_by_rules", f"""WITH {BY_RULES} SELECT job_id, service, array_to_string(rules, ',') AS rules,
  array_to_string(missing, ',') AS missing_rule_files, len(rules) > 0 AS covered FROM report""")
def coverage_by_rules(spark, d):
    return _coverage_by_rules(spark, d).select(
        "job_id", "service", F.array_join("rules", ",").alias("rules"),
        F.array_join("missing_rule_files", ",").alias("missing_rule_files"), "covered",
    )


@query("coverage_summary_by_rules", f"""WITH {BY_RULES} SELECT job_id, count(*) FILTER (len(rules) > 0) AS services_with_rules,
  count(*) FILTER (len(rules) = 0) AS services_without_rules, CAST(sum(len(rules)) AS BIGINT) AS total_applicable_rules
  FROM report GROUP BY job_id""")
def coverage_summary_by_rules(spark, d):
    return cov.coverage_summary(_coverage_by_rules(spark, d))


@query("coverage_gaps_by_rules", f"""WITH {BY_RULES} SELECT job_id, service,
  'SVC-' || replace(left(upper(service), 20), '-', '_') || '-001' AS proposed_rule_id,
  'services/' || service || '.yaml' AS proposed_path FROM report WHERE len(rules) = 0""")
def coverage_gaps_by_rules(spark, d):
    return cov.coverage_gaps(_coverage_by_rules(spark, d))


# --------------------------------------------------------------------------- integrity

ARTIFACTS = """art AS (
  SELECT 'docs_' || lang AS job_id, '01_evidence/raw/' || "source" || '/' || doc_id || '.txt' AS relative_path,
    doc_id || '.txt' AS filename, octet_length(encode(text)) AS size_bytes, sha256(text) AS sha256, text, lang, doc_id
  FROM documents)"""


def _artifacts(spark, d) -> DataFrame:
    configure(spark)
    docs = A.read(spark, d, "documents")
    path = F.concat(F.lit("01_evidence/raw/"), "source", F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    return docs.select(
        "doc_id", "lang", F.concat(F.lit("docs_"), "lang").alias("job_id"), path.alias("relative_path"),
        F.encode("text", "UTF-8").alias("content"),
    )


@query("manifest", f"WITH {ARTIFACTS} SELECT job_id, filename, relative_path, CAST(size_bytes AS BIGINT) AS size_bytes, sha256 FROM art")
def manifest(spark, d):
    return integrity.manifest_of(_artifacts(spark, d))


@query("manifest_totals", f"""WITH {ARTIFACTS} SELECT job_id, count(*) AS artifact_count,
  CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes FROM art GROUP BY job_id""")
def manifest_totals(spark, d):
    return integrity.manifest_totals(integrity.manifest_of(_artifacts(spark, d)))


def _tree_sql(digits: int, deepest: int) -> str:
    """The tree of a manifest in plain SQL, to a fixed depth: tables n0, n1, ... of nodes."""
    most = 16 ** digits
    counts = ", ".join(
        f"count(*) OVER (PARTITION BY job_id, left(name, {d * digits})) AS c{d}" for d in range(deepest))
    depth = " ".join(f"WHEN c{d} <= {most} THEN {d}" for d in range(deepest))
    levels = []
    for d in reversed(range(deepest + 1)):
        inner = "" if d == deepest else f"""
  UNION ALL SELECT job_id, left(prefix, {d * digits}), 'node', sum(files),
    sha256('node' || chr(10) || string_agg(right(prefix, {digits}) || ':' || hash, chr(10) ORDER BY prefix))
  FROM n{d + 1} GROUP BY job_id, left(prefix, {d * digits})"""
        levels.append(f"n{d} AS (SELECT job_id, prefix, 'leaf' AS kind, files, hash FROM listed WHERE depth = {d}{inner})")
    return f"""{ARTIFACTS}, leaves AS (
  SELECT DISTINCT job_id, sha256(relative_path) AS name,
    sha256(relative_path) || ':' || sha256(relative_path || chr(9) || size_bytes || chr(9) || sha256) AS entry FROM art),
counted AS (SELECT *, {counts} FROM leaves),
placed AS (SELECT *, CASE {depth} ELSE {deepest} END AS depth FROM counted),
listed AS (
  SELECT job_id, depth, left(name, depth * {digits}) AS prefix, count(*) AS files,
    sha256('leaf' || chr(10) || string_agg(entry, chr(10) ORDER BY entry)) AS hash
  FROM placed GROUP BY job_id, depth, left(name, depth * {digits})),
{", ".join(levels)}"""


@query("manifest_signature", f"WITH {_tree_sql(2, 4)} SELECT job_id, hash AS manifest_sha256 FROM n0")
def manifest_signature(spark, d):
    return integrity.sign(integrity.manifest_of(_artifacts(spark, d)))


@query("manifest_tree", f"WITH {_tree_sql(1, 5)} " + " UNION ALL ".join(
    f"SELECT job_id, {i} AS depth, prefix, kind, CAST(files AS BIGINT) AS files, hash FROM n{i}" for i in range(6)))
def manifest_tree(spark, d):
    return merkle.tree(integrity.manifest_of(_artifacts(spark, d)), digits=1).drop("entries")


@query("manifest_proofs", f"""WITH {ARTIFACTS} SELECT job_id, relative_path, coalesce(toxic, 0) <> 1 AS valid
  FROM art LEFT JOIN labels USING (doc_id)""")
def manifest_proofs(spark, d):
    # Each file is proved from the tree that was signed; afterwards toxic documents have changed.
    files = _artifacts(spark, d)
    signed = stored(merkle.tree(integrity.manifest_of(files), digits=1))
    changed = F.when(F.col("toxic") == 1, F.concat("content", F.encode(F.lit("!"), "UTF-8"))).otherwise(F.col("content"))
    now = integrity.manifest_of(files.join(A.read(spark, d, "labels"), "doc_id", "left").withColumn("content", changed))
    return merkle.verify_proofs(merkle.prove(signed, now, digits=1), now, merkle.root(signed))


_SHORT_COUNTS = ", ".join(f"count(*) OVER (PARTITION BY job_id, left(name, {i})) AS c{i}" for i in range(5))
_SHORT_DEPTH = "CASE " + " ".join(f"WHEN c{i} <= 16 THEN {i}" for i in range(5)) + " ELSE 5 END"


@query("manifest_changes", f"""WITH {ARTIFACTS}, named AS (
  SELECT job_id, sha256(relative_path) AS name, coalesce(toxic, 0) = 1 AS changed FROM art LEFT JOIN labels USING (doc_id)),
sized AS (SELECT *, {_SHORT_COUNTS} FROM named)
  SELECT DISTINCT job_id, left(name, {_SHORT_DEPTH}) AS prefix, 'changed' AS change FROM sized WHERE changed""")
def manifest_changes(spark, d):
    """The branches that name the changed files."""
    files = _artifacts(spark, d)
    changed = F.when(F.col("toxic") == 1, F.concat("content", F.encode(F.lit("!"), "UTF-8"))).otherwise(F.col("content"))
    now = files.join(A.read(spark, d, "labels"), "doc_id", "left").withColumn("content", changed)
    before, after = (merkle.tree(integrity.manifest_of(f), digits=1) for f in (files, now))
    return merkle.changed_branches(before, after)


@query("signature_verify", f"""WITH {ARTIFACTS} SELECT doc_id || '' AS job_id, art.sha256 AS expected,
  CASE WHEN lang = 'es' THEN NULL WHEN toxic = 1 THEN sha256(text || '!') ELSE art.sha256 END AS actual,
  lang <> 'es' AND coalesce(toxic, 0) <> 1 AS valid FROM art LEFT JOIN labels USING (doc_id)""")
def signature_verify(spark, d):
    # Documents stand for manifest files, signed before some changed and some were lost.
    files = _artifacts(spark, d).withColumn("job_id", F.col("doc_id").cast("string"))
    signed = integrity.file_signature(files)
    now = files.filter(F.col("lang") != "es").join(A.read(spark, d, "labels"), "doc_id", "left")
    changed = F.when(F.col("toxic") == 1, F.concat("content", F.encode(F.lit("!"), "UTF-8"))).otherwise(F.col("content"))
    return integrity.verify_signature(now.select("job_id", changed.alias("content")), signed)


@query("manifest_verify", f"""WITH {ARTIFACTS} SELECT job_id, relative_path, filename, art.sha256 AS expected,
  CASE WHEN lang = 'es' THEN NULL WHEN toxic = 1 THEN sha256(text || '!') ELSE art.sha256 END AS actual,
  CASE WHEN lang = 'es' THEN 'missing' WHEN toxic = 1 THEN 'failed' ELSE 'passed' END AS status
  FROM art LEFT JOIN labels USING (doc_id)""")
def manifest_verify(spark, d):
    # Afterwards toxic documents have changed and the Spanish ones are gone.
    stored = _artifacts(spark, d)
    now = stored.filter(F.col("lang") != "es").join(A.read(spark, d, "labels"), "doc_id", "left")
    changed = F.when(F.col("toxic") == 1, F.concat("content", F.encode(F.lit("!"), "UTF-8"))).otherwise(F.col("content"))
    current = integrity.manifest_of(now.withColumn("content", changed))
    return integrity.verify(integrity.manifest_of(stored), current)


# --------------------------------------------------------------------------- acquisition


def _acquisition(spark, d) -> DataFrame:
    configure(spark)
    o = A.read(spark, d, "orders")
    ts = F.col("o_orderdate").cast("timestamp") + F.make_interval(secs=F.col("o_orderkey") % 5000)
    end = F.when(F.col("o_orderstatus") != "P", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    errors = F.transform(
        F.sequence(F.lit(1), (F.col("o_custkey") % 3 + 1).cast("int")),
        lambda i: F.struct(i.alias("phase"), F.lit("cmd").alias("cmd"), F.lit("failed").alias("error")),
    )
    return o.select(
        F.col("o_orderkey").cast("string").alias("job_id"),
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start"),
        end.alias("end"),
        F.array_repeat(F.lit("c"), (F.col("o_custkey") % 5).cast("int")).alias("commands"),
        F.when(F.col("o_orderstatus") != "O", F.array_repeat(F.lit("a"), (F.col("o_custkey") % 4).cast("int"))).alias("artifacts"),
        errors.alias("errors"),
        (F.col("o_orderstatus") == "F").alias("connection_closed"),
    )


@query("acquisition_summary", """SELECT CAST(o_orderkey AS VARCHAR) AS job_id,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' AS start,
  CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate + to_seconds(o_orderkey % 5000), '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS "end",
  CASE WHEN o_orderstatus = 'P' THEN 'N/A' ELSE ((o_orderkey % 5000) // 60) || 'm ' || ((o_orderkey % 5000) % 60) || 's' END AS duration,
  o_custkey % 5 AS commands_logged, CASE WHEN o_orderstatus <> 'O' THEN o_custkey % 4 ELSE 0 END AS artifacts_acquired, o_custkey % 3 + 1 AS errors,
  o_orderstatus = 'F' AS connection_closed FROM orders""")
def acquisition_summary(spark, d):
    return summary.acquisition_summary(_acquisition(spark, d))


@query("acquisition_errors", """SELECT CAST(o_orderkey AS VARCHAR) AS job_id,
  CAST(unnest(range(1, o_custkey % 3 + 2)) AS INTEGER) AS phase, CAST(1 AS BIGINT) AS errors FROM orders""")
def acquisition_errors(spark, d):
    return summary.acquisition_errors(_acquisition(spark, d))
