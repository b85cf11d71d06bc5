"""Log lines rendered from the shared test tables, to be parsed back by the real operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REFERENCE_TS = datetime(2024, 1, 31)
EVENT_FORMATS = ["syslog", "access"]


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def event_lines(events: DataFrame, offsets: bool = False) -> DataFrame:
    """One line per event: errors as sshd syslog, the rest as web access, spread over four hosts.

    With ``offsets``, web servers write the local time of one of three zones.
    """
    # Rendered in two steps, so that each part is computed once.
    events = events.select(
        "*", F.get_json_object("props", "$.k").alias("k"),
        F.date_format(F.col("ts").cast("timestamp") + F.make_interval(hours=_hours(offsets)), "yyyy-MM-dd MMM HH:mm:ss").alias("at"),
    )
    zone = F.element_at(F.array(*[F.lit(z) for z in ("+0000", "+0200", "-0500")]), F.col("event_id").cast("int") % 3 + 1) if offsets else F.lit("+0000")
    k, at = F.col("k"), F.col("at")
    month, clock = F.substring(at, 12, 3), F.substring(at, 16, 8)
    user = F.col("user_id")
    ip = F.concat(F.lit("10.0."), F.expr("user_id div 256"), F.lit("."), F.expr("user_id % 256"))
    host = F.concat(F.lit("h"), F.expr("user_id % 4"))
    job = F.concat(F.lit("20240131_000000_"), host)
    error = F.col("event_type") == "error"
    syslog = F.concat(
        month, F.lit(" "), F.lpad(F.ltrim(F.substring(at, 9, 2), F.lit("0")), 2, " "),
        F.lit(" "), clock, F.lit(" "), host, F.lit(" sshd["), user + 1000,
        F.lit("]: Failed password for u"), user, F.lit(" from "), ip, F.lit(" port 22 ssh2"),
    )
    request = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("GET /view/"), k))
        .when(F.col("event_type") == "click", F.concat(F.lit("GET /click?k="), k))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("POST /purchase?cmd="), k))
        .otherwise(F.concat(F.lit("GET /signup/../etc/"), k))
    )
    status = (
        F.when(F.col("event_type") == "view", "200")
        .when(F.col("event_type") == "click", "302")
        .when(F.col("event_type") == "purchase", "201")
        .otherwise("401")
    )
    access = F.concat(
        ip, F.lit(" - u"), user, F.lit(" ["), F.substring(at, 9, 2), F.lit("/"), month, F.lit("/"),
        F.left(at, F.lit(4)), F.lit(":"), clock, F.lit(" "), zone, F.lit('] "'),
        request, F.lit(' HTTP/1.1" '), status, F.lit(' 12 "-" "agent/'), k, F.lit('"'),
    )
    path = F.concat(
        F.lit("/jobs/"), job, F.lit("/01_evidence/raw/logs/"),
        F.when(error, "var_log_auth.log").otherwise("nginx_access.log"),
    )
    return events.select(
        job.alias("job_id"), host.alias("host"), path.alias("source_file"),
        F.col("event_id").alias("line_no"), F.when(error, syslog).otherwise(access).alias("value"),
        F.when(error, "syslog").otherwise("access").alias("format"),
    )


def _hours(offsets: bool):
    if not offsets:
        return F.lit(0)
    local = F.element_at(F.array(*[F.lit(h) for h in (0, 2, -5)]), F.col("event_id").cast("int") % 3 + 1)
    return F.when(F.col("event_type") == "error", 0).otherwise(local)


def document_lines(documents: DataFrame) -> DataFrame:
    """One row per non-empty line of the documents, whole, as undated generic log rows."""
    lines = documents.select(
        F.concat(F.lit("docs_"), F.col("lang")).alias("job_id"), F.col("source").alias("host"),
        F.concat(F.lit("/docs/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("source_file"),
        F.posexplode(F.split("text", "\n")).alias("pos", "value"),
    )
    return lines.filter(F.col("value") != "").select(
        "job_id", "host", "source_file", (F.col("pos") + 1).cast("bigint").alias("line_no"), "value"
    )


def lines_as_logs(lines: DataFrame, service: str) -> DataFrame:
    """Lines taken whole as messages, for rules over free text."""
    null = lambda kind: F.lit(None).cast(kind)
    return lines.select(
        "job_id", "host", null("timestamp").alias("ts"), null("double").alias("ts_epoch"),
        null("string").alias("timestamp"), F.lit("unknown").alias("hostname"),
        F.lit(service).alias("service"), F.lit("").alias("pid"), F.lit("info").alias("level"),
        F.col("value").alias("message"), "source_file", "line_no", F.lit("generic").alias("format"),
        F.col("value").alias("raw"), F.expr("CAST(map() AS map<string,string>)").alias("extracted"),
    )
