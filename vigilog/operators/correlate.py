"""Correlations over the log table: by address, user, service, level, hour, URI and status.

All of them combine before their one shuffle. Rankings break ties by their key, so that results
repeat, and end in a top-k that sorts no more than k rows per task. ``keys`` adds grouping columns
(say ``("job_id",)``); the ranking is then per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog.functions import lookups as L
from vigilog.functions.text import iso_time


def _field(name: str) -> Column:
    return F.try_element_at("extracted", F.lit(name))


def _top(df: DataFrame, count: str, ties: list, k: int, keys: tuple) -> DataFrame:
    if not keys:
        return df.orderBy(F.desc(count), *ties).limit(k)
    order = Window.partitionBy(*keys).orderBy(F.desc(count), *ties)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank")


def _activity(logs: DataFrame, field: str, name: str, keys: tuple) -> DataFrame:
    """Events, services and first/last time per value.

    Times are compared as instants and written in UTC; a value with undated events only has none.
    Distinct services need no second shuffle of raw rows: counts per (value, service) come first.
    """
    per_service = logs.select(*keys, _field(field).alias(name), "service", "ts").groupBy(
        *keys, name, "service"
    ).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return per_service.filter(F.col(name) != "").groupBy(*keys, name).agg(
        F.sum("n").alias("event_count"),
        F.count("service").alias("services_touched"),
        iso_time(F.min("first")).alias("first_seen"),
        iso_time(F.max("last")).alias("last_seen"),
    )


def top_ips_by_activity(logs: DataFrame, keys: tuple = (), k: int = 25) -> DataFrame:
    return _top(_activity(logs, "src_ip", "src_ip", keys), "event_count", ["src_ip"], k, keys)


def top_users_by_events(logs: DataFrame, keys: tuple = (), k: int = 20) -> DataFrame:
    users = _activity(logs, "user", "username", keys).filter(~F.col("username").isin(*L.IGNORED_USERS))
    return _top(users, "event_count", ["username"], k, keys)


def events_by_service(logs: DataFrame, keys: tuple = ()) -> DataFrame:
    per_host = logs.groupBy(*keys, "service", "hostname").agg(F.count("*").alias("n"))
    return per_host.groupBy(*keys, "service").agg(
        F.sum("n").alias("total"), F.count("hostname").alias("hosts")
    )


def events_by_level(logs: DataFrame, keys: tuple = ()) -> DataFrame:
    return logs.groupBy(*keys, "level").agg(F.count("*").alias("total"))


def errors_over_time(
    logs: DataFrame, keys: tuple = (), hours: int = 72, latest: bool = False
) -> DataFrame:
    """Errors per hour: the first (or ``latest``) hours that have any."""
    errors = logs.filter(F.col("level").isin(*L.ERROR_LEVELS) & F.col("ts").isNotNull())
    per_hour = (
        errors.groupBy(*keys, F.date_trunc("hour", "ts").alias("hour"))
        .agg(F.count("*").alias("error_count"))
        .select(*keys, F.date_format("hour", "yyyy-MM-dd HH:00").alias("hour_bucket"), "error_count")
    )
    order = F.desc("hour_bucket") if latest else F.asc("hour_bucket")
    if not keys:
        return per_hour.orderBy(order).limit(hours)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return per_hour.withColumn("rank", rank).filter(F.col("rank") <= hours).drop("rank")


def _any_like(c: Column, patterns) -> Column:
    test = F.lit(False)
    for pattern in patterns:
        test = test | c.ilike(pattern)
    return test


def auth_failures_by_ip(
    logs: DataFrame, keys: tuple = (), k: int = 30, at_least: int = 3
) -> DataFrame:
    phrases = [f"%{p}%" for p in L.AUTH_FAILURE_PHRASES]
    failures = (
        logs.filter(_any_like(F.col("message"), phrases))
        .select(*keys, _field("src_ip").alias("src_ip"), "ts")
        .filter(F.col("src_ip").isNotNull())
        .groupBy(*keys, "src_ip")
        .agg(
            F.count("*").alias("failure_count"),
            iso_time(F.min("ts")).alias("first_seen"), iso_time(F.max("ts")).alias("last_seen"),
        )
        .filter(F.col("failure_count") >= at_least)
    )
    return _top(failures, "failure_count", ["src_ip"], k, keys)


def _suspicious(logs: DataFrame, keys: tuple) -> DataFrame:
    return logs.select(
        *keys, _field("uri").alias("uri"), _field("http_status").alias("status"),
        "ts", "source_file", "line_no",
    ).filter(_any_like(F.col("uri"), L.SUSPICIOUS_URI_PATTERNS))


def suspicious_uris(logs: DataFrame, keys: tuple = (), k: int = 30) -> DataFrame:
    """Hits per URI and status; ``last_status`` is the status of the group."""
    hits = _suspicious(logs, keys).groupBy(*keys, "uri", F.col("status").alias("last_status")).agg(
        F.count("*").alias("hit_count")
    )
    return _top(hits, "hit_count", ["uri", "last_status"], k, keys)


def suspicious_uri_outcomes(logs: DataFrame, keys: tuple = (), k: int = 30) -> DataFrame:
    """Hits per URI with the status of its latest request."""
    latest = F.struct("ts", "source_file", "line_no")
    hits = _suspicious(logs, keys).groupBy(*keys, "uri").agg(
        F.count("*").alias("hit_count"), F.max_by("status", latest).alias("last_status")
    )
    return _top(hits, "hit_count", ["uri"], k, keys)


def http_status_distribution(logs: DataFrame, keys: tuple = ()) -> DataFrame:
    return (
        logs.select(*keys, _field("http_status").alias("status_code"))
        .filter(F.col("status_code").isNotNull())
        .groupBy(*keys, "status_code")
        .agg(F.count("*").alias("count"))
    )


CORRELATIONS = {
    "top_ips_by_activity": top_ips_by_activity,
    "top_users_by_events": top_users_by_events,
    "events_by_service": events_by_service,
    "events_by_level": events_by_level,
    "errors_over_time": errors_over_time,
    "auth_failures_by_ip": auth_failures_by_ip,
    "suspicious_uris": suspicious_uris,
    "http_status_distribution": http_status_distribution,
}


def correlate(logs: DataFrame, keys: tuple = ()) -> dict[str, DataFrame]:
    return {name: query(logs, keys) for name, query in CORRELATIONS.items()}
