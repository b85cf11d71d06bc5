"""Raw lines of every supported format to one log table, in a single pass without a shuffle.

The line is parsed by the format of its file: one regex run per line captures all its fields into
an array, and every output column is a CASE over the format. No format gets a scan of its own.
"""

from __future__ import annotations

from datetime import datetime
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilog import schema
from vigilog.functions import lookups as L
from vigilog.functions import text as X

# The line formats accepted, as published for each log type.
SYSLOG = (
    r"^(\w{3})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})\s+"
    r"(\S+)\s+([^\[:\s]+)(?:\[(\d+)\])?\s*:\s*(.+)$"
)
ACCESS = (
    r'^(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"([A-Z]{2,10})\s+(\S+)\s+([^"]+)"\s+'
    r'(\d{3})\s+[\d-]+(?:\s+"[^"]*")?(?:\s+"([^"]*)")?.*$'
)
ACCESS_TIME = r"^(\d{1,2})/(\w{3})/(\d{4}):(\d{1,2}):(\d{1,2}):(\d{1,2})\s+(Z|[+-]\d{2}:?\d{2})$"
ERROR = r"^\[([^\]]+)\]\s+\[([^\]]+)\](.+)$"
ERROR_TIME = r"^\w{3}\s+(\w{3})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})(?:\.\d+)?\s+(\d{4})$"
AUDIT = r"^type=(\w+)\s+msg=audit\((\d+)(?:\.\d+)?:\d+\):\s*(.+)$"
ISO = (
    r"(?i)^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)\s+"
    r"(?:\[?(DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|CRIT(?:ICAL)?|ALERT|EMERG(?:ENCY)?)\]?\s+)?(.+)$"
)
STAMPED = (
    r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?|\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+"
    r"(\S+)?\s*(\S+)?(?:\[(\d+)\])?\s*:\s*(.+)$"
)
SAMPLE_CHARS = 2000
PLAIN = ("job_id", "host", "source_file", "line_no")

FORMATS = ("syslog", "access", "error", "audit", "generic", "journal", "entry_jsonl")

# Number of captured fields, which tells a match from a miss.
WIDTH = {"syslog": 9, "access": 8, "error": 3, "audit": 3, "generic": 3}

AUTH_IP = r"(?i)(?:\bfrom\s+|\brhost=)(\d{1,3}(?:\.\d{1,3}){3}|[0-9a-f]*:[0-9a-f:.]+)"
AUTH_USER = r"(?i)(?:\bfor\s+(?:invalid\s+user\s+)?|\binvalid\s+user\s+|\buser=)([^\s=]+)"


# --------------------------------------------------------------------------- format of a file


def format_of(name: Column, sample: Column) -> Column:
    """Format label from a file's base name and its first 2,000 characters."""
    name = F.lower(name)
    body = F.regexp_replace(sample, r"^[\s\x1c-\x1f]+", "")
    json = F.startswith(body, F.lit("{"))
    first = X.strip_cr(F.substring_index(F.regexp_replace(sample, "\r\n?", "\n"), "\n", 1))
    journal_name = F.contains(name, F.lit("journal")) & (
        F.endswith(name, F.lit(".json.gz")) | F.endswith(name, F.lit(".json"))
    )
    web = F.contains(name, F.lit("nginx")) | F.contains(name, F.lit("apache")) | F.contains(
        name, F.lit("httpd")
    )
    return (
        F.when(
            json & F.contains(sample, F.lit('"ts_epoch"')) & F.contains(sample, F.lit('"source_file"')),
            "entry_jsonl",
        )
        .when(journal_name, "journal")
        .when(json & F.contains(sample, F.lit("__REALTIME_TIMESTAMP")), "journal")
        .when(F.contains(name, F.lit("access")), "access")
        .when(F.contains(name, F.lit("error")) & web, "error")
        .when(F.size(X.fields(first, AUDIT, 3)) == 3, "audit")
        .when(F.size(X.fields(first, SYSLOG, 9)) == 9, "syslog")
        .otherwise("generic")
    )


def detect_format(lines: DataFrame) -> DataFrame:
    """One row per file: (source_file, format), for lines that are in a table already.

    The first 2,000 characters decide, and as many lines hold them even if all are blank. The
    row-number filter is applied inside each partition before the shuffle, however large one file
    is. For files, ``files.read_heads`` and ``format_of_heads`` read no more than the heads.
    """
    order = Window.partitionBy("source_file").orderBy("line_no")
    head = (
        lines.select("source_file", "line_no", F.left("value", F.lit(SAMPLE_CHARS)).alias("value"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= SAMPLE_CHARS)
    )
    samples = head.groupBy("source_file").agg(
        F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("head")
    )
    sample = F.left(F.array_join(F.col("head.value"), "\n"), F.lit(SAMPLE_CHARS))
    return samples.select(
        "source_file", format_of(X.base_name(F.col("source_file")), sample).alias("format")
    )


def format_of_heads(heads: DataFrame) -> DataFrame:
    """heads (path, head: the first characters of each file) with the format in place of the head."""
    sample = F.left("head", F.lit(SAMPLE_CHARS))
    return heads.withColumn("format", format_of(X.base_name(F.col("path")), sample)).drop("head")


# --------------------------------------------------------------------------- normalisation


def normalize(
    lines: DataFrame,
    formats: DataFrame | None = None,
    *,
    kinds: list | None = None,
    compat: bool = False,
    reference_ts: datetime | None = None,
) -> DataFrame:
    """The log table: lines that parse, in the columns of ``schema.LOG``. Row order is free."""
    parsed = _parse(lines, formats, kinds, compat, reference_ts, keep_errors=False)
    return parsed.select(*schema.LOG_COLUMNS)


def parse_lines(
    lines: DataFrame,
    formats: DataFrame | None = None,
    *,
    kinds: list | None = None,
    compat: bool = False,
    reference_ts: datetime | None = None,
) -> DataFrame:
    """``normalize`` plus the lines that do not parse, marked by ``parse_error``.

    ``formats`` (source_file, format) holds a row per file; without it ``lines`` has the column.
    ``kinds`` names the formats that occur, if known: the plan then leaves out the other parsers, and
    lines of other formats are dropped.
    ``reference_ts`` supplies the year that syslog times lack; the default is the current time. For
    files that span several years, ``years.with_years`` gives the lines a ``year``, which then decides.
    """
    return _parse(lines, formats, kinds, compat, reference_ts, keep_errors=True)


def _parse(lines, formats, kinds, compat, reference_ts, keep_errors) -> DataFrame:
    if formats is not None:
        lines = lines.join(formats.select("source_file", "format"), "source_file")
    kinds = tuple(k for k in FORMATS if kinds is None or k in kinds) or ("generic",)
    steps = kept(lines.sparkSession, _steps, kinds, compat, reference_ts, keep_errors, "year" in lines.columns)
    for columns in steps:
        lines = lines.select(*columns)
    return lines


def _steps(kinds: tuple, compat: bool, reference_ts, keep_errors: bool, has_years: bool) -> list[list[Column]]:
    """The projections, in order; each reads the columns of the one before."""
    fmt = F.col("format")
    line = X.strip_cr(F.col("value"))
    json_options = {"columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"}
    plain = [F.col(c) for c in (*PLAIN, *(["year"] if has_years else []))]
    regexes = {"syslog": SYSLOG, "access": ACCESS, "error": ERROR, "audit": AUDIT, "generic": ISO}
    captured = {
        k: X.fields(line, regex, WIDTH[k]) for k, regex in regexes.items() if k in kinds
    }
    first = [*plain, fmt, line.alias("value")]
    json = []
    if "journal" in kinds:
        json.append("j")
        first.append(F.when(fmt == "journal", F.from_json(line, schema.JOURNAL, json_options)).alias("j"))
    if "entry_jsonl" in kinds:
        json.append("e")
        first.append(F.when(fmt == "entry_jsonl", F.from_json(line, schema.ENTRY, json_options)).alias("e"))
    nothing = F.lit(None).cast("array<string>")
    first.append(_cases("format", captured, kinds, nothing).alias("p"))
    steps = [first]
    # Entries stored without a service may hold an access or audit line, which is parsed as such.
    kind = fmt
    if "entry_jsonl" in kinds and not compat:
        kinds = tuple(dict.fromkeys((*kinds, "access", "audit")))
        reparse = (fmt == "entry_jsonl") & (F.coalesce("e.service", F.lit("unknown")) == "unknown")
        raw = F.coalesce(F.col("e.raw"), F.lit(""))
        as_access = X.fields(raw, ACCESS, WIDTH["access"])
        again = (
            F.when(reparse & (F.size(as_access) == WIDTH["access"]), as_access)
            .when(reparse, X.fields(raw, AUDIT, WIDTH["audit"]))
            .otherwise(F.col("p"))
        )
        steps.append([*plain, fmt, F.col("value"), *[F.col(c) for c in json], again.alias("p")])
        kind = (
            F.when(reparse & (F.size("p") == WIDTH["access"]), "access")
            .when(reparse & (F.size("p") == WIDTH["audit"]), "audit")
            .otherwise(fmt)
        )
    second = [F.col("*"), kind.alias("kind")]
    if "access" in kinds or "error" in kinds:
        clock = {"access": X.fields(F.trim(_p(2)), ACCESS_TIME, 7)}
        if not compat:
            clock["error"] = X.fields(_p(0), ERROR_TIME, 6)
        tests = [(kind == k, v) for k, v in clock.items() if k in kinds]
        chain = F.when(*tests[0]) if tests else nothing
        for test, value in tests[1:]:
            chain = chain.when(test, value)
        second.append(chain.alias("t"))
    steps.append(second)
    # Blank lines are dropped, and lines of JSON files that are no objects.
    wanted = (F.col("value") != "") & fmt.isin(*kinds)
    if json:
        wanted &= ~fmt.isin("journal", "entry_jsonl") | F.startswith(F.trim("value"), F.lit("{"))
    steps += _columns(kinds, json, compat, reference_ts, wanted, keep_errors, has_years)
    return steps


def _cases(column: str, cases: dict, kinds: tuple, default=None) -> Column:
    """CASE over the format, with the branches of the formats that occur."""
    chain = None
    for kind, value in cases.items():
        if kind in kinds:
            test = F.col(column) == kind
            chain = F.when(test, value) if chain is None else chain.when(test, value)
    if chain is None:
        return default
    return chain if default is None else chain.otherwise(default)


def _p(i: int) -> Column:
    return F.get("p", F.lit(i))


def _t(i: int) -> Column:
    return F.get("t", F.lit(i))


def _columns(
    kinds: tuple, json: list, compat: bool, reference_ts, wanted: Column, keep_errors: bool, has_years: bool
) -> list[list[Column]]:
    def by_kind(cases: dict, default=None) -> Column:
        return _cases("kind", cases, kinds, default)

    matched = by_kind(
        {k: F.size("p") == w for k, w in WIDTH.items() if k != "generic"}
        | {"generic": F.lit(True), "journal": F.col("j._corrupt").isNull(),
           "entry_jsonl": F.col("e._corrupt").isNull()}
    )
    name = X.base_name(F.col("source_file"))
    tested = F.lower("source_file" if compat else name)
    web = F.when(F.contains(tested, F.lit("nginx")), "nginx").otherwise("apache2")
    iso_hit = F.size("p") == WIDTH["generic"]

    ts = by_kind({
        "syslog": syslog_time(
            _p(0), _p(1), _p(2), _p(3), _p(4), reference_ts, compat, own_year=F.col("year") if has_years else None),
        "access": _access_time(),
        "error": X.utc_timestamp(_t(5), X.lookup(L.MONTHS, F.lower(_t(0))), _t(1), _t(2), _t(3), _t(4)),
        "audit": _epoch_micros(F.try_multiply(_p(1).try_cast("bigint"), F.lit(1_000_000))),
        "generic": F.when(iso_hit, iso_timestamp(_p(0))),
        "journal": _epoch_micros(F.col("j.__REALTIME_TIMESTAMP").try_cast("bigint")),
        "entry_jsonl": X.time_from_epoch(F.col("e.ts_epoch")),
    })
    timed = [F.col("*"), matched.alias("ok"), ts.alias("ts")]

    status = _p(6)
    audit_type = _p(0)
    audit_warn = (
        F.startswith(audit_type, F.lit("ANOM_")) | F.startswith(audit_type, F.lit("ERR"))
        | F.contains(audit_type, F.lit("FAIL")) | audit_type.isin(*L.AUDIT_WARN_TYPES)
    )
    inferred = infer_service(F.col("source_file"))
    entry_service = F.coalesce(F.col("e.service"), F.lit("unknown"))
    name_token = F.when(F.contains(name, F.lit("_")), F.get(F.split(name, "_"), F.lit(1))).otherwise("system")

    raw = F.col("value")
    if "j" in json:
        raw = F.when(F.col("kind") == "journal", F.trim("value")).otherwise(raw)
    if "e" in json:
        raw = F.coalesce(F.col("e.raw"), raw)

    columns = {
        "timestamp": by_kind(
            {
                "access": _access_iso(),
                "generic": F.when(iso_hit, _p(0)),
                "entry_jsonl": F.col("e.timestamp"),
            },
            X.iso_time(F.col("ts")),
        ),
        "hostname": by_kind({
            "syslog": _p(5),
            "access": F.lit("webserver"),
            "error": F.lit("webserver"),
            "journal": F.coalesce(F.col("j._HOSTNAME"), F.lit("unknown")),
            "entry_jsonl": F.coalesce(F.col("e.hostname"), F.lit("" if not compat else "None")),
        }, F.lit("unknown")),
        "service": by_kind({
            "syslog": _p(6),
            "access": web,
            "error": F.concat(web, F.lit("_error")),
            "audit": F.coalesce(X.lookup(L.AUDIT_SERVICES, audit_type), F.lit(L.AUDIT_DEFAULT_SERVICE)),
            "generic": F.left(F.substring_index(name, ".", 1), F.lit(L.LIMITS["generic_service"])),
            "journal": F.coalesce(
                X.not_empty(F.col("j.SYSLOG_IDENTIFIER")),
                X.not_empty(F.replace(F.col("j._SYSTEMD_UNIT"), F.lit(".service"), F.lit(""))),
                name_token,
            ),
            "entry_jsonl": F.when(
                entry_service == "unknown", F.coalesce(X.not_empty(inferred), entry_service)
            ).otherwise(entry_service),
        }),
        "pid": by_kind({
            "syslog": _p(7),
            "audit": F.regexp_extract(_p(2), r"\bpid=(\d+)", 1),
            "journal": F.left(F.coalesce(F.col("j._PID"), F.lit("")), F.lit(L.LIMITS["pid"])),
            "entry_jsonl": F.left(
                F.coalesce(F.col("e.pid"), F.lit("None" if compat else "")), F.lit(L.LIMITS["pid"])
            ),
        }, F.lit("")),
        "level": by_kind({
            "access": F.when(F.left(status, F.lit(1)).isin("4", "5"), "error").otherwise("info"),
            "error": F.left(F.lower(_p(1)), F.lit(L.LIMITS["error_level"])),
            "audit": F.when(audit_warn, "warn").otherwise("info"),
            "generic": F.when(iso_hit, F.coalesce(X.not_empty(F.lower(_p(1))), F.lit("info"))).otherwise("info"),
            "journal": F.coalesce(X.lookup(L.PRIORITY_LABELS, F.coalesce("j.PRIORITY", F.lit("6"))), F.lit("info")),
            "entry_jsonl": F.coalesce(F.col("e.level"), F.lit("info")),
        }, F.lit("info")),
        "message": by_kind({
            "syslog": _p(8),
            "access": F.concat(_p(3), F.lit(" "), _p(4), F.lit(" "), _p(5), F.lit(" -> "), status),
            "error": _p(2),
            "audit": F.concat(F.lit("type="), audit_type, F.lit(" "),
                              F.left(_p(2), F.lit(L.LIMITS["message"]))),
            "generic": F.when(iso_hit, _p(2)).otherwise(F.col("value")),
            "journal": _journal_message(),
            "entry_jsonl": F.coalesce(F.col("e.message"), F.lit("")),
        }),
        "raw": raw,
        "extracted": by_kind({
            "access": X.present(
                {
                    "src_ip": _p(0), "http_method": _p(3),
                    "uri": F.left(_p(4), F.lit(L.LIMITS["uri"])), "http_status": status,
                },
                {
                    "user": F.nullif(_p(1), F.lit("-")),
                    "user_agent": X.not_empty(F.left(_p(7), F.lit(L.LIMITS["user_agent"]))),
                },
            ),
            "entry_jsonl": F.map_filter(
                F.coalesce(F.col("e.extracted"), X.no_fields()), lambda _, v: v.isNotNull()
            ),
        }, X.no_fields()),
    }
    # The audit message is cut before its prefix is added; every other one here.
    columns["message"] = F.when(F.col("kind") == "audit", columns["message"]).otherwise(
        F.left(columns["message"], F.lit(L.LIMITS["message"]))
    )
    for column in ("hostname", "service", "raw"):
        columns[column] = F.left(columns[column], F.lit(L.LIMITS[column]))
    if not compat:
        # Rules search the whole access line: its end must not fall to a long URI.
        columns["raw"] = F.when(F.col("kind") == "access", raw).otherwise(columns["raw"])

    parsed = [
        *[F.col(c) for c in PLAIN], F.col("ts"), X.epoch_seconds(F.col("ts")).alias("ts_epoch"),
        *[value.alias(column) for column, value in columns.items()],
        F.col("kind").alias("format"), (~F.col("ok")).alias("parse_error"),
        (wanted if keep_errors else wanted & F.col("ok")).alias("_keep"),
    ]
    names = ["ts", "ts_epoch", *columns, "format", "parse_error"]
    extracted = F.col("extracted") if compat else auth_fields().alias("extracted")
    last = [extracted if name == "extracted" else F.col(name) for name in names]
    return [timed, parsed, [*[F.col(c) for c in PLAIN], keep_rows(F.col("_keep"), last)]]


def keep_rows(condition: Column, columns: list) -> Column:
    """Generator with the effect of ``filter``, but evaluated where it stands.

    Spark moves a filter below the projections it reads, and so runs every regex behind the
    condition a second time, nested ones more often. Rows leave through a generator instead, which
    filters on parsed columns do not pass; those on columns beside it still reach the scan.
    """
    return F.inline(F.when(condition, F.array(F.struct(*columns))))


def kept(spark, build, *args):
    """The result of ``build``, made once per session.

    It holds column expressions only. Making some thousand of them takes seconds of round trips to
    the JVM, so repeated queries share them.
    """
    made = _KEPT.setdefault(spark, {})
    key = (build, *args)
    if key not in made:
        made[key] = build(*args)
    return made[key]


_KEPT: WeakKeyDictionary = WeakKeyDictionary()


def auth_fields() -> Column:
    """``extracted``, with address and user of failed logins, which no parser extracts."""
    failure = F.rlike("message", F.lit("(?i)" + "|".join(L.AUTH_FAILURE_PHRASES)))
    found = X.present(
        {},
        {
            "src_ip": X.not_empty(F.regexp_extract("message", AUTH_IP, 1)),
            "user": X.not_empty(F.regexp_extract("message", AUTH_USER, 1)),
        },
    )
    wanted = ~F.col("format").isin("access", "error") & (F.size("extracted") == 0) & failure
    return F.when(wanted, found).otherwise(F.col("extracted"))


def structure_text(
    lines: DataFrame, hostname: str = "unknown", *, reference_ts: datetime | None = None
) -> DataFrame:
    """Text lines of unknown format to log rows: syslog, else a stamped line, else as is.

    Each line is judged by itself. Blank lines are dropped.
    """
    parsed = lines.withColumn("value", F.trim("value")).select(
        "*", X.fields(F.col("value"), SYSLOG, 9).alias("p")
    ).select("*", F.when(F.size("p") < 9, X.fields(F.col("value"), STAMPED, 5)).alias("t"))
    syslog = F.size("p") == 9
    stamped = F.coalesce(F.size("t") == 5, F.lit(False))
    short = X.fields(_t(0), r"^(\w{3})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})$", 5)
    short_time = syslog_time(
        *[F.get(short, F.lit(i)) for i in range(5)], reference_ts, False, default_month=None
    )
    ts = F.when(
        syslog, syslog_time(_p(0), _p(1), _p(2), _p(3), _p(4), reference_ts, False, default_month=None)
    ).when(
        stamped, F.when(F.contains(_t(0), F.lit("-")), F.date_trunc("second", iso_timestamp(_t(0)))).otherwise(short_time)
    )

    def pick(p: int | None, t: int | None, default):
        chain = F.when(syslog, _p(p)) if p is not None else F.when(syslog, F.lit("info"))
        return chain.when(stamped, _t(t)).otherwise(default)

    rows = parsed.select(
        "*", ts.alias("ts"),
        pick(5, 1, F.lit(hostname)).alias("hostname"),
        pick(6, 2, F.lit("unknown")).alias("service"),
        pick(7, 3, F.lit("")).alias("pid"),
        pick(8, 4, F.col("value")).alias("message"),
    )
    columns = [
        F.col("ts"), X.epoch_seconds(F.col("ts")).alias("ts_epoch"),
        X.iso_time(F.col("ts")).alias("timestamp"), F.col("hostname"), F.col("service"),
        F.col("pid"), F.lit("info").alias("level"), F.col("message"), F.lit("text").alias("format"),
        F.col("value").alias("raw"), X.no_fields().alias("extracted"),
    ]
    return rows.select(*PLAIN, keep_rows(F.col("value") != "", columns)).select(*schema.LOG_COLUMNS)


# --------------------------------------------------------------------------- parts


def infer_service(path: Column) -> Column:
    """Service label from a log path; '' when the path says nothing."""
    path = F.lower(path)

    def has(*words):
        test = F.contains(path, F.lit(words[0]))
        for word in words[1:]:
            test = test | F.contains(path, F.lit(word))
        return test

    return (
        F.when(has("apache", "httpd") & has("error"), "apache2_error")
        .when(has("apache", "httpd"), "apache2")
        .when(has("nginx") & has("error"), "nginx_error")
        .when(has("nginx"), "nginx")
        .when(has("auth.log", "var_log_auth") | (has("secure") & has("var_log")), "sshd")
        .when(has("syslog", "messages"), "syslog")
        .otherwise("")
    )


def syslog_time(month, day, hh, mm, ss, reference_ts, compat, default_month=1, own_year=None) -> Column:
    """Syslog times carry no year: take the reference's, or the one before for a future time.

    Where ``own_year`` is known it decides."""
    ref = F.lit(reference_ts).cast("timestamp") if reference_ts else F.current_timestamp()
    number = X.lookup(L.MONTHS, F.lower(month))
    if default_month is not None:
        number = F.coalesce(number, F.lit(default_month))
    if own_year is not None:
        known = X.utc_timestamp(own_year, number, day, hh, mm, ss)
        guess = syslog_time(month, day, hh, mm, ss, reference_ts, compat, default_month)
        return F.when(own_year.isNotNull(), known).otherwise(guess)
    year = F.year(ref)
    same = X.utc_timestamp(year, number, day, hh, mm, ss)
    if compat:
        return same
    earlier = X.utc_timestamp(year - 1, number, day, hh, mm, ss)
    limit = F.unix_micros(ref) + F.lit(86_400_000_000)
    # Feb 29 exists in one of the two years only.
    return F.when(F.unix_micros(same) > limit, earlier).otherwise(
        F.coalesce(same, F.when(earlier.isNotNull() & (number == 2) & (day.try_cast("int") == 29), earlier))
    )


def iso_timestamp(text: Column) -> Column:
    colon = F.regexp_replace(F.replace(F.upper(text), F.lit(" "), F.lit("T")), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.regexp_replace(colon, r"(\.\d{6})\d+", "$1").try_cast("timestamp")


def _epoch_micros(micros: Column) -> Column:
    return F.when(micros != 0, F.timestamp_micros(micros))


def _offset_parts():
    zone = _t(6)
    sign = F.when(F.startswith(zone, F.lit("-")), F.lit(-1)).otherwise(F.lit(1))
    digits = F.when(zone == "Z", F.lit("0000")).otherwise(F.regexp_replace(zone, "[^0-9]", ""))
    return sign, F.left(digits, F.lit(2)), F.right(digits, F.lit(2))


def _access_time() -> Column:
    local = X.utc_timestamp(_t(2), X.lookup(L.MONTHS, F.lower(_t(1))), _t(0), _t(3), _t(4), _t(5))
    sign, hours, minutes = _offset_parts()
    shift = sign * (hours.try_cast("bigint") * 60 + minutes.try_cast("bigint"))
    return F.timestamp_micros(F.unix_micros(local) - shift * F.lit(60_000_000))


def _access_iso() -> Column:
    """The access log's own clock reading and offset."""
    month = X.lookup(L.MONTHS, F.lower(_t(1))).cast("string")
    sign, hours, minutes = _offset_parts()
    two = lambda c: F.lpad(c, 2, "0")
    built = F.concat(
        _t(2), F.lit("-"), two(month), F.lit("-"), two(_t(0)), F.lit("T"),
        two(_t(3)), F.lit(":"), two(_t(4)), F.lit(":"), two(_t(5)),
        F.when(sign == -1, "-").otherwise("+"), hours, F.lit(":"), minutes,
    )
    return F.when(F.col("ts").isNotNull(), built)


def _journal_message() -> Column:
    text = F.coalesce(F.col("j.MESSAGE"), F.lit(""))
    listed = F.from_json(text, "array<string>")
    return F.when(
        F.startswith(text, F.lit("[")) & (F.size(listed) > 0), F.array_join(listed, " ")
    ).otherwise(text)
