"""Row schemas, as DDL text, which every reader takes."""

LOG = (
    "job_id string, host string, ts timestamp, ts_epoch double, timestamp string, hostname string, "
    "service string, pid string, level string, message string, source_file string, line_no bigint, "
    "format string, raw string, extracted map<string,string>"
)

LOG_COLUMNS = [part.split()[0] for part in LOG.split(", ")]

# One raw line, as the text reader and the adapters deliver it.
LINE = (
    "job_id string, host string, source_file string, line_no bigint, value string"
)

JOURNAL = (
    "__REALTIME_TIMESTAMP string, _HOSTNAME string, SYSLOG_IDENTIFIER string, "
    "_SYSTEMD_UNIT string, _PID string, PRIORITY string, MESSAGE string, _corrupt string"
)

ENTRY = (
    "timestamp string, ts_epoch double, hostname string, service string, pid string, level string, "
    "message string, source_file string, raw string, extracted map<string,string>, _corrupt string"
)

PATTERN = (
    "struct<idx:int,regex:string,java_regex:string,groups:map<string,int>,"
    "required:array<array<string>>>"
)
RULE = (
    "rule_path string, rule_id string, title string, category string, subcategory string, "
    "mitre_technique string, mitre_tactic string, severity string, confidence string, "
    "enabled boolean, description string, service string, type string, "
    f"patterns array<{PATTERN}>, steps array<{PATTERN}>, "
    "agg struct<field:string,count:int,window_seconds:double>, within_seconds double, "
    "false_positives array<string>, recommendation string, references array<string>, "
    "tags array<string>"
)
RULE_ERROR = ("rule_path string, pattern_idx int, error string")

SYSTEM_INFO = (
    "hostname string, distro_id string, distro_name string, version_id string, kernel string, "
    "architecture string, init_system string, host_datetime_utc string, timezone string, "
    "raw_uname string"
)
SERVICES = (
    "raw_systemctl string, raw_ps string, "
    "parsed array<struct<unit:string,load:string,active:string,sub:string,description:string>>"
)
ACQUISITION = (
    "start string, end string, host string, username string, "
    "commands array<struct<phase:string,artifact:string,status:string>>, "
    "artifacts array<struct<phase:string,file:string,acquired_at:string>>, "
    "errors array<struct<phase:int,cmd:string,error:string>>, connection_closed boolean"
)
MANIFEST = (
    "job_id string, host string, generated_at string, tool string, artifact_count bigint, "
    "total_size_bytes bigint, artifacts array<struct<filename:string,relative_path:string,"
    "size_bytes:bigint,sha256:string,acquired_at:string,origin:string,verified_locally:boolean>>"
)
SIGNATURE = (
    "manifest_file string, manifest_sha256 string, signed_at string, tool string"
)
