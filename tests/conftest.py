import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from vigilog import build_session  # noqa: E402
from vigilog.functions.text import no_fields  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("local[8]", 4, quiet=True)
    session.sparkContext.setLogLevel("OFF")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session


@pytest.fixture(scope="session")
def make_logs(spark):
    """Log rows from (seconds or None, service, message[, captured fields])."""

    def build(rows, job="j"):
        from pyspark.sql import functions as F

        data = [
            (i + 1, None if r[0] is None else round(r[0] * 1_000_000), r[1], r[2], r[3] if len(r) > 3 else None)
            for i, r in enumerate(rows)
        ]
        df = spark.createDataFrame(
            data, "line_no bigint, us bigint, service string, message string, extracted map<string,string>"
        )
        ts = F.timestamp_micros("us")
        return df.select(
            F.lit(job).alias("job_id"), F.lit("h").alias("host"), ts.alias("ts"),
            (F.col("us") / 1e6).alias("ts_epoch"), ts.cast("string").alias("timestamp"),
            F.lit("hn").alias("hostname"), "service", F.lit("").alias("pid"), F.lit("info").alias("level"),
            "message", F.lit("/f").alias("source_file"), "line_no", F.lit("syslog").alias("format"),
            F.col("message").alias("raw"), F.coalesce("extracted", no_fields()).alias("extracted"),
        )

    return build
