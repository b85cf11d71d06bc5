"""Session settings the operators rely on."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    # Every formatted time is UTC.
    "spark.sql.session.timeZone": "UTC",
    # Normaliser fields override captured groups of the same name.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM never compiles methods over 8,000 bytecodes; a wide rule projection fused into one
    # stage would be interpreted. Past this size Spark splits it into small compiled methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session created elsewhere; cluster sizing is left alone."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(
    master: str | None = None, shuffle_partitions: int | None = None, quiet: bool = False
) -> SparkSession:
    builder = SparkSession.builder.appName("vigilog")
    if quiet:
        builder = builder.config("spark.ui.showConsoleProgress", "false")
        builder = builder.config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", "16g")  # the driver is all there is
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", shuffle_partitions)
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def spread(df: DataFrame) -> DataFrame:
    """Give a small input that arrives in few splits one partition per core.

    Parsing and searching are bound by the processor. On inputs with as many splits as cores, so at
    any real size, this does nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package on whatever machine they run; once per application.

    The package goes as a zip through the cluster's shared folder, or a local session's own.
    """
    context = spark.sparkContext
    if getattr(context, "_vigilog_shipped", False):
        return
    package, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for module in sorted(package.rglob("*.py")):
            out.writestr(f"{package.name}/{module.relative_to(package).as_posix()}", module.read_bytes())
    path = f"{shared_folder(spark)}/vigilog-{uuid.uuid4().hex}.zip"
    if ":" in path.split("/")[0]:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(inner, compression=None) as stream:
            stream.write(packed.getvalue())
    else:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_bytes(packed.getvalue())
    context.addPyFile(path)
    context._vigilog_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one without a scheme is named by that of Spark's default file system."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="vigilog-checkpoint-")
        context.setCheckpointDir(folder)
    folder = folder.rstrip("/")
    if ":" in folder.split("/")[0]:
        return folder
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    named = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    # Tasks that write through Arrow take a path without scheme for a local one.
    return folder if named.startswith("file:") else named


def stored(df: DataFrame, **options) -> DataFrame:
    """Write the rows as a table in the cluster's shared checkpoint folder and read them back.

    Later uses neither recompute them nor depend on the executors that did, and the planner knows
    their size. Only a local session, where nothing is set, gets a folder of its own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/vigilog-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


_STORED: list[str] = []


def discard_stored(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables that ``stored`` wrote, from number ``since`` on; nothing may read them then."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while len(_STORED) > since:
        path = jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        path.getFileSystem(conf).delete(path, True)


def stored_so_far() -> int:
    return len(_STORED)
