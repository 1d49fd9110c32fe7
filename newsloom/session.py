"""Session helpers: a configured local session, shared scratch tables, code shipping."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT = "spark.checkpoint.dir"
_shipped: set[str] = set()
_local: dict[str, str] = {}


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("newsloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir.

    Where that is unset, a local session (tests, one machine) gets a temporary folder of its own;
    on a cluster, whose executors couldn't read such a folder, it is an error.
    """
    found = spark.sparkContext.getConf().get(_CHECKPOINT) or spark.conf.get(_CHECKPOINT, None)
    if not found:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set {_CHECKPOINT} to a folder that all executors share")
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="newsloom-")
            atexit.register(shutil.rmtree, _local[app][7:], ignore_errors=True)
        found = _local[app]
    return found.rstrip("/")


def store(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df as a table of the shared folder and read it back: lineage ends there.

    Returns the reread table and its path, for drop_stored().
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/newsloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_stored(spark: SparkSession, *paths: str) -> None:
    """Delete tables written by store() that no later plan reads."""
    jvm = spark._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (once an application), from the shared folder."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, str(Path(root.name) / file.relative_to(root)))
    path = f"{scratch_dir(spark)}/newsloom/code-{uuid.uuid4().hex}.zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    try:
        stream.write(bytearray(packed.getvalue()))
    finally:
        stream.close()
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
