"""Session settings, and tables written to shared storage to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_scopes: list[list[DataFrame]] = []


def build_session(app: str = "tracewright", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every operator here assumes.

    On a cluster leave ``master`` unset and size ``spark.sql.shuffle.partitions``
    for the data; AQE merges small partitions and splits skewed ones.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="tracewright-")
    return _local_dirs[app]


def app_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tracewright-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    Unlike a cached frame the written table survives the loss of executors, and
    values that depend on the physical partition (ids, chunk numbers) stay fixed.
    """
    spark = df.sparkSession
    path = f"{app_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.materialized_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables materialised inside are deleted at the end, but for those put into the list it gives.

    What is put there belongs to the scope around, if there is one.
    """
    kept: list[DataFrame] = []
    _scopes.append([])
    try:
        yield kept
    finally:
        made = _scopes.pop()
        paths = {df.materialized_path for df in kept}
        discard(*[df for df in made if df.materialized_path not in paths])
        if _scopes:
            _scopes[-1].extend(df for df in made if df.materialized_path in paths)


def delete_folder(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no frame still in use reads."""
    for df in tables:
        delete_folder(df.sparkSession, df.materialized_path)


def release(spark: SparkSession) -> bool:
    """Delete every table this application has materialised."""
    return delete_folder(spark, app_dir(spark))


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate, the same figure its own broadcast rule reads."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def input_bytes(df: DataFrame) -> int:
    """Size of what the plan reads: the sum over its leaves, which no join multiplies.

    Leaves of unknown size, rows that the driver holds for one, count as nothing.
    Like ``planned_bytes`` it asks the plan through the JVM, which Spark Connect does not offer.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def broadcast_limit(spark: SparkSession) -> int:
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower()
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits = text.rstrip("b")
    if digits and digits[-1] in units:
        return int(digits[:-1]) * units[digits[-1]]
    return int(digits)
