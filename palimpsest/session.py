"""Session helpers: builder for tests and bench, and lineage cuts that survive executor loss."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cpus: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("palimpsest")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own; on a cluster an unset directory is an error,
    because a machine-local path is lost with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
        configured = tempfile.mkdtemp(prefix="palimpsest-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def _as_table(kind: T.DataType) -> bool:
    """Whether Parquet takes values of this type as they are."""
    if isinstance(kind, T.StructType):
        return bool(kind.fields) and len({f.name.lower() for f in kind}) == len(kind.fields) and all(_as_table(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _as_table(kind.elementType)
    if isinstance(kind, T.MapType):
        return _as_table(kind.keyType) and _as_table(kind.valueType)
    return not isinstance(kind, (T.NullType, T.VariantType, T.CalendarIntervalType, T.UserDefinedType))


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` kept in the shared folder and read back from there, not from executor storage.

    Rows are kept as a Parquet table, which takes a fraction of a checkpoint's disk and tells the planner how large it is; what Parquet
    doesn't take becomes a reliable checkpoint.
    """
    folder = ensure_checkpoint_dir(df.sparkSession)
    if not _as_table(df.schema):
        return df.checkpoint(eager=True)
    path = f"{folder}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_by(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` kept as by :func:`cut_lineage`, in ``tasks`` files dealt by ``keys``: work by these keys and more needs no exchange where it is read.

    Rows that lie so already stay where they are.  Without ``tasks`` this is :func:`cut_lineage`.
    """
    if tasks is None or not _as_table(df.schema):
        return cut_lineage(df)
    spark, name = df.sparkSession, f"cut_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark)}/{name}"
    # Spark reads files as dealt if a table says so: it has a name for a moment, its files stay
    df.repartition(tasks, *keys).write.option("compression", "zstd").option("path", path).bucketBy(tasks, *keys).format("parquet").saveAsTable(name)
    try:
        # columns that don't bear the table's name, else a union of such tables isn't seen to lie as its parts do
        return spark.table(name).select(*[F.col(f"`{c}`").alias(c) for c in df.columns])
    finally:
        spark.sql(f"DROP TABLE {name}")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into the session's full number of shuffle partitions.

    Used in front of kernels whose cost is not in the bytes: with an explicit number the adaptive planner does not fold
    the partitions into few tasks, and a following groupBy on the same keys needs no further exchange.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def tasks_for(spark: SparkSession, rows: int, most: int = 50_000) -> int:
    """As many tasks as leave each about ``most`` of all ``rows``."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // most))


def in_tasks(df: DataFrame, rows: int, *keys: str, most: int = 50_000) -> DataFrame:
    """Hash-partition by ``keys`` into as many tasks as leave each about ``most`` of all ``rows``.

    Used in front of a chain of windows and groupings by the same keys and more, which then need no other exchange and, since tasks
    stay small however many rows there are, do not spill.
    """
    return df.repartition(tasks_for(df.sparkSession, rows, most), *keys)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, for a session that was not started with it (``--py-files`` or an installed wheel)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # a folder of the driver alone: Spark copies the archive to every executor
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="palimpsest-"), "palimpsest"), "zip", root, "palimpsest")
    spark.sparkContext.addPyFile(archive)
