"""Sessions and the shared folder in which lineage is cut."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pagelens")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The application's folder below the one the cluster names in spark.checkpoint.dir.

    Where no folder is named (tests on one machine) a temporary one is set; on a cluster
    that would be a folder no other machine sees, so it is refused there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="pagelens-", dir=os.environ.get("TMPDIR"))
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """`df` checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def kept(df: DataFrame) -> DataFrame:
    """`df` written once as compressed files into the shared folder, and read from there.

    For the rounds of a loop: a checkpoint would carry on what the optimizer knows of each
    round's columns, which grows from round to round; a table carries only its schema.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, name: str, make: Callable[[], bytes]) -> bytes:
    """The bytes of a file of the shared folder, made and written if it isn't there yet."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    if files.exists(path):
        held = files.open(path)
        try:
            return bytes(context._jvm.org.apache.commons.io.IOUtils.toByteArray(held))
        finally:
            held.close()
    body = make()
    out = files.create(path)
    out.write(body)
    out.close()
    return body


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where its files make too few tasks for work that is heavy on the CPU.

    A table of many files is left as it is, so nothing large is ever shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so their Python finds it wherever they run.

    The archive lies in the shared checkpoint folder, like everything that tasks read.
    """
    context = spark.sparkContext
    if getattr(context, "_pagelens_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/pagelens-{uuid.uuid4().hex}.zip")
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    out.write(held.getvalue())
    out.close()
    context.addPyFile(path.toString())
    context._pagelens_shipped = True
