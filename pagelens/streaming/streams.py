"""Telemetry as streams: ingest, relay, last values, bounded history, exactly-once rows and windows.

Each function starts one query over files of a folder, runs it on what is there
(availableNow) and returns what its sink holds. Offsets, state and sinks lie below one
folder of the shared place. A query with a name of its own has a folder of that name, so
it goes on where it stopped, in the same session or a later one; without a name each call
starts anew. A batch that is run again overwrites its own output.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.operators import telemetry
from pagelens.session import shared_folder

#: The largest body taken in, in bytes, and the rows a history keeps.
MOST_BODY = 50 * 1024 * 1024
HISTORY = 250


def place(spark: SparkSession, kind: str, name: str | None = None) -> str:
    """The folder of a query: a new one, or that of its name below the folder the cluster names."""
    if name is None:
        return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    return f"{spark.conf.get('spark.checkpoint.dir', None) or shared_folder(spark)}/streams/{kind}-{name}"


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def reset(spark: SparkSession, kind: str, name: str) -> None:
    """Forget what a named query has read and kept."""
    at, files = _files(spark, place(spark, kind, name))
    files.delete(at, True)


def source(spark: SparkSession, folder: str, name: str, most_files: int = 4) -> DataFrame:
    """A table's files as a stream, a few at a time."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(f"{folder}/{name}.parquet*")


def _run(df: DataFrame, at: str, mode: str, each) -> None:
    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/offsets").trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def _epochs(spark: SparkSession, at: str) -> list[int]:
    """The epochs whose output is complete, in order."""
    path, files = _files(spark, at)
    if not files.exists(path):
        return []
    found = [s.getPath() for s in files.listStatus(path)]
    done = [p for p in found if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName()) for p in done)


def _updated(df: DataFrame, at: str, keys: list[str]) -> DataFrame:
    """The newest row of each key of a streaming aggregate in update mode.

    The aggregate's state is Spark's; each batch puts out only the keys it changed.
    """
    spark = df.sparkSession

    def each(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/{epoch}")

    _run(df, at, "update", each)
    names = [c for c in df.columns if c not in keys]
    parts = [spark.read.schema(df.schema).parquet(f"{at}/out/{e}").withColumn("_epoch", F.lit(e)) for e in _epochs(spark, f"{at}/out")]
    if not parts:
        return spark.createDataFrame([], df.schema)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*keys).agg(F.max_by(F.struct(*names), "_epoch").alias("r")).select(*keys, "r.*")


def last_values(stream: DataFrame, key: str, order: Column, fields: list[str], name: str | None = None) -> DataFrame:
    """Of each key the last non-null value of each field, kept up to date batch by batch."""
    pairs = [F.max(F.when(F.col(f).isNotNull(), F.struct(order.alias("o"), F.col(f).alias("v")))).alias(f) for f in fields]
    kept = stream.where(F.col(key).isNotNull()).groupBy(key).agg(*pairs)
    out = _updated(kept, place(stream.sparkSession, "last", name), [key])
    return out.select(key, *[F.col(f"{f}.v").alias(f) for f in fields])


def history(stream: DataFrame, order: list[Column], most: int = HISTORY, name: str | None = None) -> DataFrame:
    """The newest rows of a stream, at most `most`; each batch is merged with the rows kept before it."""
    spark = stream.sparkSession
    at = place(spark, "history", name)

    def each(batch: DataFrame, epoch: int) -> None:
        before = [e for e in _epochs(spark, f"{at}/state") if e < epoch]
        rows = batch
        if before:
            rows = spark.read.schema(batch.schema).parquet(f"{at}/state/{before[-1]}").unionByName(rows)
        telemetry.latest(rows, order, most).write.mode("overwrite").parquet(f"{at}/state/{epoch}")
        for e in before[:-1]:  # the one before stays, in case this batch is run again
            old, files = _files(spark, f"{at}/state/{e}")
            files.delete(old, True)

    _run(stream, at, "append", each)
    done = _epochs(spark, f"{at}/state")
    return spark.read.schema(stream.schema).parquet(f"{at}/state/{done[-1]}") if done else spark.createDataFrame([], stream.schema)


def relayed(stream: DataFrame, name: str | None = None) -> DataFrame:
    """Every row passed on as it is, exactly once."""
    spark = stream.sparkSession
    at = place(spark, "relay", name)
    query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/offsets").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def once(stream: DataFrame, ident: Column, time: str, late: str = "400 days", name: str | None = None) -> DataFrame:
    """Rows of a stream with each identifier once, the state bounded by a watermark on `time`."""
    at = place(stream.sparkSession, "once", name)
    kept = stream.withColumn("_id", ident).where("_id is not null").withWatermark(time, late).dropDuplicatesWithinWatermark(["_id"])
    query = kept.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/offsets").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(kept.schema).parquet(f"{at}/out")


def ingested(stream: DataFrame, payload: str, most: int = MOST_BODY, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted packets, refused bodies): one pass, written to two sinks by batch.

    A body is refused if it is null, has more than `most` bytes or is no JSON.
    """
    spark = stream.sparkSession
    at = place(spark, "ingest", name)

    def routed(df: DataFrame) -> DataFrame:
        ok = F.coalesce((F.octet_length(payload) <= most) & F.try_parse_json(payload).isNotNull(), F.lit(False))
        return telemetry.routed(df.withColumn("_ok", ok), payload)

    def each(batch: DataFrame, epoch: int) -> None:
        routed(batch).write.mode("overwrite").partitionBy("_ok").parquet(f"{at}/out/{epoch}")

    _run(stream, at, "append", each)
    out = spark.createDataFrame([], routed(stream).schema)
    for e in _epochs(spark, f"{at}/out"):
        out = out.unionByName(spark.read.schema(out.schema).parquet(f"{at}/out/{e}"))
    return out.where("_ok").drop("_ok"), out.where("not _ok").drop("_ok")


def windows(stream: DataFrame, time: str, group: str, value: Column, width: str = "1 day", name: str | None = None) -> DataFrame:
    """Count and extremes of a value by window of event time (an extension: pages have none)."""
    rolled = stream.where(value.isNotNull()).groupBy(F.window(time, width).alias("w"), group).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("top"))
    out = _updated(rolled, place(stream.sparkSession, "windows", name), ["w", group])
    return out.select(F.unix_micros("w.start").alias("start_us"), group, "n", "low", "top")


def trails(stream: DataFrame, key: str, state: str, name: str | None = None) -> DataFrame:
    """Visits of each state by key: the newest row of each key and state."""
    return _updated(stream.groupBy(key, state).agg(F.count("*").alias("visits")), place(stream.sparkSession, "visits", name), [key, state])


def connection(stream: DataFrame, name: str | None = None) -> DataFrame:
    """(tab_id, connection) by a tab's last event: error, connected or disconnected."""
    last = last_values(stream, "tab_id", F.struct("received_at", "event", "status"), ["status"], name)
    s = F.lower("status")
    return last.select("tab_id", F.when(s == "error", "error").when(s.isin("success", "info", "running"), "connected").otherwise("disconnected").alias("connection"))
