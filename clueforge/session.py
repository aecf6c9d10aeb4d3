"""Session helpers: shared scratch space, written tables that cut lineage, session factory."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def local_session(name: str = "clueforge", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and the local bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset, a temporary one on a local master (tests), else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = context.get() if context.isDefined() else None
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="clueforge-")
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def durable(df: DataFrame, label: str = "table") -> DataFrame:
    """Write df once into the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nothing refers to any more, as after their result was written by durable().

    They are deleted when the driver's garbage is collected, which a short query may never bring about."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_if(written: DataFrame, units: int, most: int) -> DataFrame:
    """written marked for broadcast where its counted size (rows, or whatever units counts) is within most.

    Beyond that it is returned unmarked, and the planner joins it by sorted or hashed partitions.
    """
    return F.broadcast(written) if units <= most else written


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all shuffle partitions by keys, before work that costs far more than its input's bytes suggest."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def purge() -> None:
    """Delete the tables written by durable(); results that still read them become invalid."""
    while _written:
        spark, path = _written.pop()
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session may be gone at exit
            return


atexit.register(purge)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
