"""Mixed timestamp formats and zones to one instant through a dictionary of distinct raw strings."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chars import filled
from ..functions.times import FORMS, MONTHS, ZONES, with_instant
from ..session import durable, scratch_dir, spread

DEFAULT_ZONE, DEFAULT_ORDER = "Asia/Shanghai", "ymd"
KEYS = ["raw", "zone", "date_order"]


_ENTRY = "raw string, zone string, date_order string, utc_us bigint"
#: Changes with anything that decides what a text means, so that a kept dictionary never answers for other rules.
RULES = hashlib.sha256(repr((FORMS, ZONES, MONTHS, 1)).encode()).hexdigest()[:12]


class InstantDictionary:
    """Distinct (raw, zone, date_order) with their instant: each is parsed once and kept in a folder of parquet batches.

    path: a folder that outlives the session (by default one in the shared scratch folder). Every call writes the
    values it hasn't met as a batch of its own, so runs at the same time don't disturb each other; a value that two of
    them wrote counts once. Values that don't parse are kept as null, so they are not tried again.
    """

    def __init__(self, path: str | None = None):
        self.path = path

    def resolve(self, values: DataFrame) -> DataFrame:
        """values: the columns KEYS, repeated at will. Returns each distinct key of them once with utc_us."""
        spark = values.sparkSession
        path = f"{self.path or scratch_dir(spark) + '/instants'}/{RULES}"
        wanted = values.select(*KEYS).distinct()
        held = self._held(spark, path)
        if held is not None:
            wanted = durable(wanted, "wanted-instants")
            known = held.join(wanted, KEYS, "left_semi").groupBy(*KEYS).agg(F.min("utc_us").alias("utc_us"))
            known = durable(known, "known-instants")
            wanted = wanted.join(known, KEYS, "left_anti")
        batch = f"{path}/batch-{uuid.uuid4().hex}"
        with_instant(spread(wanted, *KEYS), "raw", "zone", "date_order", "utc_us").write.option("compression", "zstd").parquet(batch)
        fresh = spark.read.schema(_ENTRY).parquet(batch)
        return fresh if held is None else fresh.unionByName(known)

    def _held(self, spark, path: str) -> DataFrame | None:
        """All finished batches."""
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch-*/_SUCCESS")
        done = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
        batches = [str(f.getPath().getParent()) for f in done or []]
        return spark.read.schema(_ENTRY).parquet(*batches) if batches else None


def normalise_times(
    records: DataFrame,
    sources: DataFrame,
    fields: list[str],
    key: str = "record_id",
    source: str = "source_system",
    dictionary: InstantDictionary | None = None,
) -> DataFrame:
    """(key, field_name, raw, utc_us) for every non-blank value of the fields, utc_us null where there is no instant.

    sources: source, tz_name, date_order; at most one row a source counts (the smallest zone of several), and a
    record whose source is blank or unknown is read as Asia/Shanghai, year first. Sources are joined, never collected.
    A value that a third of all rows share is one row of the dictionary; the join back to the rows is an ordinary
    equi-join in which adaptive execution splits such a partition. Empty tables give an empty result; other columns
    of either table don't matter.
    """
    zones = sources.groupBy(F.col(source).alias("__source")).agg(
        F.min(F.struct(F.col("tz_name"), F.lower("date_order").alias("date_order"))).alias("__z")
    )
    entries = F.array(*[F.struct(F.lit(f).alias("field_name"), filled(F.col(f).cast("string")).alias("raw")) for f in fields])
    long = records.select(F.col(key).alias("__key"), F.col(source).alias("__s"), F.explode(entries).alias("e")).where("e.raw is not null")
    zoned = long.join(zones, long["__s"] == zones["__source"], "left").select(
        F.col("__key").alias(key),
        "e.field_name",
        "e.raw",
        F.coalesce("__z.tz_name", F.lit(DEFAULT_ZONE)).alias("zone"),
        F.coalesce("__z.date_order", F.lit(DEFAULT_ORDER)).alias("date_order"),
    )
    known = (dictionary or InstantDictionary()).resolve(zoned)
    return zoned.join(known, KEYS, "left").select(key, "field_name", "raw", "utc_us")
