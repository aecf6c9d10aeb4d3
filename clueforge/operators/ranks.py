"""Global ranks of distinct values without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable


def dense_ranks(values: DataFrame, name: str) -> DataFrame:
    """(name, id): each distinct value with its rank in code point order as an integer from 0.

    Sorted by range over all tasks; the only thing that reaches the driver is one count a partition.
    """
    width = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = durable(
        values.select(name).distinct().repartitionByRange(width, name).sortWithinPartitions(name).withColumn("__at", F.monotonically_increasing_id()),
        "ranks",
    )
    part = F.shiftright("__at", 33)
    counts = dict(ordered.groupBy(part.alias("p")).count().collect())
    starts, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    start = F.element_at(F.array(*[F.lit(s).cast("bigint") for s in starts or [0]]), (part + 1).cast("int"))
    return ordered.select(name, (start + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"))
