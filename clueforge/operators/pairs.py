"""Operators that all pair engines share: pairs in a project, the four-valued status frame, scores, levels, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BANDS

PAIR = ["project_id", "bidder_a", "bidder_b"]


def pairs_in(members: DataFrame, group: str = "project_id", item: str = "bidder_id") -> DataFrame:
    """(group, bidder_a, bidder_b), a before b, of the distinct members of each group.

    An equi-join on the group; adaptive execution splits the partition of a very large group.
    """
    m = members.select(group, item).distinct()
    a, b = (m.select(group, F.col(item).alias(f"bidder_{s}")) for s in "ab")
    return a.join(b, group).where("bidder_a < bidder_b")


def band(score: Column, engine: str) -> Column:
    high, medium = BANDS[engine]
    return F.when(score >= high, "high").when(score >= medium, "medium").when(score > 0, "low").otherwise("none")


def signal_rows(states: DataFrame, keys: list[str], weights: dict[str, int], instances: DataFrame) -> DataFrame:
    """keys and signals: for each pair one array of (signal_type, status, instances, points), one entry a signal.

    states: keys and a map states, signal -> 'missing', 'excluded' or 'compared' (no entry counts as missing); instances: keys,
    signal_type, one row for each time the signal fires. triggered > the state's status > no_signal. A pair stays one row
    until its statuses are listed, so only pairs are joined, never pairs times signals.
    """
    fired = instances.groupBy(*keys).agg(*[F.count_if(F.col("signal_type") == s).alias(f"__{s}") for s in weights])
    entries = []
    for signal, weight in weights.items():
        n = F.coalesce(F.col(f"__{signal}"), F.lit(0))
        state = F.coalesce(F.try_element_at("states", F.lit(signal)), F.lit("missing"))
        status = F.when(n > 0, "triggered").when(state == "missing", "not_provided").when(state == "excluded", "excluded").otherwise("no_signal")
        entries.append(F.struct(F.lit(signal).alias("signal_type"), status.alias("status"), n.cast("bigint").alias("instances"), (n * weight).cast("bigint").alias("points")))
    return states.join(fired, keys, "left").select(*keys, F.array(*entries).alias("signals"))


def status_frame(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each pair and signal of signal_rows: status, instances, points."""
    return rows.select(*keys, F.explode("signals").alias("s")).select(*keys, "s.*")


def score_pairs(rows: DataFrame, keys: list[str], engine: str) -> DataFrame:
    """keys, score (capped sum of points), level, and how many signals have each status, from signal_rows."""
    having = lambda status: F.size(F.filter("signals", lambda e: e["status"] == status)).cast("bigint").alias(status)
    counts = [having(s) for s in ("triggered", "no_signal", "not_provided", "excluded")]
    points = F.aggregate("signals", F.lit(0).cast("bigint"), lambda n, e: n + e["points"])
    out = rows.select(*keys, F.least(points, F.lit(100).cast("bigint")).alias("score"), *counts)
    return out.withColumn("level", band(F.col("score"), engine))


def summarise(frame: DataFrame) -> DataFrame:
    """signal_type, status and how many pairs have it."""
    return frame.groupBy("signal_type", "status").agg(F.count("*").alias("pairs"))
