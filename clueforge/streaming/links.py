"""Network links while events arrive: bidders of one project in one subnet within a time window, as a stream-stream join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import ip_prefix, valid_ipv4
from ..schemas import SUBNET_WINDOW_S


def subnet_links(events: DataFrame, window_s: int = SUBNET_WINDOW_S, late: str = "30 minutes") -> DataFrame:
    """(project_id, bidder_a, bidder_b, prefix, at): append-only pairs of events of different addresses in one subnet.

    events: a stream of project_id, bidder_id, ip_address and event_time TIMESTAMP. The watermark and the window bound what
    each side keeps, so state doesn't grow with the stream; an event later than `late` is left out. Rows with a blank id, an
    unreadable address or no time give no link.
    """
    seen = events.where(valid_ipv4(F.col("ip_address")) & F.col("project_id").isNotNull() & F.col("bidder_id").isNotNull()).select(
        "project_id", "bidder_id", "ip_address", ip_prefix(F.col("ip_address")).alias("prefix"), "event_time"
    )
    a = seen.select(*[F.col(c).alias(f"a_{c}") for c in seen.columns]).withWatermark("a_event_time", late)
    b = seen.select(*[F.col(c).alias(f"b_{c}") for c in seen.columns]).withWatermark("b_event_time", late)
    near = F.expr(f"b_event_time between a_event_time - interval {window_s} seconds and a_event_time + interval {window_s} seconds")
    on = (F.col("a_project_id") == F.col("b_project_id")) & (F.col("a_prefix") == F.col("b_prefix")) & (F.col("a_bidder_id") < F.col("b_bidder_id")) & (F.col("a_ip_address") != F.col("b_ip_address")) & near
    return a.join(b, on).select(
        F.col("a_project_id").alias("project_id"),
        F.col("a_bidder_id").alias("bidder_a"),
        F.col("b_bidder_id").alias("bidder_b"),
        F.col("a_prefix").alias("prefix"),
        F.greatest("a_event_time", "b_event_time").alias("at"),
    )


def activity(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, project_id, events, bidders): events of each project in tumbling windows, bidders counted approximately."""
    by = events.withWatermark("event_time", late).groupBy(F.window("event_time", window), "project_id")
    return by.agg(F.count("*").alias("events"), F.approx_count_distinct("bidder_id").alias("bidders")).select(F.col("window.start").alias("start"), "project_id", "events", "bidders")
