"""Network, device and file links of bidders inside a project: eleven signals, pair features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import filled
from ..functions.parse import ip_prefix, present, strict_time, valid_ipv4
from ..schemas import CLOSE_TIME_S, LINK_SIGNALS, PUBLIC_EXIT_ROLES, SUBNET_WINDOW_S
from .pairs import PAIR, pairs_in, score_pairs, signal_rows, status_frame

#: signal -> field, for signals on a value two bidders share.
SHARED = {
    "shared_full_ip": "ip_address", "shared_device": "device_id", "shared_account": "account_id", "shared_file_hash": "file_sha256",
    "shared_author": "author", "shared_file_creator": "file_creator", "shared_pdf_producer": "pdf_producer",
}
TIMES = {"created_time_close": ("created_at",), "modified_time_close": ("modified_at",), "upload_time_close": ("uploaded_at", "event_time")}


def public_exit(records: DataFrame, excluded_ips: tuple[str, ...] = ()) -> Column:
    """Whether a row's address is one that many bidders use by right: listed, flagged, of such a role, or so by its extra columns."""
    extra = lambda k: filled(F.lower(F.trim(F.try_element_at("extra", F.lit(k)))))
    typed, flag = [filled(F.lower(F.trim("network_role")))], F.lit(False)
    if "extra" in records.columns:
        typed += [extra(k) for k in ("network_role", "ip_role", "owner_type")]
        flag = F.coalesce(extra("is_public_exit"), extra("public_exit")).isin("1", "true", "yes", "是")
    known = [F.coalesce("is_public_exit", F.lit(False)), F.coalesce(*typed).isin(*PUBLIC_EXIT_ROLES), flag, F.lower(F.trim("ip_address")).isin(*[ip.lower() for ip in excluded_ips])]
    return reduce(lambda a, b: a | b, [F.coalesce(k, F.lit(False)) for k in known])


def link_rows(records: DataFrame, excluded_ips: tuple[str, ...] = ()) -> DataFrame:
    """Rows with project and bidder: linkable values, times, and whether the row is a public exit.

    A column the table doesn't have counts as missing."""
    have = set(records.columns)
    value = lambda c: F.when(present(F.col(c)), F.lower(F.trim(c))) if c in have else F.lit(None).cast("string")
    time = lambda c: strict_time(F.col(c)) if c in have else F.lit(None).cast("timestamp")
    out = records.where(present(F.col("project_id")) & present(F.col("bidder_id")))
    return out.select(
        "record_id",
        "project_id",
        "bidder_id",
        *[value(c).alias(c) for c in SHARED.values()],
        *[time(c).alias(c) for c in ("created_at", "modified_at", "uploaded_at", "event_time")],
        public_exit(records, excluded_ips).alias("public_exit"),
    )


def _values(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """project, bidder, signal, value, usable: the distinct values; usable is false where all its rows are public exits."""
    entries = F.array(*[F.struct(F.lit(s).alias("signal_type"), F.col(c).alias("value"), F.lit(c == "ip_address").alias("net")) for s, c in fields.items()])
    long = rows.select("project_id", "bidder_id", "public_exit", F.explode(entries).alias("e")).where("e.value is not null")
    return long.groupBy("project_id", "bidder_id", "e.signal_type", "e.value").agg(F.bool_or(~(F.col("public_exit") & F.col("e.net"))).alias("usable"))


def shared_values(rows: DataFrame) -> DataFrame:
    """PAIR, signal_type, value: one row for each value that both bidders of a pair use, public exits left out."""
    v = _values(rows, SHARED).where("usable")
    on = ["project_id", "signal_type", "value"]
    a, b = (v.select(*on, F.col("bidder_id").alias(f"bidder_{s}")) for s in "ab")
    return a.join(b, on).where("bidder_a < bidder_b").select(*PAIR, "signal_type", "value")


def subnet_time(rows: DataFrame, window_s: int = SUBNET_WINDOW_S) -> DataFrame:
    """PAIR, prefix: different addresses of one subnet used within the window, one row for each subnet.

    Times are put into slots of the window's length; a row meets those of its own and the next slot, so the join is an
    equi-join on project, subnet and slot."""
    t = F.unix_timestamp(F.coalesce("event_time", "uploaded_at"))
    seen = rows.where(~F.col("public_exit") & valid_ipv4(F.col("ip_address"))).select(
        "project_id", "bidder_id", F.col("ip_address").alias("ip"), ip_prefix(F.col("ip_address")).alias("prefix"), t.alias("t")
    )
    seen = seen.where("t is not null").distinct().withColumn("slot", F.floor(F.col("t") / window_s))
    left = seen.select("project_id", "prefix", "slot", F.col("bidder_id").alias("x"), F.col("ip").alias("ip_x"), F.col("t").alias("t_x"))
    right = seen.select("project_id", "prefix", F.explode(F.array(F.col("slot") - 1, "slot", F.col("slot") + 1)).alias("slot"), F.col("bidder_id").alias("y"), F.col("ip").alias("ip_y"), F.col("t").alias("t_y"))
    met = left.join(right, ["project_id", "prefix", "slot"]).where(f"x < y and ip_x <> ip_y and abs(t_x - t_y) <= {window_s}")
    return met.select("project_id", F.col("x").alias("bidder_a"), F.col("y").alias("bidder_b"), "prefix").distinct()


def closest_times(rows: DataFrame) -> DataFrame:
    """PAIR, signal_type, seconds: the smallest distance of two bidders' times, for each kind of time.

    Distinct times are sorted once in a project; for each bidder pair only neighbours need a look, so both sides are first
    reduced to distinct times."""
    entries = F.array(*[F.struct(F.lit(s).alias("signal_type"), F.unix_timestamp(F.coalesce(*fields)).alias("t")) for s, fields in TIMES.items()])
    times = rows.select("project_id", "bidder_id", F.explode(entries).alias("e")).where("e.t is not null").select("project_id", "bidder_id", "e.signal_type", "e.t").distinct()
    per = times.groupBy("project_id", "signal_type", "bidder_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    a, b = (per.select("project_id", "signal_type", F.col("bidder_id").alias(f"bidder_{s}"), F.col("ts").alias(f"ts_{s}")) for s in "ab")
    pairs = a.join(b, ["project_id", "signal_type"]).where("bidder_a < bidder_b")
    merged = F.array_sort(F.concat(F.transform("ts_a", lambda t: F.struct(t.alias("t"), F.lit(0).alias("side"))), F.transform("ts_b", lambda t: F.struct(t.alias("t"), F.lit(1).alias("side")))))
    steps = F.transform(F.sequence(F.lit(1), F.size("m") - 1), lambda i: F.when(F.col("m")[i]["side"] != F.col("m")[i - 1]["side"], F.col("m")[i]["t"] - F.col("m")[i - 1]["t"]))
    return pairs.withColumn("m", merged).select(*PAIR, "signal_type", F.array_min(steps).alias("seconds"))


def link_instances(rows: DataFrame) -> DataFrame:
    shared = shared_values(rows).select(*PAIR, "signal_type")
    subnet = subnet_time(rows).select(*PAIR, F.lit("shared_subnet_time").alias("signal_type"))
    close = closest_times(rows).where(F.col("seconds") <= CLOSE_TIME_S).select(*PAIR, "signal_type")
    return shared.unionByName(subnet).unionByName(close)


def _pair_rows(rows: DataFrame) -> DataFrame:
    pairs = pairs_in(rows)
    t = F.coalesce("event_time", "uploaded_at")
    both = {signal: F.col(field) for signal, field in SHARED.items()} | {"shared_subnet_time": F.when(valid_ipv4(F.col("ip_address")) & t.isNotNull(), F.col("ip_address"))}
    both |= {signal: F.coalesce(*fields) for signal, fields in TIMES.items()}
    usable = [F.max(F.when(c.isNotNull(), ~(F.col("public_exit") & F.lit(s in ("shared_full_ip", "shared_subnet_time"))))).alias(s) for s, c in both.items()]
    side = rows.groupBy("project_id", "bidder_id").agg(*usable)
    a, b = (side.select("project_id", F.col("bidder_id").alias(f"bidder_{x}"), F.struct(*both).alias(f"side_{x}")) for x in "ab")
    state = lambda s: F.when(F.col(f"side_a.{s}").isNull() | F.col(f"side_b.{s}").isNull(), "missing").when(F.col(f"side_a.{s}") & F.col(f"side_b.{s}"), "compared").otherwise("excluded")
    states = F.create_map(*[x for s in both for x in (F.lit(s), state(s))])
    compared = pairs.join(a, ["project_id", "bidder_a"]).join(b, ["project_id", "bidder_b"]).select(*PAIR, states.alias("states"))
    return signal_rows(compared, PAIR, LINK_SIGNALS, link_instances(rows))


def link_frame(rows: DataFrame) -> DataFrame:
    """Status of the eleven signals: missing where either bidder has no value, then excluded where all of one's are public exits."""
    return status_frame(_pair_rows(rows), PAIR)


def link_features(rows: DataFrame) -> DataFrame:
    return score_pairs(_pair_rows(rows), PAIR, "links")


def link_lineage(rows: DataFrame) -> DataFrame:
    """PAIR, signal_type, value, record_id: every record that a shared value of a pair stands in, on either side.

    One row a record, so a value that very many records carry is never gathered in one place."""
    found = shared_values(rows)
    entries = F.array(*[F.struct(F.lit(s).alias("signal_type"), F.col(c).alias("value"), F.lit(c == "ip_address").alias("net")) for s, c in SHARED.items()])
    long = rows.select("project_id", "bidder_id", "record_id", "public_exit", F.explode(entries).alias("e")).where("e.value is not null and not (public_exit and e.net)")
    long = long.select("project_id", "bidder_id", "record_id", "e.signal_type", "e.value")
    sides = found.select("*", F.explode(F.array("bidder_a", "bidder_b")).alias("bidder_id"))
    return sides.join(long, ["project_id", "bidder_id", "signal_type", "value"]).where(present(F.col("record_id"))).select(*PAIR, "signal_type", "value", "record_id").distinct()
