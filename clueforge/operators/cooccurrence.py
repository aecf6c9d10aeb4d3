"""Bidders that meet again and again across projects: metrics, thirteen signals, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import present, strict_time
from ..schemas import COOCCURRENCE_SIGNALS, RUN_GAP_DAYS
from ..session import durable
from .components import connected_components
from .pairs import band, pairs_in

PAIR = ["bidder_a", "bidder_b"]
ADDRESS_KEYS = ("address", "地址", "联系地址", "注册地址", "公司地址", "office_addr")
CONTACT_KEYS = ("contact", "联系人")


def memberships(records: DataFrame) -> DataFrame:
    """One row for each project and bidder: outcome (a win beats a loss beats none) and best rank."""
    rows = records.where(present(F.col("project_id")) & present(F.col("bidder_id")))
    return rows.groupBy("project_id", "bidder_id").agg(F.bool_or("is_winner").alias("winner"), F.min(F.when(F.col("bid_rank") > 0, F.col("bid_rank"))).alias("rank"))


def projects(records: DataFrame) -> DataFrame:
    """project_id, first time of any of its rows, and its agency (the smallest of several)."""
    time = F.coalesce(*[strict_time(F.col(c)) for c in ("event_time", "uploaded_at", "created_at", "modified_at")])
    agency = F.when(present(F.col("agency_id")), F.col("agency_id"))
    return records.where(present(F.col("project_id"))).groupBy("project_id").agg(F.min(time).alias("time"), F.min(agency).alias("agency"))


def meetings(members: DataFrame, info: DataFrame) -> DataFrame:
    """One row for each project where a pair meets, with time, agency and both outcomes."""
    a, b = (members.select("project_id", F.col("bidder_id").alias(f"bidder_{s}"), F.col("winner").alias(f"winner_{s}")) for s in "ab")
    return a.join(b, "project_id").where("bidder_a < bidder_b").join(info, "project_id")


def metrics(members: DataFrame) -> DataFrame:
    """Counts, Jaccard, lift and pointwise mutual information of every pair that meets."""
    n = members.groupBy("bidder_id").agg(F.count("*").alias("n"))
    total = members.agg(F.count_distinct("project_id").alias("n_projects"))
    met = pairs_in(members).groupBy(*PAIR).agg(F.count("*").alias("together"))
    a, b = (n.select(F.col("bidder_id").alias(f"bidder_{s}"), F.col("n").alias(f"n_{s}")) for s in "ab")
    out = met.join(a, "bidder_a").join(b, "bidder_b").join(F.broadcast(total))
    lift = F.col("together") * F.col("n_projects") / (F.col("n_a") * F.col("n_b"))
    return out.select(*PAIR, "together", "n_a", "n_b", (F.col("together") / (F.col("n_a") + F.col("n_b") - F.col("together"))).alias("jaccard"), lift.alias("lift"), F.log2(lift).alias("pmi"))


def longest_runs(met: DataFrame, gap_days: int = RUN_GAP_DAYS) -> DataFrame:
    """Longest run of meetings at most gap_days whole days apart; meetings without a time are left out."""
    w = Window.partitionBy(*PAIR).orderBy("time", "project_id")
    days = F.floor((F.unix_timestamp("time") - F.unix_timestamp(F.lag("time").over(w))) / 86400)
    starts = met.where("time is not null").withColumn("fresh", F.when(days <= gap_days, 0).otherwise(1))
    runs = starts.withColumn("run", F.sum("fresh").over(w)).groupBy(*PAIR, "run").agg(F.count("*").alias("n"))
    return runs.groupBy(*PAIR).agg(F.max("n").alias("longest_run"))


def outcomes(met: DataFrame) -> DataFrame:
    """Meetings where both outcomes are known, those of them that one won and the other lost, and how often the winner changed."""
    known = met.where("winner_a is not null and winner_b is not null")
    winner = F.when(F.col("winner_a") != F.col("winner_b"), F.when(F.col("winner_a"), F.col("bidder_a")).otherwise(F.col("bidder_b")))
    w = Window.partitionBy(*PAIR).orderBy(F.col("time").asc_nulls_last(), "project_id").rowsBetween(Window.unboundedPreceding, -1)
    told = known.withColumn("winner", winner).withColumn("before", F.last("winner", ignorenulls=True).over(w))
    return told.groupBy(*PAIR).agg(F.count("*").alias("both_known"), F.count("winner").alias("decided"), F.count_if(F.col("winner") != F.col("before")).alias("switches"))


def same_agency(met: DataFrame) -> DataFrame:
    """The most meetings of a pair under one agency, and how many had any agency."""
    per = met.where("agency is not null").groupBy(*PAIR, "agency").agg(F.count("*").alias("n"))
    return per.groupBy(*PAIR).agg(F.max("n").alias("one_agency"), F.sum("n").alias("any_agency"))


def shared_identifiers(records: DataFrame) -> DataFrame:
    """(bidder_a, bidder_b, signal_type, values): identifiers two bidders share, unless both used them in one and the same project.

    Rows of public exits don't count for addresses of the network."""
    fields = {"shared_ip": "ip_address", "shared_device": "device_id", "shared_account": "account_id"}
    by_key = {"shared_contact": CONTACT_KEYS, "shared_address": ADDRESS_KEYS}
    exit_ = F.coalesce("is_public_exit", F.lit(False))
    values = [F.struct(F.lit(s).alias("signal_type"), (F.when(~exit_, F.col(c)) if c == "ip_address" else F.col(c)).alias("value")) for s, c in fields.items()]
    values += [F.struct(F.lit(s).alias("signal_type"), F.try_element_at("extra", F.lit(k)).alias("value")) for s, keys in by_key.items() for k in keys]
    long = records.where(present(F.col("bidder_id"))).select("bidder_id", F.coalesce("project_id", F.lit("")).alias("project_id"), F.explode(F.array(*values)).alias("e"))
    long = long.select("bidder_id", "project_id", "e.signal_type", F.lower(F.trim("e.value")).alias("value")).where(present(F.col("value")))
    used = long.groupBy("signal_type", "value", "bidder_id").agg(F.count_distinct("project_id").alias("n"), F.min("project_id").alias("p"))
    used = used.where("not (signal_type = 'shared_address' and length(value) < 5)")
    a, b = (used.select("signal_type", "value", F.col("bidder_id").alias(f"bidder_{s}"), F.col("n").alias(f"n_{s}"), F.col("p").alias(f"p_{s}")) for s in "ab")
    met = a.join(b, ["signal_type", "value"]).where("bidder_a < bidder_b and not (n_a = 1 and n_b = 1 and p_a = p_b and p_a <> '')")
    return met.groupBy(*PAIR, "signal_type").agg(F.count("*").alias("values"))


def pair_signals(records: DataFrame) -> DataFrame:
    """Every pair that meets or shares an identifier: together, and signals, an array of (signal_type, status, points) of all thirteen.

    Strengths are excluded for pairs that meet less than twice; outcomes, agencies and identifiers that neither side tells
    are not_provided, so nothing missing counts as no signal.
    """
    members, info = durable(memberships(records), "members"), projects(records)
    met = durable(meetings(members, info), "meetings")
    shared = shared_identifiers(records).groupBy(*PAIR).pivot("signal_type", [s for s in COOCCURRENCE_SIGNALS if s.startswith("shared_")]).agg(F.first("values"))
    out = metrics(members).join(shared, PAIR, "full_outer").join(longest_runs(met), PAIR, "left").join(outcomes(met), PAIR, "left").join(same_agency(met), PAIR, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    told = lambda provided, fires: F.when(~provided, "not_provided").when(fires, "triggered").otherwise("no_signal")
    strength = lambda c, least: F.when(n("together") < 2, "excluded").when(F.col(c) >= least, "triggered").otherwise("no_signal")
    status = {
        "stable_cooccurrence": told(F.lit(True), n("together") >= 2),
        "jaccard": strength("jaccard", 0.45),
        "lift": strength("lift", 1.8),
        "pmi": strength("pmi", 0.85),
        "consecutive_cooccurrence": told(n("together") > 0, n("longest_run") >= 2),
        "winner_loser_pattern": told(n("both_known") > 0, (n("decided") >= 2) & (n("decided") >= 0.75 * n("both_known"))),
        "alternating_winner": told(n("decided") >= 2, (n("switches") >= 2) & (n("decided") >= 3)),
        "same_agency": told(n("any_agency") > 0, n("one_agency") >= 2),
    } | {s: told(n(s) > 0, n(s) > 0) for s in COOCCURRENCE_SIGNALS if s.startswith("shared_")}
    entry = lambda s: F.struct(F.lit(s).alias("signal_type"), status[s].alias("status"), F.when(status[s] == "triggered", F.lit(COOCCURRENCE_SIGNALS[s])).otherwise(0).cast("bigint").alias("points"))
    return out.select(*PAIR, n("together").cast("bigint").alias("together"), F.array(*[entry(s) for s in status]).alias("signals"))


def pair_status(records: DataFrame) -> DataFrame:
    """One row for each pair and signal: status and points."""
    return pair_signals(records).select(*PAIR, F.explode("signals").alias("s")).select(*PAIR, "s.*")


def pair_features(records: DataFrame) -> DataFrame:
    """Every pair of pair_signals with its score, the names of its triggered signals, and its level."""
    fired = F.transform(F.filter("signals", lambda e: e["status"] == "triggered"), lambda e: e["signal_type"])
    points = F.aggregate("signals", F.lit(0).cast("bigint"), lambda a, e: a + e["points"])
    out = pair_signals(records).select(*PAIR, "together", F.least(points, F.lit(100).cast("bigint")).alias("score"), F.array_join(F.array_sort(fired), ",").alias("signals"))
    return out.withColumn("level", band(F.col("score"), "cooccurrence"))


def groups(features: DataFrame, members: DataFrame) -> DataFrame:
    """Components of bidders over pairs with a score: size, projects all members share, stability, score.

    A group is stable with three members or more that share two projects or more; its score is the rounded-down mean
    of its pairs, 16 more if stable, 100 at most."""
    linked = features.where("score > 0")
    of = connected_components(linked, "bidder_a", "bidder_b")
    size = of.groupBy("component").agg(F.count("*").alias("members"))
    held = members.join(of, members["bidder_id"] == of["id"]).groupBy("component", "project_id").agg(F.count("*").alias("there"))
    common = held.join(size, "component").where("there = members").groupBy("component").agg(F.count("*").alias("common_projects"))
    mean = linked.join(of, linked["bidder_a"] == of["id"]).groupBy("component").agg(F.sum("score").alias("s"), F.count("*").alias("pairs"))
    out = size.join(mean, "component").join(common, "component", "left").withColumn("common_projects", F.coalesce("common_projects", F.lit(0)))
    stable = (F.col("members") >= 3) & (F.col("common_projects") >= 2)
    score = F.least(F.floor(F.col("s") / F.col("pairs")) + F.when(stable, 16).otherwise(0), F.lit(100))
    return out.select("component", "members", "pairs", "common_projects", stable.alias("stable"), score.cast("bigint").alias("score"))
