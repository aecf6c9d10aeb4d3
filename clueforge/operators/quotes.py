"""Quote patterns inside a project: consolidated totals, ten signals, pair features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import present, strict_amount, unit_factor
from ..schemas import ITEM_SCOPES, QUOTE_SIGNALS, QUOTE_TYPES, TOTAL_SCOPES
from ..session import durable
from .pairs import PAIR, pairs_in, score_pairs, signal_rows, status_frame


def quote_rows(records: DataFrame) -> DataFrame:
    """Rows of quotes and bids with project and bidder: scope, currency, amount and control amount in yuan, unit price."""
    factor = unit_factor(F.col("amount_unit"))
    scope = F.lower(F.trim(F.coalesce("quote_scope", F.lit(""))))
    return records.where(F.col("record_type").isin(*QUOTE_TYPES) & present(F.col("project_id")) & present(F.col("bidder_id"))).select(
        "project_id",
        "bidder_id",
        "record_id",
        F.when(scope.isin(*TOTAL_SCOPES), "total").when(scope.isin(*ITEM_SCOPES), "item").otherwise("other").alias("scope"),
        F.upper(F.when(present(F.col("currency")), F.trim("currency")).otherwise("CNY")).alias("currency"),
        present(F.col("amount")).alias("has_amount"),
        (strict_amount(F.col("amount")) * factor).cast("double").alias("amount"),
        (strict_amount(F.col("control_amount")) * factor).cast("double").alias("control"),
        F.trim("item_code").alias("item_code"),
        (strict_amount(F.col("unit_price")) * factor).cast("double").alias("unit_price"),
    )


def totals(rows: DataFrame) -> DataFrame:
    """One total for each project and bidder: several amounts or currencies make it excluded, no usable one leaves it
    not_provided (excluded where an amount stands there in an unknown form)."""
    by = rows.where("scope = 'total'").groupBy("project_id", "bidder_id").agg(
        F.count_distinct("amount").alias("amounts"),
        F.count_distinct(F.when(F.col("amount").isNotNull(), F.col("currency"))).alias("currencies"),
        F.max(F.col("has_amount")).alias("typed"),
        F.min("amount").alias("amount"),
        F.min(F.when(F.col("amount").isNotNull(), F.col("currency"))).alias("currency"),
    )
    state = (
        F.when((F.col("amounts") == 1) & (F.col("currencies") == 1), "compared")
        .when((F.col("amounts") == 0) & ~F.col("typed"), "missing")
        .otherwise("excluded")
    )
    by = by.withColumn("state", state)
    keep = lambda c: F.when(F.col("state") == "compared", F.col(c)).alias(c)
    return by.select("project_id", "bidder_id", "state", keep("amount"), keep("currency"))


def clean(all_totals: DataFrame) -> DataFrame:
    return all_totals.where("state = 'compared'").select("project_id", "bidder_id", "currency", "amount")


def relative_distance(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest((F.abs(a) + F.abs(b)) / 2, F.lit(1.0))


def total_pairs(good: DataFrame) -> DataFrame:
    a, b = (good.select("project_id", "currency", F.col("bidder_id").alias(f"bidder_{s}"), F.col("amount").alias(f"amount_{s}")) for s in "ab")
    return a.join(b, ["project_id", "currency"]).where("bidder_a < bidder_b")


def pairwise_distance(good: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    pairs = total_pairs(good) if pairs is None else pairs
    distance = relative_distance(F.col("amount_a"), F.col("amount_b"))
    return pairs.select(*PAIR, "currency", "amount_a", "amount_b", distance.alias("distance"), (distance <= 0.005).alias("triggered"))


def control_prices(rows: DataFrame) -> DataFrame:
    """project_id, state, control: the one control price of a project; several make it excluded."""
    by = rows.groupBy("project_id").agg(F.count_distinct("control").alias("n"), F.min("control").alias("control"))
    return by.select(
        "project_id",
        F.when(F.col("n") == 1, "compared").when(F.col("n") == 0, "missing").otherwise("excluded").alias("state"),
        F.when(F.col("n") == 1, F.col("control")).alias("control"),
    )


def control_ratio(good: DataFrame, controls: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    pairs = (total_pairs(good) if pairs is None else pairs).join(controls.where("state = 'compared'"), "project_id")
    ra, rb = F.col("amount_a") / F.col("control"), F.col("amount_b") / F.col("control")
    hit = ra.between(0.95, 1) & rb.between(0.95, 1) & (F.abs(ra - rb) <= 0.003)
    return pairs.select(*PAIR, ra.alias("ratio_a"), rb.alias("ratio_b"), hit.alias("triggered"))


def robust_outliers(good: DataFrame) -> DataFrame:
    """Bidders of groups of four or more whose robust z-score is at least 3.5 in size."""
    group = ["project_id", "currency"]
    middle = good.groupBy(*group).agg(F.median("amount").alias("median"), F.count("*").alias("n")).where("n >= 4")
    away = good.join(middle, group).withColumn("away", F.abs(F.col("amount") - F.col("median")))
    mad = away.groupBy(*group).agg(F.median("away").alias("mad"))
    z = F.try_divide(F.lit(0.6745) * (F.col("amount") - F.col("median")), F.col("mad"))
    return away.join(mad, group).where("mad > 0").select(*group, "bidder_id", "amount", "median", "mad", z.alias("z")).where(F.abs("z") >= 3.5)


def gap_patterns(good: DataFrame) -> DataFrame:
    """Groups of three or more: how many gaps and ratios of neighbouring prices lie close to their median."""
    group = ["project_id", "currency"]
    w = Window.partitionBy(*group).orderBy("amount", "bidder_id")
    before = F.lag("amount").over(w)
    steps = good.select(*group, (F.col("amount") - before).alias("gap"), F.try_divide("amount", before).alias("ratio")).where("gap is not null")
    middle = steps.groupBy(*group).agg(F.median("gap").alias("mid_gap"), F.median("ratio").alias("mid_ratio"), F.count("*").alias("steps"))
    near_gap = (F.col("mid_gap") > 0) & (F.abs(F.col("gap") - F.col("mid_gap")) <= F.col("mid_gap") * 0.02)
    near_ratio = (F.col("mid_ratio") > 1) & (F.abs(F.col("ratio") - F.col("mid_ratio")) <= 0.003)
    by = steps.join(middle.where("steps >= 2"), group).groupBy(*group, "steps", "mid_gap", "mid_ratio")
    out = by.agg(F.count_if(near_gap).alias("near_gaps"), F.count_if(near_ratio).alias("near_ratios"))
    return out.withColumns({"fixed_difference": F.col("near_gaps") >= 2, "fixed_ratio": F.col("near_ratios") >= 2})


def price_tails(good: DataFrame, modulus: int = 10000, least: int = 3) -> DataFrame:
    """Price endings that at least `least` bidders of a group share, round ones left out."""
    tail = F.lpad((F.bround("amount", 0).cast("bigint") % modulus).cast("string"), len(str(modulus)) - 1, "0")
    return (
        good.withColumn("tail", tail)
        .where(~F.col("tail").isin("0000", "0100", "1000"))
        .groupBy("project_id", "currency", "tail")
        .agg(F.count("*").alias("bidders"))
        .where(F.col("bidders") >= least)
    )


def accompaniment(good: DataFrame) -> DataFrame:
    """Groups of three or more with one low price (at most 0.85 of the others' median) under close high prices."""
    group = ["project_id", "currency"]
    w = Window.partitionBy(*group).orderBy("amount", "bidder_id")
    ranked = good.withColumn("place", F.row_number().over(w))
    low = ranked.where("place = 1").select(*group, F.col("bidder_id").alias("low_bidder"), F.col("amount").alias("low"))
    high = ranked.where("place > 1").groupBy(*group).agg(
        F.median("amount").alias("high"), F.count("*").alias("highs"), ((F.max("amount") - F.min("amount")) / F.median("amount")).alias("spread")
    )
    return low.join(high.where("highs >= 2"), group).where("low <= 0.85 * high and spread <= 0.01")


def item_prices(rows: DataFrame) -> DataFrame:
    """One unit price for each project, bidder and item; different prices drop the item."""
    items = rows.where((F.col("scope") == "item") & present(F.col("item_code")) & F.col("unit_price").isNotNull())
    by = items.groupBy("project_id", "bidder_id", "item_code").agg(F.count_distinct("unit_price").alias("n"), F.min("unit_price").alias("price"))
    return by.where("n = 1").drop("n")


def _pearson(x: str, y: str) -> Column:
    n, sx, sy = F.count("*"), F.sum(x), F.sum(y)
    xx, yy, xy = F.sum(F.col(x) * F.col(x)), F.sum(F.col(y) * F.col(y)), F.sum(F.col(x) * F.col(y))
    vx, vy = F.greatest(n * xx - sx * sx, F.lit(0.0)), F.greatest(n * yy - sy * sy, F.lit(0.0))
    return F.try_divide(n * xy - sx * sy, F.sqrt(vx) * F.sqrt(vy))


def item_correlation(prices: DataFrame, least: int = 3) -> DataFrame:
    """Bidder pairs that share at least `least` items of a project: correlation of their prices and of their ranks."""
    a, b = (prices.select("project_id", "item_code", F.col("bidder_id").alias(f"bidder_{s}"), F.col("price").alias(f"price_{s}")) for s in "ab")
    shared = a.join(b, ["project_id", "item_code"]).where("bidder_a < bidder_b")
    ranked = shared.withColumns({f"rank_{s}": F.rank().over(Window.partitionBy(*PAIR).orderBy(f"price_{s}")).cast("double") for s in "ab"})
    out = ranked.groupBy(*PAIR).agg(F.count("*").alias("items"), _pearson("price_a", "price_b").alias("r_price"), _pearson("rank_a", "rank_b").alias("r_rank"))
    return out.where(F.col("items") >= least)


def signal_instances(rows: DataFrame, good: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """PAIR and signal_type, one row for each time a signal fires for a pair. good, items: written totals and item correlations."""
    good = durable(clean(totals(rows)), "totals") if good is None else good
    group = ["project_id", "currency"]
    pairs = durable(total_pairs(good), "total-pairs")
    named = lambda df, s: df.select(*PAIR, F.lit(s).alias("signal_type"))
    gaps = gap_patterns(good)
    out = [
        named(pairwise_distance(good, pairs).where("triggered"), "pairwise_price_distance"),
        named(control_ratio(good, control_prices(rows), pairs).where("triggered"), "control_price_ratio"),
        named(pairs.join(gaps.where("fixed_difference").select(*group), group), "fixed_difference"),
        named(pairs.join(gaps.where("fixed_difference").select(*group), group), "staircase_quote"),
        named(pairs.join(gaps.where("fixed_ratio").select(*group), group), "fixed_ratio"),
    ]
    outliers = robust_outliers(good).select(*group, F.col("bidder_id").alias("out"))
    out.append(named(pairs.join(outliers, group).where("out = bidder_a or out = bidder_b"), "median_deviation"))
    tail = lambda s: F.lpad((F.bround(f"amount_{s}", 0).cast("bigint") % 10000).cast("string"), 4, "0")
    out.append(named(pairs.where(tail("a") == tail("b")).withColumn("tail", tail("a")).join(price_tails(good), [*group, "tail"]), "repeated_price_tail"))
    low = accompaniment(good).select(*group, "low_bidder")
    out.append(named(pairs.join(low, group).where("low_bidder = bidder_a or low_bidder = bidder_b"), "accompaniment_structure"))
    items = item_correlation(item_prices(rows)) if items is None else items
    out += [named(items.where("r_price >= 0.995"), "item_price_correlation"), named(items.where("r_rank >= 0.995"), "item_rank_consistency")]
    merged = out[0]
    for more in out[1:]:
        merged = merged.unionByName(more)
    return merged


def _pair_rows(rows: DataFrame) -> DataFrame:
    all_totals = durable(totals(rows), "all-totals")
    good, items = clean(all_totals), durable(item_correlation(item_prices(rows)), "items")
    pairs = pairs_in(rows)
    states = all_totals.select("project_id", "bidder_id", "state")
    sized = good.groupBy("project_id").agg(F.count("*").alias("n"))
    controls = control_prices(rows).select("project_id", F.col("state").alias("control_state"))
    a, b = (states.select("project_id", F.col("bidder_id").alias(f"bidder_{s}"), F.col("state").alias(f"state_{s}")) for s in "ab")
    base = pairs.join(a, ["project_id", "bidder_a"], "left").join(b, ["project_id", "bidder_b"], "left").join(sized, "project_id", "left")
    base = base.join(controls, "project_id", "left")
    either = lambda value: (F.col("state_a") == value) | (F.col("state_b") == value)
    total = (
        F.when(F.coalesce(either("excluded"), F.lit(False)), "excluded")
        .when((F.col("state_a") == "compared") & (F.col("state_b") == "compared"), "compared")
        .otherwise("missing")
    )
    needs = {"median_deviation": 4, "fixed_difference": 3, "staircase_quote": 3, "fixed_ratio": 3, "repeated_price_tail": 3, "accompaniment_structure": 3}
    state = {s: F.when(total != "compared", total).when(F.coalesce("n", F.lit(0)) >= k, "compared").otherwise("missing") for s, k in needs.items()}
    state["pairwise_price_distance"] = total
    state["control_price_ratio"] = F.when(total != "compared", total).otherwise(F.coalesce("control_state", F.lit("missing")))
    base = base.join(items.select(*PAIR, "items"), PAIR, "left")
    for signal in ("item_price_correlation", "item_rank_consistency"):
        state[signal] = F.when(F.col("items").isNotNull(), "compared").otherwise("missing")
    states = F.create_map(*[x for s, e in state.items() for x in (F.lit(s), e)])
    return signal_rows(base.select(*PAIR, states.alias("states")), PAIR, QUOTE_SIGNALS, signal_instances(rows, good, items))


def quote_frame(rows: DataFrame) -> DataFrame:
    """The status of each of the ten signals for each pair of bidders of a project.

    Excluded dominates: a total signal is excluded where either total is, missing where either is absent. Group signals
    need three or four compared totals, control_price_ratio a control price, item signals three shared items.
    """
    return status_frame(_pair_rows(rows), PAIR)


def quote_features(rows: DataFrame) -> DataFrame:
    return score_pairs(_pair_rows(rows), PAIR, "quotes")
