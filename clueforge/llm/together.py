"""Items that appear together: pair counts over baskets by sorting packed 64-bit pair codes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import dense_ranks
from ..session import durable

_RUNS = "code bigint, n bigint"


def _run_lengths(batches):
    """Sorted (code, n) batches to one (code, sum of n) a run; a run may span batches."""
    code, count = None, 0
    for batch in batches:
        codes, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(codes):
            continue
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        heads, sums = codes[starts], np.add.reduceat(n, starts)
        if code is not None and heads[0] == code:
            sums[0] += count
        elif code is not None:
            yield pa.RecordBatch.from_arrays([pa.array([code], pa.int64()), pa.array([count], pa.int64())], ["code", "n"])
        code, count = int(heads[-1]), int(sums[-1])
        if len(heads) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(heads[:-1]), pa.array(sums[:-1])], ["code", "n"])
    if code is not None:
        yield pa.RecordBatch.from_arrays([pa.array([code], pa.int64()), pa.array([count], pa.int64())], ["code", "n"])


def count_codes(codes: DataFrame) -> DataFrame:
    """(code, n): sum of n for each 64-bit code, as an external sort.

    Every task sorts its codes (Spark's sorter spills sorted runs and merges them) and shortens them to run lengths
    before anything is shuffled, so a code that a third of all rows carry moves as one row a task; the shuffle
    then merges the sorted runs of all tasks and their lengths are summed.
    """
    runs = codes.sortWithinPartitions("code").mapInArrow(_run_lengths, _RUNS)
    return runs.repartition(F.col("code")).sortWithinPartitions("code").mapInArrow(_run_lengths, _RUNS)


def pairs_together(baskets: DataFrame, basket: str, item: str, least: int = 5, lift: float = 4.0) -> DataFrame:
    """Pairs of items in the same basket at least `least` times and `lift` times as often as chance.

    Returns item_a, item_b (the smaller first, by code point), n_ab, n_a, n_b, n_baskets, lift, log_odds, log_odds_se;
    the odds ratio of the 2x2 table gets 0.5 added to each cell. Rows with a null or blank basket or item don't count,
    repeated rows count once, an empty table gives no pair, other columns don't matter.

    An item found less than `least` times, or in more than 1/lift of all baskets, can be in no such pair and is left
    out first. Each item sets aside its least - 1 largest baskets (all items in one order of baskets): two items that meet
    `least` times meet in at least one basket that neither set aside. So a basket emits packed codes (rank of a,
    rank of b) only of pairs in which one item kept it; the few largest baskets, which most of their items set aside,
    emit hardly any. A pair's count is the length of its code's run and the baskets both set aside (at most least - 1 each).
    """
    clean = baskets.where(F.col(basket).rlike(r"(?U)\S") & F.col(item).rlike(r"(?U)\S"))
    members = durable(clean.select(F.col(basket).cast("string").alias("basket"), F.col(item).cast("string").alias("item")).distinct(), "members")
    n_baskets = members.select("basket").distinct().count()
    counted = members.groupBy("item").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("n") * lift <= n_baskets))
    items = durable(counted.join(dense_ranks(counted, "item"), "item"), "items")
    held = durable(members.join(items.select("item", "id"), "item").select("basket", "id"), "held")
    sized = held.join(held.groupBy("basket").agg(F.count("*").alias("size")), "basket")
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.col("size").desc(), "basket"))
    aside = durable(sized.withColumn("nth", nth).where(F.col("nth") < least).select("id", "basket", F.lit(True).alias("aside")), "aside")
    marked = durable(held.join(aside, ["id", "basket"], "left").select("basket", "id", F.coalesce("aside", F.lit(False)).alias("aside")), "marked")
    x, y = marked.where("not aside").select("basket", "id").alias("x"), marked.alias("y")
    met = x.join(y, F.col("x.basket") == F.col("y.basket")).where("x.id < y.id or (y.aside and x.id <> y.id)")
    counts = count_codes(met.select(F.expr("shiftleft(least(x.id, y.id), 32) | greatest(x.id, y.id)").alias("code"), F.lit(1).cast("bigint").alias("n")))
    pairs = counts.select(F.shiftright("code", 32).alias("ia"), F.col("code").bitwiseAND(F.lit((1 << 32) - 1)).alias("ib"), "n")
    left = items.select(F.col("id").alias("ia"), F.col("item").alias("item_a"), F.col("n").alias("n_a"))
    right = items.select(F.col("id").alias("ib"), F.col("item").alias("item_b"), F.col("n").alias("n_b"))
    enough = lambda n: (n >= least) & (n * n_baskets >= lift * F.col("n_a") * F.col("n_b"))
    pairs = pairs.join(left, "ia").join(right, "ib").where(enough(F.col("n") + (least - 1)))
    lists = aside.groupBy("id").agg(F.collect_list("basket").alias("l"))  # at most least - 1 of each item
    a, b = (lists.select(F.col("id").alias(f"i{s}"), F.col("l").alias(f"l{s}")) for s in "ab")
    both = F.greatest(F.coalesce(F.size(F.array_intersect("la", "lb")), F.lit(0)), F.lit(0))
    out = pairs.join(a, "ia", "left").join(b, "ib", "left").withColumn("n_ab", F.col("n") + both).where(enough(F.col("n_ab")))
    ab, a1, b1 = F.col("n_ab") + 0.5, F.col("n_a") - F.col("n_ab") + 0.5, F.col("n_b") - F.col("n_ab") + 0.5
    rest = n_baskets - F.col("n_a") - F.col("n_b") + F.col("n_ab") + 0.5
    return out.select(
        "item_a",
        "item_b",
        "n_ab",
        "n_a",
        "n_b",
        F.lit(n_baskets).cast("bigint").alias("n_baskets"),
        (F.col("n_ab") * n_baskets / (F.col("n_a") * F.col("n_b"))).alias("lift"),
        F.log(ab * rest / (a1 * b1)).alias("log_odds"),
        F.sqrt(1 / ab + 1 / a1 + 1 / b1 + 1 / rest).alias("log_odds_se"),
    )
