"""Mixing sources to target token shares: capped copies, rounded by pivotal dependent rounding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .tokens import VOCABULARY, with_token_counts

LEAF, FAN_IN = 4096, 64
_ROWS = "doc_id bigint, source string, n_tokens bigint, whole int, p double, block bigint"


def plan_rates(sources: list[dict], total_tokens: int | None = None) -> dict[str, float]:
    """Expected copies of each document, by source.

    sources: source, target_share, max_repeats, n_tokens. Without total_tokens the total is the largest at which every
    present source reaches its target within its cap, which puts all present sources at their targets' proportions;
    absent sources (no tokens, or a share or cap of 0) get nothing. With total_tokens a source beyond its cap gives its
    cap, and what it lacks is shared by the others in proportion to their targets.
    """
    present = [s for s in sources if s["n_tokens"] > 0 and s["target_share"] > 0 and s["max_repeats"] > 0]
    if not present:
        return {}
    if total_tokens is None:
        scale = min(s["max_repeats"] * s["n_tokens"] / s["target_share"] for s in present)
        return {s["source"]: min(scale * s["target_share"] / s["n_tokens"], s["max_repeats"]) for s in present}
    rates, rest, budget = {}, list(present), float(total_tokens)
    while rest:
        scale = budget / sum(s["target_share"] for s in rest)
        full = [s for s in rest if scale * s["target_share"] >= s["max_repeats"] * s["n_tokens"]]
        if not full:
            rates |= {s["source"]: scale * s["target_share"] / s["n_tokens"] for s in rest}
            break
        for s in full:
            rates[s["source"]] = float(s["max_repeats"])
            budget -= s["max_repeats"] * s["n_tokens"]
        rest = [s for s in rest if s not in full]
    return rates


def pivot(p: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Pivotal rounding in order: two fractional entries trade mass, sum(p * size) kept, until one is 0 or 1.

    At most one entry stays fractional; each entry keeps its expectation.
    """
    p, size = p.astype(float).copy(), np.maximum(size.astype(float), 1.0)
    tiny = 1e-9
    i = -1
    chance = draw.random(len(p))
    for j in range(len(p)):
        if p[j] <= tiny or p[j] >= 1 - tiny:
            p[j] = round(p[j])
            continue
        if i < 0:
            i = j
            continue
        ratio = size[i] / size[j]
        up = min(1 - p[i], p[j] / ratio)
        down = min(p[i], (1 - p[j]) / ratio)
        step = up if chance[j] * (up + down) < down else -down
        p[i] += step
        p[j] -= step * ratio
        for k in (i, j):
            if p[k] <= tiny or p[k] >= 1 - tiny:
                p[k] = round(p[k])
        open_i, open_j = tiny < p[i] < 1 - tiny, tiny < p[j] < 1 - tiny
        i = i if open_i else j if open_j else -1
    return p


def _round_block(seed: int, level: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        key = [seed, level, int(rows["block"].iloc[0]), *rows["source"].iloc[0].encode()]
        rows["p"] = pivot(rows["p"].to_numpy(), rows["n_tokens"].to_numpy(), np.random.default_rng(key))
        rows["block"] = rows["block"] // FAN_IN
        return rows

    return run


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents to take, copies of 1 up to the source's max_repeats.

    Token shares by source come as near to target_share as the caps allow (plan_rates). Every document of a source
    has the same expected number of copies; its whole part is given, the fraction rounded by pivotal dependent
    rounding in blocks of about LEAF documents, whose single residuals meet in a tree of fan-in FAN_IN until one a
    source is left, which is drawn. So a source's tokens miss its plan by less than one document.

    Documents with a null doc_id, a null, blank or unlisted source, or no tokens are not taken; rows repeated under
    one doc_id count once (the smallest source and count). Targets with a null source, share or cap don't count and
    of several rows for one source the smallest counts. Empty tables give an empty mix. targets is read by the driver;
    it is one row a source, not data. The draw depends only on seed, doc_ids and sources.
    """
    spark = documents.sparkSession
    wanted = (
        targets.where("source is not null and target_share is not null and max_repeats is not null")
        .groupBy("source")
        .agg(F.min("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    )
    chosen = documents.where(F.col("doc_id").isNotNull() & F.col("source").rlike(r"(?U)\S") & F.col("text").isNotNull()).select("doc_id", "source", "text")
    counted = durable(
        with_token_counts(chosen, ["doc_id", "source"], path=path)
        .where("n_tokens > 0")
        .groupBy("doc_id")
        .agg(F.min(F.struct("source", "n_tokens")).alias("s"))
        .select("doc_id", "s.source", "s.n_tokens"),
        "tokens",
    )
    sizes = counted.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n"))
    plan = [r.asDict() for r in wanted.join(sizes, "source", "left").fillna(0, ["n_tokens", "n"]).collect()]
    rates = plan_rates(plan, total_tokens)
    leaves = {s["source"]: max(1, -(-s["n"] // LEAF)) for s in plan if s["source"] in rates}
    if not rates:
        return spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint, copies int")
    rate_rows = spark.createDataFrame([(s, float(r), leaves[s]) for s, r in rates.items()], "source string, rate double, leaves bigint")
    rows = counted.join(rate_rows, "source").select(
        "doc_id",
        "source",
        "n_tokens",
        F.floor("rate").cast("int").alias("whole"),
        (F.col("rate") - F.floor("rate")).alias("p"),
        F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("leaves")).alias("block"),
    )
    settled, level, blocks = None, 0, max(leaves.values())
    while True:
        rounded = durable(rows.groupBy("source", "block").applyInPandas(_round_block(seed, level), _ROWS), f"round{level}")
        done = rounded.where("p <= 0 or p >= 1")
        rows, settled = rounded.where("p > 0 and p < 1"), done if settled is None else settled.unionAll(done)
        if blocks == 1:
            break
        level, blocks = level + 1, -(-blocks // FAN_IN)
    drawn = rows.withColumn("p", (F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1 << 30)) < F.col("p") * (1 << 30)).cast("double"))
    return settled.unionAll(drawn).select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("p").cast("int")).alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, copies, tokens, actual_share) for every target, absent ones too."""
    by = mixed.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens")
    )
    total = mixed.agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("all_tokens"))
    out = targets.select("source", "target_share", "max_repeats").join(by, "source", "left").join(F.broadcast(total))
    return out.select(
        "source",
        "target_share",
        "max_repeats",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "copies", "tokens")],
        F.coalesce(F.try_divide("tokens", "all_tokens"), F.lit(0.0)).alias("actual_share"),
    )


def mix_bounds(mixed: DataFrame, documents: DataFrame, targets: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(source, within_caps, within_a_document) of every source of the mix that has documents and a target.

    within_caps: no document has more copies than max_repeats. within_a_document: the source's tokens miss its share of
    the scarcest source's total, share * min(cap * tokens / share), by no more than its longest document. Sums are exact
    integers; the plan is compared after multiplying out the shares in billionths.
    """
    chosen = documents.where(F.col("doc_id").isNotNull() & F.col("source").rlike(r"(?U)\S") & F.col("text").isNotNull())
    counted = with_token_counts(chosen, ["doc_id", "source"], path=path).where("n_tokens > 0").groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("s")).select("s.*")
    there = counted.groupBy("source").agg(F.sum("n_tokens").alias("there"), F.max("n_tokens").alias("longest"))
    wanted = targets.groupBy("source").agg(F.min("target_share").alias("share"), F.min("max_repeats").alias("cap")).where("share > 0 and cap > 0")
    taken = mixed.groupBy("source").agg(F.max("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    rows = wanted.join(there, "source").join(taken, "source", "left").fillna(0, ["copies", "tokens"])
    billionths = F.round(F.col("share") * 1_000_000_000).cast("decimal(20,0)")
    rows = rows.select("source", "cap", "copies", "tokens", "longest", billionths.alias("b"), (F.col("cap") * F.col("there")).cast("decimal(20,0)").alias("most"))
    scarcest = rows.agg(F.min_by(F.struct("most", "b"), F.col("most") / F.col("b")).alias("z"))
    gap = F.abs(F.col("tokens").cast("decimal(20,0)") * F.col("z.b") - F.col("b") * F.col("z.most"))
    return rows.join(F.broadcast(scarcest)).select(
        "source", (F.col("copies") <= F.col("cap")).alias("within_caps"), (gap <= (F.col("longest") + 1).cast("decimal(20,0)") * F.col("z.b")).alias("within_a_document")
    )


def compose(documents: DataFrame, mixed: DataFrame) -> DataFrame:
    """The corpus itself: each chosen document's row as often as it has copies."""
    picks = mixed.select("doc_id", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return documents.dropDuplicates(["doc_id"]).join(picks, "doc_id")
