"""Findings back to their pages: evidence packets within a text budget, citation checks, merged rule and model findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_FINDINGS, MOST_CITATIONS, PAGE_CHARS, PACKET_CHARS = 8, 8, 1800, 24_000
PAIR = ["project_id", "doc_a", "doc_b"]


def merged_findings(rules: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """Rule findings and model scores of document pairs, joined whichever way round the pair stands.

    A pair that only the model finds (score at the threshold or above) comes in with level medium and basis model; one that
    both know keeps its rule score, raised to the model's where that is higher, and basis both.
    """
    key = lambda df: df.withColumn("__a", F.least("doc_a", "doc_b")).withColumn("__b", F.greatest("doc_a", "doc_b"))
    r = key(rules).select("project_id", "__a", "__b", F.col("score").alias("rule_score"))
    m = key(scores).groupBy("project_id", "__a", "__b").agg(F.max("score").alias("model_score"))
    out = r.join(m, ["project_id", "__a", "__b"], "full_outer").where((F.col("rule_score").isNotNull()) | (F.col("model_score") >= threshold))
    both = F.col("rule_score").isNotNull() & F.coalesce(F.col("model_score") >= threshold, F.lit(False))
    basis = F.when(both, "both").when(F.col("rule_score").isNotNull(), "rule").otherwise("model")
    score = F.when(both, F.greatest("rule_score", "model_score")).otherwise(F.coalesce("rule_score", "model_score"))
    level = F.when(basis == "model", "medium").when(score >= 70, "high").when(score >= 45, "medium").otherwise("low")
    return out.select("project_id", F.col("__a").alias("doc_a"), F.col("__b").alias("doc_b"), score.alias("score"), basis.alias("basis"), level.alias("level"))


def evidence_packet(findings: DataFrame, evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """(project_id, doc_a, doc_b, doc_id, page_number, excerpt): pages of the highest findings within the packet's budget.

    findings: PAIR and score; evidence: doc_id and page_number; a document without evidence pages shows its first page. The
    packet is a top-k report by definition: MOST_FINDINGS findings, PAGE_CHARS a page, PACKET_CHARS in all.
    """
    top = findings.orderBy(F.col("score").desc(), *PAIR).limit(MOST_FINDINGS)
    docs = top.select(*PAIR, F.explode(F.array("doc_a", "doc_b")).alias("doc_id"))
    first = pages.groupBy("doc_id").agg(F.min("page_number").alias("first"))
    shown = docs.join(evidence, "doc_id", "left").join(first, "doc_id", "left").withColumn("page_number", F.coalesce("page_number", "first")).where("page_number is not null").drop("first")
    nth = F.row_number().over(Window.partitionBy(*PAIR, "doc_id").orderBy("page_number"))
    shown = shown.withColumn("nth", nth).where(F.col("nth") <= MOST_CITATIONS).drop("nth")
    text = pages.groupBy("doc_id", "page_number").agg(F.max("text").alias("text"))
    cut = shown.join(text, ["doc_id", "page_number"]).withColumn("excerpt", F.substring("text", 1, PAGE_CHARS))
    so_far = F.sum(F.length("excerpt")).over(Window.partitionBy(F.lit(0)).orderBy(*PAIR, "doc_id", "page_number"))
    held = cut.withColumn("before", so_far - F.length("excerpt")).where(F.col("before") < PACKET_CHARS)
    excerpt = F.substr(F.col("excerpt"), F.lit(1), (PACKET_CHARS - F.col("before")).cast("int"))
    return held.select(*PAIR, "doc_id", "page_number", excerpt.alias("excerpt"))


def valid_citations(claims: DataFrame, packet: DataFrame) -> DataFrame:
    """Claims (claim_id, doc_id, page_number, quote) whose quote stands word for word in the excerpt of the page they cite."""
    held = packet.select("doc_id", "page_number", "excerpt").distinct()
    ok = claims.join(held, ["doc_id", "page_number"]).where((F.length(F.trim("quote")) > 0) & F.contains(F.col("excerpt"), F.col("quote")))
    return ok.select("claim_id", "doc_id", "page_number", "quote").distinct()
