"""Queries of the training-data operators, with their SQL twins."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .addresses import pairs_of, same_places
from .leaks import find_leaks, reordered, whole_runs
from .mixing import mix, mix_bounds, shares
from .names import link_names, linked_pairs
from .pii import personal_spans, redact_texts
from .spans import shared_share, shared_spans
from .splitting import piece_bounds, split_texts
from .together import pairs_together


def _together(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "audit_records").where(F.col("record_type").isin("bid", "quote"))
    return pairs_together(records, "project_id", "bidder_id", least=5, lift=4.0)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _together(spark, folder).select(F.col("item_a").alias("bidder_id_a"), F.col("item_b").alias("bidder_id_b"))


def p1_odds(spark: SparkSession, folder: str) -> DataFrame:
    return _together(spark, folder).select(
        "item_a", "item_b", "n_ab", "n_a", "n_b", "n_baskets", *[F.round(c, 6).alias(c) for c in ("lift", "log_odds", "log_odds_se")]
    )


def _text_tables(spark: SparkSession, folder: str) -> list[DataFrame]:
    zero = F.lit(0).cast("bigint")
    return [
        table(spark, folder, "documents").select("doc_id", zero.alias("part"), "text"),
        table(spark, folder, "pages").select("doc_id", F.col("page_number").cast("bigint").alias("part"), F.col("cleaned_text").alias("text")),
    ]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    documents, pages = (shared_spans(t, 120) for t in _text_tables(spark, folder))
    return documents.unionAll(pages).withColumnRenamed("part", "page_number")


def p2_share(spark: SparkSession, folder: str) -> DataFrame:
    documents, pages = (shared_share(t, shared_spans(t, 120)) for t in _text_tables(spark, folder))
    return documents.unionAll(pages).withColumnRenamed("part", "page_number")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal_spans(table(spark, folder, "documents")).drop("value").distinct()


def p4_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The key comes from clueforge.pii.key; where that is unset each run draws a secret one, so pseudonyms link within it only."""
    named = spark.conf.get("clueforge.pii.key", None)
    key = named.encode() if named else secrets.token_bytes(32)
    return redact_texts(table(spark, folder, "documents").select("doc_id", "text"), key)


def p5_places(spark: SparkSession, folder: str) -> DataFrame:
    return same_places(table(spark, folder, "audit_records").where("record_type = 'bidder'"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs_of(p5_places(spark, folder))


def p6_labels(spark: SparkSession, folder: str) -> DataFrame:
    return link_names(table(spark, folder, "audit_records"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return linked_pairs(p6_labels(spark, folder))


def p8_tiles(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark_items")).distinct()


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return whole_runs(p8_tiles(spark, folder)).select("doc_id", "item_id").distinct()


def p8_reordered(spark: SparkSession, folder: str) -> DataFrame:
    return reordered(p8_tiles(spark, folder)).select("doc_id", "item_id", "item_chars", "longest", "covered", "tiles")


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return shares(p9_mix(spark, folder), table(spark, folder, "mix_targets"))


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_texts(table(spark, folder, "documents"), table(spark, folder, "split_limits"))


def p9_bounds(spark: SparkSession, folder: str) -> DataFrame:
    documents, targets = table(spark, folder, "documents"), table(spark, folder, "mix_targets")
    return mix_bounds(mix(documents, targets), documents, targets)


def p10_bounds(spark: SparkSession, folder: str) -> DataFrame:
    documents, limits = table(spark, folder, "documents"), table(spark, folder, "split_limits")
    return piece_bounds(split_texts(documents, limits), documents, limits)


_P1 = r"""
WITH m AS (SELECT DISTINCT project_id p, bidder_id b FROM audit_records
           WHERE record_type IN ('bid', 'quote') AND regexp_matches(project_id, '\S') AND regexp_matches(bidder_id, '\S')),
     t AS (SELECT count(DISTINCT p) AS n FROM m),
     g AS (SELECT b, count(*) AS n FROM m GROUP BY b),
     c AS (SELECT x.b AS a, y.b AS b, count(*) AS n FROM m x JOIN m y ON x.p = y.p AND x.b < y.b GROUP BY ALL),
     f AS (SELECT c.a, c.b, c.n AS n_ab, ga.n AS n_a, gb.n AS n_b, t.n AS n_baskets
           FROM c JOIN g ga ON ga.b = c.a JOIN g gb ON gb.b = c.b, t WHERE c.n >= 5 AND c.n * t.n >= 4 * ga.n * gb.n)
"""
_WIDE = "".join(chr(x) for x in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(x - 0xFEE0) for x in range(0xFF01, 0xFF5F)).replace("'", "''")


def _letters(column: str) -> str:
    return rf"regexp_replace(lower(translate({column}, '{_WIDE}', '{_NARROW}')), '[^\p{{L}}\p{{Nd}}]', '', 'g')"


_P8 = f"""
WITH d AS (SELECT DISTINCT doc_id, {_letters("text")} AS t FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
     i AS (SELECT item_id, t, CAST(greatest(30, ceil(length(t) / 2)) AS INT) AS need FROM (SELECT item_id, {_letters("item_text")} AS t FROM benchmark_items)),
     iw AS (SELECT DISTINCT item_id, need, hash(substr(t, k, need)) AS h FROM (SELECT *, unnest(range(1, length(t) - need + 2)) AS k FROM i WHERE length(t) >= need)),
     dw AS (SELECT doc_id, need, hash(substr(t, k, need)) AS h FROM (SELECT doc_id, t, need, unnest(range(1, length(t) - need + 2)) AS k
            FROM d, (SELECT DISTINCT need FROM i) WHERE length(t) >= need))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (need, h)"""
_P2 = """
WITH x AS (SELECT DISTINCT 'd' AS s, doc_id, 0::BIGINT AS page_number, text FROM documents WHERE length(text) >= 120 AND doc_id IS NOT NULL
           UNION SELECT 'p', doc_id, page_number::BIGINT, cleaned_text FROM pages WHERE length(cleaned_text) >= 120 AND doc_id IS NOT NULL),
     w AS (SELECT s, doc_id, page_number, h, k FROM (SELECT s, doc_id, page_number, text, unnest(range(0, length(text) - 119)) AS k FROM x), LATERAL (SELECT hash(substr(text, k + 1, 120)) AS h)),
     r AS (SELECT s, h FROM w GROUP BY ALL HAVING min(doc_id) <> max(doc_id)),
     m AS (SELECT DISTINCT s, doc_id, page_number, k FROM w JOIN r USING (s, h)),
     g AS (SELECT *, sum(CASE WHEN k <= prev + 120 THEN 0 ELSE 1 END) OVER (PARTITION BY s, doc_id, page_number ORDER BY k) AS run FROM (
           SELECT *, lag(k) OVER (PARTITION BY s, doc_id, page_number ORDER BY k) AS prev FROM m)),
     f AS (SELECT s, doc_id, page_number, min(k) AS start_pos, max(k) + 120 AS end_pos FROM g GROUP BY s, doc_id, page_number, run)
"""
QUERIES = {"p1_found": p1_found, "p1_odds": p1_odds, "p2_found": p2_found, "p2_share": p2_share, "p4_found": p4_found, "p4_redacted": p4_redacted, "p5_found": p5_found, "p5_places": p5_places, "p6_found": p6_found, "p6_labels": p6_labels, "p8_found": p8_found, "p8_tiles": p8_tiles, "p8_reordered": p8_reordered, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_bounds": p9_bounds, "p10_pieces": p10_pieces, "p10_bounds": p10_bounds}
ORACLE = {
    "p2_found": _P2 + "SELECT doc_id, page_number, start_pos, end_pos FROM f",
    "p2_share": _P2
    + """SELECT t.doc_id, t.page_number, n_chars, coalesce(shared_chars, 0) AS shared_chars FROM (SELECT s, doc_id, page_number, sum(coalesce(length(text), 0))::BIGINT AS n_chars FROM (
SELECT DISTINCT 'd' AS s, doc_id, 0::BIGINT AS page_number, text FROM documents UNION ALL SELECT DISTINCT 'p', doc_id, page_number::BIGINT, cleaned_text FROM pages) GROUP BY ALL) t
LEFT JOIN (SELECT s, doc_id, page_number, sum(end_pos - start_pos)::BIGINT AS shared_chars FROM f GROUP BY ALL) c
ON t.s = c.s AND t.doc_id IS NOT DISTINCT FROM c.doc_id AND t.page_number IS NOT DISTINCT FROM c.page_number""",
    "p8_found": _P8,
    "p9_bounds": "SELECT source, true AS within_caps, true AS within_a_document FROM (SELECT DISTINCT source FROM mix_targets) WHERE source IN (SELECT source FROM documents WHERE length(text) > 0)",
    "p10_bounds": "SELECT profile, true AS within_limit, true AS in_order, true AS whole, true AS overlapping FROM split_limits",
    "p1_found": _P1 + "SELECT a AS bidder_id_a, b AS bidder_id_b FROM f",
    "p1_odds": _P1
    + """SELECT a AS item_a, b AS item_b, n_ab, n_a, n_b, n_baskets, round(n_ab * n_baskets / (n_a * n_b), 6) AS lift,
round(ln((n_ab + 0.5) * (n_baskets - n_a - n_b + n_ab + 0.5) / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5))), 6) AS log_odds,
round(sqrt(1 / (n_ab + 0.5) + 1 / (n_a - n_ab + 0.5) + 1 / (n_b - n_ab + 0.5) + 1 / (n_baskets - n_a - n_b + n_ab + 0.5)), 6) AS log_odds_se
FROM f""",
}
