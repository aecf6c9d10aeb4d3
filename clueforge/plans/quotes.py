"""Queries of the quote engine with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quotes as q
from ..operators.pairs import summarise
from ..session import table


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return q.quote_rows(table(spark, folder, "audit_records"))


def _good(spark: SparkSession, folder: str) -> DataFrame:
    return q.clean(q.totals(_rows(spark, folder)))


def _rounded(make: Callable[[SparkSession, str], DataFrame], *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        df = make(spark, folder)
        return df.withColumns({c: F.round(c, 6) for c in columns})

    return query


def graph(spark: SparkSession, folder: str) -> DataFrame:
    """Bidder nodes and, for pairs with signals, edges: kind, id_a, id_b, weight."""
    rows = _rows(spark, folder)
    nodes = rows.select(F.lit("node").alias("kind"), "project_id", F.col("bidder_id").alias("id_a"), F.lit(None).cast("string").alias("id_b"), F.lit(0).cast("bigint").alias("weight"))
    edges = q.quote_features(rows).where("score > 0").select(F.lit("edge").alias("kind"), "project_id", F.col("bidder_a").alias("id_a"), F.col("bidder_b").alias("id_b"), F.col("score").alias("weight"))
    return nodes.distinct().unionByName(edges)


QUERIES = {
    "quotes_totals": lambda s, d: q.totals(_rows(s, d)),
    "quotes_pairwise_distance": _rounded(lambda s, d: q.pairwise_distance(_good(s, d)), "distance"),
    "quotes_control_prices": lambda s, d: q.control_prices(_rows(s, d)),
    "quotes_control_ratio": _rounded(lambda s, d: q.control_ratio(_good(s, d), q.control_prices(_rows(s, d))), "ratio_a", "ratio_b"),
    "quotes_robust_outliers": _rounded(lambda s, d: q.robust_outliers(_good(s, d)), "z", "mad", "median"),
    "quotes_gap_patterns": _rounded(lambda s, d: q.gap_patterns(_good(s, d)), "mid_gap", "mid_ratio"),
    "quotes_price_tails": lambda s, d: q.price_tails(_good(s, d), 10000, 2),
    "quotes_accompaniment": _rounded(lambda s, d: q.accompaniment(_good(s, d)), "high", "spread"),
    "quotes_item_prices": lambda s, d: q.item_prices(_rows(s, d)),
    "quotes_item_correlation": _rounded(lambda s, d: q.item_correlation(q.item_prices(_rows(s, d)), 2), "r_price", "r_rank"),
    "quotes_status": lambda s, d: q.quote_frame(_rows(s, d)).where("status <> 'not_provided'"),
    "quotes_features": lambda s, d: q.quote_features(_rows(s, d)),
    "quotes_summary": lambda s, d: summarise(q.quote_frame(_rows(s, d))),
    "quotes_graph": graph,
}

_FACTOR = """CASE lower(trim(coalesce(amount_unit, ''))) WHEN '' THEN 1 WHEN '元' THEN 1 WHEN 'cny' THEN 1 WHEN 'rmb' THEN 1 WHEN 'yuan' THEN 1 WHEN '人民币' THEN 1
 WHEN '千元' THEN 1000 WHEN '千' THEN 1000 WHEN 'k' THEN 1000 WHEN '万元' THEN 10000 WHEN '万' THEN 10000 WHEN '10k' THEN 10000 END"""


def _amount(column: str) -> str:
    stripped = f"regexp_replace({column}, '人民币|RMB|CNY|¥|￥|元|,|，|\\s', '', 'g')"
    number = f"CASE WHEN regexp_full_match({stripped}, '\\d{{1,13}}(\\.\\d+)?') THEN CAST({stripped} AS DECIMAL(20,6)) END"
    return f"CAST(CASE WHEN ({number}) > 0 THEN ({number}) * ({_FACTOR}) END AS DOUBLE)"


BASE = f"""
WITH q AS (SELECT project_id, bidder_id, record_id,
  CASE WHEN lower(trim(coalesce(quote_scope, ''))) IN ('', 'total', '总价', '总报价', '投标总价') THEN 'total'
       WHEN lower(trim(coalesce(quote_scope, ''))) IN ('item', 'line-item', 'line_item', '分项', '单项') THEN 'item' ELSE 'other' END AS scope,
  upper(CASE WHEN regexp_matches(currency, '\\S') THEN trim(currency) ELSE 'CNY' END) AS currency,
  coalesce(regexp_matches(amount, '\\S'), false) AS has_amount, {_amount("amount")} AS amount, {_amount("control_amount")} AS control,
  trim(item_code) AS item_code, {_amount("unit_price")} AS unit_price
  FROM audit_records WHERE record_type IN ('quote', 'bid') AND regexp_matches(project_id, '\\S') AND regexp_matches(bidder_id, '\\S')),
b AS (SELECT project_id, bidder_id, count(DISTINCT amount) AS na, count(DISTINCT CASE WHEN amount IS NOT NULL THEN currency END) AS nc, bool_or(has_amount) AS typed,
  min(amount) AS amount, min(CASE WHEN amount IS NOT NULL THEN currency END) AS currency FROM q WHERE scope = 'total' GROUP BY ALL),
st AS (SELECT project_id, bidder_id, CASE WHEN na = 1 AND nc = 1 THEN 'compared' WHEN na = 0 AND NOT typed THEN 'missing' ELSE 'excluded' END AS state, amount, currency FROM b),
t AS (SELECT project_id, bidder_id, currency, amount FROM st WHERE state = 'compared'),
tp AS (SELECT x.project_id, x.currency, x.bidder_id AS bidder_a, y.bidder_id AS bidder_b, x.amount AS amount_a, y.amount AS amount_b
  FROM t x JOIN t y ON x.project_id = y.project_id AND x.currency = y.currency AND x.bidder_id < y.bidder_id),
cp AS (SELECT project_id, CASE count(DISTINCT control) WHEN 1 THEN 'compared' WHEN 0 THEN 'missing' ELSE 'excluded' END AS state,
  CASE WHEN count(DISTINCT control) = 1 THEN min(control) END AS control FROM q GROUP BY project_id),
pd AS (SELECT project_id, bidder_a, bidder_b, currency, amount_a, amount_b, abs(amount_a - amount_b) / greatest((abs(amount_a) + abs(amount_b)) / 2, 1.0) AS distance FROM tp),
cr AS (SELECT project_id, bidder_a, bidder_b, amount_a / control AS ratio_a, amount_b / control AS ratio_b FROM tp JOIN cp USING (project_id) WHERE state = 'compared'),
crt AS (SELECT *, ratio_a BETWEEN 0.95 AND 1 AND ratio_b BETWEEN 0.95 AND 1 AND abs(ratio_a - ratio_b) <= 0.003 AS triggered FROM cr),
md AS (SELECT *, abs(amount - median) AS away FROM (SELECT *, median(amount) OVER w AS median, count(*) OVER w AS n FROM t WINDOW w AS (PARTITION BY project_id, currency)) WHERE n >= 4),
ro AS (SELECT project_id, currency, bidder_id, amount, median, mad, 0.6745 * (amount - median) / mad AS z
  FROM (SELECT *, median(away) OVER (PARTITION BY project_id, currency) AS mad FROM md) WHERE mad > 0 AND abs(0.6745 * (amount - median) / mad) >= 3.5),
sp AS (SELECT * FROM (SELECT project_id, currency, amount - lag(amount) OVER w AS gap, amount / lag(amount) OVER w AS ratio FROM t
  WINDOW w AS (PARTITION BY project_id, currency ORDER BY amount, bidder_id)) WHERE gap IS NOT NULL),
mg AS (SELECT project_id, currency, median(gap) AS mid_gap, median(ratio) AS mid_ratio, count(*) AS steps FROM sp GROUP BY ALL HAVING count(*) >= 2),
gp AS (SELECT *, near_gaps >= 2 AS fixed_difference, near_ratios >= 2 AS fixed_ratio FROM (SELECT project_id, currency, steps, mid_gap, mid_ratio,
  count(*) FILTER (mid_gap > 0 AND abs(gap - mid_gap) <= mid_gap * 0.02) AS near_gaps, count(*) FILTER (mid_ratio > 1 AND abs(ratio - mid_ratio) <= 0.003) AS near_ratios
  FROM sp JOIN mg USING (project_id, currency) GROUP BY ALL)),
tl AS (SELECT *, lpad(CAST(CAST(round_even(amount, 0) AS BIGINT) % 10000 AS VARCHAR), 4, '0') AS tail FROM t),
pt AS (SELECT project_id, currency, tail, count(*) AS bidders FROM tl WHERE tail NOT IN ('0000', '0100', '1000') GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY project_id, currency ORDER BY amount, bidder_id) AS place FROM t),
hi AS (SELECT project_id, currency, median(amount) AS high, count(*) AS highs, (max(amount) - min(amount)) / median(amount) AS spread FROM rk WHERE place > 1 GROUP BY ALL),
ac AS (SELECT project_id, currency, bidder_id AS low_bidder, amount AS low, high, highs, spread FROM rk JOIN hi USING (project_id, currency)
  WHERE place = 1 AND highs >= 2 AND amount <= 0.85 * high AND spread <= 0.01),
ip AS (SELECT project_id, bidder_id, item_code, min(unit_price) AS price FROM q WHERE scope = 'item' AND regexp_matches(item_code, '\\S') AND unit_price IS NOT NULL
  GROUP BY ALL HAVING count(DISTINCT unit_price) = 1),
sh AS (SELECT *, CAST(rank() OVER (PARTITION BY project_id, bidder_a, bidder_b ORDER BY pa) AS DOUBLE) AS ka,
  CAST(rank() OVER (PARTITION BY project_id, bidder_a, bidder_b ORDER BY pb) AS DOUBLE) AS kb
  FROM (SELECT x.project_id, x.bidder_id AS bidder_a, y.bidder_id AS bidder_b, x.price AS pa, y.price AS pb
  FROM ip x JOIN ip y ON x.project_id = y.project_id AND x.item_code = y.item_code AND x.bidder_id < y.bidder_id)),
ic AS (SELECT project_id, bidder_a, bidder_b, count(*) AS items,
  (count(*) * sum(pa * pb) - sum(pa) * sum(pb)) / nullif(sqrt(greatest(count(*) * sum(pa * pa) - sum(pa) * sum(pa), 0)) * sqrt(greatest(count(*) * sum(pb * pb) - sum(pb) * sum(pb), 0)), 0) AS r_price,
  (count(*) * sum(ka * kb) - sum(ka) * sum(kb)) / nullif(sqrt(greatest(count(*) * sum(ka * ka) - sum(ka) * sum(ka), 0)) * sqrt(greatest(count(*) * sum(kb * kb) - sum(kb) * sum(kb), 0)), 0) AS r_rank
  FROM sh GROUP BY ALL),
m AS (SELECT DISTINCT project_id, bidder_id FROM q),
pr AS (SELECT x.project_id, x.bidder_id AS bidder_a, y.bidder_id AS bidder_b FROM m x JOIN m y ON x.project_id = y.project_id AND x.bidder_id < y.bidder_id)
"""
_FIRED = """, fired AS (
 SELECT project_id, bidder_a, bidder_b, 'pairwise_price_distance' AS signal_type FROM pd WHERE distance <= 0.005
 UNION ALL SELECT project_id, bidder_a, bidder_b, 'control_price_ratio' FROM crt WHERE triggered
 UNION ALL SELECT project_id, bidder_a, bidder_b, s FROM tp JOIN gp USING (project_id, currency), (VALUES ('fixed_difference'), ('staircase_quote')) v(s) WHERE fixed_difference
 UNION ALL SELECT project_id, bidder_a, bidder_b, 'fixed_ratio' FROM tp JOIN gp USING (project_id, currency) WHERE fixed_ratio
 UNION ALL SELECT tp.project_id, bidder_a, bidder_b, 'median_deviation' FROM tp JOIN ro ON tp.project_id = ro.project_id AND tp.currency = ro.currency AND ro.bidder_id IN (bidder_a, bidder_b)
 UNION ALL SELECT x.project_id, x.bidder_id, y.bidder_id, 'repeated_price_tail' FROM tl x JOIN tl y ON x.project_id = y.project_id AND x.currency = y.currency AND x.tail = y.tail AND x.bidder_id < y.bidder_id
   JOIN pt ON pt.project_id = x.project_id AND pt.currency = x.currency AND pt.tail = x.tail AND pt.bidders >= 3
 UNION ALL SELECT tp.project_id, bidder_a, bidder_b, 'accompaniment_structure' FROM tp JOIN ac ON tp.project_id = ac.project_id AND tp.currency = ac.currency AND ac.low_bidder IN (bidder_a, bidder_b)
 UNION ALL SELECT project_id, bidder_a, bidder_b, 'item_price_correlation' FROM ic WHERE items >= 3 AND r_price >= 0.995
 UNION ALL SELECT project_id, bidder_a, bidder_b, 'item_rank_consistency' FROM ic WHERE items >= 3 AND r_rank >= 0.995),
sz AS (SELECT project_id, count(*) AS n FROM t GROUP BY ALL),
ps AS (SELECT pr.*, CASE WHEN coalesce(x.state = 'excluded', false) OR coalesce(y.state = 'excluded', false) THEN 'excluded' WHEN x.state = 'compared' AND y.state = 'compared' THEN 'compared' ELSE 'missing' END AS total,
  coalesce(n, 0) AS n, coalesce(cp.state, 'missing') AS control_state, coalesce(items, 0) AS items
  FROM pr LEFT JOIN st x ON x.project_id = pr.project_id AND x.bidder_id = bidder_a LEFT JOIN st y ON y.project_id = pr.project_id AND y.bidder_id = bidder_b
  LEFT JOIN sz ON sz.project_id = pr.project_id LEFT JOIN cp ON cp.project_id = pr.project_id
  LEFT JOIN ic ON ic.project_id = pr.project_id AND ic.bidder_a = pr.bidder_a AND ic.bidder_b = pr.bidder_b),
w(signal_type, weight, need) AS (VALUES ('pairwise_price_distance', 15, 2), ('control_price_ratio', 8, 2), ('median_deviation', 10, 4), ('fixed_difference', 14, 3), ('staircase_quote', 12, 3),
  ('fixed_ratio', 14, 3), ('repeated_price_tail', 8, 3), ('accompaniment_structure', 15, 3), ('item_price_correlation', 12, 0), ('item_rank_consistency', 10, 0)),
fn AS (SELECT project_id, bidder_a, bidder_b, signal_type, count(*) AS instances FROM fired GROUP BY ALL),
fr AS (SELECT ps.project_id, ps.bidder_a, ps.bidder_b, w.signal_type, coalesce(instances, 0) AS instances, coalesce(instances, 0) * weight AS points,
  CASE WHEN coalesce(instances, 0) > 0 THEN 'triggered' WHEN need = 0 THEN (CASE WHEN items >= 3 THEN 'no_signal' ELSE 'not_provided' END)
   WHEN total = 'excluded' THEN 'excluded' WHEN total = 'missing' THEN 'not_provided'
   WHEN w.signal_type = 'control_price_ratio' THEN (CASE control_state WHEN 'compared' THEN 'no_signal' WHEN 'excluded' THEN 'excluded' ELSE 'not_provided' END)
   WHEN n >= need THEN 'no_signal' ELSE 'not_provided' END AS status
  FROM ps CROSS JOIN w LEFT JOIN fn ON fn.project_id = ps.project_id AND fn.bidder_a = ps.bidder_a AND fn.bidder_b = ps.bidder_b AND fn.signal_type = w.signal_type),
ft AS (SELECT *, CASE WHEN score >= 55 THEN 'high' WHEN score >= 30 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END AS level FROM (
  SELECT project_id, bidder_a, bidder_b, CAST(least(sum(points), 100) AS BIGINT) AS score, count(*) FILTER (status = 'triggered') AS triggered, count(*) FILTER (status = 'no_signal') AS no_signal,
  count(*) FILTER (status = 'not_provided') AS not_provided, count(*) FILTER (status = 'excluded') AS excluded FROM fr GROUP BY ALL))
"""
ORACLE = {
    "quotes_totals": BASE + "SELECT project_id, bidder_id, state, CASE WHEN state = 'compared' THEN amount END AS amount, CASE WHEN state = 'compared' THEN currency END AS currency FROM st",
    "quotes_pairwise_distance": BASE + "SELECT * REPLACE (round(distance, 6) AS distance), distance <= 0.005 AS triggered FROM pd",
    "quotes_control_prices": BASE + "SELECT * FROM cp",
    "quotes_control_ratio": BASE + "SELECT * REPLACE (round(ratio_a, 6) AS ratio_a, round(ratio_b, 6) AS ratio_b) FROM crt",
    "quotes_robust_outliers": BASE + "SELECT project_id, currency, bidder_id, amount, round(median, 6) AS median, round(mad, 6) AS mad, round(z, 6) AS z FROM ro",
    "quotes_gap_patterns": BASE + "SELECT * REPLACE (round(mid_gap, 6) AS mid_gap, round(mid_ratio, 6) AS mid_ratio) FROM gp",
    "quotes_price_tails": BASE + "SELECT * FROM pt WHERE bidders >= 2",
    "quotes_accompaniment": BASE + "SELECT * REPLACE (round(high, 6) AS high, round(spread, 6) AS spread) FROM ac",
    "quotes_item_prices": BASE + "SELECT * FROM ip",
    "quotes_item_correlation": BASE + "SELECT * REPLACE (round(r_price, 6) AS r_price, round(r_rank, 6) AS r_rank) FROM ic WHERE items >= 2",
    "quotes_status": BASE + _FIRED + "SELECT project_id, bidder_a, bidder_b, signal_type, status, instances, points FROM fr WHERE status <> 'not_provided'",
    "quotes_features": BASE + _FIRED + "SELECT * FROM ft",
    "quotes_summary": BASE + _FIRED + "SELECT signal_type, status, count(*) AS pairs FROM fr GROUP BY ALL",
    "quotes_graph": BASE + _FIRED + """SELECT 'node' AS kind, project_id, bidder_id AS id_a, NULL::VARCHAR AS id_b, 0::BIGINT AS weight FROM m
UNION ALL SELECT 'edge', project_id, bidder_a, bidder_b, score FROM ft WHERE score > 0""",
}
