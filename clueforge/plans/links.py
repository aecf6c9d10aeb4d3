"""Queries of the link engine with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import value_hint
from ..operators import links as k
from ..operators.pairs import PAIR, summarise
from ..session import durable, table


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return k.link_rows(table(spark, folder, "audit_records"))


def shared_hints(spark: SparkSession, folder: str) -> DataFrame:
    """Shared values of each pair, shown only as hints."""
    return k.shared_values(_rows(spark, folder)).select(*PAIR, "signal_type", value_hint("value", F.col("value")).alias("hint"))


def public_exits(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder).where("ip_address is not null")
    return rows.groupBy("ip_address").agg(F.count("*").alias("n"), F.count_if("public_exit").alias("exits"), F.count_distinct("bidder_id").alias("bidders"))


def trace_rate(spark: SparkSession, folder: str) -> DataFrame:
    """instances, traced, rate: shared values that lead back to a record with a source reference, 1 where there are none."""
    records = table(spark, folder, "audit_records")
    rows = durable(k.link_rows(records), "link-rows")
    sources = records.where(F.size("source_refs") > 0).select("record_id").distinct()
    on = [*PAIR, "signal_type", "value"]
    traced = k.link_lineage(rows).join(sources, "record_id", "left_semi").select(*on, F.lit(1).alias("traced")).distinct()
    by = k.shared_values(rows).join(traced, on, "left").agg(F.count("*").alias("instances"), F.count("traced").alias("traced"))
    return by.select("instances", "traced", F.round(F.coalesce(F.try_divide("traced", "instances"), F.lit(1.0)), 6).alias("rate"))


QUERIES = {
    "links_shared_values": shared_hints,
    "links_public_exits": public_exits,
    "links_subnet_time": lambda s, d: k.subnet_time(_rows(s, d)),
    "links_closest_times": lambda s, d: k.closest_times(_rows(s, d)),
    "links_status": lambda s, d: k.link_frame(_rows(s, d)).where("status <> 'not_provided'"),
    "links_features": lambda s, d: k.link_features(_rows(s, d)),
    "links_lineage": lambda s, d: k.link_lineage(_rows(s, d)).select(*PAIR, "signal_type", value_hint("value", F.col("value")).alias("hint"), "record_id"),
    "links_trace_rate": trace_rate,
    "links_summary": lambda s, d: summarise(k.link_frame(_rows(s, d))),
}


def time_sql(column: str) -> str:
    """The plain time forms of functions.parse.strict_time, for DuckDB."""
    s = f"trim({column})"
    forms = [
        (r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "%Y-%m-%d %H:%M:%S"), (r"\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}", "%Y/%m/%d %H:%M:%S"),
        (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "%Y-%m-%dT%H:%M:%S"), (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}", "%Y-%m-%dT%H:%M"),
        (r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}", "%Y-%m-%d %H:%M"), (r"\d{4}年\d{2}月\d{2}日 \d{2}:\d{2}:\d{2}", "%Y年%m月%d日 %H:%M:%S"), (r"\d{4}-\d{2}-\d{2}", "%Y-%m-%d"),
    ]
    return "CASE " + " ".join(f"WHEN regexp_full_match({s}, '{p}') THEN try_strptime({s}, '{f}')" for p, f in forms) + " END"


def _value(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '\\S') THEN lower(trim({c})) END AS {c}"


def _first(*columns: str) -> str:
    return ", ".join(f"CASE WHEN regexp_matches({c}, '\\S') THEN lower(trim({c})) END" for c in columns)


_V4 = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
BASE = f"""
WITH r AS MATERIALIZED (SELECT project_id, bidder_id, {", ".join(_value(c) for c in ("ip_address", "device_id", "account_id", "file_sha256", "author", "pdf_producer"))},
  {", ".join(f"{time_sql(c)} AS {c}" for c in ("created_at", "modified_at", "uploaded_at", "event_time"))},
  record_id, coalesce(is_public_exit, false) OR coalesce(coalesce({_first("network_role", *[f"extra['{x}']" for x in ("network_role", "ip_role", "owner_type")])})
   IN ('public_exit', 'platform', 'platform_exit', 'agency', 'agency_exit', 'procurement', 'procurement_exit', '公共出口', '平台公共出口', '代理机构', '采购单位'), false)
   OR coalesce(coalesce({_first("extra['is_public_exit']", "extra['public_exit']")}) IN ('1', 'true', 'yes', '是'), false) AS public_exit
  FROM audit_records WHERE regexp_matches(project_id, '\\S') AND regexp_matches(bidder_id, '\\S')),
v AS MATERIALIZED (SELECT project_id, bidder_id, signal_type, value, bool_or(NOT (public_exit AND net)) AS usable FROM (
  SELECT project_id, bidder_id, public_exit, 'shared_full_ip' AS signal_type, ip_address AS value, true AS net FROM r
  UNION ALL SELECT project_id, bidder_id, public_exit, 'shared_device', device_id, false FROM r UNION ALL SELECT project_id, bidder_id, public_exit, 'shared_account', account_id, false FROM r
  UNION ALL SELECT project_id, bidder_id, public_exit, 'shared_file_hash', file_sha256, false FROM r UNION ALL SELECT project_id, bidder_id, public_exit, 'shared_author', author, false FROM r
  UNION ALL SELECT project_id, bidder_id, public_exit, 'shared_pdf_producer', pdf_producer, false FROM r) WHERE value IS NOT NULL GROUP BY ALL),
sv AS (SELECT x.project_id, x.bidder_id AS bidder_a, y.bidder_id AS bidder_b, x.signal_type, x.value FROM v x JOIN v y ON x.project_id = y.project_id AND x.signal_type = y.signal_type
  AND x.value = y.value AND x.bidder_id < y.bidder_id WHERE x.usable AND y.usable),
s AS (SELECT DISTINCT project_id, bidder_id, ip_address AS ip, regexp_extract(ip_address, '^(\\d+\\.\\d+\\.\\d+)', 1) || '.0/24' AS prefix, epoch(coalesce(event_time, uploaded_at)) AS t
  FROM r WHERE NOT public_exit AND regexp_full_match(ip_address, '{_V4}(\\.{_V4}){{3}}') AND coalesce(event_time, uploaded_at) IS NOT NULL),
sn AS (SELECT DISTINCT x.project_id, x.bidder_id AS bidder_a, y.bidder_id AS bidder_b, x.prefix FROM s x JOIN s y ON x.project_id = y.project_id AND x.prefix = y.prefix
  AND x.bidder_id < y.bidder_id AND x.ip <> y.ip AND abs(x.t - y.t) <= 1800),
tm AS (SELECT DISTINCT * FROM (SELECT project_id, bidder_id, 'created_time_close' AS signal_type, epoch(created_at) AS t FROM r UNION ALL SELECT project_id, bidder_id, 'modified_time_close', epoch(modified_at) FROM r
  UNION ALL SELECT project_id, bidder_id, 'upload_time_close', epoch(coalesce(uploaded_at, event_time)) FROM r) WHERE t IS NOT NULL),
ct AS (SELECT x.project_id, x.bidder_id AS bidder_a, y.bidder_id AS bidder_b, x.signal_type, CAST(min(abs(x.t - y.t)) AS BIGINT) AS seconds FROM tm x JOIN tm y
  ON x.project_id = y.project_id AND x.signal_type = y.signal_type AND x.bidder_id < y.bidder_id GROUP BY ALL),
m AS (SELECT DISTINCT project_id, bidder_id FROM r),
pr AS (SELECT x.project_id, x.bidder_id AS bidder_a, y.bidder_id AS bidder_b FROM m x JOIN m y ON x.project_id = y.project_id AND x.bidder_id < y.bidder_id),
hs AS MATERIALIZED (SELECT project_id, bidder_id, signal_type, usable FROM (SELECT project_id, bidder_id, signal_type, bool_or(usable) AS usable FROM v GROUP BY ALL)
  UNION ALL SELECT project_id, bidder_id, 'shared_subnet_time', bool_or(NOT public_exit) FROM r WHERE regexp_full_match(ip_address, '{_V4}(\\.{_V4}){{3}}') AND coalesce(event_time, uploaded_at) IS NOT NULL GROUP BY ALL
  UNION ALL SELECT DISTINCT project_id, bidder_id, signal_type, true FROM tm),
fired AS (SELECT project_id, bidder_a, bidder_b, signal_type FROM sv UNION ALL SELECT project_id, bidder_a, bidder_b, 'shared_subnet_time' FROM sn
  UNION ALL SELECT project_id, bidder_a, bidder_b, signal_type FROM ct WHERE seconds <= 300),
fn AS MATERIALIZED (SELECT project_id, bidder_a, bidder_b, signal_type, count(*) AS instances FROM fired GROUP BY ALL),
w(signal_type, weight) AS (VALUES ('shared_full_ip', 22), ('shared_subnet_time', 12), ('shared_device', 24), ('shared_account', 20), ('shared_file_hash', 30), ('shared_author', 8),
  ('shared_file_creator', 10), ('shared_pdf_producer', 5), ('created_time_close', 6), ('modified_time_close', 7), ('upload_time_close', 8)),
fr AS (SELECT pr.project_id, pr.bidder_a, pr.bidder_b, w.signal_type, coalesce(instances, 0) AS instances, coalesce(instances, 0) * weight AS points,
  CASE WHEN coalesce(instances, 0) > 0 THEN 'triggered' WHEN x.usable IS NULL OR y.usable IS NULL THEN 'not_provided' WHEN NOT (x.usable AND y.usable) THEN 'excluded' ELSE 'no_signal' END AS status
  FROM pr CROSS JOIN w LEFT JOIN hs x ON x.project_id = pr.project_id AND x.bidder_id = bidder_a AND x.signal_type = w.signal_type
  LEFT JOIN hs y ON y.project_id = pr.project_id AND y.bidder_id = bidder_b AND y.signal_type = w.signal_type
  LEFT JOIN fn ON fn.project_id = pr.project_id AND fn.bidder_a = pr.bidder_a AND fn.bidder_b = pr.bidder_b AND fn.signal_type = w.signal_type)
"""
_LINEAGE = """, lv AS (SELECT project_id, bidder_id, record_id, unnest(['shared_full_ip', 'shared_device', 'shared_account', 'shared_file_hash', 'shared_author', 'shared_pdf_producer']) AS signal_type,
  unnest([CASE WHEN NOT public_exit THEN ip_address END, device_id, account_id, file_sha256, author, pdf_producer]) AS value FROM r),
ln AS (SELECT sv.*, lv.record_id FROM sv JOIN lv ON lv.project_id = sv.project_id AND lv.signal_type = sv.signal_type AND lv.value = sv.value AND lv.bidder_id IN (bidder_a, bidder_b)
  WHERE regexp_matches(lv.record_id, '\\S'))
"""
ORACLE = {
    "links_shared_values": BASE + "SELECT project_id, bidder_a, bidder_b, signal_type, 'value:sha256:' || substr(sha256(value), 1, 12) || ';len=' || length(value) AS hint FROM sv",
    "links_public_exits": BASE + "SELECT ip_address, count(*) AS n, count(*) FILTER (public_exit) AS exits, count(DISTINCT bidder_id) AS bidders FROM r WHERE ip_address IS NOT NULL GROUP BY ALL",
    "links_subnet_time": BASE + "SELECT * FROM sn",
    "links_closest_times": BASE + "SELECT * FROM ct",
    "links_status": BASE + "SELECT project_id, bidder_a, bidder_b, signal_type, status, instances, points FROM fr WHERE status <> 'not_provided'",
    "links_features": BASE + """SELECT *, CASE WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END AS level FROM (
  SELECT project_id, bidder_a, bidder_b, CAST(least(sum(points), 100) AS BIGINT) AS score, count(*) FILTER (status = 'triggered') AS triggered, count(*) FILTER (status = 'no_signal') AS no_signal,
  count(*) FILTER (status = 'not_provided') AS not_provided, count(*) FILTER (status = 'excluded') AS excluded FROM fr GROUP BY ALL)""",
    "links_lineage": BASE + _LINEAGE + "SELECT DISTINCT project_id, bidder_a, bidder_b, signal_type, 'value:sha256:' || substr(sha256(value), 1, 12) || ';len=' || length(value) AS hint, record_id FROM ln",
    "links_trace_rate": BASE + _LINEAGE + """SELECT count(*) AS instances, count(traced) AS traced, round(coalesce(count(traced) / nullif(count(*), 0), 1.0), 6) AS rate FROM sv LEFT JOIN (
  SELECT DISTINCT project_id, bidder_a, bidder_b, signal_type, value, 1 AS traced FROM ln WHERE record_id IN (SELECT record_id FROM audit_records WHERE len(source_refs) > 0)) USING (project_id, bidder_a, bidder_b, signal_type, value)""",
    "links_summary": BASE + "SELECT signal_type, status, count(*) AS pairs FROM fr GROUP BY ALL",
}
