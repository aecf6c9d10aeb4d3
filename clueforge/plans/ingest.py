"""Queries of the ingestion engine with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import strict_amount
from ..operators import ingest as i
from ..session import table
from .links import _V4, time_sql



def _records(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "audit_records")


def quote_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Raw price rows under canonical names, quantities and prices parsed, with the issues found."""
    raw = table(spark, folder, "quote_prices")
    rows = i.canonical(raw)
    codes = F.array_join(F.array_sort(i.issue_codes(rows)), ",")
    number = lambda c: strict_amount(F.col(c)).cast("double").alias(c)
    return rows.select(
        "record_type", "project_id", "bidder_id", "item_code", number("quantity"), number("unit_price"), F.try_element_at("extra", F.lit("source_path")).alias("source_path"), codes.alias("issues")
    )


def coverage(spark: SparkSession, folder: str) -> DataFrame:
    return i.coverage(_records(spark, folder)).withColumn("rate", F.round("rate", 6))


def names(spark: SparkSession, folder: str) -> DataFrame:
    return i.name_registry(_records(spark, folder))


QUERIES = {
    "ingest_quote_prices": quote_prices,
    "ingest_issues": lambda s, d: i.issues(_records(s, d)),
    "ingest_merge_duplicates": lambda s, d: i.merge_duplicates(_records(s, d)),
    "ingest_name_registry": names,
    "ingest_identities": lambda s, d: i.identities(_records(s, d)),
    "ingest_coverage": coverage,
    "ingest_samples": lambda s, d: i.sample_documents(table(s, d, "samples"), table(s, d, "documents")),
}


def _strict(c: str) -> str:
    s = f"regexp_replace({c}, '人民币|RMB|CNY|¥|￥|元|,|，|\\s', '', 'g')"
    return f"CASE WHEN regexp_full_match({s}, '\\d{{1,13}}(\\.\\d+)?') AND CAST({s} AS DECIMAL(20,6)) > 0 THEN CAST({s} AS DECIMAL(20,6)) END"


def _has(c: str) -> str:
    return f"coalesce(regexp_matches({c}, '[^\\s　 ]'), false)"


_NAME = "regexp_replace(regexp_replace(regexp_replace(lower({n}), '[\\s()\\-,.·]', '', 'g'), '有限责任公司', '有限公司', 'g'), 'coltd$|limited$', 'ltd', 'g')"
_WIDE, _NARROW = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　 ", "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "  "
_NAME = _NAME.format(n=f"translate(bidder_name, '{_WIDE}', '{_NARROW.replace(chr(39), chr(39) * 2)}')")
_CODE = f"CASE WHEN {_has('credit_code')} THEN upper(trim(credit_code)) END"
_NORM = " || chr(31) || ".join(f"coalesce(trim({c}), '')" for c in i.CONTENT)
_REGISTRY = f"""WITH rows AS (SELECT record_id, {_NAME} AS name, {_CODE} AS code FROM audit_records WHERE {_has('bidder_name')}),
reg AS (SELECT name, count(DISTINCT code) AS codes, CASE WHEN count(DISTINCT code) = 1 THEN min(code) END AS code FROM rows GROUP BY name)
"""
_CHECKS = {
    "missing_project": f"NOT {_has('project_id')} AND NOT {_has('project_name')} AND record_type <> 'bidder'",
    "missing_bidder": f"NOT {_has('bidder_id')} AND NOT {_has('bidder_name')} AND record_type <> 'project'",
    "missing_amount": f"NOT {_has('amount')} AND record_type IN ('quote', 'bid')",
    "invalid_amount": f"{_has('amount')} AND ({_strict('amount')}) IS NULL",
    "invalid_control_amount": f"{_has('control_amount')} AND ({_strict('control_amount')}) IS NULL",
    "invalid_quantity": f"{_has('quantity')} AND ({_strict('quantity')}) IS NULL",
    "invalid_unit_price": f"{_has('unit_price')} AND ({_strict('unit_price')}) IS NULL",
    "invalid_time": f"{_has('event_time')} AND ({time_sql('event_time')}) IS NULL",
    "invalid_ip": f"{_has('ip_address')} AND NOT regexp_full_match(trim(ip_address), '{_V4}(\\.{_V4}){{3}}')",
    "invalid_file_sha256": f"{_has('file_sha256')} AND NOT regexp_full_match(trim(file_sha256), '[0-9a-f]{{64}}')",
}
_LIST = ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _CHECKS.items())
ORACLE = {
    "ingest_quote_prices": f"""SELECT record_type, project_id, bidder_id, item_code, CAST({_strict('quantity')} AS DOUBLE) AS quantity, CAST({_strict('unit_price')} AS DOUBLE) AS unit_price, source_path,
 coalesce(array_to_string(list_sort(list_filter([CASE WHEN record_type IS NULL OR lower(trim(record_type)) NOT IN ('project', 'bidder', 'bid', 'quote', 'network_event', 'file_metadata', 'document', 'historical_relation') THEN 'unknown_record_type' END,
  CASE WHEN NOT {_has('project_id')} AND NOT {_has('project_name')} AND record_type <> 'bidder' THEN 'missing_project' END, CASE WHEN NOT {_has('bidder_id')} AND NOT {_has('bidder_name')} AND record_type <> 'project' THEN 'missing_bidder' END,
  CASE WHEN record_type IN ('quote', 'bid') THEN 'missing_amount' END, CASE WHEN {_has('quantity')} AND ({_strict('quantity')}) IS NULL THEN 'invalid_quantity' END,
  CASE WHEN {_has('unit_price')} AND ({_strict('unit_price')}) IS NULL THEN 'invalid_unit_price' END], lambda v: v IS NOT NULL)), ','), '') AS issues
FROM (SELECT CASE WHEN {_has('record_type')} THEN trim(record_type) END AS record_type, CASE WHEN {_has('project_id')} THEN trim(project_id) END AS project_id, project_name, CASE WHEN {_has('bidder_id')} THEN trim(bidder_id) END AS bidder_id,
 bidder_name, CASE WHEN {_has('line_item_code')} THEN trim(line_item_code) END AS item_code, qty AS quantity, unit_price, CASE WHEN {_has('source_path')} THEN source_path END AS source_path FROM quote_prices)""",
    "ingest_issues": f"SELECT record_type, code, count(*) AS records FROM (SELECT coalesce(record_type, '') AS record_type, unnest([{_LIST}]) AS code FROM audit_records) WHERE code IS NOT NULL GROUP BY ALL",
    "ingest_merge_duplicates": f"""WITH r AS (SELECT sha256({_NORM}) AS fingerprint, record_id, list_transform(source_refs, lambda s: s.source_path) AS paths FROM audit_records)
SELECT fingerprint, min(record_id) AS record_id, count(*) AS rows, count(DISTINCT record_id) AS ids, len(list_distinct(flatten(list(paths)))) AS sources FROM r GROUP BY fingerprint""",
    "ingest_name_registry": _REGISTRY + "SELECT * FROM reg",
    "ingest_identities": _REGISTRY + """SELECT DISTINCT record_id, coalesce(rows.code, reg.code, 'name-' || substr(sha256(name), 1, 16)) AS identity,
 CASE WHEN rows.code IS NOT NULL THEN 'code' WHEN reg.code IS NOT NULL THEN 'name' ELSE 'hash' END AS basis FROM (SELECT DISTINCT * FROM rows) rows JOIN reg USING (name)""",
    "ingest_coverage": f"""SELECT category, count(*) AS records, count(*) FILTER (good) AS usable, count(DISTINCT project) AS projects, round(count(*) FILTER (good) / count(*), 6) AS rate FROM (
 SELECT CASE WHEN record_type IN ('document', 'file_metadata') THEN 'files' WHEN record_type IN ('quote', 'bid') THEN 'quotes' WHEN record_type = 'network_event' THEN 'network' WHEN record_type = 'historical_relation' THEN 'relations' END AS category,
 CASE WHEN record_type IN ('document', 'file_metadata') THEN {_has('file_sha256')} OR {_has('file_name')} WHEN record_type IN ('quote', 'bid') THEN ({_strict('amount')}) IS NOT NULL
  WHEN record_type = 'network_event' THEN {_has('ip_address')} OR {_has('device_id')} OR {_has('account_id')} WHEN record_type = 'historical_relation' THEN {_has('related_bidder_id')} END AS good,
 CASE WHEN {_has('project_id')} THEN project_id END AS project FROM audit_records) WHERE category IS NOT NULL GROUP BY category""",
    "ingest_samples": f"""SELECT DISTINCT trim(sample_id) AS sample_id, coalesce(CASE WHEN {_has('project_name')} THEN trim(project_name) END, nullif(regexp_extract(source_inner_path, '^([^/]+)/', 1), ''), '') AS project_name,
 coalesce(CASE WHEN {_has('bidder_candidate')} THEN trim(bidder_candidate) END, '') AS bidder_candidate, lower(regexp_extract(bid_file, '\\.([A-Za-z0-9]+)$', 1)) AS suffix,
 trim(sample_id) IN (SELECT document_id FROM documents WHERE document_id IS NOT NULL) AS found FROM samples""",
}
