"""Raw rows to canonical records: header aliases, validation issues, identity, duplicates, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import filled, narrow
from ..functions.parse import present, strict_amount, strict_time, tri_state, valid_ipv4
from ..schemas import RECORD_TYPES

#: canonical field -> headers it may come under, the first non-blank of which counts.
ALIASES = {
    "record_type": ("record_type", "type", "类型", "记录类型"),
    "project_id": ("project_id", "项目编码"),
    "project_name": ("project_name", "project", "项目名称", "采购项目"),
    "tender_no": ("tender_no", "招标编号", "项目编号"),
    "bidder_id": ("bidder_id", "投标人编码"),
    "bidder_name": ("bidder_name", "bidder", "bidder_candidate", "供应商名称", "投标人", "投标人名称"),
    "credit_code": ("credit_code", "统一社会信用代码", "信用代码"),
    "amount": ("amount", "total_price", "报价", "投标报价"),
    "control_amount": ("control_amount", "control_price", "控制价", "最高限价"),
    "amount_unit": ("amount_unit", "price_unit", "currency_unit", "单位"),
    "quote_scope": ("quote_scope", "quote_type", "报价类型"),
    "item_code": ("item_code", "line_item_code", "分项编码"),
    "item_name": ("item_name", "分项名称"),
    "quantity": ("quantity", "qty", "数量"),
    "unit_price": ("unit_price", "单价"),
    "event_time": ("event_time", "time", "时间"),
    "ip_address": ("ip_address", "ip", "IP地址"),
    "is_winner": ("is_winner", "winner", "award_status", "是否中标"),
    "file_sha256": ("file_sha256", "sha256"),
    "file_name": ("file_name", "bid_file", "standard_path", "source_file"),
}


def _key(header: str) -> str:
    return "".join(header.split()).replace("-", "_").lower()


def canonical(raw: DataFrame) -> DataFrame:
    """One column for each canonical field (the first non-blank of its headers) and the map extra of all other filled columns."""
    by_key = {_key(c): c for c in raw.columns}
    used, fields = set(), []
    for field, headers in ALIASES.items():
        found = [by_key[_key(h)] for h in headers if _key(h) in by_key]
        used |= set(found)
        values = [filled(F.trim(F.col(f"`{c}`").cast("string"))) for c in found]
        fields.append((F.coalesce(*values) if values else F.lit(None).cast("string")).alias(field))
    rest = [c for c in raw.columns if c not in used and raw.schema[c].dataType.typeName() not in ("array", "map", "struct")]
    pairs = F.array(*[F.struct(F.lit(c).alias("k"), filled(F.col(f"`{c}`").cast("string")).alias("v")) for c in rest])
    extra = F.map_from_entries(F.filter(pairs, lambda e: e["v"].isNotNull())) if rest else F.create_map().cast("map<string,string>")
    return raw.select(*fields, extra.alias("extra"))


def issue_codes(records: DataFrame) -> Column:
    """array<string> of what is wrong with a canonical record; nothing is dropped for it."""
    have = set(records.columns)

    def wrong(field: str, good: Column) -> Column:
        return present(F.col(field)) & ~F.coalesce(good, F.lit(False)) if field in have else F.lit(False)

    checks = {
        "unknown_record_type": ~F.coalesce(F.lower(F.trim("record_type")).isin(*RECORD_TYPES), F.lit(False)),
        "missing_project": ~present(F.col("project_id")) & ~present(F.col("project_name")) & (F.col("record_type") != "bidder"),
        "missing_bidder": ~present(F.col("bidder_id")) & ~present(F.col("bidder_name")) & (F.col("record_type") != "project"),
        "missing_amount": ~present(F.col("amount")) & F.col("record_type").isin("quote", "bid"),
        "invalid_amount": wrong("amount", strict_amount(F.col("amount")).isNotNull()),
        "invalid_control_amount": wrong("control_amount", strict_amount(F.col("control_amount")).isNotNull()),
        "invalid_quantity": wrong("quantity", strict_amount(F.col("quantity")).isNotNull()),
        "invalid_unit_price": wrong("unit_price", strict_amount(F.col("unit_price")).isNotNull()),
        "invalid_time": wrong("event_time", strict_time(F.col("event_time")).isNotNull()),
        "invalid_ip": wrong("ip_address", valid_ipv4(F.trim("ip_address"))),
        "invalid_file_sha256": wrong("file_sha256", F.trim("file_sha256").rlike("^[0-9a-f]{64}$")),
        "invalid_is_winner": wrong("is_winner", tri_state(F.col("is_winner").cast("string")).isNotNull()) if dict(records.dtypes).get("is_winner") == "string" else F.lit(False),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]))


def issues(records: DataFrame) -> DataFrame:
    """(record_type, code, records): how many records have each issue."""
    long = records.select(F.coalesce("record_type", F.lit("")).alias("record_type"), F.explode(issue_codes(records)).alias("code"))
    return long.groupBy("record_type", "code").agg(F.count("*").alias("records"))


#: Fields that make two rows the same content, whatever id or source they came with.
CONTENT = (
    "record_type", "project_id", "bidder_id", "bid_id", "amount", "control_amount", "amount_unit", "quote_scope", "event_time", "item_code", "unit_price",
    "ip_address", "device_id", "account_id", "file_sha256", "created_at", "related_bidder_id",
)


def merge_duplicates(records: DataFrame) -> DataFrame:
    """Rows of one content merged: fingerprint, first record_id, rows, ids, and the distinct source paths united."""
    norm = [F.coalesce(F.trim(F.col(c)), F.lit("")) for c in CONTENT]
    rows = records.select(F.sha2(F.concat_ws("\x1f", *norm).cast("binary"), 256).alias("fingerprint"), "record_id", F.transform("source_refs", lambda r: r["source_path"]).alias("paths"))
    by = rows.groupBy("fingerprint").agg(
        F.min("record_id").alias("record_id"), F.count("*").alias("rows"), F.count_distinct("record_id").alias("ids"), F.array_distinct(F.flatten(F.collect_list("paths"))).alias("paths")
    )
    return by.select("fingerprint", "record_id", "rows", "ids", F.size("paths").alias("sources"))


def name_key(c: Column) -> Column:
    """Company name without blanks and signs, half-width, lower case, brackets and legal synonyms evened out."""
    s = F.regexp_replace(F.lower(narrow(c)), r"[\s()\-,.·]", "")
    return F.regexp_replace(F.regexp_replace(s, "有限责任公司", "有限公司"), "coltd$|limited$", "ltd")


def name_registry(records: DataFrame) -> DataFrame:
    """(name, codes, code): each name's registration codes; code only where there is exactly one, more are a conflict."""
    rows = records.where(present(F.col("bidder_name"))).select(name_key(F.col("bidder_name")).alias("name"), F.upper(filled(F.trim("credit_code"))).alias("code"))
    by = rows.groupBy("name").agg(F.count_distinct("code").alias("codes"), F.min("code").alias("code"))
    return by.select("name", "codes", F.when(F.col("codes") == 1, F.col("code")).alias("code"))


def identities(records: DataFrame) -> DataFrame:
    """(record_id, identity, basis): by the record's own code, else the one code of its name, else a hash of the name."""
    rows = records.where(present(F.col("bidder_name"))).select("record_id", name_key(F.col("bidder_name")).alias("name"), F.upper(filled(F.trim("credit_code"))).alias("own")).distinct()
    joined = rows.join(name_registry(records), "name")
    hashed = F.concat(F.lit("name-"), F.substring(F.sha2(F.col("name").cast("binary"), 256), 1, 16))
    return joined.select(
        "record_id",
        F.coalesce("own", "code", hashed).alias("identity"),
        F.when(F.col("own").isNotNull(), "code").when(F.col("code").isNotNull(), "name").otherwise("hash").alias("basis"),
    )


def coverage(records: DataFrame) -> DataFrame:
    """(category, records, usable, projects, rate) of files, quotes, network events and relations."""
    usable = {
        "files": (F.col("record_type").isin("document", "file_metadata"), present(F.col("file_sha256")) | present(F.col("file_name"))),
        "quotes": (F.col("record_type").isin("quote", "bid"), strict_amount(F.col("amount")).isNotNull()),
        "network": (F.col("record_type") == "network_event", present(F.col("ip_address")) | present(F.col("device_id")) | present(F.col("account_id"))),
        "relations": (F.col("record_type") == "historical_relation", present(F.col("related_bidder_id"))),
    }
    category, good = F.lit(None).cast("string"), F.lit(False)
    for name, (kind, ok) in usable.items():
        category, good = F.when(kind, name).otherwise(category), F.when(kind, ok).otherwise(good)
    rows = records.select(category.alias("category"), good.alias("good"), filled(F.col("project_id")).alias("project")).where("category is not null")
    by = rows.groupBy("category").agg(F.count("*").alias("records"), F.count_if("good").alias("usable"), F.count_distinct("project").alias("projects"))
    return by.withColumn("rate", F.try_divide("usable", "records"))


def sample_documents(samples: DataFrame, documents: DataFrame) -> DataFrame:
    """Manifest rows, each once, with the document they name and whether it is there; the project falls back to the path's folder."""
    folder = F.regexp_extract("source_inner_path", r"^([^/]+)/", 1)
    rows = samples.select(
        F.trim("sample_id").alias("sample_id"),
        F.coalesce(filled(F.trim("project_name")), F.nullif(folder, F.lit("")), F.lit("")).alias("project_name"),
        F.coalesce(filled(F.trim("bidder_candidate")), F.lit("")).alias("bidder_candidate"),
        F.lower(F.regexp_extract("bid_file", r"\.([A-Za-z0-9]+)$", 1)).alias("suffix"),
    ).distinct()
    known = documents.select(F.col("document_id").alias("sample_id"), F.lit(True).alias("found")).distinct()
    return rows.join(known, "sample_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
