"""Small reports: legacy project prices, notice categories, tender fields, evidence graph, redaction of notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import present, short_id

#: category -> words; the first with the most hits wins.
CATEGORIES = {
    "信息化": ("系统", "软件", "网络", "信息", "平台", "交换机", "终端", "阵列"),
    "设备": ("设备", "仪", "机", "泵", "阀", "柜", "装置", "单元"),
    "工程": ("工程", "施工", "建设", "改造", "装修"),
    "服务": ("服务", "咨询", "物业", "运维", "检测"),
}


def category(c: Column) -> Column:
    hits = [F.struct(sum((F.contains(c, F.lit(w)).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, words) in enumerate(CATEGORIES.items())]
    best = F.array_max(F.array(*hits))
    return F.when(best["n"] > 0, best["name"]).otherwise("其他")


def strip_html(c: Column) -> Column:
    """Visible text of a saved page: scripts, styles and tags out, the common entities back to characters, blanks squeezed."""
    s = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def tender_fields(documents: DataFrame) -> DataFrame:
    """(doc_id, project_title, warranty_months, bond_percent, has_service, has_delivery): fields of tender texts, null where absent."""
    t = F.col("text")
    number = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit("")).try_cast("int")
    return documents.where(present(t)).select(
        "doc_id",
        F.nullif(F.regexp_extract(t, "^([^\n（]{4,40}采购项目)", 1), F.lit("")).alias("project_title"),
        number("质保期([0-9]{1,3})个月").alias("warranty_months"),
        number("保证金比例为([0-9]{1,3})%").alias("bond_percent"),
        F.contains(t, F.lit("服务承诺")).alias("has_service"),
        F.contains(t, F.lit("供货范围")).alias("has_delivery"),
    )


def project_prices(totals: DataFrame) -> DataFrame:
    """Every total with its distance from its project's mean and minimum in percent, and the project's spread."""
    w = Window.partitionBy("project_id")
    mean, low, high = F.avg("amount").over(w), F.min("amount").over(w), F.max("amount").over(w)
    pct = lambda a, b: F.round(100 * (a - b) / b, 4)
    return totals.select(
        "project_id", "bidder_id", "amount", pct(F.col("amount"), mean).alias("from_mean"), pct(F.col("amount"), low).alias("from_min"), pct(high, low).alias("spread"), F.count("*").over(w).alias("bidders")
    )


def repeated_authors(records: DataFrame) -> DataFrame:
    """(author, bidders, projects, files): authors of files of several bidders."""
    rows = records.where(present(F.col("author")) & present(F.col("bidder_id")))
    by = rows.groupBy(F.trim("author").alias("author")).agg(F.count_distinct("bidder_id").alias("bidders"), F.count_distinct("project_id").alias("projects"), F.count("*").alias("files"))
    return by.where("bidders > 1")


def mask(kind: Column, value: Column) -> Column:
    """Label of an entity node: the last four characters of numbers, the domain of addresses, the first of other texts."""
    return (
        F.when(kind.isin("phone", "landline", "credit_code"), F.concat(F.lit("***"), F.substring(value, -4, 4)))
        .when(kind == "email", F.concat(F.lit("***@"), F.regexp_extract(value, "@(.*)$", 1)))
        .otherwise(F.concat(F.substring(value, 1, 1), F.lit("**")))
    )


def evidence_graph(documents: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of projects, bidders, documents and the entities that two documents or more hold."""
    docs = documents.where(present(F.col("project_id"))).select("doc_id", "project_id", "bidder_id").distinct()
    node = lambda kind, c: short_id(kind, F.col(c).cast("string"))
    shared = entities.groupBy("kind", "value").agg(F.count_distinct("doc_id").alias("docs")).where("docs >= 2")
    held = entities.join(shared, ["kind", "value"]).select("doc_id", "kind", "value").distinct()
    entity = short_id("entity", F.col("kind"), F.col("value"))
    nodes = (
        docs.select(node("project", "project_id").alias("id"), F.lit("project").alias("type"), F.col("project_id").alias("label"))
        .unionByName(docs.where(present(F.col("bidder_id"))).select(node("bidder", "bidder_id").alias("id"), F.lit("bidder").alias("type"), F.col("bidder_id").alias("label")))
        .unionByName(docs.select(node("document", "doc_id").alias("id"), F.lit("document").alias("type"), F.col("doc_id").cast("string").alias("label")))
        .unionByName(held.select(entity.alias("id"), F.col("kind").alias("type"), mask(F.col("kind"), F.col("value")).alias("label")))
        .distinct()
    )
    edges = (
        docs.select(node("project", "project_id").alias("source"), node("document", "doc_id").alias("target"), F.lit("submitted_document").alias("type"))
        .unionByName(docs.where(present(F.col("bidder_id"))).select(node("bidder", "bidder_id").alias("source"), node("project", "project_id").alias("target"), F.lit("participates").alias("type")))
        .unionByName(held.select(node("document", "doc_id").alias("source"), entity.alias("target"), F.lit("shared_entity").alias("type")))
        .distinct()
    )
    return nodes, edges
