"""Notices, manifests and archives: roles of files, links of saved pages, company names in texts, short names of bidders, doubtful OCR."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import present

#: role -> words of a path; the first role with a word in the path counts.
ROLES = {
    "tender_file": ("招标文件", "采购文件", "磋商文件"),
    "price_list": ("报价", "价格", "清单"),
    "business": ("商务",),
    "technical": ("技术", "方案"),
    "qualification": ("资格", "资质", "证书"),
    "bid_file": ("投标", "响应"),
}
DOCUMENT_SUFFIXES = ("doc", "docx", "pdf", "xls", "xlsx", "ofd")
#: Company names after a label; the shortest that ends in a legal form.
COMPANY = r"(?:投标人|供应商|单位)(?:名称)?[：: ]+([^\n，,；;。 ]{4,60}?公司)"
COMPANY_LATIN = r"(?:Bidder|Supplier|投标人|供应商)(?: name|名称)?[：: ]+([A-Za-z][A-Za-z0-9 .,&'-]{1,80}?(?:Ltd|Limited|Corporation|Inc))"
#: Marks that recognised text often leaves where it failed.
OCR_MARKS = "[□■◆�]|\\?{3,}"
MIXED = r"[一-龥][A-Za-z0-9][一-龥][A-Za-z0-9]|[A-Za-z0-9][一-龥][A-Za-z0-9][一-龥]"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1))


def file_role(path: Column) -> Column:
    out = F.lit("other")
    for role, words in reversed(ROLES.items()):
        out = F.when(path.rlike("|".join(words)), role).otherwise(out)
    return out


def roles(samples: DataFrame) -> DataFrame:
    """(role, suffix, is_document, files): files of the manifest by role and suffix."""
    path = F.concat_ws("/", "source_inner_path", "bid_file")
    rows = samples.select(file_role(path).alias("role"), suffix(F.col("bid_file")).alias("suffix"))
    return rows.groupBy("role", "suffix", F.col("suffix").isin(*DOCUMENT_SUFFIXES).alias("is_document")).agg(F.count("*").alias("files"))


def sample_numbers(samples: DataFrame) -> DataFrame:
    """(sample_id, folder, number): each sample once, numbered inside the top folder of its path, by id."""
    rows = samples.select("sample_id", F.regexp_extract(F.coalesce("source_inner_path", F.lit("")), r"^([^/]*)", 1).alias("folder")).where("sample_id is not null").distinct()
    return rows.withColumn("number", F.row_number().over(Window.partitionBy("folder").orderBy("sample_id")))


def companies(documents: DataFrame) -> DataFrame:
    """(doc_id, company): names after a label in the whole text, Chinese and Latin, each once."""
    found = F.concat(F.regexp_extract_all("text", F.lit(COMPANY), F.lit(1)), F.regexp_extract_all("text", F.lit(COMPANY_LATIN), F.lit(1)))
    return documents.where("text is not null").select("doc_id", F.explode(found).alias("company")).distinct()


def doubtful_pages(pages: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, page_number, marks, mixed): pages with marks of failed recognition, or with `least` fragments of mixed scripts."""
    held = pages.where("text is not null").select(
        "doc_id", "page_number", F.size(F.regexp_extract_all("text", F.lit(OCR_MARKS), F.lit(0))).alias("marks"), F.size(F.regexp_extract_all("text", F.lit(MIXED), F.lit(0))).alias("mixed")
    )
    return held.where((F.col("marks") > 0) | (F.col("mixed") >= least))


def page_links(html: Column) -> Column:
    """array<struct(url, name)> of the links of a saved page that lead to documents."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*href=[\"']([^\"']+)[\"'][^>]*>.*?</a>"), F.lit(0))
    url = lambda a: F.regexp_extract(a, r"(?is)href=[\"']([^\"']+)[\"']", 1)
    name = lambda a: F.trim(F.regexp_replace(F.regexp_replace(a, r"(?s)<[^>]*>", " "), r"\s+", " "))
    named = F.transform(found, lambda a: F.struct(url(a).alias("url"), name(a).alias("name")))
    return F.filter(named, lambda x: suffix(F.regexp_replace(x["url"], r"[?#].*$", "")).isin(*DOCUMENT_SUFFIXES, "zip", "rar") | suffix(x["name"]).isin(*DOCUMENT_SUFFIXES, "zip", "rar"))


def common_length(a: str, b: str) -> int:
    """Length of the longest run of characters that both hold."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0, *(row[j] + 1 if x == y else 0 for j, y in enumerate(b))]
        best = max(best, *row)
    return best


def short_names(named: DataFrame, least: int = 4) -> DataFrame:
    """(project_id, name, full_name): a bidder's short name and the only longer name of its project that shares most with it.

    Two names share a run of `least` characters exactly if they share a part of that length, so candidates come from an
    equi-join on parts; the run's length is then measured for candidates only. Legal forms don't count, ties give no full name.
    """
    names = named.where(present(F.col("project_id")) & present(F.col("name"))).select("project_id", F.regexp_replace("name", r"\s", "").alias("name")).distinct()
    names = names.withColumn("core", F.regexp_replace("name", "(集团|股份)?(有限)?(责任)?公司$", ""))
    pieces = F.transform(F.sequence(F.lit(1), F.length("core") - (least - 1)), lambda i: F.substr(F.col("core"), i, F.lit(least)))
    parts = names.where(F.length("core") >= least).select("project_id", "name", "core", F.explode(F.array_distinct(pieces)).alias("part"))
    longer = parts.select("project_id", "part", F.col("name").alias("full_name"), F.col("core").alias("full_core"))
    met = parts.join(longer, ["project_id", "part"]).where(F.length("full_name") > F.length("name"))
    met = met.select("project_id", "name", "full_name", "core", "full_core").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [common_length(a, b) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lengths, pa.int32())], ["project_id", "name", "full_name", "shared"])

    measured = met.mapInArrow(run, "project_id string, name string, full_name string, shared int")
    most = measured.groupBy("project_id", "name").agg(F.max("shared").alias("shared"))
    best = measured.join(most, ["project_id", "name", "shared"]).groupBy("project_id", "name").agg(F.count("*").alias("n"), F.min("full_name").alias("full_name"))
    return best.where("n = 1").select("project_id", "name", "full_name")
