"""Queries of notices, manifests and recognition quality, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import notices as n
from ..session import table

QUERIES = {
    "samples_roles": lambda s, d: n.roles(table(s, d, "samples")),
    "samples_numbers": lambda s, d: n.sample_numbers(table(s, d, "samples")),
    "docs_companies": lambda s, d: n.companies(table(s, d, "documents")),
    "pages_doubtful": lambda s, d: n.doubtful_pages(table(s, d, "pages")),
    "docs_short_names": lambda s, d: n.short_names(table(s, d, "documents").select("project_id", F.col("bidder_name").alias("name"))),
}
_PATH = "concat_ws('/', source_inner_path, bid_file)"
_ROLE = "CASE " + " ".join(f"WHEN regexp_matches({_PATH}, '{'|'.join(w)}') THEN '{r}'" for r, w in n.ROLES.items()) + " ELSE 'other' END"
_SUFFIX = r"lower(regexp_extract(bid_file, '\.([A-Za-z0-9]{1,5})$', 1))"
_ALL = lambda p: f"len(regexp_extract_all(text, '{p}'))"
ORACLE = {
    "samples_roles": f"SELECT {_ROLE} AS role, {_SUFFIX} AS suffix, {_SUFFIX} IN {n.DOCUMENT_SUFFIXES} AS is_document, count(*) AS files FROM samples GROUP BY ALL",
    "samples_numbers": """SELECT sample_id, folder, row_number() OVER (PARTITION BY folder ORDER BY sample_id) AS number FROM (
 SELECT DISTINCT sample_id, regexp_extract(coalesce(source_inner_path, ''), '^([^/]*)', 1) AS folder FROM samples WHERE sample_id IS NOT NULL)""",
    "docs_companies": f"""SELECT DISTINCT doc_id, company FROM (SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '{n.COMPANY}', 1), regexp_extract_all(text, '{n.COMPANY_LATIN.replace("'", "''")}', 1))) AS company
 FROM documents WHERE text IS NOT NULL)""",
    "pages_doubtful": f"SELECT doc_id, page_number, {_ALL(n.OCR_MARKS)} AS marks, {_ALL(n.MIXED)} AS mixed FROM pages WHERE text IS NOT NULL AND ({_ALL(n.OCR_MARKS)} > 0 OR {_ALL(n.MIXED)} >= 3)",
}
