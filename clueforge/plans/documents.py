"""Queries of the document engine with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as o
from ..session import durable, release, table

ON = ["project_id", "doc_a", "doc_b"]


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages")


def similar(spark: SparkSession, folder: str) -> DataFrame:
    return o.similar_documents(_docs(spark, folder)).withColumn("similarity", F.round("similarity", 6))


def findings(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    made = []
    for label, make in (("similar", o.linked_documents), ("shared", lambda d: o.shared_entities(o.entities(d))), ("segments", lambda d: o.segment_pairs(o.shared_segments(d)))):
        made.append(durable(make(docs), label))
        release(spark)  # texts and windows that were shuffled for one part are gone before the next
    similarity, shared, segments = made
    pairs = similarity.select(*ON).unionByName(shared.select(*ON)).unionByName(segments.select(*ON)).distinct()
    who = docs.select("doc_id", "bidder_id").distinct()
    named = pairs.join(who.select(F.col("doc_id").alias("doc_a"), F.col("bidder_id").alias("x")), "doc_a").join(who.select(F.col("doc_id").alias("doc_b"), F.col("bidder_id").alias("y")), "doc_b")
    same = named.groupBy(*ON).agg(F.bool_or(F.coalesce(F.col("x") == F.col("y"), F.lit(False))).alias("same_bidder"))
    return o.pair_findings(similarity, shared, segments, same).withColumns({c: F.round(c, 4) for c in ("similarity", "score")})


def totals(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = o.clean_pages(_pages(spark, folder))
    return cleaned.agg(
        F.count("*").alias("pages"), F.sum("removed_lines").alias("removed_lines"), F.count_if("duplicate").alias("duplicate_pages"), F.sum(F.length("cleaned_text")).alias("chars")
    )


QUERIES = {
    "docs_entities": lambda s, d: o.entities(_docs(s, d)),
    "docs_common_entities": lambda s, d: o.common_entities(o.entities(_docs(s, d))),
    "docs_shared_entities": lambda s, d: o.shared_entities(o.entities(_docs(s, d))),
    "docs_copies": lambda s, d: o.copies(_docs(s, d)),
    "docs_similar": similar,
    "docs_template_windows": lambda s, d: o.template_windows(o.windows(_docs(s, d).dropDuplicates(["doc_id"]))),
    "docs_shared_segments": lambda s, d: o.shared_segments(_docs(s, d)),
    "docs_segments_anywhere": lambda s, d: o.segment_pairs(o.shared_segments(_docs(s, d), same_project=False)).drop("segments"),
    "docs_segment_pairs": lambda s, d: o.segment_pairs(o.shared_segments(_docs(s, d))),
    "docs_findings": findings,
    "docs_status": lambda s, d: o.document_status(_docs(s, d), _pages(s, d)),
    "docs_evidence_pages": lambda s, d: o.evidence_pages(o.entities(_docs(s, d)), _pages(s, d)),
    "pages_lines": lambda s, d: o.page_lines(_pages(s, d)),
    "pages_cleaned": lambda s, d: o.clean_pages(_pages(s, d)),
    "pages_totals": totals,
}

_ENTITY = " UNION ".join(
    f"SELECT project_id, doc_id, '{k}' AS kind, {'lower(v)' if k == 'email' else 'v'} AS value FROM (SELECT project_id, doc_id, unnest(regexp_extract_all(text, '{p}', 1)) AS v FROM documents)"
    for k, p in o.ENTITY_PATTERNS.items()
)
_AT = "(instr('0123456789ABCDEFGHJKLMNPQRTUWXY', substr(value, {i}, 1)) - 1)"
_SUM = " + ".join(f"{_AT.format(i=i + 1)} * {w}" for i, w in enumerate((1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28)))
_GOOD = f"(kind <> 'credit_code' OR ({_AT.format(i=18)} = (31 - ({_SUM}) % 31) % 31 AND NOT regexp_full_match(value, '[0-9]+'))) AND NOT (kind = 'contact' AND value IN ('电话', '手机', '方式', '姓名'))"
BASE = rf"""
WITH en AS (SELECT * FROM ({_ENTITY}) WHERE {_GOOD}),
se AS (SELECT project_id, doc_a, doc_b, kind, count(*) AS n FROM (SELECT project_id, kind, value, min(doc_id) AS doc_a, max(doc_id) AS doc_b FROM en WHERE kind <> 'tender_number' AND regexp_matches(project_id, '\S')
  GROUP BY ALL HAVING count(*) = 2) GROUP BY ALL),
cx AS (SELECT doc_id, project_id, bidder_id, regexp_replace(text, '\s+', '', 'g') AS t FROM documents),
cp AS (SELECT project_id, doc_id, min(doc_id) OVER (PARTITION BY project_id, t) AS representative FROM cx WHERE regexp_matches(project_id, '\S') AND t <> ''),
rp AS (SELECT DISTINCT project_id, doc_id FROM cp WHERE doc_id = representative),
"""
_SIMILAR = """
tx AS (SELECT doc_id, any_value(t) AS t FROM cx WHERE doc_id IN (SELECT doc_id FROM rp) GROUP BY doc_id),
gr AS (SELECT doc_id, gram, count(*) AS tf FROM (SELECT doc_id, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS gram FROM tx WHERE length(t) >= 3) GROUP BY ALL),
gd AS (SELECT gram, count(*) AS df FROM gr GROUP BY gram),
gw AS (SELECT doc_id, gram, (1 + ln(tf)) * (ln((1 + (SELECT count(DISTINCT doc_id) FROM gr)) / (1 + df)) + 1) AS w FROM gr JOIN gd USING (gram)),
gn AS (SELECT doc_id, gram, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM gw),
gp AS (SELECT project_id, doc_id, gram, w FROM gn JOIN rp USING (doc_id)),
sm AS (SELECT x.project_id, x.doc_id AS doc_a, y.doc_id AS doc_b, sum(x.w * y.w) AS similarity FROM gp x JOIN gp y ON x.project_id = y.project_id AND x.gram = y.gram AND x.doc_id < y.doc_id
  GROUP BY ALL HAVING sum(x.w * y.w) >= 0.75),
"""
#: _SIMILAR, and the pairs of equal texts and of copies.
_LINKED = _SIMILAR.replace("\nsm AS (", "\nsr AS (") + """
sc AS (SELECT project_id, doc_a, doc_b, similarity FROM sr UNION ALL SELECT DISTINCT project_id, doc_id, doc_id, 1.0::DOUBLE FROM gp),
sm AS (SELECT DISTINCT sc.project_id, least(x.doc_id, y.doc_id) AS doc_a, greatest(x.doc_id, y.doc_id) AS doc_b, similarity FROM sc
  JOIN cp x ON x.project_id = sc.project_id AND x.representative = sc.doc_a JOIN cp y ON y.project_id = sc.project_id AND y.representative = sc.doc_b
  WHERE sc.doc_a < sc.doc_b OR x.doc_id < y.doc_id),
"""
_SEGMENTS = r"""
sx AS (SELECT doc_id, any_value(t) AS t FROM cx GROUP BY doc_id),
sw AS (SELECT doc_id, segment, min(start) AS start FROM (SELECT doc_id, start, substr(t, start + 1, 48) AS segment FROM (SELECT doc_id, t, unnest(range(0, length(t) - 47, 16)) AS start FROM sx WHERE length(t) >= 48))
  WHERE len(list_distinct(string_split(segment, ''))) >= 12 AND regexp_matches(segment, '[A-Za-z一-鿿]') GROUP BY ALL),
sb AS (SELECT segment, count(*) AS n, min(doc_id) AS doc_a, max(doc_id) AS doc_b, arg_min(start, doc_id) AS start_a, arg_max(start, doc_id) AS start_b FROM sw GROUP BY segment),
hd AS (SELECT DISTINCT substr(segment, 1, 24) AS head FROM sb WHERE n >= 3),
pj AS (SELECT DISTINCT doc_id, project_id FROM documents WHERE regexp_matches(project_id, '\S')),
s2 AS (SELECT p.project_id, doc_a, doc_b, segment, start_a, start_b FROM sb JOIN pj p ON p.doc_id = doc_a JOIN pj r ON r.doc_id = doc_b AND r.project_id = p.project_id WHERE n = 2),
bad AS (SELECT DISTINCT segment FROM (SELECT segment, unnest(list_transform(range(1, 26), lambda i: substr(segment, i, 24))) AS part FROM s2) JOIN hd ON part = head),
ss AS (SELECT * FROM s2 WHERE segment NOT IN (SELECT segment FROM bad)),
"""
_CHARS = """
sg AS (SELECT project_id, doc_a, doc_b, count(*) AS windows, CAST(sum(CASE WHEN prev IS NOT NULL AND start_a <= prev + 48 + 16 THEN start_a - prev ELSE 48 END) AS INT) AS chars FROM (
  SELECT *, lag(start_a) OVER (PARTITION BY project_id, doc_a, doc_b ORDER BY start_a) AS prev FROM ss) GROUP BY ALL),
"""
_PAGES = r"""
WITH pl AS (SELECT doc_id, page_number, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line, len(ls) AS lines FROM (
  SELECT doc_id, page_number, list_filter(list_transform(regexp_split_to_array(text, '\r\n|\n|\r'), lambda x: trim(regexp_replace(x, '[ \t　]+', ' ', 'g'), ' ')), lambda x: x <> '') AS ls FROM pages WHERE text IS NOT NULL)),
sz AS (SELECT doc_id, count(DISTINCT page_number) AS n FROM pl GROUP BY ALL),
sh AS (SELECT doc_id, line FROM (SELECT doc_id, line, count(DISTINCT page_number) AS o, avg(CASE WHEN pos <= 4 OR pos > lines - 4 THEN 1.0 ELSE 0.0 END) AS share FROM pl GROUP BY ALL) JOIN sz USING (doc_id)
  WHERE o >= greatest(3, round(n * 0.02)) AND share >= 0.6 AND (length(line) <= 120 OR regexp_matches(line, '""" + o.PAGE_MARK + r"""'))),
pg AS (SELECT doc_id, page_number, string_agg(line, chr(10) ORDER BY pos) AS whole FROM pl GROUP BY ALL),
dp AS (SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id, whole ORDER BY page_number) > 1 AND length(whole) >= 80 AS duplicate FROM pg),
jd AS (SELECT pl.*, duplicate, duplicate OR regexp_matches(line, '""" + o.PAGE_MARK + r"""') OR ((doc_id, line) IN (SELECT (doc_id, line) FROM sh) AND row_number() OVER (PARTITION BY doc_id, line ORDER BY page_number, pos) > 1)
  OR (length(line) >= 6 AND row_number() OVER (PARTITION BY doc_id, page_number, line ORDER BY pos) > 1) AS gone FROM pl JOIN dp USING (doc_id, page_number)),
cl AS (SELECT doc_id, page_number, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS cleaned_text, count(*) FILTER (gone) AS removed_lines, duplicate FROM jd GROUP BY ALL)
"""
_END = "zz AS (SELECT 1) "
ORACLE = {
    "docs_entities": BASE + _END + "SELECT * FROM en",
    "docs_common_entities": BASE + _END + "SELECT project_id, kind, value, count(DISTINCT doc_id) AS docs FROM en GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3",
    "docs_shared_entities": BASE + _END + "SELECT * FROM se",
    "docs_copies": BASE + _END + "SELECT * FROM cp",
    "docs_similar": BASE + _SIMILAR + _END + "SELECT project_id, doc_a, doc_b, round(similarity, 6) AS similarity FROM sm",
    "docs_template_windows": BASE + _SEGMENTS + _END + "SELECT segment, n AS docs FROM sb WHERE n >= 3",
    "docs_shared_segments": BASE + _SEGMENTS + _END + "SELECT * FROM ss",
    "docs_segments_anywhere": BASE + _SEGMENTS.replace(" AND r.project_id = p.project_id", "") + _CHARS + _END + "SELECT * FROM sg",
    "docs_findings": BASE + _LINKED + _SEGMENTS + _CHARS + r"""
kd AS (SELECT project_id, doc_a, doc_b, count(*) AS kinds, bool_or(kind IN ('phone', 'landline', 'email', 'credit_code')) AS strong,
  sum(CASE kind WHEN 'phone' THEN 20 WHEN 'landline' THEN 20 WHEN 'email' THEN 20 WHEN 'credit_code' THEN 25 WHEN 'contact' THEN 10 ELSE 8 END) AS points FROM se GROUP BY ALL),
al AS (SELECT project_id, doc_a, doc_b FROM sm UNION SELECT project_id, doc_a, doc_b FROM kd UNION SELECT project_id, doc_a, doc_b FROM sg),
fi AS (SELECT project_id, doc_a, doc_b, coalesce(similarity, 0) AS similarity, coalesce(kinds, 0) AS kinds, coalesce(chars, 0) AS chars, coalesce(points, 0) AS points,
  NOT EXISTS (SELECT 1 FROM documents x JOIN documents y ON x.bidder_id = y.bidder_id WHERE x.doc_id = al.doc_a AND y.doc_id = al.doc_b)
  AND (coalesce(strong, false) OR coalesce(kinds, 0) >= 2 OR coalesce(similarity, 0) >= 0.75) AS finding
  FROM al LEFT JOIN sm USING (project_id, doc_a, doc_b) LEFT JOIN kd USING (project_id, doc_a, doc_b) LEFT JOIN sg USING (project_id, doc_a, doc_b))
SELECT project_id, doc_a, doc_b, round(similarity, 4) AS similarity, kinds, chars, finding,
  round(CASE WHEN finding THEN least(70 * similarity + points + least(4.0::DOUBLE, chars / 1200.0::DOUBLE * 4), 100.0::DOUBLE) ELSE 70 * similarity + points END, 4) AS score FROM fi""",
    "docs_status": r"""
SELECT doc_id, coalesce(pages, 0) AS pages, coalesce(short_pages, 0) AS short_pages, coalesce(short_pages >= 0.8 * pages, false) AS scanned,
  CASE WHEN NOT coalesce(regexp_matches(text, '[^\s　]'), false) THEN 'empty' WHEN coalesce(short_pages >= 0.8 * pages, false) THEN 'needs_ocr' ELSE 'ok' END AS status
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS pages, count(*) FILTER (coalesce(length(trim(text, ' ')), 0) < 40) AS short_pages FROM pages GROUP BY ALL) USING (doc_id)""",
    "docs_evidence_pages": BASE + _END + r"""SELECT doc_id, page_number FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS nth FROM (
  SELECT DISTINCT p.doc_id, page_number FROM pages p JOIN (SELECT DISTINCT doc_id, value FROM en) e ON e.doc_id = p.doc_id AND contains(regexp_replace(p.text, '\s+', '', 'g'), value))) WHERE nth <= 5""",
    "pages_lines": _PAGES + "SELECT * FROM pl",
    "pages_cleaned": _PAGES + "SELECT * FROM cl",
    "pages_totals": _PAGES + "SELECT count(*) AS pages, sum(removed_lines)::BIGINT AS removed_lines, count(*) FILTER (duplicate) AS duplicate_pages, sum(length(cleaned_text))::BIGINT AS chars FROM cl",
}
