import io
import zipfile
from datetime import datetime

from clueforge.operators import replay
from clueforge.operators.reports import strip_html
from clueforge.sources import archives
from clueforge.streaming import links


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
BODY = f"<w:document {W}><w:body><w:p><w:r><w:t>第一段</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>甲</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>乙</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
CORE = '<c xmlns:dc="x" xmlns:t="y"><dc:creator>Li</dc:creator><t:created>2025-01-01T00:00:00Z</t:created></c>'


def test_archives_and_documents(spark, tmp_path):
    docx = zipped(**{"word__document.xml": BODY, "docProps__core.xml": CORE})
    (tmp_path / "a.zip").write_bytes(zipped(**{"x.txt": b"hello", "..__evil.txt": b"no", "in.zip": zipped(**{"y.txt": b"deep"})}))
    (tmp_path / "broken.zip").write_bytes(b"not a zip")
    (tmp_path / "b.docx").write_bytes(docx)
    (tmp_path / "c.docx").write_bytes(b"damaged")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4 /Producer (Print 1) /CreationDate (D:20250102030405+08'00')")
    found = {(r["path"].rsplit("/", 1)[1], r["member"], r["depth"], r["problem"]) for r in archives.zip_members(archives.files(spark, f"file://{tmp_path}", "*.zip")).collect()}
    assert found == {("a.zip", "x.txt", 1, None), ("a.zip", "../evil.txt", 1, "unsafe_path"), ("a.zip", "in.zip", 1, None), ("a.zip", "in.zip!y.txt", 2, None), ("broken.zip", None, 1, "not_an_archive")}
    texts = {r["path"].rsplit("/", 1)[1]: (r["text"], r["problem"]) for r in archives.document_texts(archives.files(spark, f"file://{tmp_path}", "*.docx")).collect()}
    assert texts == {"b.docx": ("第一段\n甲 | 乙", None), "c.docx": (None, "unreadable")}
    facts = archives.file_facts(archives.files(spark, f"file://{tmp_path}"))
    by = {r["path"].rsplit("/", 1)[1]: r for r in facts.collect()}
    assert by["b.docx"]["author"] == "Li" and by["d.pdf"]["created_at"] == "2025-01-02T03:04:05+08:00" and by["d.pdf"]["producer"] == "Print 1"
    schema = "file_name string, author string, created_at string, modified_at string, pdf_producer string, file_sha256 string"
    rows = spark.createDataFrame([("b.docx", " ", None, None, None, None), ("b.docx", "Wu", None, None, None, None), ("none", None, None, None, None, "h")], schema)
    assert sorted((r["author"] or "", r["file_sha256"][:1] != "") for r in archives.enrich(rows, facts).collect()) == [("", True), ("Li", True), ("Wu", True)]
    assert archives.pdf_date("D:2025") == "2025-01-01T00:00:00" and archives.pdf_date("x") is None


def test_findings_packet_and_citations(spark):
    rules = spark.createDataFrame([("p", 2, 1, 50.0), ("p", 3, 4, 80.0)], "project_id string, doc_a bigint, doc_b bigint, score double")
    scores = spark.createDataFrame([("p", 1, 2, 90.0), ("p", 5, 6, 60.0), ("p", 7, 8, 10.0)], "project_id string, doc_a bigint, doc_b bigint, score double")
    got = {(r["doc_a"], r["doc_b"]): (r["score"], r["basis"], r["level"]) for r in replay.merged_findings(rules, scores, 40.0).collect()}
    assert got == {(1, 2): (90.0, "both", "high"), (3, 4): (80.0, "rule", "high"), (5, 6): (60.0, "model", "medium")}
    pages = spark.createDataFrame([(d, n, f"{d}-{n} " + "文" * 3000) for d in (1, 2, 3, 4) for n in (1, 2)], "doc_id bigint, page_number int, text string")
    evidence = spark.createDataFrame([(1, 2), (3, 1), (3, 2)], "doc_id bigint, page_number int")
    packet = replay.evidence_packet(replay.merged_findings(rules, scores, 40.0), evidence, pages)
    rows = packet.collect()
    assert {(r["doc_id"], r["page_number"]) for r in rows} == {(1, 2), (2, 1), (3, 1), (3, 2), (4, 1)} and all(len(r["excerpt"]) == replay.PAGE_CHARS for r in rows)
    claims = spark.createDataFrame([("a", 1, 2, "1-2 文"), ("b", 1, 1, "1-1 文"), ("c", 1, 2, "不在其中"), ("d", 1, 2, " ")], "claim_id string, doc_id bigint, page_number int, quote string")
    assert [r["claim_id"] for r in replay.valid_citations(claims, packet).collect()] == ["a"]


def test_html_is_stripped(spark):
    df = spark.createDataFrame([("<p>a&amp;b<script>x()</script></p>\n<b>c</b>",)], "h string")
    assert df.select(strip_html(df["h"])).first()[0] == "a&b c"


def test_links_and_activity_of_a_stream(spark, tmp_path):
    schema = "project_id string, bidder_id string, ip_address string, event_time timestamp"
    at = lambda h, m: datetime(2025, 1, 1, h, m)
    rows = [("p", "a", "10.0.0.1", at(10, 0)), ("p", "b", "10.0.0.2", at(10, 20)), ("p", "c", "10.0.0.3", at(12, 0)), ("q", "b", "10.0.0.9", at(10, 0)), ("p", "d", "bad", at(10, 0)), ("p", None, "10.0.0.4", at(10, 0))]
    spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
    for name, out, mode in (("links", links.subnet_links(stream), "append"), ("activity", links.activity(stream), "complete")):
        query = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert [tuple(r)[:4] for r in spark.table("links").collect()] == [("p", "a", "b", "10.0.0.0/24")]
    assert spark.table("activity").selectExpr("sum(events)").first()[0] == 6
