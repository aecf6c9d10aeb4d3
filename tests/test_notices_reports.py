import itertools
import random

from clueforge.__main__ import main
from clueforge.operators import notices as n
from clueforge.sources import report


def test_short_names_find_the_longer_one(spark):
    rows = [("p", "力限工物业"), ("p", "平蓼市力限工物业服务有限公司"), ("p", "平蓼市其他科技有限公司"), ("q", "力限工物业"), ("q", "甲力限工物业"), ("q", "乙力限工物业"), (None, "力限工物业"), ("r", None), ("r", " ")]
    out = n.short_names(spark.createDataFrame(rows, "project_id string, name string")).collect()
    assert [tuple(r) for r in out] == [("p", "力限工物业", "平蓼市力限工物业服务有限公司")]
    rnd = random.Random(1)
    for _ in range(50):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(9))) for _ in "ab")
        want = max((j - i for i, j in itertools.combinations(range(len(a) + 1), 2) if a[i:j] in b), default=0)
        assert n.common_length(a, b) == want


def test_links_roles_and_doubtful_pages(spark):
    html = '<p><a href="/f/a.pdf?x=1" class=b>文件 <b>一</b></a><a href="x.html">no</a><a href="/download/7">清单.xlsx</a></p>'
    df = spark.createDataFrame([(html,)], "h string")
    assert [tuple(x) for x in df.select(n.page_links(df["h"])).first()[0]] == [("/f/a.pdf?x=1", "文件 一"), ("/download/7", "清单.xlsx")]
    pages = spark.createDataFrame([(1, 1, "正常文字 ABC"), (1, 2, "坏□字"), (1, 3, "甲a乙b 丙1丁2 戊x己y"), (1, 4, None), (1, 5, "")], "doc_id bigint, page_number int, text string")
    assert sorted(r["page_number"] for r in n.doubtful_pages(pages).collect()) == [2, 3]
    paths = spark.createDataFrame([("投标/报价文件.xlsx",), ("招标文件.pdf",), ("x.bin",), (None,)], "p string")
    assert [r[0] for r in paths.select(n.file_role(paths["p"])).collect()] == ["price_list", "tender_file", "other", "other"]


def test_report_manifest_and_command_line(spark, tmp_path, capsys):
    df = spark.createDataFrame([("<a>", None)], "x string, y string")
    report.html_report("T & t", {"one": df}, str(tmp_path / "r.html"))
    assert "&lt;a&gt;" in (tmp_path / "r.html").read_text() and "T &amp; t" in (tmp_path / "r.html").read_text()
    made = report.manifest(str(tmp_path), {"rows": 1})
    assert made["files"]["r.html"]["bytes"] == (tmp_path / "r.html").stat().st_size and len(made["files"]) == 1
    assert report.safe_name('a/b:c*?"') == "a_b_c" and report.safe_name("...") == "unnamed"
    assert main(["list"]) == 0 and "p7_found" in capsys.readouterr().out
    assert main(["run", "nothing", "x", "y"]) == 2
