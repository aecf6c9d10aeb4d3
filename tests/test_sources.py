import json

import pytest

from clueforge.sources import files, sinks


def test_discovery_and_csv_lineage(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "quotes.csv").write_text('﻿a,b\n1,"x, y"\n,\n3,z\n', encoding="utf-8")
    (tmp_path / "sub/events.jsonl").write_text("{}\n")
    (tmp_path / "readme.txt").write_text("hello")
    (tmp_path / "big.csv").write_text("a\n" + "1\n" * 200)
    found = {r["path"].rsplit("/", 1)[1]: (r["format"], r["state"]) for r in files.discover(spark, f"file://{tmp_path}", most_bytes=100).collect()}
    assert found == {"quotes.csv": ("csv", "recognised"), "events.jsonl": ("jsonl", "recognised"), "readme.txt": ("other", "ignored"), "big.csv": ("csv", "oversized")}
    rows = files.read_csv(spark, f"file://{tmp_path}/quotes.csv").orderBy("row_number").collect()
    assert [(r["a"], r["b"], r["row_number"]) for r in rows] == [("1", "x, y", 2), ("3", "z", 4)]
    assert all(len(r["source_sha256"]) == 64 and r["source_path"].endswith("quotes.csv") for r in rows)


def test_json_lines_lenient_and_strict(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a": 1, "b": "x"}\n{"a": \n[1]\n\n{"a": 2}\n')
    good, issues = files.read_jsonl(spark, f"file://{tmp_path}/r.jsonl", "a int, b string")
    assert sorted((r["a"], r["b"], r["row_number"]) for r in good.collect()) == [(1, "x", 1), (2, None, 5)]
    assert sorted((r["code"], r["row_number"]) for r in issues.collect()) == [("invalid_jsonl", 2), ("invalid_jsonl_row", 3)]
    strict, _ = files.read_jsonl(spark, f"file://{tmp_path}/r.jsonl", "a int, b string", mode="strict")
    with pytest.raises(Exception):
        strict.collect()


def test_missing_table_and_sinks(spark, tmp_path):
    assert files.read_or_empty(spark, f"file://{tmp_path}/none", "a int").count() == 0
    df = spark.createDataFrame([(1, ["x"]), (2, [])], "b int, a array<string>")
    sinks.write_jsonl(df, f"file://{tmp_path}/j")
    assert spark.read.json(f"file://{tmp_path}/j").count() == 2
    sinks.write_csv(df, f"file://{tmp_path}/c")
    assert next((tmp_path / "c").glob("*.csv")).read_text(encoding="utf-8").startswith("﻿b")
    sinks.write_document({"b": 1, "a": "é"}, str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text()) == {"a": "é", "b": 1}
    sinks.append_new(df, "b", f"file://{tmp_path}/p", spark.createDataFrame([(1,)], "b int"))
    assert [r["b"] for r in files.read_or_empty(spark, f"file://{tmp_path}/p", "b int").collect()] == [2]
