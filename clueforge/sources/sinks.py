"""Results to files: JSON lines, CSV with a byte order mark for spreadsheets, one small JSON document, incremental parquet."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a row, keys in order; the job's commit makes the folder appear as a whole."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header and, so that spreadsheets read it as Unicode, a byte order mark in the first header; nested columns as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    out = df.select(*flat)
    out.withColumnRenamed(out.columns[0], "﻿" + out.columns[0]).write.mode("overwrite").option("header", "true").csv(path)


def write_document(row: dict, path: str) -> None:
    """A small summary as one pretty JSON file, replaced in one step."""
    target = Path(path)
    part = target.with_suffix(target.suffix + ".part")
    part.write_text(json.dumps(row, ensure_ascii=False, indent=2, sort_keys=True, default=str), encoding="utf-8")
    part.replace(target)


def append_new(df: DataFrame, key: str, path: str, done: DataFrame) -> None:
    """Append the rows whose key isn't in done: reruns add only what is new."""
    df.join(done.select(key).distinct(), key, "left_anti").write.mode("append").parquet(path)
