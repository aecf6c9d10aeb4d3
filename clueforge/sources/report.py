"""A small result as an HTML page, and a manifest of result files with their hashes."""

from __future__ import annotations

import hashlib
import html
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame


def html_report(title: str, sections: dict[str, DataFrame], path: str, most: int = 200) -> None:
    """One table a section, the first `most` rows of each as ordered by the caller (a report shows the top; the data stays in its table)."""
    parts = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in sections.items():
        rows = df.limit(most).collect()
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v)) if v is not None else ''}</td>" for v in r) + "</tr>" for r in rows)
        parts.append(f"<h2>{html.escape(name)}</h2><table border='1'><tr>{head}</tr>{body}</table>")
    Path(path).write_text("\n".join(parts), encoding="utf-8")


def manifest(folder: str, counts: dict[str, int]) -> dict:
    """Counts and, for each file under folder, bytes and SHA-256; written as manifest.json beside them."""
    files = {}
    for p in sorted(Path(folder).rglob("*")):
        if p.is_file() and p.name != "manifest.json":
            digest = hashlib.sha256()
            with p.open("rb") as f:
                for block in iter(lambda: f.read(1 << 20), b""):
                    digest.update(block)
            files[str(p.relative_to(folder))] = {"bytes": p.stat().st_size, "sha256": digest.hexdigest()}
    out = {"counts": counts, "files": files}
    Path(folder, "manifest.json").write_text(json.dumps(out, indent=2, sort_keys=True), encoding="utf-8")
    return out


def safe_name(name: str, most: int = 80) -> str:
    """A file name without signs that file systems refuse; never empty."""
    s = re.sub(r'[\\/:*?"<>|\x00-\x1f]+', "_", name).strip(" ._")
    return s[:most] or "unnamed"
