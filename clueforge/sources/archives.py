"""Files as rows: ZIP members, text and properties of DOCX files, PDF where a reader is installed, content hashes."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import present

MOST_ENTRIES, MOST_MEMBER, MOST_TOTAL, MOST_DEPTH = 5000, 256 << 20, 2 << 30, 2
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_MEMBERS = "path string, member string, depth int, bytes bigint, sha256 string, problem string"
_TEXTS = "path string, page_number int, text string, problem string"
_FACTS = "path string, sha256 string, author string, last_author string, created_at string, modified_at string, producer string"


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def _safe(name: str) -> bool:
    return not name.startswith(("/", "\\")) and ".." not in name.replace("\\", "/").split("/") and ":" not in name[:3]


def _members(path: str, content: bytes, depth: int = 1, total: int = 0) -> Iterator[tuple]:
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, OSError):
        yield path, None, depth, len(content), None, "not_an_archive"
        return
    for n, info in enumerate(archive.infolist()):
        if n >= MOST_ENTRIES:
            yield path, None, depth, None, None, "too_many_entries"
            return
        if info.is_dir():
            continue
        total += info.file_size
        problem = "unsafe_path" if not _safe(info.filename) else "too_large" if info.file_size > MOST_MEMBER or total > MOST_TOTAL else None
        data = None
        if problem is None:
            try:
                data = archive.read(info)
            except (RuntimeError, zipfile.BadZipFile, OSError, NotImplementedError):
                problem = "unreadable"
        yield path, info.filename, depth, info.file_size, hashlib.sha256(data).hexdigest() if data is not None else None, problem
        if data is not None and info.filename.lower().endswith(".zip") and depth < MOST_DEPTH:
            for row in _members(path, data, depth + 1, total):
                yield (row[0], f"{info.filename}!{row[1] or ''}", *row[2:])


def zip_members(archives: DataFrame) -> DataFrame:
    """(path, member, depth, bytes, sha256, problem) of the files in ZIP archives, nested ones one level deep.

    archives: path and content as the binaryFile source gives them. Members with paths out of the archive, larger than the
    bounds, encrypted or damaged are listed with a problem and not read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, c in zip(batch["path"], batch["content"]) for r in _members(p, bytes(c))]
            out = pd.DataFrame(rows, columns=["path", "member", "depth", "bytes", "sha256", "problem"])
            yield out.astype({"bytes": "Int64"})

    return archives.select("path", "content").mapInPandas(run, _MEMBERS)


def docx_text(content: bytes) -> str:
    """Paragraphs a line each, table rows with cells joined by " | ", in document order."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    body = root.find(f"{_W}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    lines = []
    for block in body if body is not None else []:
        if block.tag == f"{_W}p":
            lines.append(said(block))
        elif block.tag == f"{_W}tbl":
            lines += [" | ".join(said(cell).strip() for cell in row.iter(f"{_W}tc")) for row in block.iter(f"{_W}tr")]
    return "\n".join(x for x in lines if x.strip())


def _pdf_pages(content: bytes) -> list[str]:
    from pypdf import PdfReader  # optional

    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]


def document_texts(found: DataFrame) -> DataFrame:
    """(path, page_number, text, problem) of DOCX (one page) and, where pypdf is installed, PDF files; others and damaged ones have a problem."""

    def pages(path: str, content: bytes) -> list[tuple]:
        try:
            if path.lower().endswith(".docx"):
                return [(path, 1, docx_text(content), None)]
            if path.lower().endswith(".pdf"):
                return [(path, n, t, None) for n, t in enumerate(_pdf_pages(content), 1)]
            return [(path, None, None, "unknown_format")]
        except ImportError:
            return [(path, None, None, "no_reader")]
        except Exception:  # a damaged file is one bad row, not a failed job
            return [(path, None, None, "unreadable")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, c in zip(batch["path"], batch["content"]) for r in pages(p, bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "page_number", "text", "problem"]).astype({"page_number": "Int32"})

    return found.select("path", "content").mapInPandas(run, _TEXTS)


def _core(content: bytes) -> dict[str, str]:
    try:
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("docProps/core.xml"))
        return {node.tag.rsplit("}", 1)[-1]: (node.text or "").strip() for node in root}
    except (KeyError, zipfile.BadZipFile, ElementTree.ParseError):
        return {}


def pdf_date(text: str | None) -> str | None:
    """D:YYYYMMDDHHmmSS with or without an offset, as ISO 8601."""
    m = re.match(r"D:(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:([+-])(\d{2})'?(\d{2})?'?|Z)?", text or "")
    if not m:
        return None
    y, mo, d, h, mi, s, sign, oh, om = m.groups()
    zone = f"{sign}{oh}:{om or '00'}" if sign else "Z" if (text or "").rstrip("'").endswith("Z") else ""
    return f"{y}-{mo or '01'}-{d or '01'}T{h or '00'}:{mi or '00'}:{s or '00'}{zone}"


def _pdf_info(content: bytes) -> dict[str, str]:
    found = {}
    for key in ("Author", "Producer", "CreationDate", "ModDate"):
        m = re.search(rb"/" + key.encode() + rb"\s*\(((?:\\.|[^\\()])*)\)", content)
        if m:
            found[key] = m[1].decode("utf-8", "replace")
    return found


def file_facts(found: DataFrame) -> DataFrame:
    """(path, sha256, author, last_author, created_at, modified_at, producer) of DOCX and PDF files; others have their hash only."""

    def facts(path: str, content: bytes) -> tuple:
        digest = hashlib.sha256(content).hexdigest()
        if path.lower().endswith(".docx"):
            core = _core(content)
            return path, digest, core.get("creator"), core.get("lastModifiedBy"), core.get("created"), core.get("modified"), None
        if path.lower().endswith(".pdf"):
            info = _pdf_info(content)
            return path, digest, info.get("Author"), None, pdf_date(info.get("CreationDate")), pdf_date(info.get("ModDate")), info.get("Producer")
        return path, digest, None, None, None, None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([facts(p, bytes(c)) for p, c in zip(batch["path"], batch["content"])], columns=["path", "sha256", "author", "last_author", "created_at", "modified_at", "producer"])

    return found.select("path", "content").mapInPandas(run, _FACTS)


def enrich(records: DataFrame, facts: DataFrame) -> DataFrame:
    """records with blank author, created_at, modified_at, pdf_producer and file_sha256 filled from the file of the same name."""
    by = facts.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("__file"), *[F.col(c).alias(f"__{c}") for c in ("sha256", "author", "created_at", "modified_at", "producer")])
    one = by.groupBy("__file").agg(*[F.min(c).alias(c) for c in by.columns if c != "__file"])
    joined = records.join(one, records["file_name"] == one["__file"], "left")
    filled = {"author": "__author", "created_at": "__created_at", "modified_at": "__modified_at", "pdf_producer": "__producer", "file_sha256": "__sha256"}
    out = joined.withColumns({c: F.when(present(F.col(c)), F.col(c)).otherwise(F.col(new)) for c, new in filled.items()})
    return out.select(*records.columns)
