"""Bid documents: entities, similarity inside a project, repeated passages, page cleaning, evidence pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import present, text_credit_code
from ..schemas import MOST_SEGMENTS, PREFIX, SEGMENT, STRIDE, TEMPLATE_DF
from ..session import broadcast_if, durable, spread
from .similar import BIDDER_DOCS, bidder_pairs, meeting, similar_pairs, sources, without_space

#: kind -> pattern with the value in group 1; boundaries are consumed, so that the pattern means the same in any engine.
ENTITY_PATTERNS = {
    "phone": r"(?:^|[^0-9])(1[3-9][0-9]{9})(?:[^0-9]|$)",
    "landline": r"(?:^|[^0-9-])(0[1-9][0-9]{1,2}-[0-9]{7,8})(?:[^0-9]|$)",
    "email": r"(?:^|[^A-Za-z0-9._-])([A-Za-z0-9][A-Za-z0-9._-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})(?:[^A-Za-z0-9._-]|\.[^A-Za-z]|\.?$)",
    "credit_code": r"(?:^|[^0-9A-Z])([0-9A-HJ-NPQRTUWXY]{18})(?:[^0-9A-Z]|$)",
    "contact": r"联系人[：: ]([一-龥]{2,3})(?:[，,；;（(　 ]|$)",
    "address": r"(?:联系地址|收件地址|住址|地址)[：: ]([一-龥]{4,30}[0-9]+号)",
    "tender_number": r"(?:招标编号|项目编号|采购编号)[：: ]([A-Za-z0-9_./-]{4,60})",
}
NOT_CONTACTS = ("电话", "手机", "方式", "姓名")
STRONG, KINDS = ("phone", "landline", "email", "credit_code"), ("phone", "landline", "email", "credit_code", "contact", "address")
ENTITY_POINTS = {"phone": 20, "landline": 20, "email": 20, "credit_code": 25, "contact": 10, "address": 8}


def _placed(df: DataFrame, *keys: str) -> DataFrame:
    """df spread by keys, unless it already has a partition for each core; then its texts stay where they lie."""
    return df if df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism else spread(df, *keys)


def entities(documents: DataFrame) -> DataFrame:
    """(project_id, doc_id, kind, value), each once, from whole texts."""

    def matches(kind: str, pattern: str) -> Column:
        shown = lambda v: F.lower(v) if kind == "email" else v
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), shown(v).alias("value")))

    found = F.concat(*[matches(kind, p) for kind, p in ENTITY_PATTERNS.items()])
    long = _placed(documents.select("project_id", "doc_id", "text").where("text is not null"), "doc_id").select("project_id", "doc_id", F.explode(found).alias("e")).select("project_id", "doc_id", "e.kind", "e.value")
    good = (F.col("kind") != "credit_code") | text_credit_code(F.col("value")).isNotNull()
    return long.where(good & ~((F.col("kind") == "contact") & F.col("value").isin(*NOT_CONTACTS))).distinct()


def common_entities(found: DataFrame, least: int = 3) -> DataFrame:
    """Values that at least `least` documents of one project hold: part of its template."""
    return found.groupBy("project_id", "kind", "value").agg(F.count_distinct("doc_id").alias("docs")).where(F.col("docs") >= least)


def shared_entities(found: DataFrame) -> DataFrame:
    """(project_id, doc_a, doc_b, kind, n): values two documents of a project share, those common in the project left out.

    A value left after that is in two documents at most, so its pair is its smallest and largest document."""
    on = ["project_id", "kind", "value"]
    two = found.where(F.col("kind").isin(*KINDS) & present(F.col("project_id"))).groupBy(*on).agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_a"), F.max("doc_id").alias("doc_b"))
    return two.where("n = 2").groupBy("project_id", "doc_a", "doc_b", "kind").agg(F.count("*").alias("n"))


def compact(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def _copies(documents: DataFrame) -> DataFrame:
    """copies, and whether the text is long enough for a gram."""
    t = compact(F.col("text"))
    keyed = documents.where(present(F.col("project_id")) & present(F.col("text"))).select("project_id", "doc_id", F.unhex(F.sha2(t.cast("binary"), 256)).alias("key"), (F.char_length(t) >= 3).alias("long"))
    keyed = durable(keyed, "keyed")
    first = keyed.groupBy("project_id", "key").agg(F.min("doc_id").alias("representative"))
    return keyed.join(first, ["project_id", "key"]).select("project_id", "doc_id", "representative", "long")


def copies(documents: DataFrame) -> DataFrame:
    """(project_id, doc_id, representative): equal texts inside a project, by the smallest doc_id."""
    return _copies(documents).drop("long")


def _count_grams(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, grams, counts = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                cp = np.frombuffer(text.as_py().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                packed = sum((cp[k : len(cp) - n + 1 + k] << (21 * (n - 1 - k)) for k in range(n)), np.int64(0))
                code, count = np.unique(packed, return_counts=True)
                ids.append(np.full(len(code), doc_id, np.int64))
                grams.append(code)
                counts.append(count)
            columns = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (ids, grams, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["doc_id", "gram", "tf"])

    return run


def gram_counts(documents: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, gram, tf): character n-grams (n up to 3) of the text without white space, packed exactly as 21 bits a character.

    A text is counted where it lies; arrays do in one pass what an exploded column would shuffle."""
    held = documents.where("text is not null").select("doc_id", compact(F.col("text")).alias("t")).where(F.char_length("t") >= n)
    return held.mapInArrow(_count_grams(n), "doc_id bigint, gram bigint, tf bigint")


def weighted(counts: DataFrame) -> DataFrame:
    """(doc_id, gram, df, w): unit-length vectors of (1 + ln tf) (ln((1 + N) / (1 + df)) + 1); df over the whole corpus."""
    df = counts.groupBy("gram").agg(F.count("*").alias("df"))
    total = counts.agg(F.count_distinct("doc_id").alias("total"))
    raw = counts.join(df, "gram").join(F.broadcast(total)).withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1))
    norm = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "doc_id").select("doc_id", "gram", "df", (F.col("w") / F.col("norm")).alias("w"))


def _texts(documents: DataFrame, copy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(project_id, doc_id, t) of the representatives, and (doc_id, t) with each of them once.

    Texts stay where they lie: what is left out is small and broadcast. Only those of repeated ids are shuffled."""
    held = documents.where(present(F.col("project_id")) & present(F.col("text"))).select("project_id", "doc_id", F.col("text").alias("t"))
    small = lambda df, label: broadcast_if(d := durable(df, label), d.count(), 200_000)
    later = small(copy.groupBy("project_id", "doc_id").agg(F.bool_or(F.col("doc_id") == F.col("representative")).alias("is")).where("not is").drop("is"), "later")
    twice = durable(copy.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "twice")
    first = held.join(later, ["project_id", "doc_id"], "left_anti")
    if not (n := twice.count()):
        return first, first.select("doc_id", "t")
    twice = broadcast_if(twice, n, 200_000)
    once = first.join(twice, "doc_id", "left_anti")
    one = durable(held.join(twice, "doc_id", "left_semi").join(later, ["project_id", "doc_id"], "left_anti").dropDuplicates(["doc_id"]).select("doc_id", "t"), "repeated")
    places = copy.join(twice, "doc_id", "left_semi").join(later, ["project_id", "doc_id"], "left_anti").select("project_id", "doc_id").distinct()
    return once.unionByName(places.join(one, "doc_id").select("project_id", "doc_id", "t")), once.select("doc_id", "t").unionByName(one)


def _similar(documents: DataFrame, copy: DataFrame, threshold: float) -> DataFrame:
    rows, texts = _texts(documents, copy)
    source, make = sources(texts)
    sizes = rows.groupBy("project_id").agg(F.count("*").alias("docs"), F.sum(F.char_length("t")).alias("chars"))
    if source is not texts:
        rows = rows.drop("t").join(source, "doc_id")
    return meeting(rows, sizes, "doc_id").mapInArrow(similar_pairs(make, threshold), "project_id string, doc_a bigint, doc_b bigint, similarity double")


def similar_documents(documents: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(project_id, doc_a, doc_b, similarity) of representatives of equal texts in one project, from the threshold on; exact."""
    return _similar(documents, durable(_copies(documents), "copies"), threshold)


def linked_documents(documents: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(project_id, doc_a, doc_b, similarity) of every two documents of a project from the threshold on: those of
    similar_documents, those of their copies, and equal texts with each other (1, where they have a gram)."""
    copy = durable(_copies(documents), "copies")
    met = _similar(documents, copy, threshold).withColumnsRenamed({"doc_a": "rep_a", "doc_b": "rep_b"})
    itself = copy.where("long and doc_id <> representative").select("project_id", F.col("representative").alias("rep_a"), F.col("representative").alias("rep_b"), F.lit(1.0).alias("similarity")).distinct()
    x, y = (copy.select("project_id", F.col("representative").alias(f"rep_{s}"), F.col("doc_id").alias(f"of_{s}")).distinct() for s in "ab")
    out = met.unionByName(itself).join(x, ["project_id", "rep_a"]).join(y, ["project_id", "rep_b"]).where("rep_a < rep_b or of_a < of_b")
    return out.select("project_id", F.least("of_a", "of_b").alias("doc_a"), F.greatest("of_a", "of_b").alias("doc_b"), "similarity")


def bidder_similarities(documents: DataFrame) -> DataFrame:
    """(project_id, bidder_a, bidder_b, similarity): every two bidders with documents in a project, and the largest
    similarity of a document of one and a document of the other (equal texts 1, no gram in common 0).

    No threshold: a project of n documents costs n(n-1)/2 sums. Bidders meet in blocks, so each pair is made whole in one task."""
    copy = durable(_copies(documents), "copies")
    source, make = sources(_texts(documents, copy)[1])
    of = copy.select("project_id", "doc_id", F.when(F.col("long"), F.col("representative")).alias("representative")).groupBy("project_id", "doc_id").agg(F.min("representative").alias("representative"))
    held = documents.where(present(F.col("project_id")) & present(F.col("bidder_id")))
    sizes = held.groupBy("project_id").agg(F.count("*").alias("docs"), F.sum(F.coalesce(F.char_length("text"), F.lit(0))).alias("chars"))
    rows = held.select("project_id", "bidder_id", "doc_id").distinct().join(of, ["project_id", "doc_id"], "left")
    rows = rows.join(source.withColumnRenamed("doc_id", "representative"), "representative", "left").select("project_id", "bidder_id", "representative", "t")
    return meeting(rows, sizes, "bidder_id", BIDDER_DOCS).mapInArrow(bidder_pairs(make), "project_id string, bidder_a string, bidder_b string, similarity double")


def windows(documents: DataFrame) -> DataFrame:
    """(doc_id, segment, start): windows of SEGMENT characters every STRIDE that hold 12 different characters and a letter."""
    held = spread(documents.select("doc_id", "text"), "doc_id").where("text is not null").select("doc_id", F.split(compact(F.col("text")), "").alias("c")).where(F.size("c") >= SEGMENT)
    starts = F.sequence(F.lit(0), F.size("c") - SEGMENT, F.lit(STRIDE))
    out = held.select("doc_id", "c", F.explode(starts).alias("start")).select("doc_id", "start", F.slice("c", F.col("start") + 1, SEGMENT).alias("s"))
    good = (F.size(F.array_distinct("s")) >= 12) & F.array_join("s", "").rlike(r"[A-Za-z一-鿿]")
    return out.where(good).groupBy("doc_id", F.array_join("s", "").alias("segment")).agg(F.min("start").alias("start"))


def _window_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of every window, and its hash."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.lib.stride_tricks.sliding_window_view(cp, SEGMENT)[::STRIDE] if len(cp) >= SEGMENT else np.empty((0, SEGMENT), np.uint32)
    h = at.astype(np.uint64) @ _FACTORS
    return at, (h ^ (h >> np.uint64(29))).view(np.int64)


_FACTORS = np.random.default_rng(1).integers(1 << 40, 1 << 63, SEGMENT, dtype=np.uint64) | np.uint64(1)


def _count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, n: documents of this task with a window of that hash."""
    held, kept = [], 0

    def counted() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    for batch in batches:
        for text in batch.column(1):
            held.append(np.unique(_window_hashes(without_space(text.as_py()))[1]))
            kept += len(held[-1])
            if kept > 2_000_000:
                yield counted()
                held, kept = [], 0
    if kept:
        yield counted()


def _list_windows(repeated):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if repeated is None else repeated.value
        for batch in batches:
            docs, segments, starts = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = without_space(text.as_py())
                at, h = _window_hashes(t)
                if known is not None:
                    k = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h) if len(known) else []
                else:
                    k = np.arange(len(h))
                if not len(k):
                    continue
                sorted_cp = np.sort(at[k], axis=1)
                letter = ((sorted_cp >= 0x4E00) & (sorted_cp <= 0x9FFF)) | ((sorted_cp >= 65) & (sorted_cp <= 90)) | ((sorted_cp >= 97) & (sorted_cp <= 122))
                good = ((sorted_cp[:, 1:] != sorted_cp[:, :-1]).sum(axis=1) >= 11) & letter.any(axis=1)
                first: dict[str, int] = {}
                for start in (k[good] * STRIDE).tolist():
                    first.setdefault(t[start : start + SEGMENT], start)
                docs += [doc_id] * len(first)
                segments += first
                starts += first.values()
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(segments, pa.string()), pa.array(starts, pa.int32())], ["doc_id", "segment", "start"])

    return run


def repeated_windows(documents: DataFrame, held_hashes: int = 4_000_000) -> DataFrame:
    """(doc_id, segment, start) of windows() without most that only one document has.

    A first pass counts hashes of windows, so only windows whose hash two documents have are written out and compared; where
    these are too many for each worker to hold, every window is."""
    ids = durable(documents.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "twice")
    held = documents.select("doc_id", "text")
    if n := ids.count():
        twice = broadcast_if(ids, n, 200_000)
        held = held.join(twice, "doc_id", "left_anti").unionByName(held.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    texts = _placed(held.where("text is not null"), "doc_id").select("doc_id", F.col("text").alias("t"))
    repeated = durable(texts.mapInArrow(_count_windows, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "hashes")
    known = None
    if repeated.count() <= held_hashes:
        known = texts.sparkSession.sparkContext.broadcast(np.sort(repeated.toArrow().column("h").to_numpy()))
    return texts.mapInArrow(_list_windows(known), "doc_id bigint, segment string, start int")


def template_windows(all_windows: DataFrame) -> DataFrame:
    return all_windows.groupBy("segment").agg(F.count("*").alias("docs")).where(F.col("docs") >= TEMPLATE_DF)


def shared_segments(documents: DataFrame, same_project: bool = True) -> DataFrame:
    """(project_id, doc_a, doc_b, segment, start_a, start_b): windows found in exactly two documents, both of one project
    (or of any, where same_project is False; project_id is then that of doc_a).

    Windows of more documents are templates. Windows that hold the first PREFIX characters of a template are left out
    by an equi-join on all their parts of that length.
    """
    found = durable(repeated_windows(documents), "windows")
    by = found.groupBy("segment").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("a"), F.max(F.struct("doc_id", "start")).alias("b")
    )
    two = by.where("n = 2").select("segment", F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b"), F.col("a.start").alias("start_a"), F.col("b.start").alias("start_b"))
    place = documents.where(present(F.col("project_id"))).select("doc_id", "project_id").distinct()
    two = two.join(place.withColumnRenamed("doc_id", "doc_a"), "doc_a").join(place.select(F.col("doc_id").alias("doc_b"), F.col("project_id").alias("other")), "doc_b")
    if same_project:
        two = two.where("project_id = other")
    heads = durable(by.where(F.col("n") >= TEMPLATE_DF).select(F.substring("segment", 1, PREFIX).alias("part")).distinct(), "heads")
    heads = broadcast_if(heads, heads.count(), 200_000)  # each window has 25 parts; while heads fit, they stay where they are made
    parts = two.select("segment", F.explode(F.transform(F.sequence(F.lit(1), F.lit(SEGMENT - PREFIX + 1)), lambda i: F.substr(F.col("segment"), i, F.lit(PREFIX)))).alias("part"))
    bad = parts.join(heads, "part", "left_semi").select("segment").distinct()
    return two.join(bad, "segment", "left_anti").select("project_id", "doc_a", "doc_b", "segment", "start_a", "start_b")


def segment_pairs(shared: DataFrame) -> DataFrame:
    """Pairs with shared windows: how many, the greedily chosen ones without overlap (MOST_SEGMENTS at most), covered characters."""
    by = shared.groupBy("project_id", "doc_a", "doc_b").agg(F.sort_array(F.collect_list("start_a")).alias("starts"))
    chosen = F.aggregate(
        "starts",
        F.struct(F.lit(-SEGMENT).alias("last"), F.lit(0).alias("n")),
        lambda acc, x: F.when(
            (x >= acc["last"] + SEGMENT) & (acc["n"] < MOST_SEGMENTS), F.struct(x.alias("last"), (acc["n"] + 1).alias("n"))
        ).otherwise(acc),
    )
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(-1).alias("end"), F.lit(0).alias("chars")),
        lambda acc, x: F.struct(
            (x + SEGMENT).alias("end"),
            (acc["chars"] + F.when((acc["end"] >= 0) & (x <= acc["end"] + STRIDE), x + SEGMENT - acc["end"]).otherwise(SEGMENT)).alias("chars"),
        ),
    )
    return by.select("project_id", "doc_a", "doc_b", F.size("starts").alias("windows"), chosen["n"].alias("segments"), covered["chars"].alias("chars"))


def pair_findings(similar: DataFrame, shared: DataFrame, segments: DataFrame, same_bidder: DataFrame) -> DataFrame:
    """Score of each document pair that shares something, and whether it is a finding.

    70 for full similarity, points for each shared kind of entity, up to 4 for repeated passages once triggered (a strong
    entity, two kinds of entities, or a similarity of 0.75); pairs of one bidder are kept but never findings.
    """
    on = ["project_id", "doc_a", "doc_b"]
    points = F.element_at(F.create_map(*[F.lit(x) for kv in ENTITY_POINTS.items() for x in kv]), F.col("kind"))
    kinds = shared.groupBy(*on).agg(F.sum(points).alias("points"), F.count("*").alias("kinds"), F.bool_or(F.col("kind").isin(*STRONG)).alias("strong"))
    out = similar.join(kinds, on, "full_outer").join(segments.select(*on, "chars"), on, "full_outer").join(same_bidder, on, "left")
    sim, pts, n, chars = (F.coalesce(c, F.lit(0)) for c in ("similarity", "points", "kinds", "chars"))
    hit = ~F.coalesce("same_bidder", F.lit(False)) & (F.coalesce("strong", F.lit(False)) | (n >= 2) | (sim >= 0.75))
    base = 70 * sim + pts
    score = F.when(hit, F.least(base + F.least(F.lit(4.0), chars / 1200.0 * 4), F.lit(100.0))).otherwise(base)
    return out.select(*on, sim.alias("similarity"), n.alias("kinds"), chars.alias("chars"), hit.alias("finding"), score.alias("score"))


#: A line that only holds a page number.
PAGE_MARK = r"^(?:第 ?[0-9]+ ?页(?: ?/? ?共 ?[0-9]+ ?页)?|- ?[0-9]+ ?-|[0-9]{1,4})$"
EDGE_LINES, SHELL_SHARE, SHELL_CHARS, LEAST_LINE, LEAST_PAGE = 4, 0.6, 120, 6, 80


def page_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, pos, line, lines): non-empty lines with blanks squeezed, pos from 1."""
    squeezed = F.transform(F.split(F.regexp_replace("text", "\x00", ""), "\r\n|\n|\r"), lambda x: F.trim(F.regexp_replace(x, "[ \t　]+", " ")))
    kept = F.filter(squeezed, lambda x: x != "")
    return pages.where("text is not null").select("doc_id", "page_number", kept.alias("ls")).select(
        "doc_id", "page_number", F.size("ls").alias("lines"), F.posexplode("ls").alias("p", "line")
    ).select("doc_id", "page_number", (F.col("p") + 1).alias("pos"), "line", "lines")


def shell_lines(lines: DataFrame) -> DataFrame:
    """Heads and feet: lines on at least 3 pages (2 % of a document's pages if more), mostly among the outer four lines."""
    size = lines.groupBy("doc_id").agg(F.count_distinct("page_number").alias("pages"))
    edge = (F.col("pos") <= EDGE_LINES) | (F.col("pos") > F.col("lines") - EDGE_LINES)
    by = lines.groupBy("doc_id", "line").agg(F.count_distinct("page_number").alias("on"), F.avg(edge.cast("double")).alias("share"))
    least = F.greatest(F.lit(3), F.round(F.col("pages") * 0.02).cast("int"))
    short = (F.length("line") <= SHELL_CHARS) | F.col("line").rlike(PAGE_MARK)
    return by.join(size, "doc_id").where((F.col("on") >= least) & (F.col("share") >= SHELL_SHARE) & short).select("doc_id", "line")


def clean_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, cleaned_text, removed_lines, duplicate): page numbers, repeated heads and feet, lines repeated
    on a page and repeated pages left out; the first of each stays."""
    lines = page_lines(pages)
    shell = shell_lines(lines).withColumn("shell", F.lit(True))
    page = lines.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("whole"))
    repeat = Window.partitionBy("doc_id", "sign").orderBy("page_number")
    marked = page.withColumn("sign", F.sha2(F.col("whole").cast("binary"), 256)).withColumn("nth", F.row_number().over(repeat))
    duplicate = marked.select("doc_id", "page_number", ((F.col("nth") > 1) & (F.length("whole") >= LEAST_PAGE)).alias("duplicate"))
    first_on_page = F.row_number().over(Window.partitionBy("doc_id", "page_number", "line").orderBy("pos"))
    first_in_doc = F.row_number().over(Window.partitionBy("doc_id", "line").orderBy("page_number", "pos"))
    judged = lines.join(duplicate, ["doc_id", "page_number"]).join(shell, ["doc_id", "line"], "left")
    judged = judged.withColumns({"nth_page": first_on_page, "nth_doc": first_in_doc, "mark": F.col("line").rlike(PAGE_MARK)})
    drop = F.col("duplicate") | F.col("mark") | (F.coalesce("shell", F.lit(False)) & (F.col("nth_doc") > 1)) | ((F.length("line") >= LEAST_LINE) & (F.col("nth_page") > 1))
    kept = F.array_compact(F.collect_list(F.when(~F.col("drop"), F.struct("pos", "line"))))
    by = judged.withColumn("drop", drop).groupBy("doc_id", "page_number", "duplicate")
    out = by.agg(F.sort_array(kept).alias("k"), F.count_if("drop").alias("removed_lines"))
    return out.select("doc_id", "page_number", F.array_join(F.transform("k", lambda x: x["line"]), "\n").alias("cleaned_text"), "removed_lines", "duplicate")


def document_status(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, pages, short_pages, scanned, status): scanned where 80 % of the pages hold under 40 characters."""
    by = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.coalesce(F.char_length(F.trim("text")), F.lit(0)) < 40).alias("short_pages"))
    out = documents.select("doc_id", "text").join(by, "doc_id", "left").fillna(0, ["pages", "short_pages"])
    scanned = (F.col("pages") > 0) & (F.col("short_pages") >= 0.8 * F.col("pages"))
    status = F.when(~present(F.col("text")), "empty").when(scanned, "needs_ocr").otherwise("ok")
    return out.select("doc_id", "pages", "short_pages", scanned.alias("scanned"), status.alias("status"))


def evidence_pages(found: DataFrame, pages: DataFrame, most: int = 5) -> DataFrame:
    """(doc_id, page_number): the first pages (a report's top five) whose text without white space holds an entity of the document."""
    values = found.groupBy("doc_id").agg(F.collect_set("value").alias("values"))
    held = pages.where("text is not null").select("doc_id", "page_number", compact(F.col("text")).alias("t")).join(values, "doc_id")
    hit = held.where(F.exists("values", lambda v: F.contains(F.col("t"), v))).select("doc_id", "page_number").distinct()
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number"))
    return hit.withColumn("nth", nth).where(F.col("nth") <= most).select("doc_id", "page_number")
