"""Long exact spans shared between records: hashes of all windows, counted, merged to maximal intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if, durable
from .codepoints import inside, points, sliding, window_hashes

ROW = ["doc_id", "part", "v"]
_TOP = np.uint64(2**64 - 1)
BATCH_CHARS = 2_000_000
#: Longs (16 MB) up to which the repeated marks and their places are sent to all tasks; beyond, both joins shuffle.
MOST_SENT = 2_000_000


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about BATCH_CHARS characters (a longer single text is a piece of its own)."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).tolist()
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > BATCH_CHARS:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)


def _take(part: pa.RecordBatch, owner: np.ndarray) -> list[pa.Array]:
    rows = pa.array(owner)
    return [part.column(i).take(rows) for i in range(3)]


def marks_of(chars: np.ndarray, starts: np.ndarray, least: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the windows of `width` that are the smallest among least - width + 1 neighbours.

    Any span of `least` characters holds at least one marked window, at the same place in every copy of the span.
    """
    reach = least - width + 1
    h = window_hashes(chars, width)
    ok = inside(starts, len(chars), width)
    h = np.where(ok, h, _TOP)
    if len(h) < reach:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    low = sliding(h, reach)
    pad = np.zeros(reach - 1, np.uint64)
    at = np.flatnonzero((sliding(np.concatenate([pad, low, pad]), reach, np.maximum) == h) & ok)
    return at, h[at]


def _marks(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 3):
                chars, starts = points(part.column(3).to_pylist())
                at, h = marks_of(chars, starts, least, least // 2)
                owner = np.searchsorted(starts, at, "right") - 1
                local = (at - starts[owner]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*_take(part, owner), pa.array(local), pa.array(h.view(np.int64))], [*ROW, "at", "mark"])

    return run


def _windows(least: int):
    back = least - least // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 3):
                chars, starts = points(part.column(3).to_pylist())
                h, check = window_hashes(chars, least), window_hashes(chars, least, seed=1)
                wanted = np.zeros(len(chars) + 1, np.int32)
                marks = part.column(4)
                rows = np.repeat(np.arange(len(marks)), np.diff(marks.offsets.to_numpy()))
                p = marks.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                lengths = np.diff(starts)
                first, last = np.maximum(p - back, 0), np.minimum(p, lengths[rows] - least)
                keep = last >= first
                np.add.at(wanted, (first + starts[rows])[keep], 1)
                np.add.at(wanted, (last + starts[rows])[keep] + 1, -1)
                at = np.flatnonzero(np.cumsum(wanted[:-1])[: len(h)] > 0)
                owner = np.searchsorted(starts, at, "right") - 1
                local = (at - starts[owner]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*_take(part, owner), pa.array(local), pa.array(h[at].view(np.int64)), pa.array((check[at] >> np.uint64(32)).astype(np.uint32).view(np.int32))], [*ROW, "at", "w", "check"])

    return run


def _runs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, begins, ends = [], [], []
            for i, at in enumerate(batch.column(2)):
                p = np.unique(np.asarray(at.as_py(), dtype=np.int64))
                cut = np.flatnonzero(np.diff(p) > least) + 1
                begins.append(p[np.concatenate([[0], cut])])
                ends.append(p[np.concatenate([cut - 1, [len(p) - 1]])] + least)
                rows.append(np.full(len(cut) + 1, i))
            rows, begins, ends = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, begins, ends))
            take = pa.array(rows.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(begins.astype(np.int64)), pa.array(ends.astype(np.int64))],
                ["doc_id", "part", "start_pos", "end_pos"],
            )

    return run


def _elsewhere(rows: DataFrame, *code: str) -> DataFrame:
    """Codes found under more than one doc_id; partial minimum and maximum keep hot codes small before the shuffle."""
    return rows.groupBy(*code).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select(*code)


def shared_spans(texts: DataFrame, least: int = 120) -> DataFrame:
    """(doc_id, part, start_pos, end_pos): maximal runs of characters inside spans of `least` that another doc_id has too.

    texts: doc_id BIGINT, part BIGINT, text. Positions are 0-based code points, the end exclusive; texts are compared
    unchanged. Rows with a null doc_id or text, or a text shorter than `least`, have no shared span; rows repeated under
    the same doc_id don't share with each other; a text repeated under another doc_id is one run from end to end;
    an empty table gives an empty result and other columns don't matter.

    The hash of every window of `least` / 2 is computed, and the smallest of each neighbourhood are marks: each span of
    `least` holds one, so windows of `least` need a count only where a mark is repeated under another doc_id.
    There all of them are hashed and counted, and those found elsewhere merge to runs. No pairs of records are formed.
    A window counts as found elsewhere by 96 bits, a hash and part of a second one of other constants: among 10**14 windows
    less than one pair in ten runs over the corpus is expected to agree by chance. Marks and windows are hashed once
    and written, because both the count and the join back read them.
    """
    rows = texts.where(F.col("doc_id").isNotNull() & (F.char_length("text") >= least)).select("doc_id", "part", F.xxhash64("text").alias("v"), "text")
    marks = durable(rows.mapInArrow(_marks(least), "doc_id bigint, part bigint, v bigint, at int, mark bigint"), "marks")
    repeated = durable(_elsewhere(marks, "mark"), "repeated")
    found = marks.join(broadcast_if(repeated, repeated.count(), MOST_SENT), "mark", "left_semi")
    places = durable(found.groupBy(*ROW).agg(F.collect_set("at").alias("ats")), "places")
    held = places.agg(F.sum(F.size("ats") + 4)).first()[0] or 0
    windows = rows.join(broadcast_if(places, held, MOST_SENT), ROW).select(*ROW, "text", "ats")
    windows = durable(windows.mapInArrow(_windows(least), "doc_id bigint, part bigint, v bigint, at int, w bigint, check int"), "windows")
    hits = windows.join(_elsewhere(windows, "w", "check"), ["w", "check"], "left_semi")
    return (
        hits.groupBy(*ROW)
        .agg(F.collect_list("at").alias("ats"))
        .select("doc_id", "part", "ats")
        .mapInArrow(_runs(least), "doc_id bigint, part bigint, start_pos bigint, end_pos bigint")
        .distinct()
    )


def shared_share(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, part, n_chars, shared_chars) of every text: how much of it stands elsewhere too.

    Several different texts under one (doc_id, part) count together; null texts count as empty."""
    size = texts.select("doc_id", "part", "text").distinct().groupBy("doc_id", "part").agg(F.sum(F.coalesce(F.char_length("text"), F.lit(0))).alias("n_chars"))
    covered = spans.groupBy("doc_id", "part").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars"))
    return size.join(covered, ["doc_id", "part"], "left").select(
        "doc_id", "part", F.col("n_chars").cast("bigint"), F.coalesce("shared_chars", F.lit(0)).alias("shared_chars")
    )
