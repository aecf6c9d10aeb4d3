"""Evaluation texts inside training texts: seeds joined in Spark, then greedy string tiling by running Karp-Rabin."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if, durable
from .codepoints import BASE, mix, plain, points
from .spans import MOST_SENT, marks_of

#: Characters of a seed and of the shortest tile; any common run of SURE characters holds a seed that both sides emit.
SEED, SURE = 15, 20
#: The filter of seeds has at most 2**MOST_BITS bits (8 MB), however many items there are; a full one only filters less.
MOST_BITS = 26
#: Items tiled beside one copy of a text.
CHUNK = 64
_SEEDS = "id bigint, v bigint, seed bigint"
_TILES = "doc_id bigint, item_id bigint, item_chars int, longest int, covered int, tiles int"


class SeedFilter:
    """A bit for the leading digits of each seed of the items: what it lacks, no item has."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @staticmethod
    def of(seeds: DataFrame, n: int) -> SeedFilter:
        bits = min(max(16, math.ceil(math.log2(n + 1)) + 4), MOST_BITS)
        word = F.shiftrightunsigned("seed", 70 - bits).cast("int").alias("word")
        bit = F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(seed, {64 - bits}) & 63L as int)))").alias("bit")
        found = seeds.groupBy(word).agg(bit).toArrow()  # at most 2**(bits - 6) rows
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[found["word"].to_numpy()] = found["bit"].to_numpy().view(np.uint64)
        return SeedFilter(words, bits)

    def passes(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.bits)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _seeds(keep: SeedFilter | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                raw, starts = points(part.column(2).to_pylist())
                chars, kept = plain(raw)
                starts = np.searchsorted(kept, starts)
                at, h = marks_of(chars, starts, SURE, SEED)
                if keep is not None:
                    ok = keep.passes(h)
                    at, h = at[ok], h[ok]
                owner = np.searchsorted(starts, at, "right") - 1
                once = np.unique(np.stack([owner.astype(np.int64), h.view(np.int64)]), axis=1)
                rows = pa.array(once[0])
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), pa.array(once[1])], ["id", "v", "seed"])

    return run


@functools.lru_cache(maxsize=8)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """(BASE ** k, BASE ** -k) modulo 2**64 for k up to size."""
    inverse = pow(BASE, -1, 1 << 64)
    return tuple(np.array([1] + [b] * size, np.uint64).cumprod(dtype=np.uint64) for b in (BASE, inverse))


class _Side:
    """One text of a pair: hashes of its windows of any length in two operations, and which characters are marked."""

    def __init__(self, chars: np.ndarray, jumps: np.ndarray | None = None):
        up, self.down = _powers(1 << max(10, len(chars).bit_length()))
        mixed = mix(chars.astype(np.uint64) + np.uint64(0x1234567)) * up[: len(chars)]
        self.sums = np.concatenate([np.zeros(1, np.uint64), mixed.cumsum(dtype=np.uint64)])
        self.used = np.zeros(len(chars), bool)
        self.jumps = np.concatenate([[0], np.cumsum(jumps if jumps is not None else self.used)])

    def longest(self) -> int:
        """Length of the longest stretch without a marked character or a jump inside."""
        free = ~self.used
        begins = free & np.concatenate([[True], ~free[:-1] | (np.diff(self.jumps)[1:] > 0)])[: len(free)]
        return int(np.bincount(np.cumsum(begins)[free]).max()) if free.any() else 0

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of the windows of n characters without a marked character or a jump inside."""
        marked = np.concatenate([[0], np.cumsum(self.used)])
        last = len(self.used) - n
        if last < 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero((marked[n:] == marked[: last + 1]) & (self.jumps[n:] == self.jumps[1 : last + 2]))
        return at, (self.sums[at + n] - self.sums[at]) * self.down[at]


class SortedWindows:
    """The windows of `least` characters of one document by hash, made once for all items it is tiled with."""

    def __init__(self, doc: np.ndarray, least: int):
        with np.errstate(over="ignore"):
            at, h = _Side(doc).windows(least)
        order = np.argsort(h, kind="stable")
        self.at, self.h = at[order], h[order]

    def of(self, wanted: np.ndarray) -> np.ndarray:
        """Starts of the windows that have one of the wanted hashes."""
        once = np.unique(wanted)
        low, high = np.searchsorted(self.h, once, "left"), np.searchsorted(self.h, once, "right")
        return np.concatenate([np.empty(0, np.int64), *[self.at[a:b] for a, b in zip(low[high > low], high[high > low])]])


def greedy_tiles(doc: np.ndarray, item: np.ndarray, least: int = SEED, known: SortedWindows | None = None) -> list[tuple[int, int, int]]:
    """(doc start, item start, length) of the tiles, in the order in which they are marked.

    The longest common run of unmarked characters is marked on both sides, again and again until none of `least` is left;
    of equally long ones the first in the item, then in the document. Its length is searched with Karp-Rabin hashes of all
    unmarked windows of one length after another, so repetitive texts cost no more than others, and every tile is
    compared character by character. Only the document's stretches made of windows that the item has are looked at.
    """
    if min(len(doc), len(item)) < least:
        return []
    with np.errstate(over="ignore"):
        right = _Side(item)
        hit = np.sort((known or SortedWindows(doc, least)).of(right.windows(least)[1]))
        fresh = np.minimum(np.diff(hit, append=hit[-1:] + least), least)  # characters of each window before the next begins
        keep = np.repeat(hit - np.cumsum(fresh) + fresh, fresh) + np.arange(fresh.sum())
        left = _Side(doc[keep], np.concatenate([[0], np.diff(keep) > 1])[: len(keep)])
        tiles, most = [], len(item)
        while (most := min(most, left.longest(), right.longest())) >= least:
            met = lambda n: np.isin(right.windows(n)[1], left.windows(n)[1]).any()
            if met(most):
                low = most
            elif most == least or not met(least):
                break
            else:
                low, high, step = least, most, least  # a common run of low, none of high
                while low + step < high and met(low + step):
                    low, step = low + step, step * 2
                high = min(high, low + step)
                while high - low > 1:
                    middle = (low + high) // 2
                    low, high = (middle, high) if met(middle) else (low, middle)
            (d_at, d_h), (i_at, i_h) = left.windows(low), right.windows(low)
            i = int(i_at[np.isin(i_h, d_h)][0])
            d = int(d_at[d_h == i_h[i_at == i][0]][0])
            if np.array_equal(doc[keep[d : d + low]], item[i : i + low]):
                tiles.append((int(keep[d]), i, low))
                left.used[d : d + low] = right.used[i : i + low] = True
                most = low
            else:  # two windows of one hash
                most = low - 1
    return tiles


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
    names = ["doc_id", "item_id", "item_chars", "longest", "covered", "tiles"]
    for batch in batches:
        rows = []
        for doc_id, text, items in zip(batch.column(0), batch.column(1), batch.column(2)):
            doc = plain(points([text.as_py()])[0])[0]
            known = SortedWindows(doc, SEED)
            for item in items.as_py():
                chars = plain(points([item["item_text"]])[0])[0]
                if (tiles := greedy_tiles(doc, chars, known=known)) and tiles[0][2] >= SURE:
                    rows.append((doc_id.as_py(), item["item_id"], len(chars), tiles[0][2], sum(n for _, _, n in tiles), len(tiles)))
        columns = zip(*rows) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_chars, longest, covered, tiles) for each document and item with a common run of SURE characters.

    Letter case, full- and half-width forms and all characters but letters and digits don't matter; lengths count
    the remaining characters. The tiles (of SEED characters and more) are those of greedy string tiling: longest is the
    first, which is the longest unbroken common run, covered all of the item's characters under tiles, so passages in
    another order count too.

    Both sides give the seeds that are the smallest of their neighbourhood; a document gives only those that pass a filter
    of fixed size made from the items'. Seeds are joined for equality, the pairs found get their texts back, and each
    pair is tiled; a document with very many items is tiled in chunks of about CHUNK of them. Items and the pairs go to all
    tasks only within a counted size. Null or empty texts and null ids give no row, equal documents or items one
    each, items shorter than SURE none; an empty table gives an empty result; other columns don't matter.
    """
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("v"), "text")
    asked = items.where("item_id is not null and item_text is not null").select("item_id", F.xxhash64("item_text").alias("iv"), "item_text").distinct()
    asked = durable(asked, "items")
    wanted = durable(asked.mapInArrow(_seeds(None), _SEEDS), "item-seeds")
    n = wanted.count()
    seeds = docs.mapInArrow(_seeds(SeedFilter.of(wanted, n)), _SEEDS).select(F.col("id").alias("doc_id"), "v", "seed")
    by_seed = broadcast_if(wanted.select(F.col("id").alias("item_id"), F.col("v").alias("iv"), "seed"), 3 * n, MOST_SENT)
    pairs = durable(seeds.join(by_seed, "seed").select("doc_id", "v", "item_id", "iv").distinct(), "seed-pairs")
    chars = asked.agg(F.sum(F.char_length("item_text")).alias("n")).first()["n"] or 0
    texts = broadcast_if(asked, chars, MOST_SENT)
    many = pairs.groupBy("doc_id", "v").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    chunk = F.pmod(F.xxhash64("item_id", "iv"), F.col("chunks")).alias("chunk")
    chunked = pairs.join(many, ["doc_id", "v"]).select("doc_id", "v", "item_id", "iv", chunk).join(texts, ["item_id", "iv"])
    groups = durable(chunked.groupBy("doc_id", "v", "chunk").agg(F.collect_list(F.struct("item_id", "item_text")).alias("items")), "seed-groups")
    held = groups.agg(F.sum(F.expr("aggregate(items, 4L, (n, x) -> n + char_length(x.item_text))")).alias("n")).first()["n"] or 0
    return docs.join(broadcast_if(groups, held, MOST_SENT), ["doc_id", "v"]).select("doc_id", "text", "items").mapInArrow(_tile, _TILES)


def whole_runs(tiles: DataFrame) -> DataFrame:
    """Rows of find_leaks with one tile of at least 30 characters and half of the item."""
    return tiles.where("longest >= 30 and 2 * longest >= item_chars")


def reordered(tiles: DataFrame) -> DataFrame:
    """Rows of find_leaks with at least 30 characters and half of the item under tiles, though in no single one."""
    return tiles.where("covered >= 30 and 2 * covered >= item_chars and not (longest >= 30 and 2 * longest >= item_chars)")
