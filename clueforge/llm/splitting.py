"""Splitting oversized texts at natural boundaries by a bounded-quantifier regular expression over their tokens."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tokens import VOCABULARY, _clean, encode, token_bytes

#: Characters after which a sentence or a clause ends, and those that may close it.
SENTENCE = "。！？!?…；;"
CLAUSE = "，、,：:）)》】"
CLOSERS = "”’」』）)\"'》】"
#: A profile's new tokens a piece must leave room for the up to three tokens of a character cut in two.
SLACK, LEAST_BODY = 3, 8
_SHAPE = "doc_id bigint, n_tokens int, classes string, at array<int>"


_SENTENCE, _CLAUSE, _CLOSER, _SPACE, _NEWLINE, _BLANK = 1, 2, 4, 8, 16, 32


@functools.lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """What each code point can be at a boundary, as bits."""
    out = np.zeros(0x110000, np.uint8)
    for bit, chars in ((_SENTENCE, SENTENCE), (_CLAUSE, CLAUSE), (_CLOSER, CLOSERS), (_SPACE, " \t\n\r　"), (_NEWLINE, "\n\r"), (_BLANK, " \t　")):
        for ch in chars:
            out[ord(ch)] |= bit
    return out


def boundary_classes(text: str, path: str = VOCABULARY) -> tuple[bytes, np.ndarray]:
    """(one letter a token, character position before each token and at the end).

    The letter says what ends after the token: p a paragraph or line, s a sentence, c a clause, w a word, x only
    a character; n means that the token ends inside a character.
    """
    tokens = encode(path, text)
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(token_bytes(path)[tokens])
    lead = (raw & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(lead)])
    whole = np.append(lead, True)[ends]
    pos = before[ends]
    last = cp[np.maximum(pos - 1, 0)]
    following = np.append(cp, 10)[pos]
    kinds = _kinds()
    ended, second, ahead = kinds[last], kinds[cp[np.maximum(pos - 2, 0)]], kinds[following]
    space_after = (ahead & _SPACE) > 0
    sentence = (((ended & _SENTENCE) > 0) | ((last == 46) & space_after)) & ((ahead & _CLOSER) == 0)
    sentence |= ((ended & _CLOSER) > 0) & ((second & _SENTENCE) > 0)
    out = np.full(len(tokens), ord("x"), np.uint8)
    out[((ended & _BLANK) > 0) | space_after | ((last > 0x2E7F) != (following > 0x2E7F))] = ord("w")
    out[(ended & _CLAUSE) > 0] = ord("c")
    out[sentence] = ord("s")
    out[((ended & _NEWLINE) > 0) & ((ahead & _NEWLINE) == 0)] = ord("p")
    out[~whole] = ord("n")
    return out.tobytes(), np.concatenate([[0], pos]).astype(np.int32)


def _classify(least: int, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(text) * 4 <= least:  # a code point is at most four bytes, a token at least one
                    continue
                try:
                    classes, at = boundary_classes(text, path)
                except UnicodeEncodeError:
                    classes, at = boundary_classes(_clean(text), path)
                if len(classes) > least:
                    held.append((doc_id, len(classes), classes, at))
                    size += len(classes)
                if size > 1_000_000:
                    yield _pack(held)
                    held, size = [], 0
            if held:
                yield _pack(held)

    return run


def _pack(held: list[tuple]) -> pa.RecordBatch:
    ids, counts, classes, at = zip(*held)
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in at])]).astype(np.int32)
    positions = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(at)))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(counts, pa.int32()), pa.array([c.decode() for c in classes]), positions], ["doc_id", "n_tokens", "classes", "at"]
    )


def cut_pattern(limit: int, overlap: int) -> str:
    """Alternatives in order of boundary strength, each as long as the limit allows; a last short rest comes first."""

    def body(n: int) -> str:
        half = n // 2
        late = [rf".{{{half},{n - 1}}}{c}" for c in ("p", "[ps]", "[psc]", "[pscw]")]
        early = [rf".{{0,{half}}}{c}" for c in ("[ps]", "[pscw]")]
        return "|".join([rf".{{1,{n}}}$", *late, *early, rf".{{0,{n - 1}}}[^n]"])

    return rf"^(?:{body(limit)})|(?:{body(limit - overlap - SLACK)})"


#: Pieces added up at a time, so that adding up is not quadratic in the pieces of a text.
STEP = 256


def _once(c: Column, use) -> Column:
    """use(c) with c evaluated once a row, however often use names it."""
    return F.element_at(F.transform(F.array(c), use), 1)


def _sums(lengths: Column) -> Column:
    """array<int>: running sums, made from the sums of steps of STEP and those within each step."""
    empty = F.array().cast("array<int>")

    def running(steps: Column, first: Column) -> Column:
        return F.aggregate(steps, F.struct(first.alias("sum"), empty.alias("all")), lambda a, n: F.struct((a["sum"] + n).alias("sum"), F.array_append(a["all"], a["sum"] + n).alias("all")), lambda a: a["all"])

    def joined(parts: Column) -> Column:
        whole = running(F.transform(parts, lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n)), F.lit(0))
        return _once(whole, lambda w: F.flatten(F.transform(parts, lambda x, i: running(x, F.coalesce(F.get(w, i - 1), F.lit(0))))))

    starts = lambda n: F.transform(F.sequence(F.lit(0), n - 1, F.lit(STEP)), lambda i: F.slice(lengths, i + 1, STEP))
    return _once(starts(F.size(lengths)), joined)


def _pieces(limit: int, overlap: int) -> Column:
    """array<struct>: every piece of the row's text, from the lengths of the regular expression's matches."""
    lengths = F.transform(F.regexp_extract_all("classes", F.lit(cut_pattern(limit, overlap)), F.lit(0)), lambda x: F.length(x))

    def piece(ends: Column, b: Column, i: Column) -> Column:
        before = F.get(ends, i - 1)
        back = before - overlap
        tail = F.substr(F.col("classes"), F.greatest(back - 2, F.lit(1)), F.least(back, F.lit(3)))
        begin = F.when((i == 0) | (back <= 0), F.lit(0)).otherwise(back - F.length(F.regexp_extract(tail, "n*$", 0)))
        return _once(
            begin,
            lambda a: F.struct(
                i.alias("piece"),
                F.get("at", a).alias("start_pos"),
                F.get("at", b).alias("end_pos"),
                (b - a).alias("tokens"),
                F.when(i == 0, F.lit(0)).otherwise(before - a).alias("overlap"),
            ),
        )

    return _once(_once(lengths, _sums), lambda ends: F.transform(ends, lambda b, i: piece(ends, b, i)))


def split_texts(documents: DataFrame, limits: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(profile, doc_id, piece, start_pos, end_pos, tokens, overlap) of every text longer than a profile's max_tokens.

    Pieces have at most max_tokens tokens, cover the whole text in order, and each begins overlap_tokens before the end
    of the one before it (up to three more where that would cut a character). They end after a paragraph, else a
    sentence, clause or word in the second half of the room, else such a place in the first half, else any character.
    Positions are 0-based code points, the end exclusive; tokens counts the text's tokens in the piece, which is what
    its text has when encoded by itself, or more (white space at its end may then merge).

    Null or empty texts, null doc_ids and texts within the limit give no row; equal rows give equal rows; extra columns
    don't matter. Of several limits rows with one profile the smallest counts; limits is one row a profile, not data. A
    profile must leave at least LEAST_BODY + SLACK tokens beyond its overlap, or a ValueError says so.
    """
    rows = limits.where("profile is not null and max_tokens is not null").groupBy("profile").agg(F.min(F.struct("max_tokens", F.coalesce("overlap_tokens", F.lit(0)))).alias("l")).collect()
    profiles = sorted((r[0], r[1][0], r[1][1]) for r in rows)
    schema = "profile string, doc_id bigint, piece int, start_pos int, end_pos int, tokens int, overlap int"
    if not profiles:
        return documents.sparkSession.createDataFrame([], schema)
    for name, limit, overlap in profiles:
        if overlap < 0 or limit - overlap < LEAST_BODY + SLACK:
            raise ValueError(f"profile {name}: {limit} tokens leave too little room beyond an overlap of {overlap}")
    least = min(limit for _, limit, _ in profiles)
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    classed = texts.mapInArrow(_classify(least, path), _SHAPE)
    options = [F.when(F.col("n_tokens") > limit, F.struct(F.lit(name).alias("profile"), _pieces(limit, overlap).alias("pieces"))) for name, limit, overlap in profiles]
    cut = classed.select("doc_id", F.explode(F.array_compact(F.array(*options))).alias("o"))  # from here on no text and no token
    return cut.select("o.profile", "doc_id", F.explode("o.pieces").alias("p")).select("profile", "doc_id", *[F.col(f"p.{c}").cast("int").alias(c) for c in ("piece", "start_pos", "end_pos", "tokens", "overlap")])


def piece_bounds(pieces: DataFrame, documents: DataFrame, limits: DataFrame) -> DataFrame:
    """(profile, within_limit, in_order, whole, overlapping) of each profile: what every piece must hold, as all-quantified truths.

    within_limit: no piece has more than max_tokens. in_order: the next piece begins at or before the end of the one before
    it, and after its begin. whole: each split text is covered from 0 to its length, with pieces numbered from 0.
    overlapping: two pieces share overlap_tokens tokens, or up to SLACK more, or all tokens before them where there are fewer.
    """
    w = Window.partitionBy("profile", "doc_id").orderBy("piece")
    once = pieces.distinct()
    seen = once.withColumns({"last_end": F.lag("end_pos").over(w), "last_start": F.lag("start_pos").over(w), "last_tokens": F.lag("tokens").over(w)})
    ordered = F.col("last_end").isNull() | ((F.col("start_pos") <= F.col("last_end")) & (F.col("start_pos") >= F.col("last_start")) & (F.col("end_pos") > F.col("last_end")))
    rows = seen.join(F.broadcast(limits.groupBy("profile").agg(F.min(F.struct("max_tokens", "overlap_tokens")).alias("l"))), "profile")
    shared = (F.col("piece") == 0) | F.col("overlap").between(F.col("l.overlap_tokens"), F.col("l.overlap_tokens") + SLACK) | (F.col("start_pos") == 0)
    by = rows.groupBy("profile", "doc_id").agg(
        F.bool_and(F.col("tokens") <= F.col("l.max_tokens")).alias("within_limit"),
        F.bool_and(ordered).alias("in_order"),
        F.bool_and(shared).alias("overlapping"),
        F.min("start_pos").alias("first"),
        F.max("end_pos").alias("last"),
        (F.max("piece") + 1 == F.count("*")).alias("numbered"),
    )
    sizes = documents.groupBy("doc_id").agg(F.min(F.char_length("text")).alias("lo"), F.max(F.char_length("text")).alias("hi"))
    by = by.join(sizes, "doc_id").withColumn("whole", (F.col("first") == 0) & F.col("last").between(F.col("lo"), F.col("hi")) & F.col("numbered"))
    return by.groupBy("profile").agg(*[F.bool_and(c).alias(c) for c in ("within_limit", "in_order", "whole", "overlapping")])
