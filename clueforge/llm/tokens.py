"""Token counts and token boundaries of a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder and vocabulary (tiktoken ranks) used unless a caller names others; the files are read where the tasks run.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The vocabulary's own split pattern (fixed value, stated with the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> np.ndarray:
    """Number of bytes of each token id."""
    ranks = encoding(path)._mergeable_ranks
    out = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        out[i] = len(token)
    return out


def _clean(text: str | None) -> str:
    """Lone surrogates can't be encoded; they count as a replacement character each."""
    return (text or "").encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def encode(path: str, text: str | None) -> np.ndarray:
    try:
        return encoding(path).encode_to_numpy(text or "")
    except UnicodeEncodeError:
        return encoding(path).encode_to_numpy(_clean(text))


def with_token_counts(texts: DataFrame, keys: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The key columns and n_tokens of each row's text (0 for null and empty texts)."""
    chosen = texts.select(*keys, text)
    at = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(encode(path, t)) for t in (x.as_py() for x in batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(counts, pa.int64())], [*keys, "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:at]) + ", n_tokens bigint"
    return chosen.mapInArrow(run, schema)
