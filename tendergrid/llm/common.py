"""Helpers shared by the corpus operators: words, word hashes, Arrow chunks and durable tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tables import shared_dir, written as durable  # noqa: F401

#: A word is a run of characters outside ASCII white space; bytes.split() cuts UTF-8 text the same way.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Bytes of text that a worker holds as arrays at one time (a single longer text is taken alone).
CHUNK_BYTES = 2 << 20
#: Entries after which a per-worker word cache starts afresh.
CACHE_WORDS = 150_000


def field(name: str, of: str = "") -> Column:
    """The column (or the field of a struct column) of exactly this name, whatever characters it holds."""
    return F.col((f"{of}." if of else "") + "`" + name.replace("`", "``") + "`")


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; 0 for null."""
    tight = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{SPACE}|{SPACE}$", "")
    return F.when(tight == "", F.lit(0)).otherwise(F.size(F.split(tight, SPACE))).cast("long")


class WordHashes(dict):
    """64-bit hashes of words, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples of Python values, a slice of each batch at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(column.to_pylist() for column in part.columns))


def chunks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[list[tuple]]:
    """Lists of rows whose texts (binary, at column text_at) come to about CHUNK_BYTES."""
    held, size = [], 0
    for row in rows(batches):
        held.append(row)
        size += len(row[text_at] or b"")
        if size >= CHUNK_BYTES or len(held) >= 20_000:
            yield held
            held, size = [], 0
    if held:
        yield held


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def digest_pairs(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """16-byte digests as two columns of longs."""
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
