"""Packing token sequences by bounded-space online packing.

Each partition keeps a fixed number of open windows. A document's full windows leave at once; what remains is
placed best-fit. When nothing fits, the fullest window is emitted, topped up by a cut from the incoming piece if
more than max_pad tokens would be padded. At the end of a partition its open windows are merged into full ones,
so that one partial window is left; those few windows travel on with their ids and are merged across partitions.
"""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, chunks, durable, rows

WINDOW = 2048
OPEN_WINDOWS = 64
MAX_PAD = 16
END_ID = 1
#: Partial windows that one task merges.
FAN_IN = 512
#: Words after which a worker's token cache starts afresh, and the longest word it keeps.
CACHE_WORDS, CACHE_BYTES = 120_000, 48

_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("ids", pa.binary())])
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"


#: Words that the tokenizer splits into a run of letters, lower-cased, and a run of marks.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([.,;:!?|%&*#$]*)")


class Merges:
    """The tokenizer's merges applied to many runs of letters at once, one merge per run in each round.

    In each round a run merges its leftmost pair of the lowest rank, as the tokenizer does run by run.
    """

    NONE = np.int64(1 << 40)

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text())
        model, normalizer = spec["model"], spec.get("normalizer") or {}
        vocab, merges, end = model["vocab"], model["merges"], model["end_of_word_suffix"]
        if model["type"] != "BPE" or max(vocab.values()) >= 1 << 16 or "Lowercase" not in {n["type"] for n in normalizer.get("normalizers", [normalizer]) if n}:
            raise ValueError(f"{path}: merges in batches need a lower-casing BPE tokenizer of fewer than 65,536 ids")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        key = np.array([(vocab[x] << 16) | vocab[y] for x, y in pairs], np.int64)
        self.made = np.array([vocab[x + y] for x, y in pairs], np.int64)
        # Bytes stand in the vocabulary as printable characters, those that aren't moved up from 256 in order.
        printable = [b for r in ((33, 126), (161, 172), (174, 255)) for b in range(r[0], r[1] + 1)]
        others = [b for b in range(256) if b not in printable]
        char = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.inner = np.array([vocab[char[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[char[b] + end] for b in range(256)], np.int64)
        self.keys = np.full(1 << 18, -1, np.int64)
        self.ranks = np.zeros(1 << 18, np.int64)
        left = np.arange(len(key))
        at = self._slot(key)
        while len(left):  # each round places the keys that find their slot free, one per slot
            free = self.keys[at[left]] < 0
            self.keys[at[left[free]]] = key[left[free]]
            placed = self.keys[at[left]] == key[left]
            self.ranks[at[left[placed]]] = left[placed]
            left = left[~placed]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)

    def _rank(self, key: np.ndarray) -> np.ndarray:
        out = np.full(len(key), self.NONE)
        left, at = np.arange(len(key)), self._slot(key)
        while len(left):
            there = self.keys[at]
            hit = there == key[left]
            out[left[hit]] = self.ranks[at[hit]]
            on = ~hit & (there >= 0)
            left, at = left[on], (at[on] + 1) & (len(self.keys) - 1)
        return out

    def encode(self, runs: list[bytes]) -> list[bytes]:
        sizes = np.array([len(r) for r in runs])
        raw = np.frombuffer(b"".join(runs), np.uint8)
        symbol, run = self.inner[raw], np.repeat(np.arange(len(runs)), sizes)
        symbol[np.cumsum(sizes) - 1] = self.last[raw[np.cumsum(sizes) - 1]]
        done = []
        while len(symbol):
            first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            rank = np.full(len(symbol), self.NONE)
            inside = np.flatnonzero(run[1:] == run[:-1])
            rank[inside] = self._rank((symbol[inside] << 16) | symbol[inside + 1])
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(symbol))))
            ended = least == self.NONE
            done.append((run[ended], symbol[ended]))
            at = np.flatnonzero((rank == least) & ~ended)
            at = at[np.append(True, run[at][1:] != run[at][:-1])] if len(at) else at
            symbol[at] = self.made[rank[at]]
            keep = ~ended
            keep[at + 1] = False
            symbol, run = symbol[keep], run[keep]
        run, symbol = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(run, kind="stable")
        ends = np.cumsum(np.bincount(run, minlength=len(runs))) * 4
        ids = symbol[order].astype("<u4").tobytes()
        return [ids[x:y] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist())]


class Encoder:
    """Token ids of whole texts as little-endian 32-bit integers.

    The tokenizer drops white space and never joins across it, so each run between ASCII white space is encoded on
    its own and remembered: plain words by their letters and their marks, all others by the tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.merges = Tokenizer.from_file(path), Merges(path)
        self.known: dict[bytes, bytes] = {}
        self.runs: dict[bytes, bytes] = {b"": b""}

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        plain, heads, tails, rest = [], [], [], []
        match = _PLAIN.fullmatch
        for w in words:
            m = match(w.decode()) if len(w) <= CACHE_BYTES else None
            if m:
                a, b = m.groups()
                plain.append(w)
                heads.append(a.lower().encode())
                tails.append(b.encode())
            else:
                rest.append(w)
        if len(self.runs) > CACHE_WORDS:
            self.runs = {b"": b""}
        runs = self.runs
        new = list({r for r in heads if r not in runs} | {r for r in set(tails) if r not in runs})
        if new:
            runs.update(zip(new, self.merges.encode(new)))
        out = dict(zip(plain, map(bytes.__add__, map(runs.__getitem__, heads), map(runs.__getitem__, tails))))
        if rest:
            found = self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)
            out |= {w: b"".join([i.to_bytes(4, "little") for i in e.ids]) for w, e in zip(rest, found)}
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        split = [t.split() for t in texts]
        got = [list(map(self.known.get, words)) for words in split]
        gaps = [[i for i, x in enumerate(found) if x is None] if None in found else [] for found in got]
        new = self._learn({words[i] for words, at in zip(split, gaps) for i in at})
        for words, found, at in zip(split, got, gaps):
            for i in at:
                found[i] = new[words[i]]
        self.known.update(new if max(map(len, new), default=0) <= CACHE_BYTES else {w: x for w, x in new.items() if len(w) <= CACHE_BYTES})
        return [b"".join(found) for found in got]


class Window:
    __slots__ = ("pieces", "fill")

    def __init__(self):
        self.pieces, self.fill = [], 0

    def add(self, piece: tuple) -> None:
        """piece: (doc_id, start, doc_tokens, ids)."""
        self.pieces.append(piece)
        self.fill += len(piece[3]) // 4


def _cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
    doc_id, start, total, ids = piece
    return (doc_id, start, total, ids[: 4 * n]), (doc_id, start + n, total, ids[4 * n :])


class Packer:
    """Windows of one task; out gathers the rows of finished sequences."""

    def __init__(self, size: int, first_id: int, open_windows: int, max_pad: int):
        self.size, self.next_id, self.most, self.max_pad = size, first_id, open_windows, max_pad
        self.open: list[Window] = []
        self.out: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, total, ids in pieces:
            n = len(ids) // 4
            self.out.append((doc_id, start, n, zlib.crc32(ids), total, self.next_id, offset, None, None))
            offset += n
        self.next_id += 1

    def document(self, doc_id: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        piece = (doc_id, 0, total, ids)
        while len(piece[3]) >= 4 * self.size:
            full, piece = _cut(piece, self.size)
            self.emit([full])
        while piece[3]:
            n = len(piece[3]) // 4
            fits = [w for w in self.open if w.fill + n <= self.size]
            if fits or len(self.open) < self.most:
                best = max(fits, key=lambda w: w.fill) if fits else Window()
                if not fits:
                    self.open.append(best)
                best.add(piece)
                if best.fill == self.size:
                    self.open.remove(best)
                    self.emit(best.pieces)
                return
            fullest = max(self.open, key=lambda w: w.fill)
            self.open.remove(fullest)
            gap = self.size - fullest.fill
            if gap > self.max_pad:
                top, piece = _cut(piece, gap)
                fullest.add(top)
            self.emit(fullest.pieces)

    def merge(self) -> list[tuple]:
        """Fills the fullest windows from the emptiest; the pieces of the one partial window that is left."""
        left = sorted(self.open, key=lambda w: -w.fill)
        self.open = []
        while len(left) > 1:
            a, b = left[0], left[-1]
            while a.fill < self.size and b.pieces:
                piece = b.pieces.pop()
                gap, n = self.size - a.fill, len(piece[3]) // 4
                if n > gap:
                    piece, rest = _cut(piece, gap)
                    b.pieces.append(rest)
                b.fill -= len(piece[3]) // 4
                a.add(piece)
            if a.fill == self.size:
                self.emit(left.pop(0).pieces)
            if not b.pieces:
                left.pop()
        return left[0].pieces if left else []

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _pack(path: str, size: int, open_windows: int, max_pad: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        # A reused worker may still hold what earlier stages have freed.
        gc.collect()
        pa.default_memory_pool().release_unused()
        gc.disable()  # nothing here is cyclic, and looking for cycles among millions of words takes longer than all else
        try:
            encoder, packer, end = Encoder(path), Packer(size, part << 28, open_windows, max_pad), END_ID.to_bytes(4, "little")
            for held in chunks(batches, 1):
                for (doc_id, _), ids in zip(held, encoder.encode([t or b"" for _, t in held])):
                    packer.document(doc_id, ids + end)
                if out := packer.take():
                    yield batch(_PIECE, *zip(*out))
            left = [(d, s, len(ids) // 4, None, total, None, i, part, ids) for i, (d, s, total, ids) in enumerate(packer.merge())]
            if out := packer.take() + left:
                yield batch(_PIECE, *zip(*out))
        finally:
            gc.enable()

    return run


def _merge(size: int, round_no: int, last: bool):
    """Rows (part, offset, doc_id, start, doc_tokens, ids) in order: full sequences, and what is left of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, bucket = None, None

        def close() -> list[tuple]:
            left = packer.merge()
            if not last:
                return packer.take() + [(d, s, len(ids) // 4, None, total, None, i, bucket, ids) for i, (d, s, total, ids) in enumerate(left)]
            fill = sum(len(p[3]) // 4 for p in left)
            while fill:  # lengths that are powers of two need no padding
                n, pieces = 1 << (fill.bit_length() - 1), []
                fill -= n
                while n:
                    piece = left.pop(0)
                    if len(piece[3]) // 4 > n:
                        piece, rest = _cut(piece, n)
                        left.insert(0, rest)
                    n -= len(piece[3]) // 4
                    pieces.append(piece)
                packer.emit(pieces)
            return packer.take()

        for b, _, _, doc_id, start, total, ids in rows(batches):
            if b != bucket:
                if packer and (out := close()):
                    yield batch(_PIECE, *zip(*out))
                bucket, packer = b, Packer(size, (1 << 60) + (round_no << 52) + (b << 28), 1, 0)
            piece = (doc_id, start, total, ids)
            while piece[3]:
                window = packer.open[0] if packer.open else Window()
                top, piece = _cut(piece, min(len(piece[3]) // 4, size - window.fill))
                window.add(top)
                packer.open = [window]
                if window.fill == size:
                    packer.emit(window.pieces)
                    packer.open = []
        if packer and (out := close()):
            yield batch(_PIECE, *zip(*out))

    return run


def pack_documents(documents: DataFrame, tokenizer_path: str, size: int = WINDOW, open_windows: int = OPEN_WINDOWS, max_pad: int = MAX_PAD, fan_in: int = FAN_IN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and then END_ID; null and empty texts are END_ID alone. Null and repeated doc_ids
    are packed row by row like any other. An empty table gives no rows. Sequences hold size tokens, up to max_pad
    fewer, or, for what is left at the very end, a power of two. Texts are encoded whole; further columns are not read.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    done = durable(texts.mapInArrow(_pack(tokenizer_path, size, open_windows, max_pad), _DDL))
    out, left = done.filter("part is null"), done.filter("part is not null")
    parts, round_no = (left.agg(F.max("part")).first()[0] or 0) + 1, 0
    while True:
        last, round_no = parts <= fan_in, round_no + 1
        bucket = F.floor(F.col("part") / fan_in)
        order = ["bucket", "part", "offset"]
        dealt = left.select(bucket.alias("bucket"), "part", "offset", "doc_id", "start", "doc_tokens", "ids").repartition("bucket").sortWithinPartitions(*order)
        merged = durable(dealt.mapInArrow(_merge(size, round_no, last), _DDL))
        out, left = out.unionByName(merged.filter("part is null")), merged.filter("part is not null")
        parts = -(-parts // fan_in)
        if last:
            return out.drop("part", "ids")
