"""Exact removal of repeated passages by super-k-mer partitioning.

A window is k consecutive words of one document. Consecutive windows that share a minimiser (the least
hash among their m-word groups) form a super-k-mer: one packed string instead of many windows. Equal
windows have equal minimisers, so they meet in one bucket.

1. Only minimisers that occur in two documents or more can hold a repeated window; the rest goes no further.
2. Equal super-k-mers are pre-aggregated by a 128-bit digest to the smallest doc_id that holds them.
3. A bucket with one distinct string is settled by that. Otherwise its strings travel, packed, to the
   bucket, where sorting their windows finds the smallest doc_id of each window exactly.
4. A bucket with more than HOT_STRINGS distinct strings (the edge of a passage that very many documents
   hold) is split by window instead: each window travels as a digest of its own and Spark aggregates them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, batch, chunks, digest_pairs, durable, mix, rows, word_count, words_of

K, M = 50, 8
HOT_STRINGS = 1000

_OCC = pa.schema([("mini", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("dk", pa.int64()), ("pos", pa.int32()), ("n", pa.int32())])
_PACKED = pa.schema([("mini", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("first_doc", pa.int64()), ("hot", pa.bool_()), ("packed", pa.binary())])
_RUN = pa.schema([("mini", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("i", pa.int32()), ("len", pa.int32()), ("g", pa.int64())])
_WINDOW = pa.schema([("mini", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("i", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64()), ("first_doc", pa.int64())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("dk", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def _offsets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends once the words are joined by one space."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.empty_like(ends)
    starts[:1], starts[1:] = 0, ends[:-1] + 1
    return starts, ends


def _super_kmers(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, factor = WordHashes(), np.uint64(0x9E3779B97F4A7C15)
        for part in chunks(batches, 2):
            docs = [(d, dk, words) for d, dk, text in part if len(words := text.split()) >= k]
            if not docs:
                continue
            words = [w for _, _, ws in docs for w in ws]
            code = hashes.array(words)
            grams = code[: len(code) - m + 1].copy()
            power = np.uint64(1)
            with np.errstate(over="ignore"):
                for j in range(1, m):
                    power = power * factor
                    grams += code[j : len(code) - m + 1 + j] * power
                grams = mix(grams)
            least = _sliding_min(grams, k - m + 1)
            sizes = np.array([len(ws) for _, _, ws in docs])
            firsts = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(docs)), sizes - k + 1)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes - k + 1) - (sizes - k + 1), sizes - k + 1) + firsts[owner]
            mini = least[at]
            begins = np.flatnonzero(np.concatenate([[True], (mini[1:] != mini[:-1]) | (at[1:] != at[:-1] + 1)]))
            n = np.diff(np.append(begins, len(at)))
            text, (starts, ends) = b" ".join(words), _offsets(words)
            first = at[begins]
            lo, hi = starts[first].tolist(), ends[first + n + k - 2].tolist()
            h1, h2 = digest_pairs([xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(lo, hi)])
            own = owner[begins]
            yield batch(_OCC, mini[begins].view(np.int64), h1, h2, np.array([d for d, _, _ in docs])[own], np.array([x for _, x, _ in docs])[own], (first - firsts[own]).astype(np.int32), n.astype(np.int32))

    return run


def _pack(k: int):
    """Rows (parts, text), parts being (mini, h1, h2, first_doc, hot, pos, n): the packed strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 1):
            out = []
            for parts, text in part:
                words = text.split()
                out += [(p["mini"], p["h1"], p["h2"], p["first_doc"], p["hot"], b" ".join(words[p["pos"] : p["pos"] + p["n"] + k - 1])) for p in parts]
            yield batch(_PACKED, *zip(*out))

    return run


def _windows_of(packed: bytes, k: int) -> list[bytes]:
    starts, ends = _offsets(packed.split(b" "))
    return [packed[a:b] for a, b in zip(starts[: len(starts) - k + 1].tolist(), ends[k - 1 :].tolist())]


def _sort_buckets(k: int):
    """Rows (mini, h1, h2, first_doc, packed) in order of mini: each bucket's windows sorted, the smallest doc_id of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for mini, members in groupby(rows(batches), itemgetter(0)):
            strings = list(members)
            seen = sorted((w, s, i) for s, x in enumerate(strings) for i, w in enumerate(_windows_of(x[4], k)))
            least = [[0] * (len(x[4].split(b" ")) - k + 1) for x in strings]
            for _, equal in groupby(seen, itemgetter(0)):
                equal = list(equal)
                g = min(strings[s][3] for _, s, _ in equal)
                for _, s, i in equal:
                    least[s][i] = g
            for x, found in zip(strings, least):
                i = 0
                for g, same in groupby(found):
                    n = sum(1 for _ in same)
                    out.append((mini, x[1], x[2], i, n, g))
                    i += n
            if len(out) > 20_000:
                yield batch(_RUN, *zip(*out))
                out = []
        if out:
            yield batch(_RUN, *zip(*out))

    return run


def _hot_windows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 4):
            out, digests = [], []
            for mini, h1, h2, first_doc, packed in part:
                for i, w in enumerate(_windows_of(packed, k)):
                    out.append((mini, h1, h2, i, first_doc))
                    digests.append(xxhash.xxh3_128_digest(w))
            mini, h1, h2, i, first = zip(*out)
            yield batch(_WINDOW, mini, h1, h2, i, *digest_pairs(digests), first)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, dk, text, spans) to what is left once the k-word spans are gone."""
    for part in chunks(batches, 2):
        out = []
        for doc_id, dk, text, spans in part:
            words = text.split()
            gone = np.zeros(len(words) + 1, np.int32)
            for s in spans:
                gone[s["at"]] += 1
                gone[s["to"]] -= 1
            keep = np.cumsum(gone[:-1]) == 0
            kept = b" ".join([w for w, ok in zip(words, keep.tolist()) if ok])
            out.append((doc_id, dk, int(len(words) - keep.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
        yield batch(_KEPT, *zip(*out))


def remove_repeats(documents: DataFrame, k: int = K, m: int = M, hot_strings: int = HOT_STRINGS, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row, and kept_text where with_text.

    A word goes if it lies in a window of k words whose sequence also starts in a document of smaller doc_id.
    Null text: no words. Null doc_id: nothing is removed from the row and nothing counts as repeated from it.
    Rows of equal doc_id never count as earlier than each other. Texts under k words, and empty tables, pass
    through. Further columns of documents are not read, so their names can't clash.
    """
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    documents = documents.withColumn("dk", F.xxhash64("text"))
    tight = F.array_join(words_of(F.col("text")), " ")
    base = documents.select("doc_id", "dk", word_count(F.col("text")).alias("n_words"), F.sha2(F.encode(tight, "UTF-8"), 256).alias("full_sha256"), *([tight.alias("full_text")] if with_text else []))

    texts = documents.filter("doc_id is not null").select("doc_id", "dk", F.encode("text", "UTF-8").alias("text"))
    occ = texts.mapInArrow(_super_kmers(k, m), _ddl(_OCC))
    shared = occ.groupBy("mini").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("mini")
    occ = durable(occ.join(shared, "mini"))
    affected = durable(texts.join(occ.select("doc_id", "dk").distinct(), ["doc_id", "dk"], "left_semi"))

    key = ["mini", "h1", "h2"]
    strings = durable(occ.groupBy(*key).agg(F.min(F.struct("doc_id", "dk", "pos", "n")).alias("rep")))
    counts = strings.groupBy("mini").agg(F.count("*").alias("n_strings"))
    strings = strings.join(counts, "mini")
    alone = strings.filter("n_strings = 1").select(*key, F.lit(0).alias("i"), F.col("rep.n").alias("len"), F.col("rep.doc_id").alias("g"))
    parts = strings.filter("n_strings > 1").select("rep.doc_id", "rep.dk", F.struct(*key, F.col("rep.doc_id").alias("first_doc"), (F.col("n_strings") > hot_strings).alias("hot"), "rep.pos", "rep.n").alias("part"))
    parts = parts.groupBy("doc_id", "dk").agg(F.collect_list("part").alias("parts"))
    packed = durable(parts.join(affected, ["doc_id", "dk"]).select("parts", "text").mapInArrow(_pack(k), _ddl(_PACKED)))
    cold = packed.filter("not hot").drop("hot").repartition("mini").sortWithinPartitions("mini").mapInArrow(_sort_buckets(k), _ddl(_RUN))
    windows = durable(packed.filter("hot").drop("hot").mapInArrow(_hot_windows(k), _ddl(_WINDOW)))
    least = durable(windows.groupBy("w1", "w2").agg(F.min("first_doc").alias("g")))
    hot = windows.join(least, ["w1", "w2"]).select(*key, "i", F.lit(1).alias("len"), "g")

    found = occ.join(durable(alone.unionByName(cold).unionByName(hot)), key).filter("g < doc_id")
    at = F.col("pos") + F.col("i")
    spans = found.groupBy("doc_id", "dk").agg(F.collect_list(F.struct(at.alias("at"), (at + F.col("len") + F.lit(k - 1)).alias("to"))).alias("spans"))
    cut = affected.dropDuplicates(["doc_id", "dk"]).join(spans, ["doc_id", "dk"]).select("doc_id", "dk", "text", "spans").mapInArrow(_cut, _ddl(_KEPT))
    cut = cut if with_text else cut.drop("kept_text")
    out = base.join(cut, ["doc_id", "dk"], "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "full_sha256").alias("kept_sha256"),
        *([F.coalesce("kept_text", "full_text").alias("kept_text")] if with_text else []))
    return out
