"""Document fingerprints by a homomorphic multiset hash.

A paragraph (a line) hashes to a wide vector: four 64-bit lanes from the whole paragraph, and 256 lanes that add
+1 or -1 for each of its three-word shingles. A document's fingerprint is the sum of its paragraphs' vectors, the
lanes taken modulo 2^64 and 2^32 (no text of a Spark string reaches that many shingles). So it doesn't depend on their order, and a paragraph is inserted or deleted by
adding or subtracting its vector. The first lanes tell equality; the others estimate how much two documents share.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, WordHashes, batch, mix, rows

EQUAL_LANES, SIGN_LANES = 4, 256
#: Bytes of a word after which it is cut, so that a text without spaces has shingles too.
LONG_WORD = 32
#: Bytes of text for each bucket of neighbouring doc_ids; at most so many buckets, whose first rows are broadcast.
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 1 << 16

_SALTS = mix(np.arange(1, SIGN_LANES // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ONES = np.uint64(0x0101010101010101)
_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _words(paragraph: bytes) -> list[bytes]:
    words = paragraph.split()
    if len(paragraph) > LONG_WORD and any(len(w) > LONG_WORD for w in words):
        words = [w[i : i + LONG_WORD] for w in words for i in range(0, len(w), LONG_WORD)]
    return words


def vectors(texts: list[bytes], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The two parts of each text's fingerprint, uint64 (n, 4) and int32 (n, 256)."""
    split = [t.split(b"\n") for t in texts]
    n_lines = np.array([len(x) for x in split], np.int64)
    first_line = np.cumsum(n_lines) - n_lines
    lines = list(chain.from_iterable(split))
    digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), "<u8").reshape(-1, 2)
    wide = np.hstack([digests, mix(digests + np.uint64(0x9E3779B97F4A7C15))])
    equal = np.add.reduceat(wide, first_line, axis=0) if len(texts) else np.zeros((0, 4), np.uint64)

    words = [_words(x) for x in lines]
    per_line = np.fromiter(map(len, words), np.int64, len(words))
    code = hashes.array(list(chain.from_iterable(words)))
    place = np.arange(len(code)) - np.repeat(np.cumsum(per_line) - per_line, per_line)
    with np.errstate(over="ignore"):
        gram = code.copy()
        for back, factor in ((1, np.uint64(0x9E3779B97F4A7C15)), (2, np.uint64(0xC2B2AE3D27D4EB4F))):
            before = np.full(len(code), back, np.uint64)
            before[back:] = np.where(place[back:] >= back, code[:-back], np.uint64(back))
            gram += before * factor
        gram = mix(gram)
    per_text = np.add.reduceat(per_line, first_line) if len(texts) else per_line
    ends = np.cumsum(per_text)
    sums = np.zeros((len(texts), SIGN_LANES), np.int64)
    if len(code):
        # Segments of at most 255 shingles of one text: their bits add up within the bytes of 64-bit integers.
        starts = np.concatenate([np.arange(e - n, e, 255) for n, e in zip(per_text.tolist(), ends.tolist())])
        owner = np.repeat(np.arange(len(texts)), -(-per_text // 255))
        where = np.flatnonzero(per_text)
        firsts = np.searchsorted(owner, where)
        for j, salt in enumerate(_SALTS):
            h = mix(gram ^ salt)
            for bit in range(8):
                ones = np.add.reduceat((h >> np.uint64(bit)) & _ONES, starts).view(np.uint8).reshape(-1, 8)
                sums[where, j * 64 + bit * 8 : j * 64 + bit * 8 + 8] = np.add.reduceat(ones.astype(np.int64), firsts, axis=0)
    signs = 2 * sums - per_text[:, None]
    return equal, signs.astype(np.int32)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of shingles in common, 2 |A and B| / (|A| + |B|), as the lanes estimate it; rows of a against rows of b."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    both = (x * x).sum(1) + (y * y).sum(1)
    return np.clip(2 * (x * y).sum(1) / np.maximum(both, 1), 0, 1)


def _pairs(found: list[tuple], hashes: WordHashes) -> pa.RecordBatch:
    """found: (doc_id, text, next text), as str."""
    edited, gone, come = [], [], []
    for _, text, following in found:
        k = len(text) // 3
        cut = len(text) - k
        line = text.rfind("\n", 0, cut) + 1
        new = text[line:cut] + following[:k]
        edited.append(hashlib.sha256((text[:line] + new).encode()).hexdigest())
        gone.append(text[line:].encode())
        come.append(new.encode())
    n = len(found)
    equal, signs = vectors([t.encode() for _, t, _ in found] + [t.encode() for _, _, t in found] + gone + come, hashes)
    own, following, out, into = (slice(i * n, i * n + n) for i in range(4))
    with np.errstate(over="ignore"):
        edited_equal, edited_signs = equal[own] - equal[out] + equal[into], signs[own] - signs[out] + signs[into]
    same = lambda e: (equal[own] == e).all(1)
    near_edited = np.where(same(edited_equal), 1.0, likeness(signs[own], edited_signs))
    near_next = np.where(same(equal[following]), 1.0, likeness(signs[own], signs[following]))
    text_of = lambda e, s: [base64.b64encode(x.tobytes() + y.tobytes()).decode() for x, y in zip(e, s)]
    return batch(_OUT, [d for d, _, _ in found], [len(t) for _, t, _ in found], edited, text_of(equal[own], signs[own]), text_of(edited_equal, edited_signs), near_edited, near_next)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, extra, doc_id, text): each document with the one after it; a bucket ends with a copy of the next head."""
    hashes, found, size, last = WordHashes(), [], 0, None
    for bucket, extra, doc_id, text in rows(batches):
        if last is not None and last[0] == bucket and not last[1]:
            found.append((last[2], last[3], text))
            size += len(last[3])
            if size >= CHUNK_BYTES // 4 or len(found) >= 2000:
                yield _pairs(found, hashes)
                found, size = [], 0
        last = (bucket, extra, doc_id, text)
    if found:
        yield _pairs(found, hashes)


def _placed(docs: DataFrame, n: int, nulls: float) -> DataFrame:
    """docs with a bucket each: about n buckets that follow one another in descending (doc_id, hash of the text).

    Buckets are cut at quantiles of doc_id. An id that holds several cuts, and null, which comes last, is cut by hash too.
    """
    cuts = docs.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    once = sorted(set(cuts)) or [0.0]
    parts = lambda m: F.least(F.floor((F.col("hash") / F.lit(2.0**64) + 0.5) * m), m - 1).cast("long")
    bounds = Bucketizer(splits=[float("-inf"), *once, float("inf")], inputCol="place", outputCol="base")
    placed = bounds.transform(docs.withColumn("place", F.coalesce("doc_id", F.lit(0)).cast("double")))
    repeated = [(c, cuts.count(c)) for c in once if cuts.count(c) > 1 and abs(c) < 2.0**53] if len(once) < len(cuts) else []
    # At most n / 2 rows.
    hot = F.broadcast(docs.sparkSession.createDataFrame(repeated, "place double, parts long"))
    placed = placed.join(hot, "place", "left")
    own = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.col("parts") - 1 - parts(F.col("parts")))
    # What follows an id that is cut, within its bucket, has greater ids and so the place before it.
    sub = F.when(F.col("parts").isNull(), F.lit(MOST_BUCKETS)).otherwise(own)
    of_null = F.lit(-1 << 20) - parts(F.lit(max(1, round(nulls * n))))
    bucket = F.when(F.col("doc_id").isNull(), of_null).otherwise(F.col("base").cast("long") * (2 * MOST_BUCKETS) + sub)
    return placed.select(bucket.alias("bucket"), "doc_id", "hash", "text")


def fingerprint_documents(documents: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    The edited text is the text with its last third replaced by the start of the next document in descending
    doc_id, wrapping round; its fingerprint is updated from the text's by the paragraphs that go and come. Null
    text is empty. Null doc_ids come last, and rows of equal doc_id in order of a hash of the text; repeated rows are
    each other's next. A single row is its own next. Two texts without words are 1.0 alike if equal and 0.0 if not.
    Very long texts are read whole, one at a time. An empty table gives no rows. Further columns, whatever their names,
    are not read.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size, count, nulls = docs.agg(F.sum(F.octet_length("text")), F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = buckets or min(max(least, -(-(size or 0) // BUCKET_BYTES)), MOST_BUCKETS)
    placed = _placed(docs.withColumn("hash", F.xxhash64("text")), n, nulls / max(count, 1))
    # One row per bucket, of which there are about n: the first in order.
    first = F.min(F.struct(F.col("doc_id").isNull(), F.bitwise_not(F.coalesce("doc_id", F.lit(0))), "hash", "doc_id"))
    heads = sorted(((b, f.doc_id, f.hash) for b, f in placed.groupBy("bucket").agg(first).collect()), reverse=True) or [(0, 0, 0)]
    after = [(*heads[(i + 1) % len(heads)][1:], b) for i, (b, _, _) in enumerate(heads)]
    after = F.broadcast(spark.createDataFrame(after, "head long, head_hash long, target long"))
    copies = placed.join(after, placed.doc_id.eqNullSafe(after["head"]) & (placed["hash"] == after["head_hash"]))
    copies = copies.groupBy("target").agg(F.min(F.struct("doc_id", "hash", "text")).alias("row")).select(F.col("target").alias("bucket"), F.lit(True).alias("extra"), "row.*")
    both = placed.select("bucket", F.lit(False).alias("extra"), "doc_id", "hash", "text").unionByName(copies)
    order = ["bucket", "extra", F.col("doc_id").desc_nulls_last(), "hash", "text"]
    dealt = both.repartition(n, "bucket").sortWithinPartitions(*order).select("bucket", "extra", "doc_id", "text")
    return dealt.mapInArrow(_in_order, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
