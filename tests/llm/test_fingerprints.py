import base64
import hashlib
import random
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tendergrid.llm.common import WordHashes
from tendergrid.llm.fingerprints import _placed, fingerprint_documents, likeness, vectors


def fp(text):
    e, s = vectors([text.encode()], WordHashes())
    return base64.b64encode(e[0].tobytes() + s[0].tobytes()).decode()


def made(n=90, seed=4):
    r = random.Random(seed)
    rows = [(i * 3 % 97, r.choice([" ", "\n"]).join(r.choice(["à", "bb", "ccc", "d🙂", "\n"]) + str(r.randint(0, 99)) for _ in range(r.choice([0, 1, 2, 30, 300])))) for i in range(n)]
    return rows + [(200, None), (201, ""), (202, "z" * 5000), (203, "z" * 4000), (None, "no id"), (204, "same\nlines"), (205, "lines\nsame"), (206, "\n\n")]


def cut_words(line):
    return [w[i : i + 32] for w in line.split() for i in range(0, len(w), 32)] if len(line) > 32 else line.split()


def fp_by_definition(text):
    """The fingerprint paragraph by paragraph and shingle by shingle, in Python integers."""
    m64 = (1 << 64) - 1

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m64
        return x ^ (x >> 31)

    equal, signs = [0] * 4, [0] * 256
    for line in text.encode().split(b"\n"):
        low, high = struct.unpack("<QQ", xxhash.xxh3_128_digest(line))
        for i, v in enumerate((low, high, mixed(low + 0x9E3779B97F4A7C15 & m64), mixed(high + 0x9E3779B97F4A7C15 & m64))):
            equal[i] = (equal[i] + v) & m64
        codes = [xxhash.xxh3_64_intdigest(w) for w in cut_words(line)]
        for i, code in enumerate(codes):
            one, two = codes[i - 1] if i >= 1 else 1, codes[i - 2] if i >= 2 else 2
            gram = mixed(code + one * 0x9E3779B97F4A7C15 + two * 0xC2B2AE3D27D4EB4F & m64)
            for j in range(4):
                h = mixed(gram ^ mixed((j + 1) * 0x9E3779B97F4A7C15 & m64))
                for lane in range(64):
                    signs[j * 64 + lane] += 1 if h >> (lane // 8 + lane % 8 * 8) & 1 else -1
    return base64.b64encode(struct.pack("<4Q", *equal) + struct.pack("<256i", *signs)).decode()


def true_likeness(a, b):
    def shingles(text):
        out = Counter()
        for line in text.encode().split(b"\n"):
            w = cut_words(line)
            out.update((w[i], w[i - 1] if i else 1, w[i - 2] if i > 1 else 2) for i in range(len(w)))
        return out

    x, y = shingles(a), shingles(b)
    both = sum(v * v for v in x.values()) + sum(v * v for v in y.values())
    return 1 - sum((x[k] - y[k]) ** 2 for k in x | y) / both if both else float(a == b)


@pytest.mark.parametrize("buckets", [1, 7, 40])
def test_against_brute_force(spark, buckets):
    rows = made()
    df = spark.createDataFrame([(d, t, 1, False, "p") for d, t in rows], "doc_id long, text string, bucket int, extra boolean, place string").repartition(4)
    out = {r.doc_id: r for r in fingerprint_documents(df, buckets=buckets).collect()}
    order = sorted(rows, key=lambda x: -1 if x[0] is None else x[0], reverse=True)
    assert len(out) == len(rows)
    for i, (d, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + following[:k]
        r = out[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fp(t) == (fp_by_definition(t) if i % 9 == 0 or i > 90 else fp(t)) and r.edited_fingerprint == fp(edited)
        assert abs(r.near_edited - true_likeness(t, edited)) < 0.25 and abs(r.near_next - true_likeness(t, following)) < 0.25
        if edited == t:
            assert r.near_edited == 1
    assert out[204].fingerprint == out[205].fingerprint != out[206].fingerprint != out[201].fingerprint


def test_likeness_follows_the_share_in_common():
    r = random.Random(1)
    words = [str(r.randint(0, 10**9)) for _ in range(3000)]
    for share in (0.0, 0.3, 0.67, 0.9, 1.0):
        k = int(share * 2000)
        _, s = vectors([" ".join(words[:2000]).encode(), " ".join(words[2000 - k : 4000 - k][:2000]).encode()], WordHashes())
        if k + 2000 <= 3000 or share:
            _, s = vectors([" ".join(words[:1500]).encode(), " ".join(words[:int(1500 * share)] + words[1500 : 3000 - int(1500 * share)]).encode()], WordHashes())
        assert abs(likeness(s[:1], s[1:])[0] - share) < 0.2


def test_likeness_of_long_repetitive_texts():
    for n, m in ((65_538, 60_002), (65_538, 68_538), (70_000, 140_000), (200_000, 199_000)):
        _, s = vectors([b"w " * n, b"w " * m], WordHashes())
        assert abs(likeness(s[:1], s[1:])[0] - 2 * n * m / (n * n + m * m)) < 0.01


def test_null_and_repeated_ids_are_split(spark):
    texts = [f"text {i}" for i in range(600)]
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t) for i, t in enumerate(texts)]
    spread = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.xxhash64("text"))
    sizes = [r["count"] for r in _placed(spread, 12, 1 / 3).groupBy("bucket").count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 150
    hashes = {r.text: r.hash for r in spread.collect()}
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), hashes[x[1]]))
    wanted = {(d, hashlib.sha256((t[: len(t) - len(t) // 3] + order[(i + 1) % 600][1][: len(t) // 3]).encode()).hexdigest()) for i, (d, t) in enumerate(order)}
    got = fingerprint_documents(spread.repartition(5), buckets=12).collect()
    assert len(got) == 600 and {(r.doc_id, r.edited_sha256) for r in got} == wanted


def test_insert_and_delete():
    h = WordHashes()
    e, s = vectors([b"one two\nthree four five\nsix", b"three four five", b"six\none two"], h)
    assert (e[0] - e[1] == e[2]).all() and (np.subtract(s[0], s[1]) == s[2]).all()


def test_ties_single_and_empty(spark):
    one = fingerprint_documents(spark.createDataFrame([(5, "abc def")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1 and one[0].edited_sha256 == hashlib.sha256(b"abc dab").hexdigest()
    two = fingerprint_documents(spark.createDataFrame([(5, "abc"), (5, "abc"), (5, "xyz")], "doc_id long, text string"), buckets=3).collect()
    assert len(two) == 3
    assert fingerprint_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
