import hashlib
import random

from tendergrid.llm.substring_dedup import remove_repeats


def brute(rows, k):
    docs = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in docs:
        if d is not None:
            for i in range(len(w) - k + 1):
                key = tuple(w[i : i + k])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in docs:
        gone = set()
        if d is not None:
            for i in range(len(w) - k + 1):
                if first[tuple(w[i : i + k])] < d:
                    gone.update(range(i, i + k))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed=1):
    r = random.Random(seed)
    vocab = [f"w{i}é" for i in range(60)]
    passages = [[r.choice(vocab) for _ in range(r.randint(8, 40))] for _ in range(4)]
    rows = []
    for d in range(140):
        words = [r.choice(vocab) for _ in range(r.randint(0, 30))]
        for p in r.sample(passages, r.randint(0, 2)):
            at = r.randint(0, len(words))
            words[at:at] = p
        words += [r.choice(vocab) for _ in range(r.randint(0, 20))]
        rows.append((d * 7 % 141, r.choice([" ", "\n", "\t "]).join(words)))
    rows += [(500, rows[3][1]), (500, rows[3][1]), (500, "x y"), (501, None), (502, ""), (None, rows[3][1]), (503, "a " * 300), (504, "a " * 200), (505, " ".join("abc"))]
    return rows


def check(spark, rows, **more):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, mini string, n int")
    out = remove_repeats(df, k=8, m=3, with_text=True, **more).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out), key=str) == brute(rows, 8)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in out)


def test_against_brute_force(spark):
    check(spark, made())


def test_hot_buckets_are_split_by_window(spark):
    check(spark, made(2), hot_strings=2)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(df).count() == 0
