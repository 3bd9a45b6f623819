import random
import struct
import zlib

import public_tokenizers
from tokenizers import Tokenizer

from tendergrid.llm.packing import Encoder, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def verify(out, rows, size, max_pad):
    tok = Tokenizer.from_file(PATH)
    ids = {}
    for d, t in rows:
        ids.setdefault(d, []).append(tok.encode(t or "", add_special_tokens=False).ids + [1])
    pieces, sequences = {}, {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(ids)
    for d, docs in ids.items():
        if len(docs) == 1:
            own, at = sorted(pieces[d], key=lambda r: r.start), 0
            for r in own:
                assert r.start == at and r.doc_tokens == len(docs[0])
                part = docs[0][at : at + r.length]
                assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
                at += r.length
            assert at == len(docs[0])
        assert sum(r.length for r in pieces[d]) == sum(map(len, docs))
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size and (at >= size - max_pad or at & (at - 1) == 0)


def rows_of(n=120, seed=3):
    r = random.Random(seed)
    words = ["the", "Théâtre", "don't", "x9!!", "ﬁne", "áb", " nb sp", "\x1c?!", "<|endoftext|>", "ΟΔΟΣ", "日本語テキスト", "🙂🙂", "1234"]
    rows = [(i, r.choice([" ", "\n", "\t\t"]).join(r.choice(words) for _ in range(r.choice([0, 3, 30, 90])))) for i in range(n)]
    return rows + [(900, None), (901, ""), (902, "  \n"), (903, "long " * 3000), (904, "z" * 9000), (None, "no id"), (905, "same"), (905, "same"), (905, "other text")]


def test_pieces_cover_all_ids_with_little_padding(spark):
    rows = rows_of()
    df = spark.createDataFrame([(d, t, "x", 5) for d, t in rows], "doc_id long, text string, ids string, part int").repartition(5)
    verify(pack_documents(df, PATH, size=256, open_windows=4, max_pad=8).collect(), rows, 256, 8)


def test_leftovers_merge_in_rounds(spark):
    rows = [(i, "a few words " * (i % 4 + 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    out = pack_documents(df, PATH, size=64, fan_in=3).collect()
    verify(out, rows, 64, 16)


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_encoder_agrees_with_the_tokenizer():
    tok, encoder, r = Tokenizer.from_file(PATH), Encoder(PATH), random.Random(4)
    letters = "aeiouthnsrdlcmwfgypbvkjxqzAEIOUTHNSÀÉÈÊËÏÔÖÜßçñøþÿ"
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 18))) + r.choice(["", "", ".", ",", "!!", "***", "###", "?!.", "|"]) for _ in range(20_000)]
    words += ["don't", "x9", "İstanbul", "ΟΔΟΣ", "e\u0301", "\u00a0a", "a\u200bb", "<|endoftext|>", "'s", "''", "-", "|", "%%%", "ſ", "K", "µm", "×", "÷", "naïve", "THE", "the.", "z" * 300]
    text = " ".join(words)
    got = encoder.encode([text.encode(), b"", b" the "])
    want = [tok.encode(t, add_special_tokens=False).ids for t in (text, "", "the")]
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in got] == want
