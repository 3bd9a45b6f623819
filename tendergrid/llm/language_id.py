"""Language identification by rank-order profiles.

A profile ranks the most frequent n-grams (1 to 3 letters, with word ends) of a language. A document ranks its own
most frequent n-grams; its distance to a language sums how far out of place each stands there, an n-gram that the
profile lacks counting as the profile's length. The language at the least distance is predicted.

Profiles are learned from a bounded sample, about profile_docs documents per language, those whose hash of doc_id lies
under a threshold; predictions read every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch, chunks, field

PROFILE_DOCS = 3000
PROFILE_GRAMS = 400
DOC_GRAMS = 400
UNKNOWN = "und"
#: Code points that are counted at one time; a longer text is taken slice by slice and its counts are added up.
SLICE = 1 << 20

_COUNT = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
_SPACE = 32


def letters_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _add(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[first], np.add.reduceat(counts, first)


def gram_counts(text: str, is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text as integers, ascending, and how often each occurs. Nothing if it has no letter."""
    parts = []
    for at in range(0, len(text), SLICE):
        raw = np.frombuffer(text[at : at + SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        raw = np.where(is_letter[raw], raw, np.uint32(_SPACE)).astype(np.int64)
        padded = np.concatenate([[_SPACE], raw, [_SPACE]])
        c = padded[np.append(True, (padded[1:] != _SPACE) | (padded[:-1] != _SPACE))]
        if len(c) < 3:
            continue
        two = (c[:-1] << 21) | c[1:]
        three = (two[:-1] << 21) | c[2:]
        grams = np.sort(np.concatenate([c[c != _SPACE], two, three[c[1:-1] != _SPACE]]))
        first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
        parts.append((grams[first], np.diff(np.append(first, len(grams)))))
    if len(parts) > 1:
        return _add(parts)
    return parts[0] if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def ranked(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, most of them at most; ties in order of the n-gram."""
    if len(codes) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = np.flatnonzero(counts >= least)
        codes, counts = codes[keep], counts[keep]
    return codes[np.argsort(-counts, kind="stable")][:most]


class Profiles:
    """ranks: language -> n-grams by rank."""

    def __init__(self, ranks: dict[str, np.ndarray], length: int):
        self.langs, self.length = sorted(ranks), length
        self.codes = np.unique(np.concatenate([np.zeros(0, np.int64), *ranks.values()]))
        self.place = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.place[np.searchsorted(self.codes, ranks[lang]), j] = np.arange(len(ranks[lang]))

    def predict(self, top: np.ndarray) -> tuple[str, float]:
        if not len(top) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        at = np.where(self.codes[at] == top, at, len(self.codes))
        place = self.place[at]
        apart = np.abs(place - np.arange(len(top))[:, None])
        distance = np.where(place < 0, self.length, np.minimum(apart, self.length)).sum(0)
        best = int(distance.argmin())
        return self.langs[best], float(1 - distance[best] / (len(top) * self.length))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    is_letter = letters_table()
    for held in chunks(batches, 1):
        by_lang: dict[str, list] = {}
        for lang, text in held:
            by_lang.setdefault(lang, []).append(gram_counts(text.decode(), is_letter))
        for lang, parts in by_lang.items():
            codes, counts = _add(parts)
            yield batch(_COUNT, [lang] * len(codes), codes, counts)


def _predict(profiles: dict[str, list[int]], length: int, doc_grams: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter = letters_table()
        known = Profiles({lang: np.array(codes, np.int64) for lang, codes in profiles.items()}, length)
        for part in batches:
            row = part.column(0)
            texts = part.column(1) if part.num_columns == 2 else row.field("text")
            found = []
            for at in range(len(texts)):
                text = texts[at].as_py()
                found.append(known.predict(ranked(*gram_counts(text, is_letter), doc_grams)) if text else (UNKNOWN, 0.0))
            langs, scores = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([row, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def learn_profiles(labelled: DataFrame, profile_docs: int = PROFILE_DOCS, grams: int = PROFILE_GRAMS) -> dict[str, list[int]]:
    """Rows (doc_id, text, lang) to each language's n-grams by rank; about profile_docs documents per language are read.

    What comes to the driver is one count and one list of grams integers per language.
    """
    usable = labelled.filter("lang is not null and doc_id is not null and text is not null").select("doc_id", "lang", "text")
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    chosen = F.lit(False)
    for lang, n in sorted(tuple(r) for r in usable.groupBy("lang").agg(F.count("*")).collect()):
        chosen = chosen | ((F.col("lang") == lang) & (lot <= min(1.0, profile_docs / n) * (1 << 40)))
    texts = usable.filter(chosen).select("lang", F.encode("text", "UTF-8").alias("text"))
    counts = texts.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # First the best of each of 64 parts of a language's n-grams, then the best of these.
    top = counts.withColumn("part", F.pmod("gram", F.lit(64)))
    for part in (["lang", "part"], ["lang"]):
        top = top.withColumn("rank", F.row_number().over(W.partitionBy(*part).orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= grams)
    out: dict[str, list[int]] = {}
    for r in sorted(top.select("lang", "rank", "gram").collect()):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def identify_languages(documents: DataFrame, profiles: dict[str, list[int]], length: int = PROFILE_GRAMS, doc_grams: int = DOC_GRAMS, keep: list[str] | None = None) -> DataFrame:
    """row (a struct of the columns keep, default doc_id), lang_pred and score (1: in place throughout, 0: nothing in
    common) of each row. Columns travel in the struct, so their names clash with nothing.

    Null texts and texts without a letter, and every text where no language was learned, are `und` with score 0.
    Distances that tie go to the first language by code point. Repeated rows and null doc_ids are rows like any other,
    very long texts are counted slice by slice, and an empty table gives no rows.
    """
    keep = keep or ["doc_id"]
    row = documents.select(F.struct(*[field(c) for c in keep]).alias("row"), *([] if "text" in keep else [F.col("text")]))
    schema = row.select("row").schema.add("lang_pred", "string").add("score", "double")
    return row.mapInArrow(_predict(profiles, length, doc_grams), schema)


def predict_held_out(documents: DataFrame, profile_docs: int = PROFILE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; profiles come from rows that are not held out. A table without
    rows gives none; further columns, whatever their names, are not read."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    profiles = learn_profiles(docs.filter(~held_out(F.col("doc_id"))), profile_docs)
    found = identify_languages(docs, profiles).select("row.doc_id", "lang_pred", "score")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def in_known_languages(documents: DataFrame, least_score: float) -> DataFrame:
    """The rows of documents in a learned language, all columns as they are, whatever their names: those with a
    prediction other than `und` and a score of least_score or more. Profiles come from rows that are not held out."""
    columns = documents.columns
    profiles = learn_profiles(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(~held_out(F.col("doc_id"))))
    told = identify_languages(documents, profiles, keep=columns)
    return told.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select(*[field(c, "row") for c in columns])
