"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Targets: each source's weight shares a multiple of all words; no target exceeds most_repeats times its source,
   and the excess is shared again by weight (water filling, solved in closed form over the sources in order).
2. Seats: all blocks of block words are given to sources by the highest quotients target / (2k + 1), then each
   source's blocks to its shards the same way. The seats are integer quotas per shard.
3. A shard lays its documents out in a seeded order and picks its blocks systematically from a seeded start: block
   i is taken floor((i + 1 + u) q / n) - floor((i + u) q / n) times. The words of a document that the picks cover
   follow by arithmetic from where it begins and ends, so no block ever becomes a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, field, rows

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_REPEATS = 2
SEED = 20240229
#: Words of a block at most; smaller where the least target is under LEAST_BLOCKS such blocks.
BLOCK_WORDS, LEAST_BLOCKS = 256, 256
#: A source of n words has the root of n / SHARD_SCALE shards: both they and the rows of each grow slowly, as one task
#: sorts a shard's narrow rows and one ranks a source's shards.
SHARD_SCALE = 2048

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def count_words(texts: pa.Array) -> np.ndarray:
    """Words of each text (binary, no nulls), counted on the bytes of the whole array."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends -= ends[0]
    word = ~_IS_SPACE[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    first = ends[:-1][ends[:-1] < ends[1:]]
    begins[first] = word[first]
    upto = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
    return upto[ends[1:]] - upto[ends[:-1]]


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            n = count_words(part.column(2))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), part.column(3)], ["doc_id", "source", "size", "tie"])


def sainte_lague(parties: DataFrame, within: list[str], order: list[Column]) -> DataFrame:
    """parties with seats: those of each group (columns within) share `house` seats by the quotients
    votes / (2k + 1), none getting more than `most`. Ties go by order.

    Seats lie near a party's exact share, off by less than a bound that sums to a few per party, so only that
    many quotients of each party are ranked.
    """
    w = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    exact = F.when(F.col("all_votes") > 0, F.col("votes") / F.col("all_votes") * F.col("house")).otherwise(F.lit(0.0))
    slack = F.lit(3) + F.ceil(2 * F.col("exact") * F.col("n_parties") / F.greatest(F.col("house"), F.lit(1)))
    known = (
        parties.withColumn("all_votes", F.sum("votes").over(w)).withColumn("n_parties", F.count("*").over(w)).withColumn("exact", exact)
        .withColumn("lo", F.least(F.col("most"), F.greatest(F.lit(0), F.floor("exact") - slack)).cast("long"))
        .withColumn("hi", F.greatest(F.col("lo"), F.least(F.col("most"), F.floor("exact") + slack)).cast("long"))
        .withColumn("left", F.col("house") - F.sum("lo").over(w))
    )
    offered = known.withColumn("k", F.explode_outer(F.when(F.col("hi") > F.col("lo"), F.sequence(F.col("lo"), F.col("hi") - 1))))
    ranked = offered.withColumn("rank", F.row_number().over(w.orderBy((F.col("votes") / (2 * F.col("k") + 1)).desc_nulls_last(), *order, "k")))
    won = F.sum(F.when(F.col("k").isNotNull() & (F.col("rank") <= F.col("left")), 1).otherwise(0))
    keep = [c for c in parties.columns]
    return ranked.groupBy(*keep, "lo").agg(won.alias("won")).withColumn("seats", F.col("lo") + F.col("won")).drop("lo", "won")


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, most_repeats: int) -> DataFrame:
    """Rows (source, source_size) to source, source_size, target; sources by code point, null last."""
    everything = W.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    by_room = everything.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(W.unboundedPreceding, -1)
    known = (
        sources.withColumn("weight", weight).withColumn("room", (F.lit(most_repeats) * F.col("source_size")).cast("double"))
        .withColumn("goal", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("full", F.coalesce(F.sum("room").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("goal") - F.col("full")) / F.col("open_weight"))
    )
    # The sources before the first that is not full are full, and the level is right there; it only falls after.
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("room"), F.col("level"))).over(everything)
    target = F.when(level.isNull(), F.col("room")).otherwise(F.least(F.col("room"), F.col("weight") * level))
    return known.withColumn("target", target).select("source", "source_size", "target")


def mix_sources(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_repeats: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row, with source and the plan of its shard (shard, begin,
    block, blocks, quota, start) from which slices() finds the words taken.

    Null text: size 0, taken 0. Null source: a source of its own, the last. Null and repeated doc_ids are rows like
    any other; ties in the seeded order go by doc_id, size and a hash of the text. A source without words has target
    0. Very long texts are counted whole. An empty table gives no rows. Further columns, whatever their names, are not read.
    """
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", text.alias("text"), F.xxhash64("text").alias("tie"))
    sized = durable(narrow.mapInArrow(_sizes, "doc_id long, source string, size long, tie long"))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, weights, share, most_repeats)

    everything = W.partitionBy(F.lit(0))
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.coalesce(least, F.lit(0.0)) / LEAST_BLOCKS))).cast("long")
    n_shards = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("source_size") / SHARD_SCALE))).cast("long")
    targets = durable(targets.withColumn("block", block).withColumn("n_shards", n_shards))

    lot = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("tie"))
    placed = sized.join(targets, sized.source.eqNullSafe(targets.source)).drop(targets.source)
    placed = placed.withColumn("lot", lot).withColumn("shard", F.pmod("lot", "n_shards"))
    line = W.partitionBy("source", "shard").orderBy("lot", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("begin", F.coalesce(F.sum("size").over(line), F.lit(0).cast("long")))

    blocks = F.ceil(F.col("words") / F.col("block")).cast("long")
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("block").alias("block"), F.first("target").alias("target"))
    shards = durable(shards.withColumn("blocks", blocks))
    by_source = shards.groupBy("source").agg(F.first("target").alias("votes"), F.first("block").alias("block"), (most_repeats * F.sum("blocks")).alias("most"))
    by_source = by_source.withColumn("house", F.least(F.round(F.sum("votes").over(everything) / F.col("block")), F.sum("most").over(everything)).cast("long"))
    seats = sainte_lague(by_source, [], [F.col("source").asc_nulls_last()]).select(F.col("source").alias("of"), F.col("seats").alias("house"))
    split = shards.join(seats, shards.source.eqNullSafe(seats.of)).select("source", "shard", "blocks", F.col("words").cast("double").alias("votes"), (most_repeats * F.col("blocks")).alias("most"), "house")
    quotas = sainte_lague(split, ["source"], [F.col("shard")])
    quotas = durable(quotas.select(F.col("source").alias("of"), F.col("shard").alias("at"), "blocks", F.col("seats").alias("quota")))
    quotas = quotas.withColumn("start", F.when(F.col("blocks") > 0, F.pmod(F.xxhash64(F.lit(seed + 1), key_of("of"), "at"), "blocks")).otherwise(F.lit(0)).cast("long"))

    out = placed.join(quotas, placed.source.eqNullSafe(quotas.of) & (placed.shard == quotas.at), "left")
    taken = _taken_before(F.col("begin") + F.col("size")) - _taken_before(F.col("begin"))
    taken = F.when(F.coalesce("blocks", F.lit(0)) > 0, taken).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), placed.source, "shard", "tie", "begin", "block", "blocks", "quota", "start")


def key_of(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("\x00null"))


def _div(a: Column, b: str) -> Column:
    return F.call_function("div", a, F.col(b))


def _taken_before(at: Column) -> Column:
    """Words of the shard's line before a place that its picks cover, repeats counted."""
    j = F.least(_div(at, "block"), F.col("blocks"))
    picked = lambda x: _div((x + F.col("start")) * F.col("quota"), "blocks")
    copies = picked(j + 1) - picked(j)
    return (picked(j) - picked(F.lit(0))) * F.col("block") + copies * (at - j * F.col("block"))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def taken_texts(text: bytes, size: int, begin: int, block: int, blocks: int, quota: int, start: int) -> list[bytes]:
    """What each pass over the shard takes of a text: all of it unchanged, or its taken stretches joined by a space."""
    if not size or not blocks:
        return []
    copies = [((j + 1 + start) * quota) // blocks - ((j + start) * quota) // blocks for j in range(begin // block, (begin + size - 1) // block + 1)]
    spans, out = None, []
    for n in range(1, max(copies) + 1):
        if min(copies) >= n:
            out.append(text)
            continue
        spans = spans or [m.span() for m in _WORD.finditer(text)]
        found, j0 = [], begin // block
        for i, c in enumerate(copies):
            if c >= n:
                lo, hi = max((j0 + i) * block, begin) - begin, min((j0 + i + 1) * block, begin + size) - begin
                if found and found[-1][1] == lo:
                    found[-1][1] = hi
                else:
                    found.append([lo, hi])
        out.append(b" ".join(text[spans[lo][0] : spans[hi - 1][1]] for lo, hi in found))
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            who, texts = [], []
            for i, (text, *plan) in enumerate(rows([part.select(["raw", "size", "begin", "block", "blocks", "quota", "start"])])):
                found = taken_texts(text, *plan)
                who += [i] * len(found)
                texts += found
            if who:
                kept = part.drop_columns(["raw", "size", "begin", "block", "blocks", "quota", "start"]).take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([t.decode() for t in texts], pa.string())], [*kept.schema.names, "taken_text"])


def mixed_documents(documents: DataFrame, **how) -> DataFrame:
    """The mix itself: documents' columns, a row for each pass that takes words of a row, with what it takes as text.

    n_chars, where there is such a column, becomes the length of that text. Further columns pass through, whatever their
    names. Arguments and edge cases: mix_sources().
    """
    plan = mix_sources(documents, **how)
    same = ["doc_id", "source", "tie"]
    plan = plan.withColumn("nth", F.row_number().over(W.partitionBy(*same).orderBy("begin")))
    plan = plan.filter("taken > 0").select(*[F.col(c).alias(f"_p_{c}") for c in [*same, "nth"]], *[F.col(c).alias(f"_p_{c}") for c in ("size", "begin", "block", "blocks", "quota", "start")])
    columns, plan_columns = documents.columns, ("size", "begin", "block", "blocks", "quota", "start")
    rest = F.struct(*[field(c) for c in columns if c != "text"]).alias("rest")
    tagged = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("tie"), F.encode("text", "UTF-8").alias("raw"), rest)
    tagged = tagged.withColumn("nth", F.row_number().over(W.partitionBy(*same).orderBy(F.lit(0))))
    on = [tagged[c].eqNullSafe(plan[f"_p_{c}"]) if c in ("doc_id", "source") else tagged[c] == plan[f"_p_{c}"] for c in [*same, "nth"]]
    packed = tagged.join(plan, on).select("rest", "raw", *[F.col(f"_p_{c}").alias(c) for c in plan_columns])
    schema = packed.select("rest").schema.add("taken_text", "string")
    out = packed.mapInArrow(_texts, schema)
    kept = {c: field(c, "rest") for c in columns if c != "text"} | {"text": F.col("taken_text")}
    if "n_chars" in columns:
        kept["n_chars"] = F.length("taken_text").cast(documents.schema["n_chars"].dataType)
    return out.select(*[kept[c].alias(c) for c in columns])
