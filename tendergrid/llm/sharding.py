"""Shards of near-equal bytes by histogram sort.

1. Every row gets a key (hash of the text, doc_id, row number), and the rows are written once with it. Equal texts lie
   together in key order.
2. Rounds: exact bytes and rows below candidate boundaries are counted over all rows in one aggregate, a row per cell
   between candidates. Each splitter has a goal; the cell in which its goal falls gets new candidates, evenly
   between the least and greatest key found there, until a boundary meets the tolerance or the cell holds one row. While a
   cell holds different texts, candidates lie between texts only: a group of equal texts is cut only where its bytes leave no other way.
3. Splitters between shards have goals in bytes; those that part a shard for its tasks have goals in bytes and rows, as
   a shard of short texts has many rows. One exchange then brings each part together, in order; rows below each
   splitter are known exactly, so places in a shard need no further pass.

The driver holds the splitters and a few candidates for each, never rows.
"""

from __future__ import annotations

import bisect
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, field

SHARDS = 16
#: Of an equal share of all bytes: how far from its goal a splitter between shards, or parts, may lie.
TOLERANCE, PART_TOLERANCE = 0.002, 0.2
#: Bytes of a part (counting each row's share of rows as bytes too), and the most parts.
PART_BYTES, MOST_PARTS = 32 << 20, 1 << 14
#: New candidates in a splitter's cell, a round.
PROBES = 24
_LEAST = -(1 << 63)


def _key() -> Column:
    return F.struct(F.col("h"), F.col("d"), F.col("i"))


def _cell(key: Column, bounds: list[tuple[int, int, int]]) -> Column:
    """Number of bounds (ascending) that are not above key, by binary search in a constant array."""
    if not bounds:
        return F.lit(0)
    array = F.from_json(F.lit(json.dumps([dict(zip("hdi", b)) for b in bounds])), "array<struct<h:bigint,d:bigint,i:bigint>>")
    steps = F.array(*[F.lit(i) for i in range(len(bounds).bit_length())])

    def halve(at: Column, _: Column) -> Column:
        mid = F.shiftright(at["lo"] + at["hi"], 1)
        low = F.get(array, mid) <= key
        done = at["lo"] >= at["hi"]
        lo = F.when(done | ~low, at["lo"]).otherwise(mid + 1)
        return F.struct(lo.alias("lo"), F.when(done | low, at["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(steps, start, halve)["lo"]


def _between(least: tuple[int, int, int], most: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    """Candidates over least and up to most, evenly in the first part of the key in which they differ."""
    at = next(i for i in range(3) if least[i] != most[i])
    room = most[at] - least[at]
    values = sorted({least[at] + -(-room * j // PROBES) for j in range(1, PROBES + 1)})
    return [(*most[:at], v, *[_LEAST] * (2 - at)) for v in values if v > least[at]]


def find_splitters(keyed: DataFrame, goals: list[tuple[str, float, float]], totals: dict[str, float]) -> list[tuple[tuple[int, int, int], dict[str, float]]]:
    """A boundary for each goal, with what lies below it. keyed: h, d, i, and a column for each measure in totals.

    goals: (measure, goal, tolerance). A boundary is a key and parts rows below it from the others; None stands for one below or above all rows.
    """
    names = list(totals)
    zero = dict.fromkeys(names, 0)
    known: list[tuple] = []  # boundaries in order: (key, {measure: sum below})
    cells: list[tuple] = [(None, None, totals)]  # between these: (least key, greatest key, sums)
    while True:
        keys = [k for k, _ in known]
        below = [zero, *[s for _, s in known], totals]
        wanted: set[tuple[int, int, int]] = set()
        for measure, goal, tolerance in goals:
            sums = [b[measure] for b in below]
            after = bisect.bisect_left(sums, goal)
            if after == 0 or min(abs(sums[j] - goal) for j in (after - 1, min(after, len(sums) - 1))) <= tolerance:
                continue
            least, most, _ = cells[after - 1]
            if least is None:
                wanted |= set(_between((_LEAST, _LEAST, _LEAST), ((1 << 63) - 1, _LEAST, _LEAST)))
            elif least != most:
                wanted |= set(_between(least, most))
        if not wanted - set(keys):
            break
        keys = sorted({*keys, *wanted})
        counted = keyed.groupBy(_cell(_key(), keys).alias("cell")).agg(F.min(_key()).alias("least"), F.max(_key()).alias("most"), *[F.sum(n).alias(n) for n in names])
        found = {r.cell: r for r in counted.collect()}
        at, known, cells = dict(zero), [], []
        for c in range(len(keys) + 1):
            r = found.get(c)
            sums = {n: (r[n] if r else 0) for n in names}
            at = {n: at[n] + sums[n] for n in names}
            cells.append((tuple(r.least), tuple(r.most), sums) if r else ((0, 0, 0), (0, 0, 0), sums))
            if c < len(keys):
                known.append((keys[c], at))
    out = []
    ends = [(None, zero), *known, (None, totals)]
    for measure, goal, _ in goals:
        out.append(min(ends, key=lambda e: abs(e[1][measure] - goal)))
    return out


def keyed_rows(documents: DataFrame) -> DataFrame:
    """documents' columns in a struct `rest`, with size, text_crc32 and key, written once."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = documents.select(
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST + 1)).alias("d"), F.monotonically_increasing_id().alias("i"),
        (F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(1).cast("long")).alias("size"), F.crc32(raw).alias("text_crc32"), F.struct(*[field(c) for c in documents.columns]).alias("rest"),
    )
    return durable(rows)


def shard_rows(keyed: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, part_bytes: int = PART_BYTES) -> DataFrame:
    """keyed with shard (0 to shards - 1) and slot, the row's place in its shard from 0 in key order."""
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    totals = {"bytes": total["bytes"], "rows": total["rows"], "weight": 2.0 * total["bytes"]}
    per_row = total["bytes"] / max(total["rows"], 1)
    counted = keyed.select("h", "d", "i", F.col("size").alias("bytes"), F.lit(1).alias("rows"), (F.col("size") + F.lit(per_row)).alias("weight"))
    share = totals["bytes"] / shards
    goals = [("bytes", share * j, share * tolerance) for j in range(1, shards)]
    n_parts = min(MOST_PARTS, max(shards, -(-int(totals["weight"]) // part_bytes)))
    piece = totals["weight"] / n_parts
    part_goals = [("weight", piece * j, piece * PART_TOLERANCE) for j in range(1, n_parts)]
    found = find_splitters(counted, goals + part_goals, totals)
    bounds = sorted({k for k, _ in found if k is not None})
    rows_below = {k: s["rows"] for k, s in found}
    # A splitter that is None lies below all rows or above them, which the sum below it tells.
    of_shards = [(k, s["rows"]) for k, s in found[: shards - 1]]
    parts = []  # shard of each part and rows of the shard below it
    for p in range(len(bounds) + 1):
        begin = rows_below[bounds[p - 1]] if p else 0
        passed = [n for k, n in of_shards if (k is None and n == 0) or (k is not None and p and k <= bounds[p - 1])]
        parts.append((len(passed), begin - (max(passed) if passed else 0)))
    table = F.from_json(F.lit(json.dumps([{"shard": s, "base": b} for s, b in parts])), "array<struct<shard:int,base:bigint>>")
    parted = keyed.withColumn("part", _cell(_key(), bounds).cast("int"))
    # The one exchange: each part is a partition, so ordering within parts needs no other.
    together = parted.repartitionById(len(parts), F.col("part"))
    place = F.row_number().over(W.partitionBy("part").orderBy("h", "d", "i")) - 1
    at = F.get(table, F.col("part"))
    return together.withColumn("slot", place + at["base"]).withColumn("shard", at["shard"]).drop("part")


def shard_documents(documents: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """documents' columns in a struct `rest`, with size (UTF-8 bytes and 1), text_crc32, shard and slot.

    Bytes per shard are near equal: a boundary lies within tolerance of its goal, or beside the one row that spans it.
    Equal texts stay in one shard where that permits. The law is `bytes` alone: another number of shards moves rows between all of them.

    Null text: empty. Null doc_id: a value of its own, before all others. Repeated rows are told apart by the number a row gets when
    written; they are alike, so reruns agree. A text longer than a share fills a shard and others stay small or
    empty. An empty table gives no rows. Further columns lie untouched in rest, whatever their names.
    """
    return shard_rows(keyed_rows(documents), shards, tolerance).select("rest", "size", "text_crc32", "shard", "slot")


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The shards as Parquet folders shard=0, shard=1, ... under path, rows in order of slot within each file."""
    out = shard_documents(documents, shards)
    out.select("rest.*", "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def sharded(documents: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is bytes) of every row."""
    out = shard_documents(documents.select("doc_id", "text"))
    return out.select("rest.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
