"""The agency-winner graph: edges, degrees, PageRank, betweenness, places and the composite rank."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import places
from ..tables import written


def edges(c: DataFrame) -> DataFrame:
    own = c.filter(F.col("dept_key").isNotNull() & F.col("winner_key").isNotNull()).groupBy("dept_key", "winner_key")
    out = own.agg(F.sum("contract_price_agree").alias("value"), F.count("*").alias("n"))
    # Each measure reads links many times, from either end: the contracts are read once.
    return written(out.select(F.concat(F.lit("A::"), F.col("dept_key").cast("string")).alias("source"), F.concat(F.lit("C::"), F.col("winner_key").cast("string")).alias("target"), "value", "n"))


def _both(e: DataFrame) -> DataFrame:
    return e.select(F.col("source").alias("id"), F.col("target").alias("other"), "value").unionByName(e.select(F.col("target").alias("id"), F.col("source").alias("other"), "value"))


def degrees(e: DataFrame) -> DataFrame:
    return _both(e).groupBy("id").agg(F.count("*").alias("degree"), F.sum("value").cast("double").alias("weighted_degree"))


def pagerank(e: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """(id, rank): weighted PageRank of the undirected graph. A null value is none. A node whose links have no value passes
    its rank on to all nodes alike. Links and every fifth round are written to the shared folder, which cuts lineage."""
    both = _both(e.withColumn("value", F.coalesce(F.col("value").cast("double"), F.lit(0.0))))
    weight = written(both.groupBy("id").agg(F.sum("value").alias("out")))
    links = written(both.join(weight.filter("out > 0"), "id").select("id", "other", (F.col("value") / F.col("out")).alias("share")))
    n, idle = weight.agg(F.count("*"), F.count_if(F.col("out") == 0)).first()
    n = max(n, 1)
    # Idle nodes get the same from round to round, so one number stands for all of them.
    alone = 1.0 / n
    rank = weight.filter("out > 0").select("id", F.lit(alone).alias("rank"))
    for i in range(rounds):
        alike = (1 - damping) / n + damping * idle * alone / n
        got = links.join(rank, "id").groupBy(F.col("other").alias("id")).agg(F.sum(F.col("share") * F.col("rank")).alias("s"))
        # A node with value is also linked by value, as links go both ways; links without any bring an idle node nothing.
        rank = got.join(weight.filter("out > 0"), "id", "left_semi").select("id", (F.lit(alike) + damping * F.col("s")).alias("rank"))
        alone = alike
        if i % 5 == 4:
            rank = written(rank)
    return rank.unionByName(weight.filter("out = 0").select("id", F.lit(alone).alias("rank")))


#: Links of a node that one task may join: nodes with more are dealt into slots.
PER_SLOT = 10_000


def _slotted(e: DataFrame) -> DataFrame:
    """Links both ways (id, slot, other, other_slots), each once, without loops and ends that are null."""
    both = _both(e.withColumn("value", F.lit(0))).filter("id != other").select("id", "other").distinct()
    slots = both.groupBy("id").agg(F.ceil(F.count("*") / PER_SLOT).alias("slots"))
    dealt = both.join(slots, "id").join(slots.select(F.col("id").alias("other"), F.col("slots").alias("other_slots")), "other")
    return written(dealt.select("id", F.pmod(F.xxhash64("other"), "slots").alias("slot"), "other", "other_slots"))


def _beyond(level: DataFrame, links: DataFrame) -> DataFrame:
    """The level's rows once for each neighbour of their node."""
    return level.withColumn("slot", F.explode(F.expr("sequence(0L, slots - 1)"))).withColumnRenamed("node", "id").join(links, ["id", "slot"])


def betweenness(e: DataFrame, pivots: int = 400, seed: int = 42) -> DataFrame:
    """(id, betweenness): the share of shortest paths between other nodes that run through a node, links of one length.

    Paths start at `pivots` nodes, the first in order of the MD5 digest of `seed:id`; all nodes where there are no more than
    that, which gives exact values. Values are scaled by nodes a pivot and 1 / ((n - 1) (n - 2)); 0 in graphs of under
    three nodes. Repeated links count once; loops and links with a null end not at all; a node that has no other link isn't
    returned. Searches go level by level for all pivots at once: a level is a table of (pivot, node, paths), at most
    pivots x nodes rows in all levels together, and a level's nodes are new if neither it nor the one before it holds them. The way
    back adds up what each node passes to those before it. A node of many links is joined in slots."""
    links = _slotted(e)
    nodes = links.select("id", "slot").groupBy("id").agg(F.lit(0.0).alias("none"))
    n = nodes.count()
    # Top-k by the digest: the sample is the feature, its size a parameter.
    chosen = nodes.select("id").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "id")), "id").limit(pivots)
    ends = links.select(F.col("other").alias("id"), F.col("other_slots").alias("slots")).distinct()
    levels = [written(chosen.join(ends, "id").select(F.col("id").alias("pivot"), F.col("id").alias("node"), "slots", F.lit(1.0).alias("paths")))]
    while not levels[-1].isEmpty():
        found = _beyond(levels[-1], links).groupBy("pivot", F.col("other").alias("node"), F.col("other_slots").alias("slots")).agg(F.sum("paths").alias("paths"))
        for known in levels[-2:]:
            found = found.join(known, ["pivot", "node"], "left_anti")
        levels.append(written(found))
    passed, sums = None, []
    for level in reversed(levels[1:-1]):
        if passed is None:
            level = level.withColumn("through", F.lit(0.0))
        else:
            level = written(level.join(passed, ["pivot", "node"], "left").withColumn("through", F.coalesce(F.col("paths") * F.col("per_path"), F.lit(0.0))).drop("per_path"))
        sums.append(level.groupBy("node").agg(F.sum("through").alias("through")))
        passed = _beyond(level.withColumn("part", (1 + F.col("through")) / F.col("paths")), links).groupBy("pivot", F.col("other").alias("node")).agg(F.sum("part").alias("per_path"))
    scale = n / min(pivots, n) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    total = nodes.select("id", F.col("none").alias("through"))
    for part in sums:
        total = total.unionByName(part.select(F.col("node").alias("id"), "through"))
    return total.groupBy("id").agg((F.sum("through") * F.lit(scale)).alias("betweenness"))


#: What each percentile weighs in the composite rank.
COMPOSITE = {"degree": "0.30", "weighted_degree": "0.30", "pagerank": "0.20", "betweenness": "0.20"}


def composite(e: DataFrame, pivots: int = 400, seed: int = 42) -> DataFrame:
    """A row per node: its kind, name, degrees, PageRank and betweenness, the percentile of each, and their weighted sum, from
    the highest down. Percentiles are taken of values without the last digits, in which sums differ from run to run; ties go by id."""
    ranks = pagerank(e).withColumnRenamed("rank", "pagerank")
    through = betweenness(e, pivots, seed)
    out = degrees(e).join(ranks, "id").join(through, "id", "left").fillna(0.0, ["weighted_degree", "betweenness"])
    out = written(out.withColumns({"pagerank": F.round("pagerank", 12), "betweenness": F.round("betweenness", 12)}))
    for column in COMPOSITE:
        out = percentile(out, column, f"{column}_n")
    total = sum((F.lit(Decimal(w)) * F.col(f"{c}_n").cast("decimal(7,2)") for c, w in COMPOSITE.items()), F.lit(Decimal("0.00")))
    kind = F.when(F.col("id").startswith("A::"), "agency").otherwise("contractor")
    out = out.withColumns({"type": kind, "name": F.substring("id", 4, 1 << 30), "composite": F.round(total, 2).cast("double")})
    return out.select("id", "type", "name", *COMPOSITE, *[f"{c}_n" for c in COMPOSITE], "composite").orderBy(F.desc("composite"), "id")


def percentile(df: DataFrame, column: str, out: str) -> DataFrame:
    """Place among all, 0 to 100; ties in order of id; 0 for all where all values are the same."""
    n, low, high = df.agg(F.count("*"), F.min(column), F.max(column)).first()
    if low == high:
        return df.withColumn(out, F.lit(0.0))
    ranked = places(df, [column, "id"], "_place")
    return ranked.withColumn(out, F.round(100 * F.col("_place") / F.lit(n - 1), 2)).drop("_place")
