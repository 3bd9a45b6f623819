"""A Merkle manifest of a dataset: a tree of digests per source, and one over the sources' roots.

1. Leaves are placed within their source by a range shuffle of narrow rows and a prefix sum of the counts of its
   stretches, so a source of any size is ranked by many tasks.
2. Parents store their preimage, the concatenated digests of their children. A shuffle builds BAND levels: groups of
   ARITY^BAND neighbours hold the preimages of all parents over them.
3. Preimages of ancestors travel down the bands, once for each group; leaves join their group. A leaf's siblings are a
   preimage without the leaf's own 64-character slot; folding splices another digest into that slot and hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, field

ARITY = 3
BAND = 4
GROUP = ARITY**BAND
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_POSITION = (1 << 33) - 1


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def framed(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value: no two rows have one frame."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return digest(F.concat(*map(framed, values)))


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def _placed(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """rows (g, hash, ...) with idx, their place in g by order from 0, and levels, the height of g's tree; and the greatest height."""
    by = [F.col("g"), *order, F.col("hash")]
    lined = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_line", F.monotonically_increasing_id())
    lined = durable(lined.withColumn("_part", F.shiftright("_line", 33)).withColumn("_line", F.col("_line").bitwiseAND(F.lit(_POSITION))))
    # A row per range and group it holds: as many as ranges and groups together.
    stretches = lined.groupBy("g", "_part").agg(F.min("_line").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy("g").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    power = F.array(*[F.lit(ARITY**i).cast("long") for i in range(39)])
    total = F.sum("_n").over(W.partitionBy("g"))
    stretches = stretches.withColumn("_total", total).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    levels = F.size(F.filter(power, lambda p: p < F.col("_total")))
    stretches = durable(stretches.select("g", "_part", (F.col("_before") - F.col("_first")).alias("_shift"), levels.alias("levels")))
    height = stretches.agg(F.max("levels")).first()[0] or 0
    placed = lined.join(stretches, ["g", "_part"]).withColumn("idx", F.col("_line") + F.col("_shift"))
    return placed.drop("_line", "_part", "_shift"), height


def _band(nodes: DataFrame, low: int) -> DataFrame:
    """Groups of neighbouring nodes of level low: g, levels, at, the preimages over them by level, and the digest at the top."""
    groups = nodes.groupBy("g", "levels", _div(F.col("idx"), GROUP).alias("at"))
    groups = groups.agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"]).alias("h0"))
    for j in range(BAND):
        last = _div(F.size(f"h{j}") + (ARITY - 1), ARITY).cast("int") - 1
        kids = F.col(f"h{j}")
        joined = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(kids, i * ARITY + 1, F.lit(ARITY)), ""))  # noqa: B023
        more = F.col("levels") > low + j
        groups = groups.withColumn(f"p{j}", F.when(more, joined).otherwise(F.array().cast("array<string>")))
        groups = groups.withColumn(f"h{j + 1}", F.when(more, F.transform(f"p{j}", digest)).otherwise(F.col(f"h{j}")))
    return groups.select("g", "levels", "at", F.array(*[f"p{j}" for j in range(BAND)]).alias("preimages"), F.get(f"h{BAND}", F.lit(0)).alias("top"))


def _bands(placed: DataFrame, height: int) -> list[DataFrame]:
    nodes, bands = placed.select("g", "levels", "idx", "hash"), []
    for low in range(0, max(height, 1), BAND):
        bands.append(durable(_band(nodes, low)))
        nodes = bands[-1].filter(F.col("levels") > low + BAND).select("g", "levels", F.col("at").alias("idx"), F.col("top").alias("hash"))
    return bands


def _roots(bands: list[DataFrame]) -> DataFrame:
    found = [b.filter(F.col("levels") <= (i + 1) * BAND).select("g", F.col("top").alias("hash")) for i, b in enumerate(bands)]
    for b in found[1:]:
        found[0] = found[0].unionByName(b)
    return found[0]


def _steps(idx: Column, preimages: Column) -> Column:
    """Of a node's parents within its group, from below: preimage and the node's slot there."""
    local = (idx % GROUP).cast("int")
    steps = [F.struct(F.get(F.get(preimages, F.lit(j)), _div(local, ARITY ** (j + 1)).cast("int")).alias("preimage"), (_div(local, ARITY**j) % ARITY).cast("int").alias("slot")) for j in range(BAND)]
    return F.filter(F.array(*steps), lambda s: s["preimage"].isNotNull())


def _paths(placed: DataFrame, bands: list[DataFrame], above: DataFrame | None) -> DataFrame:
    """placed with path, subroot and root. above: g with path, subroot and root of its root; None where that is the root."""
    known = None
    for i in reversed(range(len(bands))):
        over = bands[i].filter(F.col("levels") <= (i + 1) * BAND)
        none = F.array().cast("array<struct<preimage:string,slot:int>>")
        over = over.withColumns({"path": none, "subroot": F.col("top"), "root": F.col("top")}) if above is None else over.join(above, "g")
        over = over.select("g", "at", "preimages", "path", "subroot", "root")
        if known is not None:
            under = bands[i].filter(F.col("levels") > (i + 1) * BAND).select("g", "at", "preimages")
            upper = known.select("g", F.col("at").alias("_at"), F.col("preimages").alias("_over"), F.col("path").alias("_path"), "subroot", "root")
            under = under.withColumn("_at", _div(F.col("at"), GROUP)).join(upper, ["g", "_at"])
            path = F.concat(_steps(F.col("at"), F.col("_over")), F.col("_path"))
            over = over.unionByName(under.select("g", "at", "preimages", path.alias("path"), "subroot", "root"))
        known = durable(over)
    leaves = placed.withColumn("at", _div(F.col("idx"), GROUP)).join(known, ["g", "at"])
    return leaves.withColumn("path", F.concat(_steps(F.col("idx"), F.col("preimages")), F.col("path"))).drop("at", "preimages", "levels", "idx")


def merkle_paths(rows: DataFrame, group: str, order: str, leaf: str) -> DataFrame:
    """rows' columns in a struct `rest`, with subroot, root and path: an array of (preimage, slot) from the leaf's parent
    to the parent at the top, first within the leaf's group, then over the groups' subroots.

    Leaves ascend by order (null first), then by leaf; groups by their UTF-8 bytes, null first. Every ARITY consecutive
    nodes, the last fewer, become one, until one remains; a lone leaf is its group's subroot. Rows equal in order and leaf are
    equal leaves, so any order of them is one tree. An empty table gives no rows. Further columns lie untouched in rest.
    """
    g = F.coalesce(F.concat(F.lit("="), field(group).cast("string")), F.lit(""))
    made = rows.select(g.alias("g"), field(order).alias("o"), field(leaf).alias("hash"), F.struct(*[field(c) for c in rows.columns]).alias("rest"))
    placed, height = _placed(made, [F.col("o").asc_nulls_first()])
    bands = _bands(placed, height)
    tops = _roots(bands).select(F.lit("").alias("g"), F.col("g").alias("o"), "hash")
    tops, top_height = _placed(tops, [F.col("o")])
    above = _paths(tops, _bands(tops, top_height), None)
    above = durable(above.select(F.col("o").alias("g"), "path", F.col("hash").alias("subroot"), "root"))
    return _paths(placed, bands, above).select("rest", "path", "subroot", "root")


def siblings(path: Column) -> Column:
    """The digests beside each node on the path, level by level, as one text: preimages without the node's own slot."""
    cut = lambda s: F.concat(F.substring(s["preimage"], F.lit(1), s["slot"] * DIGEST), F.substring(s["preimage"], (s["slot"] + 1) * DIGEST + 1, F.lit(ARITY * DIGEST)))
    return F.array_join(F.transform(path, cut), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path: the digest so far is spliced into its slot, and hashed."""
    return F.aggregate(path, leaf, lambda d, s: digest(F.overlay(s["preimage"], d, s["slot"] * DIGEST + 1, F.lit(DIGEST))))


def manifest(documents: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 of every row, and whether its text, with line ends deleted where 2 divides
    the crc32 of doc_id, still folds to the root.

    Null fields are framed as `-`; a null doc_id isn't tampered with. Repeated rows are leaves of their own. Texts of any
    length are hashed where they lie; only digests are shuffled. Further columns aren't read.
    """
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = F.when(even, F.call_function("replace", F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    values = [F.col(c) for c in FIELDS]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf_digest(values).alias("leaf"), leaf_digest([*values[:-1], changed]).alias("shown"))
    out = merkle_paths(rows, "source", "doc_id", "leaf").withColumn("folded_root", folded(F.col("rest.shown"), F.col("path")))
    proof = digest(siblings(F.col("path")))
    return out.select("rest.doc_id", "rest.leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
