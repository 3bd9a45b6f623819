"""Append, replace and upsert of contract tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

IDENTITY = ("project_id", "contract_no", "winner_tin")


def append(base: DataFrame, incoming: DataFrame) -> DataFrame:
    return base.unionByName(incoming, allowMissingColumns=True)


def latest(df: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """The last row of each key."""
    w = W.partitionBy(*key).orderBy(F.desc(order))
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def upsert(base: DataFrame, incoming: DataFrame, key: tuple[str, ...] = IDENTITY, order: str | None = None) -> DataFrame:
    """base with incoming's values where they are not blank, and its new rows, as one full join; merge_kind says added,
    updated or kept. Keys must be unique in base; of equal keys in incoming the last by `order` counts, or without one
    the greatest by all of its columns. Where base has the order too, an incoming row that comes before it changes nothing,
    and the later order stays."""
    if order:
        new = latest(incoming, key, order)
    else:
        rest = F.struct(*[F.col(c) for c in incoming.columns if c not in key])
        new = incoming.groupBy(*key).agg(F.max(rest).alias("_row")).select(*key, "_row.*")
    stale = F.lit(False)
    if order and order in base.columns:
        stale = F.coalesce(F.col(f"n_{order}") < F.col(f"b_{order}"), F.lit(False))
    elif order:
        new = new.drop(order)
    values = [c for c in base.columns if c not in key]
    b = base.select(*[F.col(c).alias(f"b_{c}") for c in base.columns], F.lit(1).alias("_b"))
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in base.columns if c in new.columns], F.lit(1).alias("_n"))
    on = None
    for c in key:
        same = F.col(f"b_{c}").eqNullSafe(F.col(f"n_{c}"))
        on = same if on is None else on & same
    both = b.join(n, on, "full")
    there = lambda c: F.when(~stale & (F.trim(F.col(f"n_{c}").cast("string")) != ""), F.col(f"n_{c}"))
    merged = {c: F.coalesce(there(c), F.col(f"b_{c}")) if c in new.columns else F.col(f"b_{c}") for c in values}
    changed = F.lit(False)
    for c in values:
        changed = changed | ~merged[c].eqNullSafe(F.col(f"b_{c}"))
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_n").isNotNull() & changed, "updated").otherwise("kept")
    keys = [F.when(F.col("_b").isNotNull(), F.col(f"b_{c}")).otherwise(F.col(f"n_{c}")).alias(c) for c in key]
    return both.select(*keys, *[merged[c].alias(c) for c in values], kind.alias("merge_kind"))


def changes(base: DataFrame, merged: DataFrame, key: tuple[str, ...] = IDENTITY) -> DataFrame:
    """A row per cell that an upsert changed: the key, field, before and after, both as text."""
    values = [c for c in base.columns if c not in key]
    new = merged.filter("merge_kind = 'updated'").select(*[F.col(c).alias(f"n_{c}") for c in base.columns])
    on = None
    for c in key:
        same = F.col(c).eqNullSafe(F.col(f"n_{c}"))
        on = same if on is None else on & same
    cell = lambda c: F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("before"), F.col(f"n_{c}").cast("string").alias("after"))
    differ = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"n_{c}")), cell(c)) for c in values]))
    return base.join(new, on).select(*key, F.explode(differ).alias("cell")).select(*key, "cell.*")


def change_examples(changed: DataFrame, key: tuple[str, ...] = IDENTITY, each: int = 5) -> DataFrame:
    """Each field's number of changed cells, n, beside its first `each` changes in order of the key."""
    counts = changed.groupBy("field").agg(F.count("*").alias("n"))
    # The limit on the row number acts before the shuffle, so a task gets no more than `each` rows from each of the others.
    first = changed.withColumn("nth", F.row_number().over(W.partitionBy("field").orderBy(*key))).filter(F.col("nth") <= each)
    return first.join(counts, "field").select("field", "n", "nth", *key, "before", "after")


def report(df: DataFrame, key: tuple[str, ...] = IDENTITY) -> DataFrame:
    """One row: rows, repeated keys, gaps per column."""
    gaps = [F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(f"blank_{c}") for c in df.columns]
    repeated = df.groupBy(*key).agg(F.count("*").alias("n")).agg(F.count("*").alias("n_keys"), F.sum(F.col("n") - 1).alias("n_repeated"))
    return df.agg(F.count("*").alias("n"), *gaps).join(F.broadcast(repeated))
