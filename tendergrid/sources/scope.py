"""What a file covers, told from its rows: the order they stand in, where a search was cut off, what was searched for.

Rows are never sorted or gathered: each split of a file checks its own rows in the order they are read and sends one row a
column, and a window over these few rows compares the borders. Files count one after another by path.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import EXPORT_CAPS, SEARCH_WORDS, SORT_FIELDS

_SPLIT = "file string, start long, field string, n long, n_missing long, n_up long, first double, last double, least double"


class _Run:
    """The rows of one split so far, of one column."""

    def __init__(self) -> None:
        self.n = self.missing = self.up = 0
        self.first = self.last = float("nan")
        self.least = float("inf")

    def add(self, values: np.ndarray) -> None:
        before = np.concatenate([[self.last], values[:-1]]) if self.n else np.concatenate([[np.nan], values[:-1]])
        if not self.n:
            self.first = values[0]
        gone = np.isnan(values)
        self.n, self.missing, self.up, self.last = self.n + len(values), self.missing + int(gone.sum()), self.up + int((values > before).sum()), values[-1]
        if not gone.all():
            self.least = min(self.least, float(np.nanmin(values)))


def row_order(files: DataFrame, fields: Iterable[str] = SORT_FIELDS) -> DataFrame:
    """Per field of files (a DataFrame as read from files): n rows, n_missing without a number, n_up whose number is above
    the row's before, least, and falling: all have a number and none is above the one before. No rows: no result rows."""
    fields = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, runs = None, []
        plain = lambda x: None if np.isnan(x) or np.isinf(x) else float(x)

        def told() -> pa.RecordBatch:
            rows = [(at[0], at[1], f, r.n, r.missing, r.up, plain(r.first), plain(r.last), plain(r.least)) for f, r in zip(fields, runs)]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 3, *[pa.float64()] * 3])], [x.split()[0] for x in _SPLIT.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            names, starts = pc.dictionary_encode(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            code = names.indices.to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(code) != 0) | (np.diff(starts) != 0)) + 1), batch.num_rows]
            columns = [batch.column(2 + j).to_numpy(zero_copy_only=False).astype(float) for j in range(len(fields))]
            for lo, hi in zip(cuts, cuts[1:]):
                here = (names.dictionary[int(code[lo])].as_py(), int(starts[lo]))
                if here != at:
                    if at is not None:
                        yield told()
                    at, runs = here, [_Run() for _ in fields]
                for r, values in zip(runs, columns):
                    r.add(values[lo:hi])
        if at is not None:
            yield told()

    rows = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), *[F.col(f).try_cast("double").alias(f) for f in fields])
    splits = rows.mapInArrow(run, _SPLIT)
    # A row per split and field.
    border = F.col("first") > F.lag("last").over(W.partitionBy("field").orderBy("file", "start"))
    each = splits.withColumn("_border", F.coalesce(border, F.lit(False)).cast("long")).groupBy("field").agg(F.sum("n").alias("n"), F.sum("n_missing").alias("n_missing"), F.sum(F.col("n_up") + F.col("_border")).alias("n_up"), F.min("least").alias("least"))
    return each.withColumn("falling", (F.col("n_missing") == 0) & (F.col("n_up") == 0))


def file_scope(files: DataFrame, fields: Iterable[str] = SORT_FIELDS, name: str = "project_name", words: Iterable[str] = SEARCH_WORDS, project: str = "project_id") -> DataFrame:
    """One row: sort_key, the first field that falls from row to row (the file is the head of a search); cutoff_value, its
    least; projects and contracts; looks_capped: sorted, and as many projects as exports stop at; name_keyword, the first
    word that 99.9 % of the names hold, and its share. A null name holds no word; an empty file has nulls and zeros."""
    fields, words = list(fields), list(words)
    order = F.array_position(F.array(*map(F.lit, fields)), F.col("field"))
    key = row_order(files, fields).filter("falling").agg(F.min_by("field", order).alias("sort_key"), F.min_by("least", order).alias("cutoff_value"))
    share = [F.count_if(F.coalesce(F.col(name), F.lit("")).contains(w)) / F.nullif(F.count("*"), F.lit(0)) for w in words]
    told = files.agg(F.count_distinct(project).alias("n_projects"), F.count("*").alias("n_contracts"), *[s.alias(f"_{i}") for i, s in enumerate(share)])
    held = F.coalesce(*[F.when(F.col(f"_{i}") >= 0.999, F.struct(F.lit(w).alias("w"), F.col(f"_{i}").alias("s"))) for i, w in enumerate(words)])
    # One row each.
    both = told.withColumn("_one", F.lit(1)).join(key.withColumn("_one", F.lit(1)), "_one")
    return both.select("sort_key", "cutoff_value", "n_projects", "n_contracts", (F.col("sort_key").isNotNull() & F.col("n_projects").isin(*EXPORT_CAPS)).alias("looks_capped"), held["w"].alias("name_keyword"), F.round(held["s"], 6).alias("keyword_share"))
