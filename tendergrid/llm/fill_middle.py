"""Fill-in-the-middle over relational units: each text is cut at two of its units, and its pieces are put in another order.

1. Units are rows: the matches of UNIT, posexploded with their ordinals. A text comes apart in stretches of STRETCH
   units first, so that no array holds a row for each word of a very long text.
2. Cut requests are rows (document, name, ordinal). Units between two requested ordinals are summed where they lie, so
   at most one run per request, and one for the rest, leaves a task; window running sums of the run lengths give
   the offset after each run's last unit.
3. Requests join the running sums by unit ordinal, offsets are aggregated per document, and substring cuts the text.
   Texts that stay plain are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, field

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
STRETCH = 512
#: The possessive repetition runs as a loop: no recursion, however long the text.
_STRETCHES = rf"(?:{UNIT}){{1,{STRETCH}}}+"

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of 100: documents that are cut, and those of them with the suffix first.
CUT, SUFFIX_FIRST = 50, 80


def _units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def _stretches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_STRETCHES), F.lit(0))


def _n_units(stretches: Column) -> Column:
    """All stretches but the last are full."""
    last = F.size(_units(F.element_at(stretches, -1)))
    return F.when(F.size(stretches) > 0, (F.size(stretches) - 1) * STRETCH + last).otherwise(F.lit(0)).cast("long")


def _drawn(doc_id: Column, seed: int, i: int) -> Column:
    """The i-th 8-digit group of the hash of seed and doc_id, as an unsigned integer."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long")


def _form(text: Column, doc_id: Column, seed: int, cut: int, suffix_first: int) -> Column:
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(mark))
    plain = (text == "") | marked | (_drawn(doc_id, seed, 3) % 100 >= cut)
    return F.when(plain, "plain").when(_drawn(doc_id, seed, 4) % 100 < suffix_first, "spm").otherwise("psm")


def cut_offsets(texts: DataFrame, requests: dict[str, Column]) -> DataFrame:
    """(doc_id, k) with n and, for each request, the code points up to the end of the unit that it names.

    texts: doc_id, k, text, which rows of one (doc_id, k) share. requests: name to a unit ordinal from 0 (before all units) to n, over doc_id and n.
    """
    key, names = ["doc_id", "k"], list(requests)
    apart = texts.select(*key, _stretches(F.col("text")).alias("stretches"))
    apart = apart.select(*key, "stretches", _n_units(F.col("stretches")).alias("n"))
    apart = apart.select(*key, "n", *[requests[name].alias(name) for name in names], F.posexplode("stretches").alias("stretch", "part"))
    units = apart.select(*key, "n", *names, "stretch", F.posexplode(_units(F.col("part"))).alias("at", "unit"))
    ordinal = F.col("stretch").cast("long") * STRETCH + F.col("at") + 1
    units = units.select(*key, "n", *names, ordinal.alias("ordinal"), F.length("unit").alias("length"))
    # A run ends at the first requested ordinal from here on, or at the last unit.
    upto = F.least(*[F.when(F.col(name) >= F.col("ordinal"), F.col(name)) for name in names], F.col("n"))
    # Rows of one key are copies: each has one unit that ends the run.
    copies = F.count_if(F.col("ordinal") == F.col("upto"))
    runs = units.withColumn("upto", upto).groupBy(*key, "n", *names, "upto").agg(F.sum("length").alias("length"), copies.alias("copies"))
    line = W.partitionBy(*key).orderBy("upto")
    runs = durable(runs.select(*key, "n", *names, "upto", F.sum(F.call_function("div", F.col("length"), F.col("copies"))).over(line).alias("offset")))
    last = runs.filter(F.col("upto") == F.col("n"))
    asked = last.select(*key, "n", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("upto")) for name in names])).alias("r"))
    asked = asked.select(*key, "n", "r.name", "r.upto").alias("a")
    found = asked.join(runs.select(*key, "upto", "offset").alias("r"), F.col("a.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("a.k") == F.col("r.k")) & (F.col("a.upto") == F.col("r.upto")), "left")
    at = lambda name: F.max(F.when(F.col("a.name") == name, F.coalesce("r.offset", F.lit(0)))).alias(name)
    return found.groupBy("a.doc_id", "a.k").agg(F.max("a.n").alias("n"), *map(at, names))


def fill_middle(documents: DataFrame, seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """documents' columns in a struct `rest`, with n (units), form, prefix_chars, middle_chars and output.

    Of 100 documents, `cut` are cut at two units that seed and doc_id draw, and `suffix_first` of 100 such have the form
    spm (suffix, prefix, middle), the others psm. The rest, empty texts and texts that hold a mark are plain: output is
    the text, and the lengths are null.

    Null text: empty. Null doc_id: drawn as the empty string. Rows of one doc_id draw alike and are cut each by its own
    text; repeated rows give equal rows. Very long texts are taken in stretches of units. An empty table gives no rows.
    Further columns lie untouched in rest, whatever their names.
    """
    text = F.coalesce("text", F.lit(""))
    whole = documents.select(F.struct(*[field(c) for c in documents.columns]).alias("rest"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    whole = whole.withColumn("form", _form(F.col("text"), F.col("doc_id"), seed, cut, suffix_first)).withColumn("k", F.xxhash64("text"))

    plain = whole.filter("form = 'plain'").withColumn("stretches", _stretches(F.col("text")))
    none = F.lit(None).cast("long")
    plain = plain.select("rest", _n_units(F.col("stretches")).alias("n"), "form", none.alias("prefix_chars"), none.alias("middle_chars"), F.col("text").alias("output"))

    parted = whole.filter("form != 'plain'")
    drawn = [_drawn(F.col("doc_id"), seed, i) % (F.col("n") + 1) for i in (1, 2)]
    offsets = cut_offsets(parted.select("doc_id", "k", "text"), {"lo": F.least(*drawn), "hi": F.greatest(*drawn)})
    offsets = offsets.select(F.col("doc_id").alias("_doc"), F.col("k").alias("_k"), "n", "lo", "hi")
    joined = parted.join(offsets, parted.doc_id.eqNullSafe(offsets._doc) & (parted.k == offsets._k))
    one = F.lit(1).cast("int")
    lo, hi = F.col("lo").cast("int"), F.col("hi").cast("int")
    prefix, middle = F.substring("text", one, lo), F.substring("text", lo + 1, hi - lo)
    suffix = F.substring("text", hi + 1, F.length("text"))
    joined = joined.select("rest", "n", "form", prefix.alias("prefix"), middle.alias("middle"), suffix.alias("suffix"), lo.alias("lo"), (hi - lo).alias("mid"))
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "spm", spm).otherwise(psm)
    return plain.unionByName(joined.select("rest", "n", "form", F.col("lo").cast("long").alias("prefix_chars"), F.col("mid").cast("long").alias("middle_chars"), output.alias("output")))


def restored(output: Column, form: Column) -> Column:
    """The text that output was made of. A mark holds one '<', its first character, so none arises where pieces meet."""
    second = F.when(form == "spm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX))
    two, three = F.call_function("locate", second, output), F.call_function("locate", F.lit(MIDDLE), output)
    skip = F.when(form == "spm", F.lit(len(SUFFIX))).otherwise(F.lit(len(PREFIX)))
    a = F.substring(output, skip + 1, two - skip - 1)
    b = F.substring(output, two + F.length(second), three - two - F.length(second))
    middle = F.substring(output, three + len(MIDDLE), F.length(output))
    return F.when(form == "plain", output).when(form == "spm", F.concat(b, middle, a)).otherwise(F.concat(a, middle, b))


def fill_middle_digests(documents: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and digests of the output and of the text restored from it."""
    out = fill_middle(documents)
    kept = F.sha2(restored(F.col("output"), F.col("form")), 256)
    return out.select("rest.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), kept.alias("restored_sha256"))
