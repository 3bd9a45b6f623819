"""Secret scans in DataFrame functions alone: patterns for known shapes, a randomness test battery for the rest.

Candidates are runs of characters that encodings use. For each the encoding is inferred (hex, base32, base36, base58,
base62, base64) and three tests are made of how it would look if it were drawn at random from that alphabet:
chi-squared uniformity, runs of characters of one class (small, capital, digit), and serial correlation of neighbours.
Words fail them badly, the more so the longer they are; short ones may pass by luck. So each test is turned round,
with the candidate's length: how rarely would ordinary text of that length look so random? These chances are combined,
and Benjamini-Hochberg holds the share of false finds among the distinct candidates of an encoding and class of length
below a rate. That needs the counts of candidates by step of evidence only, a table of bounded size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, field

# The patterns of the known shapes.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
ASSIGN_LENGTH = 8

#: Runs that the battery looks at, and the shortest that it can tell from text.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}+(?![A-Za-z0-9+_=-]))?+"
#: Runs that some alphabet fits. Runs of more than one part are looked at as a whole, where one fits, and cut at each of
#: CUTS, as a path may hold a value; words of a path before and after a part are left off.
ONE_ALPHABET = r"^(?:[A-Za-z0-9+/]{20,}|[A-Za-z0-9_-]{20,})={0,2}$"
CUTS = ("/", "[-_]")
WORDS_BEFORE, WORDS_AFTER = r"^(?:(?:[a-z]+[-_]){0,9}(?:[a-z]{2,}|v[0-9])?/){1,64}", r"(?:/(?:(?:[a-z]+[-_]){0,9}(?:[a-z]{2,}|v[0-9]))?){1,64}$"
FALSE_FINDS = 0.01
#: Evidence (minus the natural logarithm of a chance) is kept in steps of 1 / STEPS up to MOST_EVIDENCE.
STEPS, MOST_EVIDENCE = 8, 40.0
#: Chance below which a run is too uneven for a random one, by any of the tests.
LEAST_RANDOM = 1e-4
#: Ordinary text: the excess of its chi-squared per character as a share of the alphabet's size (words use few of an
#: alphabet's characters and often), the correlation of neighbours, and changes of class per character.
TEXT_UNEVEN, TEXT_SERIAL, TEXT_CHANGES = 0.0375, 0.35, 0.15
#: Weights of the three tests' chances under ordinary text.
WEIGHTS = {"text_chi": 0.4, "text_changes": 0.4, "text_serial": 0.2}
KINDS = ("assign", "access", "hex", "random")

_ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base32lower": "abcdefghijklmnopqrstuvwxyz234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base58": "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}


_SPAN = "array<struct<start:int,kind:int,stop:int,found:string>>"


def _matches(kind: str, pattern: str, group: int) -> dict[str, Column]:
    """Columns of all leftmost non-overlapping matches of a pattern in `text`, and of the gaps around them."""
    has = F.col("text").rlike(pattern)
    none = F.array().cast("array<string>")
    got = {"found": F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), "gap": F.split("text", pattern, -1)}
    if group:
        got["value"] = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    return {f"{kind}_{name}": F.when(has, column).otherwise(none) for name, column in got.items()}


def _spans(kind: str, least: int) -> Column:
    """Matches as spans, from the lengths of gaps and matches, in code points; least: of the value, where there is one."""
    names = ("found", "gap", "value") if least else ("found", "gap")
    parts = F.arrays_zip(*[F.col(f"{kind}_{n}").alias(n) for n in names])
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(a: Column, m: Column) -> Column:
        begin = a["at"] + F.length(m["gap"])
        end = begin + F.coalesce(F.length(m["found"]), F.lit(0))
        span = F.array(F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("stop"), m["found"].alias("found")))
        fits = m["found"].isNotNull() if not least else m["found"].isNotNull() & (F.length(m["value"]) >= least)
        return F.struct(end.alias("at"), F.when(fits, F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(parts, start, step, lambda a: a["spans"])


def _whole_and_parts(runs: Column) -> Column:
    """Of each run the whole and its parts between slashes and between - or _, those that one alphabet fits."""

    def parts(run: Column, cut: str) -> Column:
        start = F.struct(run["start"].alias("at"), F.array().cast(_SPAN).alias("spans"))

        def step(a: Column, part: Column) -> Column:
            before, after = (F.length(F.regexp_extract(part, words, 0)) for words in (WORDS_BEFORE, WORDS_AFTER))
            begin, end = a["at"] + before, a["at"] + F.length(part) - after
            found = F.substring(part, before + 1, end - begin)
            span = F.array(F.struct(begin.alias("start"), run["kind"].alias("kind"), end.alias("stop"), found.alias("found")))
            return F.struct((a["at"] + F.length(part) + 1).alias("at"), F.when(found.rlike(ONE_ALPHABET), F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

        return F.aggregate(F.split(run["found"], cut, -1), start, step, lambda a: a["spans"])

    def all_of(run: Column) -> Column:
        whole = F.filter(F.array(run), lambda r: r["found"].rlike(ONE_ALPHABET))
        return F.when(run["found"].rlike("[/_-]"), F.array_distinct(F.concat(whole, *[parts(run, c) for c in CUTS]))).otherwise(whole)

    return F.flatten(F.transform(runs, all_of))


def _merged(spans: Column) -> Column:
    """Spans in order, those that overlap as one."""

    def step(a: Column, s: Column) -> Column:
        last = F.element_at(a, -1)
        longer = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["stop"], s["stop"]).alias("stop"), last["found"].alias("found"))
        overlaps = F.when(F.size(a) > 0, last["stop"] > s["start"]).otherwise(False)
        return F.when(overlaps, F.concat(F.slice(a, 1, F.size(a) - 1), F.array(longer))).otherwise(F.concat(a, F.array(s)))

    return F.aggregate(F.sort_array(spans), F.array().cast(_SPAN), step)


def _normal_tail(z: Column) -> Column:
    """Chance that a standard normal exceeds z, by the rational approximation of Abramowitz and Stegun 26.2.17."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.greatest(F.when(z >= 0, upper).otherwise(1 - upper), F.lit(1e-18))


def _chi_squared_z(x: Column, degrees: Column) -> Column:
    """Wilson and Hilferty: a chi-squared value as a standard normal one."""
    spread = 2 / (9 * degrees)
    return (F.cbrt(x / degrees) - (1 - spread)) / F.sqrt(spread)


_CLASSES = ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 26 + "A" * 26 + "0" * 10)
#: Of each encoding: how many characters, and how many of them are small, capital, digits and others.
_SIZES = {"hex": (16, 6, 0, 10, 0), "HEX": (16, 0, 6, 10, 0), "base32": (32, 0, 26, 6, 0), "base32lower": (32, 26, 0, 6, 0), "base36": (36, 26, 0, 10, 0), "base58": (58, 25, 24, 9, 0), "base62": (62, 26, 26, 10, 0), "base64": (64, 26, 26, 10, 2), "base64url": (64, 26, 26, 10, 2)}


def _of_encoding(values: dict[str, float | str]) -> Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(F.col("encoding") == name, F.lit(value)).otherwise(out)
    return out


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def battery(found: DataFrame) -> DataFrame:
    """Rows (found) to found, encoding, size (without padding), random (the least chance of the tests under
    randomness) and step (the evidence against ordinary text); runs that fit no encoding go."""
    fits = [F.when(F.translate("body", letters, "") == "", name) for name, letters in _ALPHABETS.items()]
    c = found.select("found", F.regexp_replace("found", "=+$", "").alias("body")).withColumn("encoding", F.coalesce(*fits)).filter("encoding is not null")
    c = c.withColumn("letters", _of_encoding(_ALPHABETS)).withColumn("chars", F.filter(F.split("body", ""), lambda x: x != ""))
    c = c.withColumn("classes", F.filter(F.split(F.translate("body", *_CLASSES), ""), lambda x: x != ""))
    c = c.select("found", "encoding", "classes", "chars", "letters", F.size("chars").alias("size"), F.size("chars").cast("double").alias("n"), _of_encoding({e: float(x[0]) for e, x in _SIZES.items()}).alias("k"))
    c = c.withColumn("digits", F.transform("chars", lambda x: F.call_function("instr", F.col("letters"), x) - 1))
    counts = F.transform(F.array_distinct("digits"), lambda d: F.size(F.filter("digits", lambda e: e == d)).cast("double"))
    c = c.withColumn("squares", _total(F.transform(counts, lambda o: o * o))).withColumn("x", F.transform("digits", lambda d: d - (F.col("k") - 1) / 2))
    products = F.transform(F.slice("x", 1, F.col("size") - 1), lambda a, i: a * F.get("x", i + 1))
    changes = F.transform(F.slice("classes", 1, F.col("size") - 1), lambda a, i: F.when(a == F.get("classes", i + 1), 0.0).otherwise(1.0))
    n, k = F.col("n"), F.col("k")
    c = c.select("found", "encoding", "size", "n", "k", (F.col("squares") * k / n - n).alias("chi"), (_total(products) / ((k * k - 1) / 12 * (n - 1))).alias("serial"), _total(changes).alias("changes"))

    rate = _of_encoding({e: 1 - sum((x / s[0]) ** 2 for x in s[1:]) for e, s in _SIZES.items()})
    c = c.withColumn("rate", rate).withColumn("steps", n - 1).withColumn("excess", TEXT_UNEVEN * k * n)
    steps, excess = F.col("steps"), F.col("excess")
    z = {
        "chi": _chi_squared_z(F.greatest(F.col("chi"), F.lit(1e-6)), k - 1),
        "serial": F.abs(F.col("serial")) * F.sqrt(steps),
        "changes": F.abs(F.col("changes") - steps * F.col("rate")) / F.sqrt(steps * F.col("rate") * (1 - F.col("rate"))),
        "text_chi": (k - 1 + excess - F.col("chi")) / F.sqrt(2 * (k - 1) + 4 * excess),
        "text_changes": (F.col("changes") - steps * TEXT_CHANGES) / F.sqrt(steps * TEXT_CHANGES * (1 - TEXT_CHANGES)),
        "text_serial": (TEXT_SERIAL - F.abs(F.col("serial"))) * F.sqrt(steps),
    }
    # All tails in one lambda: written out for each test, the expression would fill the driver's memory.
    c = c.select("found", "encoding", "size", F.transform(F.array(*z.values()), _normal_tail).alias("tails"))
    tail = {name: F.get("tails", F.lit(i)) for i, name in enumerate(z)}
    random = F.least(tail["chi"], 2 * tail["serial"], 2 * tail["changes"])
    # The tests are not independent: e times a weighted geometric mean of their chances is a chance whatever binds them.
    evidence = -1 - sum(w * F.log(tail[name]) for name, w in WEIGHTS.items())
    evidence = F.when(random >= LEAST_RANDOM, evidence).otherwise(F.lit(0.0))
    step = F.floor(F.greatest(F.lit(0.0), F.least(evidence, F.lit(MOST_EVIDENCE))) * STEPS).cast("int")
    return c.select("found", "encoding", "size", random.alias("random"), step.alias("step"))


def discoveries(tested: DataFrame, rate: float) -> DataFrame:
    """Benjamini-Hochberg within encoding and class of length (doublings): the rows whose evidence suffices."""
    code = _of_encoding({e: i for i, e in enumerate(_SIZES)}) * 64 + F.floor(F.log2("size"))
    tested = tested.withColumn("stratum", code.cast("long"))
    stratum = ["stratum"]
    counts = tested.groupBy(*stratum, "step").agg(F.count("*").alias("n"))
    whole = W.partitionBy(*stratum)
    upto = F.sum("n").over(whole.orderBy(F.desc("step")))
    passes = F.exp(-F.col("step") / STEPS) * F.sum("n").over(whole) <= rate * upto
    # A row per encoding and class of length at most.
    cuts = counts.select(*stratum, "step", passes.alias("passes")).filter("passes and step > 0").groupBy(*stratum).agg(F.min("step").alias("cut"))
    return tested.join(F.broadcast(cuts), stratum).filter("step >= cut")


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


# A broadcast of even a few rows under keys other than one long takes 64 MB of the driver and of each executor, so the
# joins below are merged.


def scan(documents: DataFrame, false_finds: float = FALSE_FINDS) -> DataFrame:
    """doc_id, dk (a hash of the text), base and spans, arrays of (start, kind, stop, found) in order, of each row.

    kind is a place in KINDS. Null texts are empty and have no spans. Repeated rows have the same spans and count
    once among candidates; null doc_ids are rows like any other. Very long texts are searched whole. An empty table gives
    no rows. Further columns, whatever their names, are not read.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("dk", F.xxhash64("text"))
    parts = {k: v for kind, pattern, group in (("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0), ("random", CANDIDATE, 0)) for k, v in _matches(kind, pattern, group).items()}
    matched = docs.select("doc_id", "dk", *[v.alias(k) for k, v in parts.items()])
    base = F.sort_array(F.concat(_spans("assign", ASSIGN_LENGTH), _spans("access", 0), _spans("hex", 0)))
    spanned = matched.select("doc_id", "dk", base.alias("base"), _whole_and_parts(_spans("random", 0)).alias("runs"))
    apart = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["stop"]) & (r["start"] < b["stop"])))
    spanned = durable(spanned.select("doc_id", "dk", "base", apart.alias("runs")))

    runs = spanned.filter(F.size("runs") > 0).select("doc_id", "dk", F.explode("runs").alias("run")).distinct()
    tested = durable(battery(runs.select("run.found").distinct()))
    secret = discoveries(tested, false_finds).select("found")
    hits = runs.withColumn("found", F.col("run.found")).join(secret.hint("merge"), "found").groupBy("doc_id", "dk").agg(_merged(F.collect_list("run")).alias("hits"))
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("dk").alias("_dk"), "hits")
    out = spanned.join(hits.hint("merge"), spanned.doc_id.eqNullSafe(hits["_id"]) & (spanned.dk == hits["_dk"]), "left")
    every = F.sort_array(F.concat("base", F.coalesce("hits", F.array().cast(_SPAN))))
    return out.select("doc_id", "dk", "base", every.alias("spans"))


def find_secrets(documents: DataFrame, false_finds: float = FALSE_FINDS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256 and spans (kind:start:end, joined) of each row; see scan()."""
    count = lambda spans, kind: F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    found = scan(documents, false_finds)
    return found.select("doc_id", count("base", "assign").alias("n_assign"), count("base", "access").alias("n_access"), count("base", "hex").alias("n_hex"), count("spans", "random").alias("n_random"), F.sha2(F.encode(_joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(documents: DataFrame, mark: str = "[secret]", false_finds: float = FALSE_FINDS) -> DataFrame:
    """documents with each stretch of text that spans cover replaced by mark; n_chars, where there is one, follows.
    Further columns pass through, whatever their names; edge cases: scan()."""
    found = scan(documents, false_finds).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "dk"])
    found = found.select(F.col("doc_id").alias("of"), F.col("dk").alias("key"), "spans")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("dk"), "text", F.struct(*[field(c) for c in documents.columns if c != "text"]).alias("rest"))
    both = rows.join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("dk") == F.col("key")), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("kept"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"])
        return F.when(s["start"] >= a["at"], F.struct(s["stop"].alias("at"), F.concat(a["kept"], gap, F.lit(mark)).alias("kept"))).otherwise(F.struct(F.greatest(a["at"], s["stop"]).alias("at"), a["kept"].alias("kept")))

    text = F.aggregate("spans", start, step, lambda a: F.concat(a["kept"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    out = both.select("rest", F.col("spans").isNotNull().alias("changed"), F.when(F.col("spans").isNull(), F.col("text")).otherwise(text).alias("redacted"))
    columns = {c: field(c, "rest") for c in documents.columns if c != "text"} | {"text": F.col("redacted")}
    if "n_chars" in documents.columns:
        columns["n_chars"] = F.when(F.col("changed"), F.length("redacted")).otherwise(F.col("rest.n_chars")).cast(documents.schema["n_chars"].dataType)
    return out.select(*[columns[c].alias(c) for c in documents.columns])
