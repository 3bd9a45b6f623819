"""Quality rules under weak supervision, in DataFrame functions alone.

Each rule votes +1 (good) or -1 (bad) or abstains (0). The votes of a document form a pattern, of which there are at
most 3 to the power of the number of rules; expectation-maximisation over the counts of patterns, one fold over one
row, estimates the share of good documents and each rule's two accuracies, among its votes on good and on bad
documents: a rule that also praises bad documents so loses its say. A document is kept by the posterior of its pattern. Statistics are counted over all documents and whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, words_of

ROUNDS = 25
#: Where the share of good documents and the accuracies on good and on bad ones start; the estimates are drawn
#: there as by PRIOR_VOTES votes, and the accuracies stay within bounds.
START_GOOD, START_RIGHT, START_CAUGHT, PRIOR_VOTES = 0.8, 0.9, 0.4, 20.0
RIGHT_BOUNDS, CAUGHT_BOUNDS = (0.5, 0.99), (0.02, 0.99)
KEEP_AT = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SPACES = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


def _count_of(text: str, chars: str) -> Column:
    """How many of a text's characters are among chars."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules judge, of each row."""
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.translate(x, _SPACES, "") != "")
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cut = base.select("doc_id", "text", words_of(F.col("text")).alias("words"), lines.alias("lines"))
    word = lambda i: F.get("words", i)
    windows = F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, word(i + 1), word(i + 2)).alias("h"), i.alias("i")))
    short = F.filter("words", lambda x: (F.length(x) <= 3) & x.rlike(r"^\p{L}+$"))
    plain = F.filter("words", lambda x: x.rlike(r"^\p{L}+[.,;:!?]?$"))
    ended = F.filter("lines", lambda x: x.rlike(r"[.!?…\"'»”)][\x20\x09-\x0D]*$"))
    counted = cut.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.sort_array(windows).alias("sorted"), (F.length("text") - _count_of("text", _SPACES)).cast("long").alias("word_chars"),
        _count_of("text", _SYMBOLS).cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"), F.size(ended).cast("long").alias("n_ended"),
        _count_of("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"), _count_of("text", "0123456789").cast("long").alias("n_digits"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"), F.size(short).cast("long").alias("n_short"), F.size(plain).cast("long").alias("n_plain"),
    )
    other = [c for c in counted.columns if c != "sorted"]
    near = lambda x, i: F.coalesce(x["h"] == F.get("sorted", i)["h"], F.lit(False))
    again = F.filter("sorted", lambda x, i: near(x, i - 1) | near(x, i + 1))
    starts = counted.select(*other, F.sort_array(F.transform(again, lambda x: x["i"])).alias("starts"))
    covered = F.transform("starts", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("starts", i + 1) - x, F.lit(3))))
    return starts.select(*other, F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"))


def votes() -> dict[str, Column]:
    """The rules, each by name a column of -1, 0 or 1 over statistics()."""
    return {
        "length": _vote(F.col("n_words") >= 80, F.col("n_words") < 20),
        "word_length": _vote(_share("word_chars", "n_words").between(3, 10), ~_share("word_chars", "n_words").between(2, 14)),
        "symbols": _vote(_share("n_symbols", "n_words") <= 0.03, _share("n_symbols", "n_words") > 0.1),
        "repeated_lines": _vote(_share("n_dup_lines", "n_lines") <= 0.1, _share("n_dup_lines", "n_lines") > 0.3),
        "repeated_words": _vote(_share("n_repeat_words", "n_words") <= 0.2, _share("n_repeat_words", "n_words") > 0.4),
        "line_ends": _vote(_share("n_ended", "n_lines") >= 0.5, _share("n_ended", "n_lines") < 0.1),
        "upper_case": _vote(_share("n_upper", "word_chars") <= 0.15, _share("n_upper", "word_chars") > 0.4),
        "digits": _vote(_share("n_digits", "word_chars") <= 0.1, _share("n_digits", "word_chars") > 0.3),
        "short_words": _vote(_share("n_short", "n_words") >= 0.15, _share("n_short", "n_words") < 0.08),
        "plain_words": _vote(_share("n_plain", "n_words") >= 0.8, _share("n_plain", "n_words") < 0.65),
        "variety": _vote(_share("n_distinct", "n_words") >= 0.2, _share("n_distinct", "n_words") < 0.05),
    }


def _log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def _posterior(pattern: Column, state: Column) -> Column:
    praise = F.zip_with(state["right"], state["caught"], lambda r, c: F.log(r / (1 - c)))
    blame = F.zip_with(state["right"], state["caught"], lambda r, c: F.log((1 - r) / c))
    said = F.zip_with(pattern["votes"], F.arrays_zip(praise.alias("p"), blame.alias("b")), lambda v, w: F.when(v > 0, w["p"]).when(v < 0, w["b"]).otherwise(F.lit(0.0)))
    return 1 / (1 + F.exp(-(_log_odds(state["good"]) + _total(said))))


def _within(x: Column, bounds: tuple[float, float]) -> Column:
    return F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), x))


def fit(patterns: DataFrame, rules: int, rounds: int = ROUNDS) -> DataFrame:
    """Rows (votes array, n) to votes and quality, the posterior probability of a good document."""
    one = patterns.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("votes"), F.col("n").cast("double").alias("n")))).alias("patterns"))

    def step(state: Column, _: Column) -> Column:
        judged = F.transform("patterns", lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), (p["n"] * _posterior(p, state)).alias("good"), (p["n"] * (1 - _posterior(p, state))).alias("bad")))

        def update(js: Column) -> Column:
            def rate(j: Column, side: str, sign: int, start: float, bounds: tuple[float, float]) -> Column:
                agreed = _total(F.transform(js, lambda p: F.when(sign * F.get(p["votes"], j) > 0, p[side]).otherwise(F.lit(0.0))))
                voted = _total(F.transform(js, lambda p: p[side] * F.abs(F.get(p["votes"], j))))
                return _within((agreed + PRIOR_VOTES * start) / (voted + PRIOR_VOTES), bounds)

            every = F.sequence(F.lit(0), F.lit(rules - 1))
            good = (_total(F.transform(js, lambda p: p["good"])) + PRIOR_VOTES * START_GOOD) / (_total(F.transform(js, lambda p: p["n"])) + PRIOR_VOTES)
            right = F.transform(every, lambda j: rate(j, "good", 1, START_RIGHT, RIGHT_BOUNDS))
            caught = F.transform(every, lambda j: rate(j, "bad", -1, START_CAUGHT, CAUGHT_BOUNDS))
            return F.struct(_within(good, (0.01, 0.99)).alias("good"), right.alias("right"), caught.alias("caught"))

        return F.get(F.transform(F.array(judged), update), F.lit(0))

    start = F.struct(F.lit(START_GOOD).alias("good"), F.array_repeat(F.lit(START_RIGHT), rules).alias("right"), F.array_repeat(F.lit(START_CAUGHT), rules).alias("caught"))
    fitted = one.select("patterns", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("state"))
    judged = F.transform("patterns", lambda p: F.struct(p["votes"].alias("votes"), _posterior(p, F.col("state")).alias("quality")))
    return fitted.select(F.explode(judged).alias("x")).select("x.votes", "x.quality")


def judge_quality(documents: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and quality, the
    posterior, of each row.

    Null and empty texts have no words and fail. Repeated rows, which count as often as they stand there, and null
    doc_ids are rows like any other. An empty table gives no rows. Further columns are not read.
    """
    rules = votes()
    counted = durable(statistics(documents).withColumn("votes", F.array(*rules.values())))
    # At most 3 ** len(rules) patterns, of a few dozen bytes each.
    judged = fit(counted.groupBy("votes").agg(F.count("*").alias("n")), len(rules))
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = counted.join(F.broadcast(judged), "votes", "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & (F.col("quality") >= keep_at)).alias("kept"), "quality")
