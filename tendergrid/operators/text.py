"""Project names: groups, anatomy, places and near-repeated names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import all_groups, first_group, place_of
from ..functions.values import ANATOMY, NAME_LEAD, NAME_TAIL, NO_WORD_END, NO_WORD_START, PHRASE_ENDS
from ..tables import written


def tokens(name: Column) -> Column:
    """Distinct words of a name that are longer than two characters; brackets and quotes part words, as white space does."""
    return F.array_distinct(F.filter(F.split(F.coalesce(name, F.lit("")), "(?U)[\\s()\"'“”]+"), lambda w: F.length(w) > 2))


def classify(df: DataFrame, groups, column: str = "project_name") -> DataFrame:
    return df.withColumn("groups", all_groups(F.col(column), groups)).withColumn("primary_group", first_group(F.col(column), groups))


def group_counts(df: DataFrame, groups, column: str = "project_name") -> DataFrame:
    found = classify(df, groups, column)
    any_ = found.select(F.explode("groups").alias("group")).groupBy("group").agg(F.count("*").alias("n_any"))
    first = found.groupBy(F.col("primary_group").alias("group")).agg(F.count("*").alias("n_primary"))
    return first.join(any_, "group", "full").select("group", F.coalesce("n_any", F.lit(0)).alias("n_any"), F.coalesce("n_primary", F.lit(0)).alias("n_primary"))


def _by_set(df: DataFrame, groups, column: str) -> DataFrame:
    """Rows per different list of groups; there are few such lists."""
    return df.select(all_groups(F.col(column), groups).alias("groups")).groupBy("groups").agg(F.count("*").alias("n"))


def group_overlaps(df: DataFrame, groups, column: str = "project_name", top: int = 8) -> DataFrame:
    """The pairs of groups (a, b, n) that most names are in both of, a before b; ties in order of a and b."""
    pairs = F.flatten(F.transform("groups", lambda x, i: F.transform(F.filter("groups", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    both = _by_set(df, groups, column).select("n", F.explode(pairs).alias("pair")).groupBy("pair.a", "pair.b").agg(F.sum("n").alias("n"))
    return both.orderBy(F.desc("n"), "a", "b").limit(top)


def group_coverage(df: DataFrame, groups, column: str = "project_name") -> DataFrame:
    """One row: names, those in any group, their share, and the share of names in several; shares of no names are 0."""
    size = F.size("groups")
    found = _by_set(df, groups, column).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(size > 0, F.col("n"))), F.lit(0)).alias("matched"), F.coalesce(F.sum(F.when(size > 1, F.col("n"))), F.lit(0)).alias("several"))
    share = lambda part: F.round(F.col(part) / F.greatest("n", F.lit(1)), 6)
    return found.select("n", "matched", share("matched").alias("coverage"), share("several").alias("multi_share"))


def anatomy(df: DataFrame, column: str = "project_name", parts=ANATOMY) -> DataFrame:
    counts = df.agg(F.count("*").alias("total"), *[F.count_if(F.col(column).rlike(f"(?U){p}")).alias(k) for k, p in parts])
    rows = F.array(*[F.struct(F.lit(k).alias("part"), F.col(k).alias("n")) for k, _ in parts])
    return counts.select(F.explode(rows).alias("x"), "total").select("x.part", "x.n", F.round(F.col("x.n") / F.greatest("total", F.lit(1)), 6).alias("share"))


def term_counts(df: DataFrame, column: str = "project_name", least: int = 5) -> DataFrame:
    """How many names hold a term, each once per name."""
    return df.select(F.explode(tokens(F.col(column))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def repeated_places(df: DataFrame, least: int = 3) -> DataFrame:
    """Places that the names of an agency's contracts give `least` times or more; a price that is null counts as 0."""
    placed = df.withColumn("place", place_of(F.col("project_name"))).filter(F.col("place").isNotNull())
    return placed.groupBy("dept_key", "place").agg(F.count("*").alias("n"), F.coalesce(F.sum("contract_price_agree").cast("double"), F.lit(0.0)).alias("value")).filter(F.col("n") >= least)


def _bare(name: Column) -> Column:
    """A name without what all names share."""
    left = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), NAME_TAIL, ""), NAME_LEAD, "")
    return F.trim(F.regexp_replace(left, r"(?U)\s+", " "))


def _as_word(term: Column) -> Column:
    """A term without signs that can't end or begin a word."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(term, NO_WORD_END, ""), NO_WORD_START, ""), r"(?U)^[\s\-–—.,]+|[\s\-–—.,]+$", "")


def grown_terms(phrases: DataFrame, least: int, shortest: int, longest: int, keeps: float = 0.7) -> DataFrame:
    """term, n of terms that begin phrases. phrases: (name_id, phrase).

    Prefixes of phrases are counted once a name. Each frequent prefix of the shortest length grows by the commonest next
    character while at least `keeps` of its own count remains; of ties the first character goes on.
    """
    lengths = F.sequence(F.lit(shortest), F.least(F.length("phrase"), F.lit(longest)))
    each = phrases.filter(F.length("phrase") >= shortest).select("name_id", F.explode(F.transform(lengths, lambda n: F.substring(F.col("phrase"), F.lit(1), n))).alias("prefix"))
    counts = written(each.distinct().groupBy("prefix").agg(F.count("*").alias("n")).filter(F.col("n") >= max(1, -(-int(100 * keeps) * least // 100))))
    seeds = counts.filter((F.length("prefix") == shortest) & (F.col("n") >= least)).select(F.col("prefix").alias("seed"), F.col("n").alias("seed_n"))
    longer = counts.filter(F.length("prefix") > shortest).withColumn("seed", F.substring("prefix", 1, shortest)).join(seeds, "seed").filter(F.col("n") >= keeps * F.col("seed_n"))
    # Few prefixes of a seed keep so much of its count: at each length one or, where names hold several phrases, a few.
    step = F.struct(F.length("prefix").alias("size"), (-F.col("n")).alias("order"), "prefix", "n")
    steps = longer.groupBy("seed").agg(F.sort_array(F.collect_list(step)).alias("steps"))
    start = F.struct(F.col("seed").alias("term"), F.col("seed_n").alias("n"))
    goes_on = lambda at, s: (s["size"] == F.length(at["term"]) + 1) & s["prefix"].startswith(at["term"])
    grown = F.aggregate(F.coalesce("steps", F.array().cast(steps.schema["steps"].dataType)), start, lambda at, s: F.when(goes_on(at, s), F.struct(s["prefix"].alias("term"), s["n"].alias("n"))).otherwise(at))
    out = seeds.join(steps, "seed", "left").select(grown.alias("g")).select(_as_word(F.col("g.term")).alias("term"), "g.n")
    return out.filter(F.length("term") >= shortest).groupBy("term").agg(F.max("n").alias("n"))


def _occurrences(names: DataFrame, terms: DataFrame, shortest: int) -> DataFrame:
    """name_id, term, place of each term in each name: places meet terms by their first characters, then the whole term is compared."""
    places = F.sequence(F.lit(1), F.greatest(F.length("name") - shortest + 1, F.lit(1)))
    at = names.filter(F.length("name") >= shortest).select("name_id", "name", F.explode(places).alias("place")).withColumn("head", F.substring("name", F.col("place"), F.lit(shortest)))
    keyed = terms.select("term", F.substring("term", 1, shortest).alias("head"))
    return at.join(keyed, "head").filter(F.substring("name", F.col("place"), F.length("term")) == F.col("term"))


def mine_terms(df: DataFrame, groups, column: str = "project_name", least: int = 3, shortest: int = 4, longest: int = 32, top: int = 25) -> DataFrame:
    """Terms that would tell names apart which no group fits: term, n (names without a group that begin a phrase with it), leak (names
    with a group that hold it), hit and leak_rate (their shares), score = hit - leak_rate.

    A term must be three times as common without a group as with one, must not follow a number in 60 % of its places (it
    is a unit then), and neither holds nor lies in a better one. All names count; the terms, a bounded table of frequent prefixes, are taken
    in order until `top` are kept. Null names are empty.
    """
    bare = df.select(F.monotonically_increasing_id().alias("name_id"), _bare(F.col(column)).alias("name"), (F.size(all_groups(F.col(column), groups)) > 0).alias("known"))
    bare = written(bare)
    sizes = bare.agg(F.count_if(~F.col("known")).alias("new"), F.count_if("known").alias("known")).first()
    new, known = bare.filter(~F.col("known")), bare.filter("known")
    phrase = F.trim(F.regexp_replace(F.col("phrase"), "[0-9๐-๙]+", " "))
    phrases = new.select("name_id", F.explode(F.split("name", PHRASE_ENDS)).alias("phrase")).withColumn("phrase", phrase)
    terms = written(grown_terms(phrases, least, shortest, longest))
    leaks = _occurrences(known, terms, shortest).groupBy("term").agg(F.count_distinct("name_id").alias("leak"))
    before = F.substring("name", F.greatest(F.col("place") - 4, F.lit(1)), F.least(F.col("place") - 1, F.lit(4)))
    units = _occurrences(new, terms, shortest).groupBy("term").agg((F.count_if(before.rlike("(?U)[0-9๐-๙][\\s.,]*$")) / F.count("*")).alias("after_number"))
    both = terms.join(leaks, "term", "left").join(units, "term", "left").withColumn("leak", F.coalesce("leak", F.lit(0)))
    both = both.withColumns({"hit": F.col("n") / max(sizes["new"], 1), "leak_rate": F.col("leak") / max(sizes["known"], 1)})
    # A bounded table: the tests of one term against those kept before it have an order.
    ordered = written(both.filter(F.col("hit") >= 3 * F.col("leak_rate")).withColumn("score", F.col("hit") - F.col("leak_rate")))
    kept: list = []
    for r in ordered.orderBy(F.desc("score"), F.desc("n"), F.desc(F.length("term")), "term").toLocalIterator():
        if len(kept) == top:
            break
        if (r["after_number"] or 0) < 0.6 and not any(k["term"] in r["term"] or r["term"] in k["term"] for k in kept):
            kept.append(r)
    rows = [(r["term"], r["n"], r["leak"], round(r["hit"], 6), round(r["leak_rate"], 6), round(r["score"], 6)) for r in kept]
    return df.sparkSession.createDataFrame(rows, "term string, n long, leak long, hit double, leak_rate double, score double")


def near_repeats(df: DataFrame, by: list[str], days: int = 30, percent: int = 80, column: str = "project_name") -> DataFrame:
    """Pairs of contracts of one agency, other projects, within some days, whose names share most of their words.

    Names repeat, so each different list of words is compared once: candidates share one of their rarest words, as two such
    lists must, and have sizes that permit the threshold. Contracts then meet by agency, list of a similar pair and date bucket of
    `days`, their own and the one before; what meets is what is found, but for the days.

    A contract that has several rows may be found with another one more than once. Only pairs of which that may be so, by
    the days of their rows, are made distinct; all others, which are found once, are never shuffled.
    """
    t = df.filter(F.col("contract_date").isNotNull()).select(*by, "project_id", "contract_no", F.unix_date("contract_date").alias("day"), tokens(F.col(column)).alias("words")).filter(F.size("words") > 0)
    # Half of a SHA-256 tells lists apart, and is a quarter of its hexadecimal text.
    t = written(t.withColumn("words", F.array_sort("words")).withColumn("list", F.substring(F.unhex(F.sha2(F.array_join("words", "\0"), 256)), 1, 16)))
    lists = t.groupBy("list").agg(F.first("words").alias("words"), F.count("*").alias("_n"))
    rarity = lists.select("_n", F.explode("words").alias("word")).groupBy("word").agg(F.sum("_n").alias("df"))
    ranked = lists.select("list", F.explode("words").alias("word")).join(rarity, "word").groupBy("list").agg(F.sort_array(F.collect_list(F.struct("df", "word")))["word"].alias("words"))
    n = F.size("words")
    prefix = F.slice("words", 1, (n - F.ceil(n * percent / 100) + 1).cast("int"))
    keyed = written(ranked.withColumn("word", F.explode(prefix)))
    x, y = (keyed.select("word", *[F.col(c).alias(f"{side}_{c}") for c in ("list", "words")]) for side in "xy")
    sizes = 100 * F.least(F.size("x_words"), F.size("y_words")) >= percent * F.greatest(F.size("x_words"), F.size("y_words"))
    shared = F.size(F.array_intersect("x_words", "y_words"))
    union = F.size("x_words") + F.size("y_words") - shared
    like = x.join(y, "word").filter((F.col("x_list") <= F.col("y_list")) & sizes & (100 * shared >= percent * union))
    half = written(like.select("x_list", "y_list", F.round(shared / union, 6).alias("jaccard")).distinct())
    similar = half.union(half.filter("x_list < y_list").select(F.col("y_list").alias("x_list"), F.col("x_list").alias("y_list"), "jaccard"))
    # A contract's different rows, each with the days of all (`all`, null for a single row). near: with one contract two of them may
    # meet the same row, so they are at most twice `days` apart and, of Jaccard distances, at most twice the one permitted.
    own = [*by, "project_id", "contract_no"]
    each = t.groupBy(*own).agg(F.collect_set(F.struct("day", "list", "words")).alias("rows"))
    each = each.select(*own, "rows", F.explode("rows").alias("row")).select(*own, "row.*", "rows")
    both = lambda r: F.size(F.array_intersect(r["words"], F.col("words")))
    alike = lambda r: 100 * both(r) >= (2 * percent - 100) * (F.size(r["words"]) + F.size("words") - both(r))
    near = (F.size("rows") > 1) & (F.size(F.filter("rows", lambda r: (F.abs(r["day"] - F.col("day")) <= 2 * days) & alike(r))) > 1)
    each = written(each.select(*own, "day", "list", near.alias("near"), F.when(F.size("rows") > 1, F.transform("rows", lambda r: r["day"])).alias("all")))
    bucket = F.floor(F.col("day") / days)
    sides = {s: [F.col(c).alias(f"{s}_{c}") for c in ("project_id", "contract_no", "day", "near", "all")] for s in "ab"}
    a = each.select(*by, bucket.alias("bucket"), F.col("list").alias("x_list"), *sides["a"]).join(similar, "x_list").drop("x_list")
    b = each.select(*by, F.explode(F.array(bucket, bucket + 1)).alias("bucket"), F.col("list").alias("y_list"), *sides["b"])
    apart = F.col("a_day") - F.col("b_day")
    # Of two contracts of one day each finds the other.
    close = a.join(b, [*by, "bucket", "y_list"]).filter((F.col("a_project_id") != F.col("b_project_id")) & apart.between(0, days) & ((apart > 0) | (F.col("a_project_id") < F.col("b_project_id"))))
    met = F.aggregate("a_all", F.lit(0), lambda k, d: k + F.size(F.filter("b_all", lambda e: F.abs(d - e) <= days)))
    # One condition, of both sides: pushed into one of them it would have the two branches shuffle rows that they can share.
    once = F.when(F.col("a_near") | F.col("b_near"), False).when(F.col("a_all").isNull() | F.col("b_all").isNull(), True).otherwise(met == 1)
    first = lambda c, one, other: F.when(F.col("a_project_id") < F.col("b_project_id"), F.col(f"{one}_{c}")).otherwise(F.col(f"{other}_{c}"))
    ends = [first(c, *order).alias(name) for order, names in (("ab", ("project_a", "contract_a")), ("ba", ("project_b", "contract_b"))) for c, name in zip(("project_id", "contract_no"), names)]
    pairs = lambda some: close.filter(some).select(*by, *ends, "jaccard")
    return pairs(once).unionByName(pairs(~once).distinct())


def province_mismatch(df: DataFrame) -> DataFrame:
    """Contracts whose name states another province than their own: one that doesn't begin with the first four letters of it.
    A stated name has two letters or more, the first a consonant; one that begins with a vowel isn't read."""
    said = F.regexp_extract(F.coalesce("project_name", F.lit("")), r"จังหวัด\s*([ก-ฮ][ก-๙]+)", 1)
    own = F.substring(F.coalesce("province", F.lit("")), 1, 4)
    return df.withColumn("said_province", said).filter((F.col("said_province") != "") & (own != "") & ~F.col("said_province").startswith(own))
