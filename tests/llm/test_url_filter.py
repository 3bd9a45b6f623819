import numpy as np
import xxhash

from tendergrid.llm.queries import URL_RULES
from tendergrid.llm.url_filter import UNWANTED, _buckets, _split, judge_urls, seed_urls, train

URLS = ["https://www.spam-farm.example.net/en/1", "HTTP://Cheap-Pills.Example.COM/fr/3?x=1", "http://tiontion.example.net/en/5", None, "no scheme", "", "http://", "http://h.org", "http://h.org/", "http://org/x",
        "http://a.example.org/es/2", "http://example.org/en/12#top", "http://xexample.org/es/1", "http://b.com/de/9", "http://b.com/fr/9?u=://c", "http://casino-win.example.net/?q", "http://a.net/p\nq#f", "x://É.ORG/Ä", "https://free-bets.example.net" + "/long" * 3000]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    host, path = _split(url)
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [t for _, t in URL_RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith(t[t.index("/") :])]
    return host, path, max(fits, key=len, default=None)


def test_rules_and_verdicts(spark):
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)] + [(0, URLS[0], "h", "r"), (None, URLS[1], "h", "r")], "page_id long, url string, host string, rule string")
    out = judge_urls(df, URL_RULES).collect()
    assert len(out) == len(URLS) + 2
    verdicts = dict(map(reversed, URL_RULES))
    for r in out:
        url = URLS[1] if r.page_id is None else URLS[r.page_id]
        assert (r.host, r.path, r.rule) == brute(url)
        assert r.verdict == (verdicts[r.rule] if r.rule else "block" if r.unwanted >= 0.5 else "allow")
    assert {r.page_id: r.verdict for r in out if r.page_id in (0, 1, 2, 3, 4, 15)} == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "allow", 15: "block"} or [r for r in out if r.page_id == 1][0].rule == "com/fr/"


WORDS = {"spam-farm": 1, "casino-win": 1, "adult-x": 1, "cheap-pills": 1, "free-bets": 1, "ads-track": 1, "poker-jackpot": 1, "tionsh": 0, "ththth": 0, "therind": 0, "en-pa": 0, "eauouon": 0, "science-news": 0, "zeitung": 0}


def probability(url, model):
    f = list(set(_buckets(_split(url)[0], "h"))) + list(set(_buckets(_split(url)[1], "p")))
    return 1 / (1 + np.exp(-(model[0][f].sum() / len(f) ** 0.5 + model[1])))


def test_model_on_words():
    model = train(seed_urls())
    assert {w: int(probability(f"https://www.{w}.example.net/en/4", model) >= 0.5) for w in WORDS} == WORDS


def test_training_is_stable_and_held_out_urls_are_told_apart():
    table = seed_urls()
    rest, held = ([x for x in table if (xxhash.xxh32_intdigest(x[0]) % 4 == 0) == side] for side in (False, True))
    model, again = train(rest), train(rest)
    assert (model[0] == again[0]).all() and model[1] == again[1]
    right = [(probability(url, model) >= 0.5) == bool(label) for url, label in held]
    assert sum(right) / len(right) > 0.9


def test_paths_tell_too():
    model = train(seed_urls())
    told = {"https://www.zeitung.example.net/casino/4": 1, "https://garten.example.org/buy/cheap-viagra.html": 1, "https://qvarl.example.com/x/poker-bonus": 1,
            "https://www.zeitung.example.net/library/4": 0, "https://garten.example.org/buy/garden-flowers.html": 0, "https://qvarl.example.com/x/science-museum": 0}
    assert sum(int(probability(u, model) >= 0.5) == label for u, label in told.items()) >= 5


def test_ordinary_endings_are_no_sign():
    """Parts that unwanted and ordinary words share."""
    model = train(seed_urls())
    hosts = ("thing", "clothing", "ththing", "fishing", "teaching", "discover", "tracking-parcel", "downtown", "creditable", "windows", "beatles", "pricing")
    right = [probability(f"https://www.{h}.example.net/en/4", model) < 0.5 for h in hosts]
    assert sum(right) >= 8


def test_empty(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES).count() == 0


def test_an_unwanted_word_beside_any_other():
    table = seed_urls()
    model = train(table)
    words = {"poker-online": 1, "spiel-casino": 1, "lottery-heute": 1, "beste-viagra": 1, "haus-garten": 0, "qxzrkt": 0}
    assert {w: int(probability(f"https://www.{w}.example.net/en/4", model) >= 0.5) for w in words} == words
    beside = ("online", "gratis", "heute", "shop", "store", "point", "corner", "tienda", "qzvkx", "wrblon")
    urls = [f"https://www.{host}.example.org/en/4" for a in UNWANTED for b in beside for host in (f"{a}-{b}", f"{b}{a}")]
    assert not any(b in url for url, _ in table for b in ("online", "gratis", "heute", "tienda", "qzvkx", "wrblon"))
    assert sum(probability(url, model) >= 0.5 for url in urls) / len(urls) > 0.88
