"""PageRank, betweenness and the composite rank against plain Python."""

import hashlib
import random
from collections import deque

import pytest

from tendergrid.operators import graph

SHAPE = "source string, target string, value double, n long"


def uneven(seed: int) -> list[tuple]:
    """Two parts that don't meet, a hub, lone pairs and links without value."""
    r = random.Random(seed)
    rows = {(f"A::{r.randrange(6)}", f"C::{r.randrange(25)}"): float(r.randrange(1, 90)) for _ in range(40)}
    rows |= {("A::hub", f"C::{i}"): 7.0 for i in range(0, 25, 3)}
    rows |= {("A::x", "C::x"): 0.0, ("A::y", "C::y"): None, ("A::z", "C::x1"): 0.0, ("A::z", "C::x2"): 3.0}
    rows |= {(f"A::p{i}", f"C::p{i}"): 5.0 for i in range(3)} | {(f"A::p{i + 1}", f"C::p{i}"): 5.0 for i in range(2)}
    return [(s, t, v, 1) for (s, t), v in rows.items()]


def neighbours(rows) -> dict[str, set]:
    out: dict[str, set] = {}
    for s, t, *_ in rows:
        if s and t and s != t:
            out.setdefault(s, set()).add(t)
            out.setdefault(t, set()).add(s)
    return out


def paths_from(start, links):
    far, paths, queue = {start: 0}, {start: 1}, deque([start])
    while queue:
        at = queue.popleft()
        for to in links[at]:
            if to not in far:
                far[to], paths[to] = far[at] + 1, 0
                queue.append(to)
            if far[to] == far[at] + 1:
                paths[to] += paths[at]
    return far, paths


def by_definition(rows, pivots=400, seed=42):
    """Of all shortest paths from a pivot to a node, those that have the third node on them."""
    links = neighbours(rows)
    every = {v: paths_from(v, links) for v in links}
    first = sorted(links, key=lambda v: (hashlib.md5(f"{seed}:{v}".encode()).hexdigest(), v))[:pivots]
    out, n = dict.fromkeys(links, 0.0), len(links)
    for s in first:
        far, paths = every[s]
        for t in far:
            for v in far:
                if len({s, t, v}) == 3 and t in every[v][0] and far[v] + every[v][0][t] == far[t]:
                    out[v] += paths[v] * every[v][1][t] / paths[t]
    return {v: x * n / len(first) / ((n - 1) * (n - 2)) if n > 2 else 0.0 for v, x in out.items()}


def got(spark, rows, **options):
    out = graph.betweenness(spark.createDataFrame(rows, SHAPE).repartition(3), **options).collect()
    assert len({r.id for r in out}) == len(out)
    return {r.id: r.betweenness for r in out}


@pytest.mark.parametrize("options", [{}, {"pivots": 7}, {"pivots": 7, "seed": 5}])
def test_betweenness_by_definition(spark, options):
    rows = uneven(1)
    assert got(spark, rows, **options) == pytest.approx(by_definition(rows, **options), abs=1e-12)


def test_nodes_of_many_links_are_joined_in_slots(spark, monkeypatch):
    monkeypatch.setattr(graph, "PER_SLOT", 2)
    rows = uneven(2)
    assert got(spark, rows) == pytest.approx(by_definition(rows), abs=1e-12)
    slots = graph._slotted(spark.createDataFrame(rows, SHAPE)).groupBy("id").agg({"slot": "max", "other": "count"}).collect()
    assert max(r["max(slot)"] for r in slots) == max(len(x) for x in neighbours(rows).values()) // 2 + max(len(x) for x in neighbours(rows).values()) % 2 - 1


def test_odd_cycles_repeated_links_loops_and_null_ends(spark):
    ring = [(f"A::{i}", f"A::{(i + 1) % 5}", 1.0, 1) for i in range(5)] + [("A::0", "C::tail", 1.0, 1)]
    odd = [*ring, ring[0], ("A::1", "A::0", 2.0, 1), ("A::2", "A::2", 1.0, 1), (None, "A::2", 1.0, 1), ("A::3", None, 1.0, 1)]
    assert got(spark, odd) == pytest.approx(by_definition(ring), abs=1e-12)


def test_small_graphs(spark):
    assert got(spark, []) == {}
    assert got(spark, [("A::a", "C::b", 1.0, 1)]) == {"A::a": 0.0, "C::b": 0.0}
    assert got(spark, [("A::a", "C::b", 1.0, 1), ("A::a", "C::c", 1.0, 1)]) == {"A::a": 1.0, "C::b": 0.0, "C::c": 0.0}
    assert graph.composite(spark.createDataFrame([], SHAPE)).count() == 0


def ranks_by_hand(rows, rounds=20):
    weights: dict = {}
    for s, t, v, _ in rows:
        for a, b in ((s, t), (t, s)):
            weights.setdefault(a, {})[b] = v or 0.0
    n, out = len(weights), {v: sum(w.values()) for v, w in weights.items()}
    rank = dict.fromkeys(weights, 1 / n)
    for _ in range(rounds):
        idle = sum(rank[v] for v in rank if not out[v])
        rank = {v: 0.15 / n + 0.85 * (idle / n + sum(w * rank[o] / out[o] for o, w in weights[v].items() if out[o])) for v in weights}
    return rank


def test_pagerank_by_hand(spark):
    rows = uneven(3)
    found = {r.id: r["rank"] for r in graph.pagerank(spark.createDataFrame(rows, SHAPE)).collect()}
    assert found == pytest.approx(ranks_by_hand(rows), abs=1e-12) and sum(found.values()) == pytest.approx(1)


def test_composite_by_hand(spark):
    rows = uneven(4)
    links, rank, through = neighbours(rows), ranks_by_hand(rows), by_definition(rows)
    value = {v: sum(x or 0 for s, t, x, _ in rows if v in (s, t)) for v in links}
    order = lambda m: {v: round(100 * i / (len(m) - 1), 2) for i, v in enumerate(sorted(m, key=lambda v: (round(m[v], 12), v)))}
    parts = [order(m) for m in ({v: len(x) for v, x in links.items()}, value, rank, through)]
    out = graph.composite(spark.createDataFrame(rows, SHAPE)).collect()
    assert [r.id for r in out] == [r.id for r in sorted(out, key=lambda r: (-r.composite, r.id))] and {r.id for r in out} == set(links)
    for r in out:
        assert (r.degree_n, r.weighted_degree_n, r.pagerank_n, r.betweenness_n) == tuple(p[r.id] for p in parts)
        assert abs(r.composite - (0.3 * r.degree_n + 0.3 * r.weighted_degree_n + 0.2 * r.pagerank_n + 0.2 * r.betweenness_n)) <= 0.0050001
        assert r.type == ("agency" if r.id.startswith("A") else "contractor") and r.id.endswith("::" + r["name"])


def test_places_are_zero_where_all_values_are_the_same(spark):
    same = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "id string, x double")
    assert {r.p for r in graph.percentile(same, "x", "p").collect()} == {0.0}
