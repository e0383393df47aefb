"""Paths over graphs against plain searches."""

import heapq
import math
import random

import pytest

from ballast.functions.geo import EARTH_RADIUS_M
from ballast.operators import graphs as R


def metres(a, b):
    (y1, x1), (y2, x2) = a, b
    h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(h))


def dijkstra(start, links):
    best, heap = {}, [(0.0, start)]
    while heap:
        g, u = heapq.heappop(heap)
        if u in best:
            continue
        best[u] = g
        for v, w in links.get(u, []):
            heapq.heappush(heap, (g + w, v))
    return best


@pytest.mark.parametrize("a_table", [8, 2])
def test_relaxation_finds_the_cheapest_paths(spark, monkeypatch, a_table):
    monkeypatch.setattr(R, "ROUNDS_A_TABLE", a_table)
    rng = random.Random(4)
    at = {i: (50 + rng.random(), 5 + rng.random()) for i in range(60)}
    links, rows = {}, []
    for u in at:
        for v in sorted(at, key=lambda v: metres(at[u], at[v]))[1:4]:
            for x, y in ((u, v), (v, u)):
                w = metres(at[u], at[v]) * (1 + (x * y % 7) / 10)
                links.setdefault(x, []).append((y, w))
                rows.append((x, y, w, *at[y], f"{x}>{y}"))
    wanted = [(f"p{i}", rng.randrange(60), rng.randrange(60)) for i in range(25)]
    wanted = [(p, a, b) for p, a, b in wanted if a != b]
    pairs = spark.createDataFrame([(p, *at[b], 1e9, None) for p, _, b in wanted], "pair string, goal_lat double, goal_lon double, cap double, w_max double")
    starts = spark.createDataFrame([(p, a, 0.0, "start") for p, a, _ in wanted], "pair string, node int, g double, tag string")
    exits = spark.createDataFrame([(p, b, 5.0) for p, _, b in wanted], "pair string, node int, exit_w double")
    graph = spark.createDataFrame(rows, "u int, v int, w double, v_lat double, v_lon double, tag string").dropDuplicates(["u", "v"])
    got = {}
    for r in R.relax_paths(pairs, starts, graph, exits).collect():
        got.setdefault(r.pair, {})[r.n] = (r.tag, r.total)
    weight = {f"{x}>{y}": w for x, ys in links.items() for y, w in ys}
    for p, a, b in wanted:
        best = dijkstra(a, links)
        if b not in best:
            assert p not in got
            continue
        path = [got[p][n] for n in range(len(got[p]))]
        tags = [t for t, _ in path]
        assert tags[0] == "start" and abs(path[0][1] - best[b] - 5) < 1e-6
        assert abs(sum(weight[t] for t in tags[1:]) - best[b]) < 1e-6
        stops = [a] + [int(t.split(">")[1]) for t in tags[1:]]
        assert stops[-1] == b and all(t == f"{x}>{y}" for t, x, y in zip(tags[1:], stops, stops[1:], strict=False))


def test_fewest_links(spark):
    rng = random.Random(6)
    edges = {tuple(sorted(rng.sample([f"c{i:02}" for i in range(40)], 2))) for _ in range(60)}
    links = {}
    for u, v in edges:
        links.setdefault(u, []).append((v, 1.0))
        links.setdefault(v, []).append((u, 1.0))
    graph = spark.createDataFrame([(u, v) for u in links for v, _ in links[u]], "u string, v string")
    wanted = [(f"p{i}", *rng.sample(sorted(links), 2)) for i in range(30)]
    got = {}
    for r in R.bfs_paths(spark.createDataFrame(wanted, "pair_id string, a string, b string"), graph).collect():
        got.setdefault(r.pair_id, {})[r.pos] = r.segment
    for p, a, b in wanted:
        hops = dijkstra(a, links).get(b)
        assert len(got.get(p, {})) == (hops or 0)
        node = a
        for i in range(int(hops or 0)):
            x, y = got[p][i].split("|")
            node = y if x == node else x
            assert tuple(got[p][i].split("|")) in edges
        assert hops is None or node == b
