"""The value of opening a pattern takes in every pattern, whatever its number."""

from collections import Counter, defaultdict

import pytest

from ballast.operators.aggregates import COLOURED_MINUTES, SERVICE_MINUTES
from ballast.registry import QUERIES, load_all
from ballast.testbed import Testbed

SMALL = "/root/testdata/sf0.001"


def test_all_patterns_count(spark):
    load_all()
    t = Testbed(spark, SMALL)
    place = {r.stop_id: r.cluster_id for r in t.stops.collect()}
    calls, fine = defaultdict(list), defaultdict(list)
    for r in sorted(t.stop_times.collect(), key=lambda r: r.stop_sequence):
        if r.stop_id in place and calls[r.trip_id][-1:] != [place[r.stop_id]]:
            calls[r.trip_id].append(place[r.stop_id])
    for r in t.refinement.collect():
        fine[r.coarse].append(r.fine)
    trips, number = Counter(), {}
    for trip, at in calls.items():
        if len(at) > 1:
            trips[tuple(at)] += 1
            number[tuple(at)] = min(trip, number.get(tuple(at), trip))

    def edges(at):
        links = ["|".join(sorted(pair)) for pair in zip(at, at[1:])]
        return {edge for link in links for edge in fine.get(link) or [link]}

    seen = {at: [i for i, c in enumerate(at) if c in ("c03", "c14")] for at in trips}
    covered = {edge for at, s in seen.items() if s for edge in edges(at[s[0] : s[-1] + 1])}
    want = {number[at]: min(1, trips[at] * COLOURED_MINUTES / SERVICE_MINUTES) * n for at, s in seen.items() if not s and (n := len(edges(at) - covered))}
    got = {r.pattern_id: r.value for r in QUERIES["win_16_pattern_opening_value"](spark, SMALL).collect()}
    assert got == pytest.approx(want) and any(not p.endswith("77") for p in got)
