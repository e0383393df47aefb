"""Centroids, conversation repair and sharding against plain versions."""

import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from math import floor

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from helpers import DOCUMENTS, awkward, documents  # noqa: E402

from ballast.llm import conversations as cv
from ballast.llm.centroids import Assigner, Cells, centroid_clusters, exact_distances, limbs
from ballast.llm.sharding import network, permute, place, round_keys, row_at, shard_documents, sharded, write_shards


# ---- centroids

def kmeans(rows, k=16, rounds=3):
    """The clusters of (vec_id, vector) rows, in Python's whole numbers."""
    kept = [(i, [floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in first[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        for c, vs in members.items():
            centroids[c] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    out = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = Counter()
    for _, c, d in out:
        inertia[c] += d
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, inertia[c], sum(inertia.values()), shas[c]) for i, c, d in out]


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x", 2) for i, v in rows], "vec_id long, embedding array<float>, label int, cells string, cluster int").repartition(3)


def embeddings(n, seed=1, scale=0.12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, scale, (7, 64))
    return [(i, (centres[i % 7] + rng.normal(0, scale / 3, 64)).astype(np.float32).tolist()) for i in range(n)]


def clusters(df):
    return sorted((tuple(r[:6]) for r in df.collect()), key=str)


def test_centroids_against_plain_kmeans(spark):
    rows = embeddings(300)
    rows += [(i % 5, rows[3][1]) for i in range(120)] + [(None, rows[9][1]), (900, None), (901, []), (902, [0.0] * 64), (903, [0.5] * 63), (904, [0.5] * 65)]
    rows += [(905, [float("nan")] + [0.1] * 63), (906, [float("inf")] + [0.1] * 63), (907, [None] + [0.1] * 63), (908, [90.0] + [0.1] * 63), (908, [-3.0] * 64)]
    got = centroid_clusters(vectors(spark, rows), sample=64)
    assert clusters(got) == sorted(kmeans(rows), key=str)


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_cells_of_any_size_give_the_same(spark, bits):
    rows = embeddings(200, 2)
    rows_of = centroid_clusters(vectors(spark, rows), bits=bits, sample=32)
    assert clusters(rows_of) == sorted(kmeans(rows), key=str)


def test_ties_few_vectors_and_none(spark):
    same = [0.25] * 64
    assert clusters(centroid_clusters(vectors(spark, [(1, same), (2, same), (3, same)]))) == sorted(kmeans([(1, same), (2, same), (3, same)]), key=str)
    assert {r[1] for r in kmeans([(1, same), (2, same)])} == {0}
    assert centroid_clusters(vectors(spark, [(1, None)])).count() == 0
    assert centroid_clusters(vectors(spark, [])).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "fetched"]
    assert centroid_clusters(vectors(spark, [(None, same)])).count() == 0  # no id, so nothing to begin from


def test_large_components_stay_exact(spark):
    rows = embeddings(60, 3) + [(100, [3e5] * 64), (101, [3e5 + 0.5] * 64), (102, [-2.9e6] * 63 + [1.0])]
    assert clusters(centroid_clusters(vectors(spark, rows))) == sorted(kmeans([(i, [float(np.float32(x)) for x in v]) for i, v in rows]), key=str)
    huge = centroid_clusters(vectors(spark, rows + [(103, [1e30] * 64), (104, [-1e30] * 64)])).collect()
    assert len(huge) == 65 and all(0 <= r.distance <= (1 << 63) - 1 for r in huge)


def test_cells_bound_every_distance():
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(0, 30, (500, 8)))
    cells = Cells(x[:50], x.min(0), x.max(0), 3)
    centroids = [list(map(int, v)) for v in x[:5]]
    assign = Assigner(cells, centroids)
    exact, code = exact_distances(x, centroids), cells.of(x)
    low = sum(assign.low[d][code[:, d]] for d in range(8))
    high = sum(assign.high[d][code[:, d]] for d in range(8))
    assert (low <= exact).all() and (exact <= high).all()
    assert (assign(code, x)[0] == exact.argmin(1)).all()


def test_limbs_are_whole():
    for v in (0, 5, -5, -1, (1 << 40) - 1, 1 << 40, -(1 << 40), 3 << 90, -(7 << 130) + 3):
        assert sum(part << (40 * i) for i, part in enumerate(limbs(v))) == v


# ---- conversations

CONVERSATIONS = "conv_id long, turn long, role string, text string, part int, first string, times string, fault int"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def plain_repair(rows):
    """conv_id -> report, from (conv_id, turn, role, text) rows: a dynamic program over rows with the grammar's states as sets of strings."""
    after = defaultdict(list)
    for conv, turn, role, text in rows:
        text, role = " " if text is None else text, " " if role is None else role
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out = after[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {conv: plain_report(sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).hexdigest()))) for conv, out in after.items()}


def plain_report(rows):
    faults, seen = [], set()
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, audit, lines = plain_edits([(r, t) for _, r, t in rows], faults)
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha)


def step(state, initial):
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))


def plain_edits(rows, faults):
    """The cheapest edits, least audit first, of all: Bellman's sweep, row by row, with insertions to a fixed point."""
    best = {"": (0, "", ())}

    def offer(into, state, way):
        if state is not None and (state not in into or way < into[state]):
            into[state] = way
            return True
        return False

    def insertions(level):
        while any(offer(level, step(q, i), (c + 2, a + "I", (*ls, name + ":"))) for q, (c, a, ls) in list(level.items()) for i, name in (("u", "user"), ("a", "assistant"))):
            pass
        return level

    insertions(best)
    for (role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for q, (c, a, ls) in best.items():
            offer(new, q, (c + 3, a + "D", ls))
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            offer(new, step(q, role[:1]), (c + extra, a + "K", (*ls, f"{role}:{text}")))
            for name in ("user", "assistant"):
                offer(new, step(q, name[0]), (c + 2 + extra, a + "R", (*ls, f"{name}:{text}")))
        best = insertions(new)
    return min(best[q] for q in ("", "a") if q in best)


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, "f", "t", 2) for r in rows], CONVERSATIONS).repartition(5)


def awkward_talk(seed=1):
    rng = random.Random(seed)
    out = []
    for conv in range(120):
        for turn in range(rng.randrange(1, 9)):
            role = ["system"] * (turn == 0 and rng.random() < 0.3) or [rng.choice(["user", "assistant", "user", "assistant", "tool", "system", "u", ""])]
            out.append((conv, turn, role[0], rng.choice(["", " \t\n", "Hm.", "Yes!", "no end", "a.b.c ", "x. \n", "Why?\x0b", f"t{rng.random()}."])))
    out += [(None, 1, "user", "a."), (None, None, "assistant", "b."), (500, None, None, None), (501, 3, "user", None), (502, 3, None, "c."), (503, 2**40, "user", "x"), (503, -(2**40), "user", "y")]
    out += [(504, 1, "user", "same.")] * 40 + [(505, t, "user", "same.") for t in range(40)] + [(506, 1, "user", "long " * 20000 + "."), (506, 2, "assistant", "é😀.")]
    out += [(600, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b.", f"c{t}.", f"d{t}", ""])) for t in range(300)]
    return out


def reports(df):
    return {r[0]: tuple(r[1:9]) for r in df.collect()}


@pytest.mark.parametrize("rows_a_block", [1024, 3])
def test_repair_against_plain_edits(spark, rows_a_block, monkeypatch):
    rows = awkward_talk()
    want = plain_repair(rows)
    df = talk(spark, rows)
    if rows_a_block != 1024:  # workers do not see a patched module, so the plan runs here
        monkeypatch.setattr(cv, "BLOCK_ROWS", rows_a_block)
        got = in_driver(spark, df)
    else:
        got = reports(cv.repair_conversations(df))
    assert got == want
    assert {a for w in want.values() for a in w[6]} == set("KRDI")


def in_driver(spark, df):
    """The same functions over one sorted range, block by block, without workers."""
    import pyarrow as pa

    ordered = cv.in_order(cv.damaged(df)).toArrow().combine_chunks().to_batches()
    table = pa.Table.from_batches(list(cv.derive(iter(ordered))), cv.arrow_schema(cv.DERIVED)).to_pylist()
    cut = [r for r in table if not r["whole"]]
    key = lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["part"], r["number"])
    assert sum(r["conv_id"] == 600 for r in cut) > 90
    run = lambda f, rows: [r for b in f(iter([pa.RecordBatch.from_pylist(rows)])) for r in b.to_pylist()]
    back = sorted(cut, key=lambda r: (key(r)[:2], -r["part"], -r["number"]))
    steps = {(s["part"], s["number"]): s for s in run(cv.follow, sorted(run(cv.choose, back), key=key))}
    made = run(cv.apply, [r | steps[r["part"], r["number"]] for r in cut])
    names = [f.split()[0] for f in cv.REPORT.split(", ")]
    out = run(cv.join_blocks, sorted(made, key=key)) + [r for r in table if r["whole"]]
    return {r["conv_id"]: tuple(r[n] for n in names) for r in out}


def test_lightest_derivations_of_random_codes():
    rng = random.Random(7)
    for _ in range(300):
        codes = "".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(7)))
        ((cost, audit),) = cv.lightest(codes, 0, cv.GOALS).values()
        roles = [{"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "tool") for c in codes]
        faults = ["blank" if c == "x" else "truncated" if c.isupper() else "" for c in codes]
        want = plain_edits([(r, str(i)) for i, r in enumerate(roles)], faults)
        assert (cost, audit, cv.edited(audit, 0, roles, [str(i) for i in range(len(codes))])) == (want[0], want[1], list(want[2]))
        assert GRAMMAR.fullmatch("".join(line[0] for line in want[2]))


def test_repair_of_nothing(spark):
    assert cv.repair_conversations(talk(spark, [])).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    assert reports(cv.repair_conversations(talk(spark, [(dropped, 1, "user", "a.")]))) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


# ---- sharding

@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_feistel_is_a_permutation_with_an_inverse(n):
    rows = np.arange(n)
    at = permute(rows, n, 13)
    assert sorted(at.tolist()) == list(range(n)) and (permute(at, n, 13, back=True) == rows).all()
    shard, slot = place(rows, n, 24, 13)
    assert (row_at(shard, slot, n, 24, 13) == rows).all()


def test_feistel_of_large_ranges_and_its_spread():
    n, rows = (1 << 61) + 12345, np.array([0, 1, 2, (1 << 61) + 12344])
    assert (permute(permute(rows, n, 5), n, 5, back=True) == rows).all()
    x = np.arange(1 << 12)
    assert len(set(network(x, 6, round_keys(9)).tolist())) == 1 << 12
    runs = (np.diff(permute(np.arange(20000), 20000, 3)) == 1).sum()
    assert runs < 20 and abs(np.corrcoef(np.arange(20000), permute(np.arange(20000), 20000, 3))[0, 1]) < 0.03


def test_shards_of_awkward_documents(spark):
    texts = awkward()
    ids = [None if i % 9 == 0 else i % 25 for i in range(len(texts))]
    texts, ids = texts * 3 + ["copy"] * 70, ids * 3 + [3] * 70
    rows = shard_documents(documents(spark, texts, ids)).collect()
    want = Counter((i, len((x or "").encode()) + 8, zlib.crc32((x or "").encode())) for i, x in zip(ids, texts, strict=True))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) == set(range(24))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = shard_documents(documents(spark, texts[::-1], ids[::-1]).coalesce(1)).collect()
    place_of = lambda rs: sorted(((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32, r.shard, r.slot) for r in rs))
    assert place_of(again) == place_of(rows)
    assert len({r.shard for r in rows if r["size"] == 12 and r.doc_id == 3}) > 12


def test_shards_of_nothing_and_written_shards(spark, tmp_path):
    assert shard_documents(spark.createDataFrame([], DOCUMENTS)).count() == 0
    docs = documents(spark, [f"text {i}" for i in range(100)])
    write_shards(docs, str(tmp_path / "out"), 7, slots_a_file=5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.text for r in back.collect()) == sorted(f"text {i}" for i in range(100))
    placed = {r.row.doc_id: (r.shard, r.slot, r.number) for r in sharded(docs, 7).collect()}
    assert all(placed[r.doc_id][:2] == (r.shard, r.slot) for r in back.collect())
    assert [placed[i][2] for i in range(100)] == list(range(100))
    with pytest.raises(ValueError):
        write_shards(docs.withColumn("Slot", docs.k), str(tmp_path / "x"))
