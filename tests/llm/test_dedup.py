"""Substring, suffix-array, MinHash and lattice dedup against brute force."""

import hashlib
import os
import random
import re
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from helpers import awkward, covered, documents, groups, prose, words  # noqa: E402

from ballast.llm.components import components
from ballast.llm.lattice import nearest_e8, near_vectors, roots
from ballast.llm.minhash import near_duplicates
from ballast.llm.phrase_dedup import phrase_dedup
from ballast.llm.suffix_dedup import Suffixes, suffix_dedup


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("most", [1 << 15, 2])  # 2: anchors with more contents are split by window
def test_phrase_dedup(spark, most):
    texts = awkward()
    units = [tuple(words(x)) for x in texts]
    want = []
    for i, (u, mask) in enumerate(zip(units, covered(units, 35), strict=True)):
        want.append((i, len(u), sum(mask), sha(" ".join(w for w, m in zip(u, mask, strict=True) if not m).encode())))
    got = phrase_dedup(documents(spark, texts), most=most).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == want
    assert sum(w[2] for w in want) > 500


@pytest.mark.parametrize("most", [1 << 15, 2])
def test_suffix_dedup(spark, most):
    texts = awkward(2)
    units = [(x or "").encode() for x in texts]
    want = []
    for i, (u, mask) in enumerate(zip(units, covered(units, 200), strict=True)):
        rest = bytes(b for b, m in zip(u, mask, strict=True) if not m)
        want.append((i, len(u), sum(mask), len(re.findall(b"\1+", bytes(mask))), sha(rest)))
    got = suffix_dedup(documents(spark, texts), most=most).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == want
    assert sum(w[2] for w in want) > 2000


def test_kept_text_and_carried_columns(spark):
    rng = random.Random(3)
    same = prose(rng, 50)
    docs = documents(spark, [same + " a", same + " b", None])
    rows = {r.doc_id: r for r in suffix_dedup(docs, text=True, carry=["spans", "k"]).collect()}
    assert (rows[0].text, rows[1].text, rows[2].text) == ("a", "b", "") and rows[0]["_c0"] == "b" and rows[0]["_c1"] == 1


def test_suffix_sort_orders_and_verifies():
    rng = random.Random(4)
    data = np.frombuffer("".join(rng.choice("ab") for _ in range(300)).encode(), np.uint8)
    start = np.array(sorted(rng.sample(range(300), 120)))
    end = np.minimum(start + 40, 300)
    group = np.repeat(np.arange(4), 30)
    suffixes = Suffixes(data, start, end, 0x9E3779B97F4A7C15)
    order = suffixes.order(group)
    body = data.tobytes()
    assert [body[start[i] : end[i]] for i in order] == [x for g in range(4) for x in sorted(body[start[i] : end[i]] for i in range(30 * g, 30 * g + 30))]
    common = suffixes.checked(order, group)
    assert common[30] == -1 and all(os.path.commonprefix([body[start[i] : end[i]], body[start[j] : end[j]]]) == body[start[i] : start[i] + n] for i, j, n in zip(order, order[1:], common[1:], strict=False) if n >= 0)
    suffixes.sums = np.zeros_like(suffixes.sums)  # every hash equal: the bytes must give it away
    assert suffixes.checked(order, group) is None


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rng = random.Random(5)
    base = prose(rng, 80).split()
    texts = awkward(6)
    for _ in range(40):  # a family whose members link by way of others
        copy = list(base)
        for _ in range(rng.randrange(0, 6)):
            copy[rng.randrange(80)] = f"e{rng.randrange(99)}"
        texts.append(" ".join(copy))
    texts += ["a b c d e f", "A b c D e F", "x"]
    sets = []
    for x in texts:
        w = words(re.sub("[A-Z]", lambda m: m.group().lower(), x or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    want = groups(list(range(len(texts))), lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and bool(sets[i]))
    got = near_duplicates(documents(spark, texts), size=size).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == [(i, len(sets[i]), want[i], want[i] == i) for i in range(len(texts))]
    assert len(set(want.values())) < len(texts) - 10


def test_rows_without_or_with_one_id(spark):
    texts = ["a b c d e f g", "a b c d e f g", "a b c d e f g", "z y x w v u t"]
    docs = documents(spark, texts, ids=[None, 7, 7, 9])
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_duplicates(docs).collect()) == [(-1, -1, True), (7, 7, True), (7, 7, True), (9, 9, True)]
    assert phrase_dedup(docs).count() == suffix_dedup(docs).count() == 4


def test_empty_tables(spark):
    docs = documents(spark, [])
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for made in (phrase_dedup(docs), suffix_dedup(docs), near_duplicates(docs), near_vectors(vectors)):
        assert made.count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    known = {frozenset(e) for e in edges}
    want = groups(sorted({x for e in edges if e[0] != e[1] for x in e}), lambda i, j: frozenset((i, j)) in known)
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert dict(map(tuple, got.collect())) == want and got.count() == len(want)


def test_e8():
    x = np.random.default_rng(8).normal(size=(500, 8)) * 2
    near = nearest_e8(x)
    least = ((x - near) ** 2).sum(1)
    assert len(roots()) == 240 and (np.abs((roots() ** 2).sum(1) - 2) < 1e-12).all()
    assert (((x[:, None] - near[:, None] - roots()[None]) ** 2).sum(2).min(1) >= least - 1e-9).all()
    doubled = (2 * near).astype(int)
    assert ((doubled % 2 == doubled[:, :1] % 2).all(1)).all() and (near.sum(1) % 2 == 0).all()


def test_near_vectors(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(300, 64))
    turned = []
    for i in range(150):
        other = rng.normal(size=64)
        other -= other @ base[i] / (base[i] @ base[i]) * base[i]
        other *= np.linalg.norm(base[i]) / np.linalg.norm(other)
        c = 0.9 + 0.09 * rng.random()
        turned.append(c * base[i] + np.sqrt(1 - c * c) * other)
    rows = [*base.tolist(), *turned, base[3].tolist(), (2.5 * base[4]).tolist(), [0.0] * 64, None, [], [float("nan")] * 64, [None] * 64, [float("inf")] * 64, [1.0, 2.0], [2.0, 4.0]]
    rows = [None if r is None else [None if v is None else float(v) for v in r] for r in rows]
    table = spark.createDataFrame([(i, r, 1, "x") for i, r in enumerate(rows)], "vec_id long, embedding array<double>, label int, node string")
    sound = {i: np.array(r) for i, r in enumerate(rows) if r and None not in r and np.isfinite(r).all() and any(r)}
    link = lambda i, j: i in sound and j in sound and len(rows[i]) == len(rows[j]) and sound[i] @ sound[j] / np.linalg.norm(sound[i]) / np.linalg.norm(sound[j]) >= 0.9
    want = {i: sum(link(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))}
    got = {r.vec_id: r for r in near_vectors(table).collect()}
    assert len(got) == len(rows) and all(got[i].n_links <= n for i, n in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(want.values())
    assert got[450].component_id == 3 and got[451].component_id == 4 and got[459].component_id == got[458].component_id == 458
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(452, 458))
