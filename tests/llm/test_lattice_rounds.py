"""Vectors meet in rounds of tables, and a round leaves only its links behind."""

import os

import numpy as np

from ballast.llm import lattice as L


def test_rounds_find_the_same_and_leave_the_disk(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    rows = [(40 * copy + i, [float(x) for x in v + 0.1 * copy * rng.standard_normal(16)]) for copy in range(4) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    paths, alive, stored = [], [], L.stored

    def kept():
        return sum(os.path.exists(path) for path in paths)

    def noted(table):
        out = stored(table)
        if "look" in out.columns:
            paths.append("/" + out.inputFiles()[0].removeprefix("file:").lstrip("/"))
            alive.append(kept())
        return out

    monkeypatch.setattr(L, "stored", noted)
    got = sorted(tuple(r) for r in L.near_vectors(df).collect())
    assert alive == [1] * (L.TABLES // L.TABLES_A_ROUND) and len(alive) > 1 and not kept()
    monkeypatch.setattr(L, "TABLES_A_ROUND", L.TABLES)
    assert got == sorted(tuple(r) for r in L.near_vectors(df).collect())
    unit = np.array([v for _, v in rows], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert sum(n for _, n, _, _ in got) == ((unit @ unit.T) >= 0.9).sum() - len(rows) > 0
