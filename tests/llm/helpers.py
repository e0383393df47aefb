"""Small inputs with every awkward case, and brute-force answers."""

from __future__ import annotations

import random
import re
from collections import Counter

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, k long, t int, anchor string, spans string, label int, row string"


def documents(spark, texts, ids=None, sources=None):
    """Documents with columns whose names the operators use themselves."""
    ids = range(len(texts)) if ids is None else ids
    sources = [f"src{i % 3}" for i in range(len(texts))] if sources is None else sources
    rows = [(i, x, "en", s, None if x is None else len(x), 1, 2, "a", "b", 3, None) for i, x, s in zip(ids, texts, sources, strict=True)]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}x{rng.randrange(5)}" for _ in range(n))


def awkward(seed: int = 1) -> list[str | None]:
    """Null, empty, blank, one word, exact and near copies, shared passages, a self-repeat, signs of several bytes, a long text."""
    rng = random.Random(seed)
    base, other, passage = prose(rng, 120), prose(rng, 90), prose(rng, 60)
    near = base.split()
    near[60] = "changed"
    out = [None, "", " \t\n", "word", "Éa" * 300, base, base, " ".join(near), other, other.replace(" ", "\n")]
    out += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(6)]
    out += [f"{passage} {passage}", "é漢字😀 " * 200, "ab" * 500, "ab" * 300 + "c" + "ab" * 200]
    out += [prose(rng, 6000), *(prose(rng, rng.randrange(1, 60)) for _ in range(12))]
    return out


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def covered(units: list, length: int) -> list[bytearray]:
    """For each sequence, 1 where a window that starts at two or more places covers it."""
    seen = Counter(u[i : i + length] for u in units for i in range(len(u) - length + 1))
    out = []
    for u in units:
        mask = bytearray(len(u))
        for i in range(len(u) - length + 1):
            if seen[u[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        out.append(mask)
    return out


def groups(ids: list, linked) -> dict:
    """The least id that each id reaches by links."""
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for at, i in enumerate(ids):
        for j in ids[:at]:
            if linked(i, j):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}
