"""Embedding near-dedup by lattice hashing: random projections to eight dimensions, decoded to the E8 lattice.

A table joins the E8 points of a few projections into one cell. A vector lies in its own cell of every table and looks, besides,
into neighbouring cells: those where one projection's point is swapped for a nearby one. Pairs that meet are
compared in double precision, so no pair below the limit is linked.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import discard, stored
from ballast.llm.components import components
from ballast.llm.hashing import U64, mix
from ballast.session import setting

#: Of pairs with a cosine of 0.9 these find over 99 in 100, and of those above 0.93 all but one in thousands.
TABLES, BLOCKS, PROBES, SCALE = 16, 3, 6, 0.85
#: Tables whose cells and pairs are on disk at once.
TABLES_A_ROUND = 1


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum: rounding, and the least certain coordinate the other way if odd."""
    near = np.rint(x)
    rest = x - near
    worst = np.abs(rest).argmax(1)
    rows = np.flatnonzero(near.sum(1) % 2)
    near[rows, worst[rows]] += np.where(rest[rows, worst[rows]] < 0, -1, 1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, the union of D8 and D8 moved by one half in every coordinate."""
    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


@lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8, by which its neighbouring points differ."""
    pairs = [[(a if k == i else b if k == j else 0) for k in range(8)] for i, j in itertools.combinations(range(8), 2) for a in (-1, 1) for b in (-1, 1)]
    halves = [s for s in itertools.product((-0.5, 0.5), repeat=8) if sum(v < 0 for v in s) % 2 == 0]
    return np.array(pairs + halves, np.float64)


@lru_cache(maxsize=8)
def projections(size: int, seed: int) -> np.ndarray:
    """For each table and block an orthonormal set of eight directions (as far as there are), scaled to keep lengths on average."""
    rng = np.random.default_rng([seed, size])
    made = []
    for _ in range(TABLES * BLOCKS):
        basis = np.linalg.qr(rng.standard_normal((size, min(8, size))))[0]
        made.append(np.pad(basis, ((0, 0), (0, 8 - basis.shape[1]))) * np.sqrt(size / min(8, size)))
    return np.stack(made)


def cells(vectors: np.ndarray, seed: int = 5, tables: Sequence[int] = range(TABLES)) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors: the cell in each table (rows, tables), and all cells to look into (rows, tables, 1 + BLOCKS * PROBES)."""
    own = np.empty((len(vectors), len(tables)), U64)
    look = np.empty((len(vectors), len(tables), 1 + BLOCKS * PROBES), U64)
    salt = mix(np.arange(1, 1 + 8 * BLOCKS * TABLES, dtype=U64) * U64(0x9E3779B97F4A7C15)).reshape(TABLES, BLOCKS, 8) | U64(1)
    for at, t in enumerate(tables):
        parts, others = [], []
        for b in range(BLOCKS):
            x = vectors @ projections(vectors.shape[1], seed)[t * BLOCKS + b] / SCALE
            point = nearest_e8(x)
            toward = np.argpartition(-((x - point) @ roots().T), PROBES, axis=1)[:, :PROBES]
            # The hash is linear in the point, so a neighbour's is the point's and its root's together.
            step = ((2 * roots()).astype(np.int64).view(U64) * salt[t, b]).sum(-1, dtype=U64)
            parts.append(((2 * point).astype(np.int64).view(U64) * salt[t, b]).sum(-1, dtype=U64))
            others.append(parts[b][:, None] + step[toward])
        total = sum(parts)
        own[:, at] = mix(total + U64(t))
        look[:, at, 0] = own[:, at]
        for b in range(BLOCKS):
            look[:, at, 1 + b * PROBES : 1 + (b + 1) * PROBES] = mix((total - parts[b])[:, None] + others[b] + U64(t))
    return own, look


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = column.value_lengths().to_numpy()
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, matrix(column.take(pa.array(rows)))


def near_vectors(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links (other vectors with a cosine of ``least`` or more), component_id (the least vec_id that links reach), kept.

    Vectors that are null, empty or zero, or hold null or non-finite numbers, link with nothing, and so do vectors of
    different lengths among each other. Equal vectors are one node with a count. A null vec_id links with nothing, has a
    null component and is kept; rows that share a vec_id are vectors of their own, with the same component; labels and
    other columns are ignored; an empty table gives an empty result.
    """
    source = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.expr("size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(v, x -> x <> 0)")
    good = source.filter(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))
    nodes = stored(good.groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("times")))

    def hashed(tables: Sequence[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    ids = part.column("node").to_numpy(zero_copy_only=False)
                    for rows, x in by_length(part.column("v")):
                        x = x / np.abs(x).max(1, keepdims=True)
                        own, look = cells(x / np.linalg.norm(x, axis=1, keepdims=True), tables=tables)
                        size = U64(x.shape[1])
                        yield pa.record_batch({
                            "node": pa.array(ids[rows]), "own": pa.array((own ^ size).view(np.int64).tolist(), pa.list_(pa.int64())),
                            "look": pa.array((look ^ size).reshape(len(rows), -1).view(np.int64).tolist(), pa.list_(pa.int64())),
                        })

        return run

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            one, two = batch.column("va"), batch.column("vb")
            same = one.value_lengths().to_numpy() == two.value_lengths().to_numpy()
            for rows, x in by_length(one):
                rows, x = rows[same[rows]], x[same[rows]]
                if len(rows):
                    y = matrix(two.take(pa.array(rows)))
                    x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
                    near[rows] = (x * y).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) >= least
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(near))

    side = {c: nodes.select(F.col("node").alias(c), F.col("v").alias(f"v{c}")) for c in "ab"}
    found = []
    # Tables go in rounds: only links outlive one, and its cells, pairs and shuffles leave the disk before the next.
    for first in range(0, TABLES, TABLES_A_ROUND):
        with setting(vectors.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            placed = stored(nodes.select("node", "v").mapInArrow(hashed(range(first, min(first + TABLES_A_ROUND, TABLES))), "node long, own array<long>, look array<long>"))
            index = placed.select(F.col("node").alias("a"), F.explode("own").alias("cell"))
            probes = placed.select(F.col("node").alias("b"), F.explode(F.array_distinct("look")).alias("cell"))
            pairs = index.join(probes, "cell").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            found.append(stored(pairs.join(side["b"], "b").join(side["a"], "a").select("a", "b", "va", "vb").mapInArrow(compared, "a long, b long")))
        discard(placed)
    links = stored(reduce(DataFrame.unionByName, found).distinct())
    discard(*found)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.join(nodes.select(F.col("node").alias("b"), "times"), "b").groupBy("a").agg(F.sum("times").alias("n"))
    groups = components(links).select(F.col("node").alias("c"), "component")
    known = nodes.join(counts, F.col("node") == F.col("a"), "left").join(groups, F.col("node") == F.col("c"), "left")
    known = known.select("v", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    joined = good.join(known, "v").select("id", "n_links", "component")
    rest = source.filter(F.col("id").isNull() | ~F.coalesce(sound, F.lit(False))).select("id", F.lit(0).cast("long"), F.col("id"))
    return joined.union(rest).select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"),
    )
