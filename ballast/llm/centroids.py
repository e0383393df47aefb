"""Centroid clustering over a VA-file: k-means in whole numbers whose distances come from few-bit cells first.

The index keeps, for every vector, a cell number of ``BITS`` bits per dimension beside the full vector. For a round, lookup
tables hold the least and the greatest squared distance from each centroid to each cell of each dimension. Summed over the
dimensions they bound the distance of a vector to every centroid; where one centroid's upper bound lies below the lower
bounds of all others, the vector is decided from its cells alone. Full vectors are looked up for distances only where bounds
overlap. Each vector is read once more for the sums of its cluster, which are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import stored

BITS = 6
#: Vectors on which the cells are laid: those whose ids have the least hashes. All vectors are indexed.
SAMPLE = 1024
#: Up to this size of components doubles hold every squared distance of 64 dimensions exactly.
EXACT = float(1 << 20)
LIMB = 40
MOST = (1 << 63) - 1


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """The vectors of a list column without nulls, as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), size)


def whole_numbers(column: pa.Array, size: int, scale: float) -> np.ndarray:
    return np.floor(matrix(column, size) * scale)


class Cells:
    """Equal cells between the least and the greatest sampled number of a dimension; one more at each end for all beyond."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int = BITS):
        self.count = 1 << bits
        self.first = sample.min(0)
        self.width = np.maximum(1.0, np.ceil((sample.max(0) - self.first + 1) / (self.count - 2)))
        edges = self.first + self.width * np.arange(self.count - 1)[:, None]  # where cells 1, 2, ... begin
        self.low = np.vstack([np.minimum(low, edges[0] - 1), edges])
        self.high = np.vstack([edges - 1, np.maximum(high, edges[-1])])

    def of(self, vectors: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((vectors - self.first) / self.width) + 1, 0, self.count - 1).astype(np.uint8)

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(dimension, cell, centroid): the least and the greatest squared distance to a number of the cell."""
        c = centroids.T[:, None, :]
        low, high = self.low.T[:, :, None], self.high.T[:, :, None]
        outside = np.maximum(np.maximum(low - c, c - high), 0.0)
        return outside**2, np.maximum(np.abs(c - low), np.abs(c - high)) ** 2


def exact_distances(vectors: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared distances as whole numbers: doubles where they are exact, Python's numbers for components beyond ``EXACT``."""
    greatest = max(abs(x) for c in centroids for x in c)
    if greatest <= EXACT and (not len(vectors) or np.abs(vectors).max() <= EXACT):
        c = np.array(centroids, np.float64)
        return (vectors**2).sum(1)[:, None] - 2 * (vectors @ c.T) + (c**2).sum(1)
    rows = [[int(x) for x in v] for v in vectors]
    return np.array([[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids] for v in rows], dtype=object).reshape(len(rows), len(centroids))


class Assigner:
    """Assigns the vectors of a batch to the nearest centroids (of equal ones the first)."""

    def __init__(self, cells: Cells, centroids: list[list[int]]):
        self.centroids = centroids
        self.low, self.high = cells.tables(np.array(centroids, np.float64))
        wide = max(np.abs(cells.low).max(), np.abs(cells.high).max(), *(abs(x) for c in centroids for x in c)) > EXACT
        self.slack = 1e-9 if wide else 0.0  # beyond EXACT the bounds are rounded

    def __call__(self, cells: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cluster of each vector, and whether its full vector had to be fetched for it."""
        low, high = np.zeros((len(cells), len(self.centroids))), np.zeros((len(cells), len(self.centroids)))
        for d in range(cells.shape[1]):
            low += self.low[d][cells[:, d]]
            high += self.high[d][cells[:, d]]
        best = high.argmin(1)
        limit = high[np.arange(len(high)), best] * (1 + self.slack)
        open_ = low * (1 - self.slack) <= limit[:, None]
        fetched = open_.sum(1) > 1
        rows = np.flatnonzero(fetched)
        if len(rows):
            exact = exact_distances(vectors[rows], self.centroids)
            best[rows] = [min(range(len(d)), key=d.__getitem__) for d in exact] if exact.dtype == object else exact.argmin(1)
        return best, fetched


def limbs(value: int) -> list[int]:
    """A whole number of any size in parts of 40 bits; the last keeps the sign."""
    out = []
    while not -(1 << LIMB) <= value < 1 << LIMB:
        value, part = divmod(value, 1 << LIMB)
        out.append(part)
    return [*out, value]


def cluster_sums(index: DataFrame, cells: Cells, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Of every non-empty cluster the number of its vectors and their exact sums. A task sends one row per cluster, dimension and part."""
    k, size = len(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = Assigner(cells, centroids)
        counts, sums, wide = np.zeros(k, np.int64), np.zeros((k, size), np.int64), {}
        for batch in batches:
            vectors = matrix(batch.column(1), size)
            cluster, _ = assign(cells_of(batch.column(0), size), vectors)
            counts += np.bincount(cluster, minlength=k)
            small = np.abs(vectors).max(1, initial=0) <= EXACT
            member = (cluster[None, :] == np.arange(k)[:, None]) & small
            sums += (member.astype(np.float64) @ np.where(small[:, None], vectors, 0)).astype(np.int64)
            for i in np.flatnonzero(~small):
                have = wide.setdefault(int(cluster[i]), [0] * size)
                for d, x in enumerate(vectors[i]):
                    have[d] += int(x)
        rows = [(c, -1, 0, int(counts[c])) for c in range(k) if counts[c]]
        for c, *_ in list(rows):
            for d in range(size):
                total = int(sums[c, d]) + (wide[c][d] if c in wide else 0)
                rows += [(c, d, i, part) for i, part in enumerate(limbs(total))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["c", "d", "limb", "v"])

    parts = index.select("cells", "vector").mapInArrow(run, "c long, d long, limb long, v long")
    counts: dict[int, int] = {}
    sums: dict[int, list[int]] = {}
    for row in parts.groupBy("c", "d", "limb").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v")).collect():  # k * (size + 1) rows, times parts
        if row.d < 0:
            counts[row.c] = int(row.v)
        else:
            sums.setdefault(row.c, [0] * size)[row.d] += int(row.v) << (LIMB * row.limb)
    return {c: (n, sums[c]) for c, n in counts.items()}


def cells_of(column: pa.Array, size: int) -> np.ndarray:
    """The cell numbers of a batch: binary values of ``size`` bytes each."""
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), size) if len(column) else np.zeros((0, size), np.uint8)


def survey(kept: DataFrame, size: int, scale: float) -> tuple[int, np.ndarray, np.ndarray]:
    """How many vectors there are, and the least and the greatest number of each dimension; one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.full(size, np.inf), np.full(size, -np.inf)
        for batch in batches:
            vectors = whole_numbers(batch.column(0), size, scale)
            n += len(vectors)
            low, high = np.minimum(low, vectors.min(0, initial=np.inf)), np.maximum(high, vectors.max(0, initial=-np.inf))
        if n:
            yield pa.record_batch({"n": pa.array([n]), "low": pa.array([low.tolist()]), "high": pa.array([high.tolist()])})

    parts = kept.select("embedding").mapInArrow(run, "n long, low array<double>, high array<double>")
    ends = parts.agg(F.sum("n").alias("n"), *[F.min(F.col("low")[d]).alias(f"l{d}") for d in range(size)], *[F.max(F.col("high")[d]).alias(f"h{d}") for d in range(size)]).first()
    return ends.n or 0, np.array(ends[1 : 1 + size], np.float64), np.array(ends[1 + size :], np.float64)


def first_by_hash(kept: DataFrame, n: int, wanted: int, seed: int, size: int, scale: float) -> np.ndarray:
    """The vectors of the ``wanted`` least hashes, in their order. Only rows below a hash that few undercut are sorted."""
    hashed = kept.filter("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"), "embedding")
    share = min(1.0, 4 * wanted / n)
    while True:
        below = hashed if share >= 1 else hashed.filter(F.col("hash") < F.lit(f"{int(share * (1 << 64)):016x}"))
        rows = below.orderBy("hash", "embedding").limit(wanted).collect()
        if len(rows) == wanted or share >= 1:
            return np.floor(np.array([r.embedding for r in rows], np.float64).reshape(len(rows), size) * scale)
        share = min(1.0, share * 16)


def centroid_clusters(
    vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: float = 64.0, seed: int = 1, bits: int = BITS, sample: int = SAMPLE, progress: Callable[[int, list], None] | None = None
) -> DataFrame:
    """vec_id, cluster, distance (squared, to the final centroid), cluster_inertia, inertia, centroid_sha256, and fetched: whether
    the full vector was needed for the last assignment.

    Vectors with ``size`` components, none null or non-finite, are kept, and each component x becomes floor(scale * x).
    Null vectors and others are no rows of the result. The ``k`` vectors whose hash of ``seed:vec_id`` is least are the
    first centroids (of equal hashes, as repeated ids have, the least vector first); fewer if there are fewer. A null
    vec_id cannot be one, but its vector is assigned like any other. Each round assigns all vectors to the nearest
    centroid (ties: the smaller number) and moves non-empty centroids to floor(sum / count); then all are assigned once more.
    Equal vectors lie in one cluster. Distances that a long cannot hold come out as its greatest value; they are compared in
    full. Labels and other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    sound = F.expr(f"size(embedding) = {size} AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.coalesce(sound, F.lit(False)))
    n, low, high = survey(kept, size, scale)
    none = spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, fetched boolean")
    if not n:
        return none
    first = first_by_hash(kept, n, max(k, sample), seed, size, scale)
    if not len(first):
        return none
    centroids = [[int(x) for x in v] for v in first[:k]]
    cells = Cells(first, low, high, bits)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = whole_numbers(batch.column(1), size, scale)
            code = cells.of(numbers)
            packed = pa.array([row.tobytes() for row in code], pa.binary())
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * size)
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, pa.ListArray.from_arrays(ends, pa.array(numbers.ravel()))], ["vec_id", "cells", "vector"])

    index = stored(kept.mapInArrow(make, "vec_id long, cells binary, vector array<double>"))
    for number in range(rounds):
        for c, (count, sums) in cluster_sums(index, cells, centroids).items():
            centroids[c] = [total // count for total in sums]
        if progress:
            progress(number, centroids)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = Assigner(cells, centroids)
        for batch in batches:
            numbers = matrix(batch.column(2), size)
            cluster, fetched = assign(cells_of(batch.column(1), size), numbers)
            distance = np.zeros(len(numbers), np.int64)
            for c in np.unique(cluster):
                rows = np.flatnonzero(cluster == c)
                exact = exact_distances(numbers[rows], [centroids[c]])[:, 0]
                distance[rows] = [min(int(x), MOST) for x in exact] if exact.dtype == object else exact.astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(fetched)], ["vec_id", "cluster", "distance", "fetched"])

    assigned = stored(index.mapInArrow(last, "vec_id long, cluster int, distance long, fetched boolean"))
    totals = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    whole = min(sum(totals.values()), MOST)
    rows = [(c, min(d, MOST), whole, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, d in totals.items()]
    of_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    known = assigned.join(F.broadcast(of_cluster), "cluster")  # k rows
    return known.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "fetched")
