"""MinHash near-dedup: universal hash minima, banding, signature and full-set verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import chunks, stored, utf8
from ballast.llm.components import components
from ballast.llm.hashing import U64, mix, prefix, span, word_hashes, words

#: Bands and minima of a band: of two sets with a likeness of 0.8, one pair in ten million shares no band.
BANDS, BAND_ROWS = 40, 5
HASHES = BANDS * BAND_ROWS
#: Texts that meet as many others in one block.
BLOCK = 200
#: How far below the wanted likeness signatures may agree before a pair is given up: 4.6 standard deviations.
SLACK = 0.13
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's shingles, one text after another, and how many there are before each.

    Letters A-Z are lower-cased; a text with fewer than ``size`` words has them all as its one shingle, one without
    words has none.
    """
    starts, ends, before = words(data := LOWER[data], offsets)
    count = np.diff(before)
    number = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(count)), number)
    first = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(before[:-1], number)
    width = np.minimum(size, count[text])
    hashes = mix(span(prefix(word_hashes(data, starts, ends)), first, first + width) + width.astype(U64))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.searchsorted(text[new], np.arange(len(count) + 1))


def universal(seed: int = 41) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and summands of the hash functions x -> a x + b modulo 2**64."""
    made = np.random.default_rng(seed).integers(0, 1 << 64, (2, HASHES), dtype=U64)
    return made[0] | U64(1), made[1]


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """id, n, s1, s2, sig: the size of each text's set, two hashes of the set, and the low 16 bits of its minima."""
    factor, summand = universal()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in chunks(offsets):
                sets, before = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                n = np.diff(before)
                full = np.flatnonzero(n)
                heads = before[:-1][full]
                made = np.zeros((b - a, HASHES), np.uint16)
                sums = np.zeros((2, b - a), U64)
                if len(full):
                    for i in range(HASHES):
                        made[full, i] = (np.minimum.reduceat(sets * factor[i] + summand[i], heads) & U64(0xFFFF)).astype(np.uint16)
                    for i, salt in enumerate((U64(0x9FB21C651E98DF25), U64(0xE7037ED1A0B428DB))):
                        sums[i, full] = np.add.reduceat(mix(sets ^ salt), heads)
                sig = [made[i].tobytes() if n[i] else None for i in range(b - a)]
                yield pa.record_batch({
                    "id": batch.column("id")[a:b], "n": pa.array(n), "s1": pa.array(sums[0].view(np.int64)), "s2": pa.array(sums[1].view(np.int64)), "sig": pa.array(sig, pa.binary()),
                })

    return docs.mapInArrow(run, "id long, n long, s1 long, s2 long, sig binary")


def agreeing(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose signatures agree about as much as those of linked texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            near = pa.array((one == two).sum(1) >= least_agreement(percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(near)

    side = {c: reps.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab"}
    return pairs.join(side["b"], "b").join(side["a"], "a").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def least_agreement(percent: int) -> int:
    return int((percent / 100 - SLACK) * HASHES)


def sets_of(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted shingle hashes of each text of a column."""
    data, offsets = utf8(column)
    got = []
    for a, b in chunks(offsets):
        all_, before = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
        got += [all_[before[i] : before[i + 1]] for i in range(b - a)]
    return got


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    side = {c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab"}
    return pairs.join(side["b"], "b").join(side["a"], "a").select("a", "b", "text_a", "text_b")


def linked(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those with 100 * intersection >= percent * union, by their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                near = []
                for one, two in zip(sets_of(part.column("text_a"), size), sets_of(part.column("text_b"), size), strict=True):
                    common = len(np.intersect1d(one, two, assume_unique=True))
                    near.append(common > 0 and 100 * common >= percent * (len(one) + len(two) - common))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    return with_texts(pairs, texts).mapInArrow(run, "a long, b long").distinct()


def differences(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """a, b, n_set (size of a's set), added and removed: what b's set has and a's has not, and the other way round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                both = list(zip(sets_of(part.column("text_a"), size), sets_of(part.column("text_b"), size), strict=True))
                yield pa.record_batch({
                    "a": part.column("a"), "b": part.column("b"), "n_set": pa.array([len(one) for one, _ in both], pa.int64()),
                    "added": pa.array([np.setdiff1d(two, one, assume_unique=True).view(np.int64) for one, two in both], kind),
                    "removed": pa.array([np.setdiff1d(one, two, assume_unique=True).view(np.int64) for one, two in both], kind),
                })

    return with_texts(pairs, texts).mapInArrow(run, "a long, b long, n_set long, added array<long>, removed array<long>")


def beyond_lead(pairs: DataFrame, links: DataFrame, groups: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between texts of a bucket that its lead does not link both, and that are in two components so far.

    Copies differ little from their lead, so a text stands for its differences from it: of two texts x and y of a lead p,
    the intersection is size(p) - |removed x or removed y| + |added x and added y|. The texts that a lead does not link
    meet its others in blocks of about BLOCK each; only links leave a task.
    """
    near = links.select("a", "b", F.lit(True).alias("near"))
    label = groups.select(F.col("node").alias("b"), "component")
    found = pairs.join(near, ["a", "b"], "left").join(label, "b", "left").withColumn("component", F.coalesce("component", "b"))
    counts = found.groupBy("a").agg(F.count("*").alias("n"), F.count_if(F.col("near").isNull()).alias("lost"), F.min("component").alias("low"), F.max("component").alias("high"))
    counts = stored(counts.filter("lost > 0 and low <> high").select("a", "n", "lost"))
    found = found.join(counts, "a")
    rows = stored(found.join(differences(found.select("a", "b"), texts, size), ["a", "b"]))

    def blocks(df: DataFrame, n: str, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("b"), F.ceil(F.col(n) / BLOCK)).alias("block")
        return df.groupBy("a", block).agg(F.collect_list(F.struct("b", "component", "n_set", "added", "removed")).alias(name)).drop("block")

    both = blocks(rows.filter("near is null"), "lost", "x").join(blocks(rows, "n", "y"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns(cell: pa.Scalar) -> tuple[np.ndarray, ...]:
            *plain, added, removed = cell.values.flatten()
            lists = [(c.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(c.value_lengths().to_numpy())]) for c in (added, removed)]
            return *(c.to_numpy(zero_copy_only=False) for c in plain), *lists

        def common(one: np.ndarray, all_: np.ndarray, bounds: np.ndarray) -> np.ndarray:
            """How many values of a sorted array each of several lists holds."""
            at = np.minimum(np.searchsorted(one, all_), max(len(one) - 1, 0))
            hit = np.r_[0, np.cumsum(one[at] == all_ if len(one) else np.zeros(len(all_), bool))]
            return hit[bounds[1:]] - hit[bounds[:-1]]

        for batch in batches:
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                xi, xc, _, (xa, xa_at), (xr, xr_at) = columns(x)
                yi, yc, n, (ya, ya_at), (yr, yr_at) = columns(y)
                sizes = n + np.diff(ya_at) - np.diff(yr_at)
                for i in np.flatnonzero((xc[:, None] != yc).any(1)):
                    added, removed = np.sort(xa[xa_at[i] : xa_at[i + 1]]), np.sort(xr[xr_at[i] : xr_at[i + 1]])
                    shared = n - np.diff(yr_at) - len(removed) + common(removed, yr, yr_at) + common(added, ya, ya_at)
                    union = sizes + n + len(added) - len(removed) - shared
                    to = yi[(yc != xc[i]) & (shared > 0) & (100 * shared >= percent * union)]
                    if len(to):
                        yield pa.record_batch({"a": pa.array(np.minimum(xi[i], to)), "b": pa.array(np.maximum(xi[i], to))})

    return both.select("x", "y").mapInArrow(run, "a long, b long").distinct()


def regrouped(groups: DataFrame, links: DataFrame) -> DataFrame:
    """node, component after further links; only the components that these join are worked on."""
    of = groups.select(F.col("node"), F.col("component"))
    known = links.join(of.toDF("a", "x"), "a", "left").join(of.toDF("b", "y"), "b", "left")
    known = stored(known.select("a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")).filter("x <> y"))
    if known.isEmpty():
        return groups
    moved = stored(components(known.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    single = known.select("a").union(known.select("b")).distinct().toDF("node").join(of, "node", "left_anti").select("node", F.col("node").alias("component"))
    return stored(of.union(single).join(moved.toDF("component", "least"), "component", "left").select("node", F.coalesce("least", "component").alias("component")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) and kept (it is the doc_id itself) of every row.

    Texts link if 100 * intersection >= percent * union of their sets of ``size``-word shingles. A null or empty text
    has no shingles and links with nothing; a null doc_id links with nothing, has a null component and is kept; rows that
    share a doc_id share the least component that one of them has; other columns are ignored; an empty
    table gives an empty result.

    Texts with one set are one node, so copies are never paired. In a bucket (texts with one band in common) all are
    compared with its first; where that does not link both of two texts, see beyond_lead.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    made = stored(signatures(source, size))
    known = made.filter("id is not null and n > 0")
    reps = stored(known.groupBy("s1", "s2").agg(F.min("id").alias("id"), F.first("sig").alias("sig")))
    width = 2 * BAND_ROWS
    hashes = F.array(*[F.xxhash64(F.substring("sig", 1 + width * i, width), F.lit(i)) for i in range(BANDS)])
    bands = reps.select("id", F.explode(hashes).alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.min("id").alias("lead"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = stored(shared)  # a written side lets Spark split the other one where a bucket is large
    members = stored(bands.join(shared, "bucket").filter("id <> lead").select("lead", "id"))
    names = members.select("id").union(members.select("lead")).distinct()
    texts = stored(source.join(names, "id", "left_semi").dropDuplicates(["id", "text"]))
    pairs = stored(members.select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct())
    links = stored(linked(stored(agreeing(pairs, reps, percent)), texts, size, percent))
    groups = stored(components(links))
    groups = regrouped(groups, stored(beyond_lead(pairs, links, groups, texts, size, percent)))
    ids = known.select("s1", "s2", F.col("id").alias("own")).distinct().join(reps.select("s1", "s2", "id"), ["s1", "s2"])
    ids = ids.join(groups.withColumnRenamed("node", "id"), "id", "left").select("own", F.coalesce("component", "id").alias("component"))
    ids = ids.groupBy("own").agg(F.min("component").alias("component"))
    placed = made.select("id", "n").join(ids, F.col("id") == F.col("own"), "left")
    component = F.coalesce("component", "id")
    return placed.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
