"""Mixing sources to target weights.

A source's texts, laid end to end, are cut into blocks of a fixed number of words. Each output shard gets a multinomial
draw of every source's slots, slots map to blocks by a pseudorandom permutation of the source's block numbers (a new one
for each pass over the source), and blocks meet their slots in a join by number.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.llm.common import WORD, doc_key, spans_of, stored, text_tag, utf8
from ballast.llm.hashing import words

#: Words of a block; a source's take misses its target by less than one block.
BLOCK = 64
#: Slots of an output shard, on average.
SHARD_SLOTS = 4096
#: Copies of a document that are numbered at once.
COPIES = 1 << 12
#: Ranges of a source's documents whose sizes are added up apart.
RANGES = 4096


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def permuted(index: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1: a four-round Feistel network, walked until it lands inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(seed).integers(1, 1 << 62, 4, dtype=np.uint64)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for key in keys:
            x = (right + key) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((x >> np.uint64(32)) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def shard_slots(slots: int, shards: int, shard: int, seed: int, bounds: Callable[[int], int] = int) -> tuple[int, int]:
    """First slot and number of slots of one shard of a multinomial draw over equal shards, or of one range of them that
    ``bounds`` tells the borders of.

    The draw is taken by halving the shards, a binomial each time, so any task finds its own shard's part alone.
    """
    first, low, high = 0, 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        draw = np.random.default_rng([seed, low, high])
        left = int(draw.binomial(slots, (bounds(middle) - bounds(low)) / (bounds(high) - bounds(low))))
        if shard < middle:
            slots, high = left, middle
        else:
            first, slots, low = first + left, slots - left, middle
    return first, slots


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """source, source_size and target of a table of source, source_size: the sizes' total shared by weight.

    Sources stand by code point, null last, and weigh ``weights``, repeating. A target stops at ``most`` times its
    source's size; what is above goes to the others by weight. That is the level at which the sum of
    min(most * size, level * weight) is the total. The table has a row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything, before = Window.partitionBy(), by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    table = sizes.withColumn("weight", weight).withColumn("cap", cap)
    table = table.withColumns({
        "total": F.sum("source_size").over(everything).cast("double"),
        "spent": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "free": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # In the order of cap / weight, the first source whose cap lies above the level that is left for it sets that level.
    table = table.withColumn("level", (F.col("total") - F.col("spent")) / F.col("free"))
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    return table.withColumn("target", F.least("cap", F.coalesce(level, F.lit(0.0)) * F.col("weight"))).select("source", "source_size", "target")


def sizes_of(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), doc_key().alias("k"), text_tag().alias("t"), n_words().alias("size"),
    )


def take(sized: DataFrame, targets: DataFrame, block: int, seed: int) -> DataFrame:
    """source, k, t, copy, pass, a, b, shard, slot, at: the words [a, b) of a copy of a document that a slot of an output shard
    holds from its word ``at`` on; pass tells the how many-th time the source is gone over."""
    # Documents end to end: sizes are added up per range of a source, then within it.
    ranged = sized.filter("size > 0").groupBy("source", "k", "t").agg(F.max("size").alias("size"), F.count("*").alias("copies"))
    ranged = ranged.withColumn("range", F.pmod(F.xxhash64("k", "t"), F.lit(RANGES)))
    sums = ranged.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("copies")).alias("sum"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "range").orderBy("k", "t").rowsBetween(Window.unboundedPreceding, -1)
    laid = ranged.withColumn("inner", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    laid = laid.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).drop("s", "r")
    laid = each_copy(laid).withColumn("start", F.expr("base + inner + copy * size"))
    parts = laid.withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    slots = draws(targets, block, seed).withColumnRenamed("source", "s").hint("merge")
    joined = parts.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("index")))
    joined = joined.withColumn("a", F.expr(f"greatest(start, block * {block}) - start")).withColumn("b", F.expr(f"least(start + size, block * {block} + words) - start"))
    at = F.expr(f"greatest(start - block * {block}, 0)")
    return joined.filter("a < b").select("source", "k", "t", "copy", "pass", "a", "b", "shard", "slot", at.alias("at"))


def each_copy(df: DataFrame) -> DataFrame:
    """A row for each of ``copies``, numbered by ``copy`` from 0; numbers are made in parts, so that no list is long."""
    parts = df.withColumn("_part", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")))
    return parts.withColumn("copy", F.explode(F.expr(f"sequence(_part * {COPIES}, least(copies, (_part + 1) * {COPIES}) - 1)"))).drop("_part")


def plan(docs: DataFrame, weights: tuple[float, ...], most: float, block: int) -> tuple[DataFrame, DataFrame]:
    sized = stored(sizes_of(docs))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return sized, stored(source_targets(per_source, weights, most).withColumn("blocks", F.expr(f"(source_size + {block} - 1) div {block}")))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted), and the first and the last output shard that
    holds any of them, of every row.

    ``size`` counts words; a null or empty text has none. A null source is a source, and stands last. Rows that share id,
    text and source have slots of their own each; which of them has which cannot be told. A null doc_id stays null. No
    document is taken more than ``most`` (rounded up) times. Other columns are ignored; an empty table gives an empty
    result. A rerun draws the same.
    """
    sized, targets = plan(docs, weights, most, block)
    taken = take(sized, targets, block, seed).groupBy("source", "k", "t", "copy").agg(
        F.sum(F.col("b") - F.col("a")).alias("taken"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    copies = each_copy(sized.filter("size > 0").groupBy("doc_id", "source", "k", "t", "size").agg(F.count("*").alias("copies")))
    s, u = copies.alias("s"), taken.alias("u")
    same = [F.col(f"s.{c}") == F.col(f"u.{c}") for c in ("k", "t", "copy")]
    known = s.join(u, F.col("s.source").eqNullSafe(F.col("u.source")) & same[0] & same[1] & same[2], "left")
    shards = ["first_shard", "last_shard"]
    known = known.select("s.doc_id", F.col("s.source").alias("own"), "s.size", F.coalesce("u.taken", F.lit(0)).alias("taken"), *shards)
    none = F.lit(None).cast("long")
    wordless = sized.filter("size = 0").select("doc_id", F.col("source").alias("own"), "size", F.lit(0).cast("long").alias("taken"), *[none.alias(c) for c in shards])
    known = known.union(wordless).join(targets, F.col("own").eqNullSafe(F.col("source")))
    return known.select("doc_id", "size", "source_size", "target", "taken", *shards)


def mixed_blocks(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """The output shards in fixed-length blocks: shard, source, slot, at, text: the words from word ``at`` on of what a slot holds.

    A shard holds of each source as many slots as it has drawn; a slot that lies across documents comes in parts, one a
    document. Words are joined by one space. What ``mix`` says of nulls, repeats and empty tables holds here.
    """
    sized, targets = plan(docs, weights, most, block)
    parts = take(sized, targets, block, seed).groupBy("source", "k", "t", "copy").agg(F.collect_list(F.struct("shard", "slot", "at", "a", "b")).alias("parts"))
    each = docs.select(doc_key().alias("k"), text_tag().alias("t"), F.col("source").cast("string").alias("own"), "text").dropDuplicates(["k", "t", "own"])
    held = each.join(parts, (each.k == parts.k) & (each.t == parts.t) & each.own.eqNullSafe(parts.source)).select("source", "text", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, cell in enumerate(batch.column(2)):
                body = data[offsets[i] : offsets[i + 1]].tobytes().split()  # splits at the six white-space bytes
                shard, slot, at, a, b = cell.values.flatten()
                texts = [b" ".join(body[x:y]).decode() for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
                source = pa.array([batch.column(0)[i].as_py()] * len(texts), pa.string())
                yield pa.record_batch([shard, source, slot, at, pa.array(texts, pa.string())], ["shard", "source", "slot", "at", "text"])

    return held.mapInArrow(run, "shard long, source string, slot long, at long, text string")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each pass that takes words of a document, holding the text
    from the first to the last word of every stretch taken, stretches parted by a line end. A document that a pass takes
    whole keeps its words as they stand. What ``mix`` says of nulls, repeats and empty tables holds here; texts without
    words are not in the mix.
    """
    sized, targets = plan(docs, weights, most, block)
    lists = take(sized, targets, block, seed).groupBy("source", "k", "t", "copy", "pass").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    lists = lists.select(F.col("source").alias("_s"), "k", "t", F.col("spans").alias("_spans"))
    columns = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    each = docs.select(row, doc_key().alias("k"), text_tag().alias("t"), F.col("source").cast("string").alias("s")).dropDuplicates(["k", "t", "s"])
    joined = each.join(lists, (each.k == lists.k) & (each.t == lists.t) & each.s.eqNullSafe(lists["_s"])).select("row.*", "_spans")
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            texts = []
            for i, cell in enumerate(batch.column(len(columns))):
                part = data[offsets[i] : offsets[i + 1]]
                starts, ends, _ = words(part, np.array([0, len(part)]))
                body = part.tobytes()
                texts.append("\n".join(body[starts[a] : ends[b - 1]].decode() for a, b in spans_of(cell)))
            out = [*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 : len(columns)]]
            yield pa.RecordBatch.from_arrays(out, columns)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(run, schema)


def draws(targets: DataFrame, block: int, seed: int) -> DataFrame:
    """source, shard, slot, pass, index, words: the block of every slot, and how many of its words the slot takes.

    All sources fill the same output shards. Each draws, over all shards alike, how many of its slots lie in each, so a
    shard's counts by source are a multinomial draw, and a source's slots over all shards are those of its target.
    """
    slots = targets.agg(F.sum(F.floor("target") / block + 3)).first()[0] or 0
    shards = max(1, -int(-slots // SHARD_SLOTS))
    # A source's part of the draw comes in ranges of shards of about as many slots each, however many sources there are.
    ranges = F.least(F.lit(shards), F.ceil((F.floor("target") / block + 3) / SHARD_SLOTS)).cast("long")
    ranged = targets.filter("source_size > 0").withColumn("ranges", ranges).withColumn("range", F.explode(F.expr("sequence(0L, ranges - 1)")))
    # Rows are few and small but make many: a number that Spark does not lower.
    tasks = max(int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards // 64)
    ranged = ranged.repartition(tasks, "source", "range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                size, n_blocks, wanted = row["source_size"], row["blocks"], int(row["target"])
                passes, rest = divmod(wanted, size)
                # Of the last pass as many slots as its words need; the very last slot takes only what is missing.
                last = -(-rest // block)
                key = zlib.crc32(repr((row["source"], seed)).encode())
                parts, part = row["ranges"], row["range"]

                def bounds(i: int, parts: int = parts) -> int:
                    return i * shards // parts

                first, count = shard_slots(passes * n_blocks + last, parts, part, key, bounds)
                low, high = bounds(part), bounds(part + 1)
                counts = np.random.default_rng([key, part, 1]).multinomial(count, np.full(high - low, 1 / (high - low)))
                slot = np.arange(first, first + count)
                number, within = slot // n_blocks, slot % n_blocks
                index = np.zeros(count, np.int64)
                for n in np.unique(number):
                    index[number == n] = permuted(within[number == n], n_blocks, key + 7919 * (int(n) + 1))
                words_taken = np.full(count, block, np.int64)
                words_taken[slot == passes * n_blocks + last - 1] = rest - block * (last - 1) if last else block
                yield pa.record_batch({
                    "source": pa.array([row["source"]] * count, pa.string()), "shard": pa.array(np.repeat(np.arange(low, high), counts)), "slot": pa.array(slot),
                    "pass": pa.array(number), "index": pa.array(index), "words": pa.array(words_taken),
                })

    return ranged.mapInArrow(run, "source string, shard long, slot long, pass long, index long, words long")

