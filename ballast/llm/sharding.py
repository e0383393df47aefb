"""Sharding by a Feistel permutation: a reproducible shuffle in which shard and slot of every row can be computed.

Rows are numbered from 0 in an order that does not depend on partitions. A Feistel network over the least even number of
bits that holds all numbers permutes them; where it leaves the range, it is applied again (cycle walking), so it permutes
exactly the numbers below n. Of the permuted number, the remainder by the number of shards is the shard, the quotient the slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ballast.llm.common import stored

PRIME = (1 << 31) - 1
ROUNDS = 6
#: Of a row's number, as Spark gives it out within partitions, these bits count the rows of a partition.
LOW_BITS = 33


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Three numbers below 2**31 - 1 for each round, from a linear congruence over the seed."""
    x, out = (seed * 1103515245 + 12345) % PRIME or 1, []
    for _ in range(rounds):
        key = []
        for _ in range(3):
            x = x * 48271 % PRIME
            key.append(x)
        out.append(tuple(key))
    return out


def scramble(x: np.ndarray, key: tuple[int, int, int]) -> np.ndarray:
    """The round function: numbers below 2**31 to numbers below 2**31, in products that fit 63 bits."""
    a, b, c = key
    y = (x * a + b) % PRIME
    y = ((y ^ (y >> 15)) * c + a) % PRIME
    return y ^ (y >> 13)


def half_bits(n: int) -> int:
    return max(1, ((n - 1).bit_length() + 1) // 2)


def network(x: np.ndarray, half: int, keys: list[tuple[int, int, int]], back: bool = False) -> np.ndarray:
    """The Feistel network over 2 * half bits, or its inverse."""
    mask = (1 << half) - 1
    left, right = x >> half, x & mask
    for key in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (scramble(left, key) & mask), left
        else:
            left, right = right, left ^ (scramble(right, key) & mask)
    return left << half | right


def permute(x: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The place of each row number below n in the shuffle, or (``back``) the row number at each place."""
    half, keys = half_bits(n), round_keys(seed)
    out = network(np.asarray(x, np.int64), half, keys, back)
    while len(beyond := np.flatnonzero(out >= n)):
        out[beyond] = network(out[beyond], half, keys, back)
    return out


def place(rows: np.ndarray, n: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of each row number."""
    at = permute(rows, n, seed)
    return at % shards, at // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int) -> np.ndarray:
    """The number of the row that lies in a slot of a shard, for readers that fetch by place."""
    return permute(np.asarray(slot, np.int64) * shards + shard, n, seed, back=True)


def numbered(df: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
    """struct ``row`` of the columns of ``df`` and ``number``: from 0, without gaps, in the order of ``by`` (nulls last), then
    of a hash of all columns; and how many rows there are.

    Rows are sorted in ranges; a number is the rows of the ranges before, plus those before it in its own range. Rows that
    are equal throughout may lie in several ranges: which of them has which number cannot be told.
    """
    spark = df.sparkSession
    hashed = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]
    wide = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.xxhash64(*hashed).alias("hash"), F.monotonically_increasing_id().alias("salt"))
    order = [F.col(f"row.`{c}`").asc_nulls_last() for c in by] + [F.col("hash").asc(), F.col("salt").asc()]
    ranged = wide.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    # Written once: the ids must not change between readings.
    rows = stored(ranged.select("row", F.monotonically_increasing_id().alias("id")))
    sizes = rows.groupBy(F.shiftright("id", LOW_BITS).alias("range")).agg(F.count("*").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shuffle partition
    ranges = [(r.range, r.base, r.n) for r in sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).collect()]
    bases = spark.createDataFrame([(r, b) for r, b, _ in ranges], "range long, base long")
    number = F.col("base") + F.col("id").bitwiseAND(F.lit((1 << LOW_BITS) - 1))
    known = rows.withColumn("range", F.shiftright("id", LOW_BITS)).join(F.broadcast(bases), "range")
    return known.select("row", number.alias("number")), sum(n for _, _, n in ranges)


def sharded(df: DataFrame, shards: int = 24, by: tuple[str, ...] = ("doc_id",), seed: int = 13) -> DataFrame:
    """struct ``row`` of all columns of ``df``, and its number, shard and slot in the shuffle of ``seed``.

    Law: the counts of the shards are at most one apart, and slots are gapless from 0. The place follows from the row's
    number, the number of rows and the seed, so ``row_at`` finds a row from its place. Null ids stand last; rows that
    repeat are rows like others, spread over all shards; an empty table gives an empty result. Columns may have any names.
    """
    rows, n = numbered(df, list(by))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, slot = place(batch.column(1).to_numpy(), n, shards, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard.astype(np.int32)), pa.array(slot)], ["row", "number", "shard", "slot"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, number long, shard int, slot long")


def write_shards(df: DataFrame, path: str, shards: int = 24, by: tuple[str, ...] = ("doc_id",), seed: int = 13, slots_a_file: int = 1 << 20) -> None:
    """The shards as Parquet folders ``shard=N``, in files of consecutive slots that are sorted by slot."""
    placed = sharded(df, shards, by, seed)
    names = {c.lower() for c in df.columns}
    if names & {"shard", "slot"}:
        raise ValueError("a column named shard or slot would be lost")
    files = placed.withColumn("file", F.expr(f"slot div {slots_a_file}"))
    dealt = files.repartition("shard", "file").sortWithinPartitions("shard", "file", "slot")
    dealt.select("row.*", "slot", "shard").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 13) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null) and number of every document.

    The law is ``rows``: counts at most one apart, which leaves no room for keeping equal texts together; copies are dealt
    out like other documents, so a group of them is spread over the shards. A null text has no bytes. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharded(narrow, shards, ("doc_id",), seed)
    return placed.select("row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "number")
