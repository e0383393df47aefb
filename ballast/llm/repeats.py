"""Repeated windows of fixed length in a corpus: where a window may recur, and which stretches it covers.

Every window of ``length`` tokens names one of its k-grams, the least by hash, its anchor. Equal windows name the same one at
the same place, so windows can recur only around anchors that recur. The windows of one document that share an anchor make
a segment. Segments of recurring anchors, one of each distinct content, are handed to a resolver, all of an anchor
together; what it finds covered goes back to every place of that content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import CHUNK_BYTES, chunks, discard, doc_key, stored, text_tag, utf8
from ballast.llm.hashing import BYTE_TOKENS, U64, mix, prefix, span, word_hashes, words

#: Low bits of a k-gram's rank, which hold its place.
PLACE = 24


@dataclass(frozen=True)
class Windows:
    """``unit`` is "word" or "byte"; windows have ``length`` of them, anchors ``gram``."""

    unit: str
    length: int
    gram: int

    @property
    def grams(self) -> int:
        return self.length - self.gram + 1


@dataclass(frozen=True)
class Segment:
    """Content of consecutive windows with one anchor: its bytes, the anchor's place, the number of windows, and how often it occurs."""

    anchor: int
    content: int
    data: bytes
    place: int
    windows: int
    times: int


def tokens_of(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit token per unit, and the number of units before each text."""
    if unit == "byte":
        return BYTE_TOKENS[data], offsets
    starts, ends, before = words(data, offsets)
    return word_hashes(data, starts, ends), before


def anchors(tokens: np.ndarray, bounds: np.ndarray, w: Windows) -> tuple[np.ndarray, ...]:
    """Text number, first window, windows, anchor's place in the segment, anchor's hash and content's hash of all segments."""
    n, step = len(tokens), w.grams
    empty = tuple(np.zeros(0, np.int64) for _ in range(6))
    if n < w.length:
        return empty
    at = np.arange(n - w.gram + 1)
    grams = mix(span(prefix(tokens), at, at + w.gram))
    least = (grams & ~U64((1 << PLACE) - 1)) | at.astype(U64)
    width = 1
    while width < step:  # minima of windows twice as wide each time
        more = min(width, step - width)
        least = np.minimum(least[: len(least) - more], least[more:])
        width += more
    # Windows must lie within one text.
    sizes = np.diff(bounds)
    counts = np.maximum(sizes - w.length + 1, 0)
    total = int(counts.sum())
    if not total:
        return empty
    text = np.repeat(np.arange(len(sizes)), counts)
    start = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(bounds[:-1], counts)
    place = (least[start] & U64((1 << PLACE) - 1)).astype(np.int64)
    new = np.ones(total, bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    number = np.diff(first, append=total)
    begin, place, text = start[first], place[first], text[first]
    sums = prefix(grams, 0xA24BAED4963EE407)
    content = mix(span(sums, begin, begin + number + w.length - w.gram, 0xA24BAED4963EE407))
    return text, begin - bounds[text], number, place - begin, grams[place].view(np.int64), content.view(np.int64)


def pieces(data: np.ndarray, offsets: np.ndarray, w: Windows) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of texts as (first text, tokens, bounds, units before each text of the chunk); a very long text comes in
    several, so that every window lies in exactly one."""
    limit = 4 * CHUNK_BYTES
    for first, last in chunks(offsets):
        part = data[offsets[first] : offsets[last]]
        tokens, bounds = tokens_of(part, offsets[first : last + 1] - offsets[first], w.unit)
        if last - first > 1 or len(tokens) <= limit:
            yield first, tokens, bounds, np.zeros(last - first, np.int64)
            continue
        for at in range(0, len(tokens) - w.length + 1, limit):
            cut = tokens[at : at + limit + w.length - 1]
            yield first, cut, np.array([0, len(cut)]), np.array([at])


def find(docs: DataFrame, w: Windows) -> DataFrame:
    """k, t, anchor, content, first, windows, place: all segments of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "t"))
            for at, tokens, bounds, shift in pieces(*utf8(batch.column("text")), w):
                text, first, number, place, anchor, content = anchors(tokens, bounds, w)
                if len(text):
                    yield pa.record_batch({
                        "k": pa.array(keys[at + text]), "t": pa.array(tags[at + text]), "anchor": pa.array(anchor), "content": pa.array(content),
                        "first": pa.array(first + shift[text]), "windows": pa.array(number.astype(np.int32)), "place": pa.array(place.astype(np.int32)),
                    })

    return docs.select("k", "t", "text").mapInArrow(run, "k long, t long, anchor long, content long, first long, windows int, place int")


def cut_out(docs: DataFrame, wanted: DataFrame, w: Windows) -> DataFrame:
    """anchor, content, data, place, windows, times of the wanted segments; those of a document come as one list."""
    lists = wanted.groupBy("k", "t").agg(F.collect_list(F.struct("anchor", "content", "first", "windows", "place", "times")).alias("segments"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for i, listed in enumerate(batch.column("segments")):
                text = data[offsets[i] : offsets[i + 1]]
                body = text.tobytes()
                got = listed.values.flatten()
                anchor, content, first, number, place, times = (c.to_numpy(zero_copy_only=False) for c in got)
                last = first + number + w.length - 1
                if w.unit == "byte":
                    cuts = [body[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                else:
                    starts, ends, _ = words(text, np.array([0, len(text)]))
                    cuts = [body[starts[a] : ends[b - 1]] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                yield pa.record_batch({
                    "anchor": pa.array(anchor), "content": pa.array(content), "data": pa.array(cuts, pa.binary()), "place": pa.array(place), "windows": pa.array(number), "times": pa.array(times),
                })

    return docs.join(lists, ["k", "t"]).mapInArrow(run, "anchor long, content long, data binary, place int, windows int, times long")


Resolver = Callable[[list[Segment]], list[tuple[int, int, int]]]


def resolve(segments: DataFrame, w: Windows, resolver: Resolver, batch: int, most: int) -> DataFrame:
    """anchor, content, a, b: units [a, b) of a content that recurring windows cover.

    A task meets its anchors in order and resolves about ``batch`` segments at once, whole anchors together. Of an anchor
    with over ``most`` distinct contents nothing is gathered: its windows go out one by one, by hash, and are counted by
    Spark, which brings equal ones together however many there are.
    """
    schema = "anchor long, content long, a int, b int, w1 long, w2 long, times long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Segment] = []
        ready = 0  # segments of whole anchors, at the front of what is held
        loose: int | None = None  # the anchor whose windows go out one by one

        def settle(part: list[Segment]) -> pa.RecordBatch:
            got = resolver(part)
            none = pa.nulls(len(got), pa.int64())
            return pa.record_batch([
                pa.array([part[i].anchor for i, _, _ in got], pa.int64()), pa.array([part[i].content for i, _, _ in got], pa.int64()),
                pa.array([a for _, a, _ in got], pa.int32()), pa.array([b for _, _, b in got], pa.int32()), none, none, none,
            ], schema=ARROW)

        for batch_ in batches:
            for row in zip(*(batch_.column(c).to_pylist() for c in ("anchor", "content", "data", "place", "windows", "times")), strict=True):
                segment = Segment(*row)
                if segment.anchor == loose:
                    yield single(segment, w)
                    continue
                loose = None
                if held and held[-1].anchor != segment.anchor:
                    ready = len(held)
                    if ready >= batch:
                        yield settle(held)
                        held, ready = [], 0
                held.append(segment)
                if len(held) - ready > most:
                    loose = segment.anchor
                    if ready:
                        yield settle(held[:ready])
                    for x in held[ready:]:
                        yield single(x, w)
                    held, ready = [], 0
        if held:
            yield settle(held)

    parts = segments.repartition("anchor").sortWithinPartitions("anchor", "content")
    found = stored(parts.mapInArrow(run, schema))
    loose = found.filter("w1 is not null")
    again = loose.groupBy("w1", "w2").agg(F.sum("times").alias("n")).filter("n > 1").drop("n")
    columns = ["anchor", "content", "a", "b"]
    return found.filter("w1 is null").select(*columns).unionByName(loose.join(again, ["w1", "w2"], "left_semi").select(*columns))


ARROW = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64()), ("times", pa.int64())])


def single(x: Segment, w: Windows) -> pa.RecordBatch:
    """The windows of one segment by two hashes each."""
    data = np.frombuffer(x.data, np.uint8)
    tokens, _ = tokens_of(data, np.array([0, len(data)]), w.unit)
    at = np.arange(x.windows)
    one, two = (mix(span(prefix(t, b), at, at + w.length, b)).view(np.int64) for t, b in ((tokens, 0xA24BAED4963EE407), (mix(tokens + U64(1)), 0x9FB21C651E98DF25)))
    return pa.record_batch([
        pa.array(np.full(x.windows, x.anchor)), pa.array(np.full(x.windows, x.content)), pa.array(at.astype(np.int32)), pa.array((at + w.length).astype(np.int32)),
        pa.array(one), pa.array(two), pa.array(np.full(x.windows, x.times)),
    ], schema=ARROW)


def keyed(docs: DataFrame, carry: list[str]) -> DataFrame:
    """doc_id, k, t, text, and the columns to carry along, as ``_c0``, ``_c1``, ... so that no name clashes."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), doc_key().alias("k"), text_tag().alias("t"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)],
    )


def covered(docs: DataFrame, w: Windows, resolver: Resolver, batch: int = 2048, most: int = 1 << 15) -> DataFrame:
    """doc_id, k, t, text and ``spans``, the unit ranges (a, b) of each text that recurring windows cover; docs is keyed.

    Rows that share id and text are documents of their own: each makes the other's windows recur.
    """
    everything = stored(find(docs, w))
    # A written side lets Spark split the other one where an anchor is very frequent.
    twice = stored(everything.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"))
    segments = stored(everything.join(twice, "anchor", "left_semi"))
    discard(everything, twice)
    distinct = segments.groupBy("anchor", "content").agg(F.count("*").alias("times"), F.min(F.struct("k", "t", "first", "windows", "place")).alias("at"))
    wanted = distinct.select("anchor", "content", "times", "at.*")
    found = resolve(cut_out(docs, wanted, w), w, resolver, batch, most)
    # Rows of a repeated document cut the same segments out twice; the ranges found are the same.
    places = segments.select("k", "t", "anchor", "content", "first").join(found, ["anchor", "content"])
    spans = places.select("k", "t", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))
    lists = spans.groupBy("k", "t").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return docs.join(lists, ["k", "t"], "left")
