"""Packing: examples go to sequences by the dot product of what they need with what is left.

A sequence has three limits at once: tokens, segments and loss-bearing tokens. The open sequence takes, among the waiting
pieces that fit, the one whose demand points most in the direction of what is left. Where pieces may be cut, a gap that no
piece fills is filled with the front of a larger one, so only the end of a task can hold padding.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces a task keeps waiting; their ids take 2048 * 4 bytes each at most.
WAITING = 512
SPACED = re.compile(r"[^ \t\n\r\x0b\x0c]+")
#: Words of these signs alone change under normalisation by lower case only.
PLAIN = re.compile("[!-~À-ÖØ-öø-ľ]+")
#: The vocabulary's own cut of a word into units, for such signs in lower case.
UNIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ľ]+|[0-9]|[^a-zß-öø-ľ0-9]+")
#: Byte-level vocabularies write each byte as a sign that can be seen: Latin-1's own signs, the rest from 256 on.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SEEN)))}
#: Distinct words, and distinct units of words, whose ids a task remembers before it starts anew.
REMEMBERED = 500_000


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most."""

    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


def text_words(text: str) -> list[str]:
    """The words of a text. str.split() takes four separator signs for white space that the vocabulary does not."""
    return SPACED.findall(text) if any(sign in text for sign in "\x1c\x1d\x1e\x1f") else text.split()


class Codes(dict):
    """Numbers of words, given out as they are first asked for."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = code = len(self)
        return code


class WordIds:
    """Ids of texts by way of their white-space separated words; no token of such a vocabulary spans white space.

    A word is worked out once. If it holds only signs of PLAIN, which normalisation leaves as they are but for case, its
    units go to the vocabulary's merges directly, each distinct one once; others go through the whole tokenizer.
    """

    def __init__(self, encode: Callable[[str], list[int]], merge: Callable[[str], list[int]]):
        self.encode, self.merge, self.units = encode, merge, {}
        self.clear()

    def clear(self) -> None:
        self.codes = Codes()
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def unit(self, text: str) -> list[int]:
        shown = text if text.isascii() else text.encode().decode("latin-1").translate(SHOWN)
        ids = self.units[text] = self.merge(shown)
        return ids

    def of_word(self, word: str) -> list[int]:
        if word.isascii() and word.isalpha():  # one unit
            text = word.lower()
            return self.units[text] if text in self.units else self.unit(text)
        if not PLAIN.fullmatch(word) or "<|" in word:
            return self.encode(word)
        known, out = self.units, []
        for text in UNIT.findall(word.lower()):
            out += known[text] if text in known else self.unit(text)
        return out

    def learn(self) -> None:
        made = [self.of_word(word) for word in self.codes.new]
        self.codes.new.clear()
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        ids = np.fromiter(chain.from_iterable(made), np.uint32, int(sizes.sum()))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used += len(ids)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.codes) > REMEMBERED:
            self.clear()
        if len(self.units) > REMEMBERED:
            self.units.clear()
        found = [text_words(text) for text in texts]
        at = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(found)), np.int64, sum(map(len, found)))
        if self.codes.new:
            self.learn()
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        words = np.cumsum([len(f) for f in found])
        return np.split(ids, np.r_[0, ends][words[:-1]])


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return WordIds(lambda text: tokenizer.encode(text, add_special_tokens=False).ids, lambda text: [t.id for t in tokenizer.model.tokenize(text)])


class Packer:
    """Places pieces one sequence after another. A piece: example, start within it, its tokens, its loss-bearing tokens."""

    def __init__(self, limits: Limits, cut: bool, first_id: int = 0):
        self.limits, self.cut, self.next_id = limits, cut, first_id
        self.full = np.array([limits.tokens, limits.segments, limits.loss], np.float64)
        self.keys: list = []
        self.starts = np.zeros(0, np.int64)
        self.needs = np.zeros((0, 3))

    def add(self, key, start: int, tokens: int, loss: int) -> None:
        self.keys.append(key)
        self.starts = np.append(self.starts, start)
        self.needs = np.vstack([self.needs, (tokens, 1, loss)])

    def _place(self, most: int) -> Iterator[tuple]:
        """One sequence of at most ``most`` tokens from what waits: (key, start, tokens, sequence, offset).

        Where as many pieces as may be are too short to fill it, it is closed at a power of two, which needs no padding.
        """
        segments = self.limits.segments
        if self.cut and len(self.keys) > segments:
            within = int(np.partition(self.needs[:, 0], -segments)[-segments:].sum())
            most = min(most, 1 << (within.bit_length() - 1))
        left = self.full.copy()
        left[0] = most
        offset, live = 0, np.ones(len(self.keys), bool)
        while left[0] and left[1] and live.any():
            fits = live & (self.needs <= left).all(1)
            last = self.cut and left[1] == 1 and left[0] == most - offset
            if fits.any() and not (last and (live & (self.needs[:, 0] > left[0])).any()):
                best = int(np.argmax(np.where(fits, (self.needs / self.full) @ (left / self.full), -1.0)))
                size = int(self.needs[best, 0])
                live[best] = False
            elif self.cut:
                best = int(np.argmax(np.where(live, self.needs[:, 0], -1)))
                size = int(min(left[0], left[2], self.needs[best, 0]))
                if size <= 0:
                    break
                if size == self.needs[best, 0]:
                    live[best] = False
            else:
                break
            spent = np.array([size, 1, min(size, self.needs[best, 2])])
            yield self.keys[best], int(self.starts[best]), size, self.next_id, offset
            offset += size
            left -= spent
            if live[best]:
                self.starts[best] += size
                self.needs[best] -= (spent[0], 0, spent[2])
        if not offset and len(self.keys):  # an example beyond the limits that may not be cut: a sequence of its own
            yield self.keys[0], int(self.starts[0]), int(self.needs[0, 0]), self.next_id, 0
            live[0] = False
        self.next_id += 1
        keep = np.flatnonzero(live)
        self.keys = [self.keys[i] for i in keep]
        self.starts, self.needs = self.starts[keep], self.needs[keep]

    def drain(self, down_to: int) -> Iterator[tuple]:
        while len(self.keys) > down_to:
            yield from self._place(self.limits.tokens)

    def finish(self) -> Iterator[tuple]:
        """Everything that waits. If pieces may be cut, the last tokens go to sequences of a power of two each: no padding."""
        while self.keys and (not self.cut or self.needs[:, 0].sum() >= self.limits.tokens):
            yield from self._place(self.limits.tokens)
        while self.keys:
            yield from self._place(1 << (int(self.needs[:, 0].sum()).bit_length() - 1))


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 1) -> DataFrame:
    """Pieces of all documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are its text's and ``end_id``; all of them bear loss. A null or empty text is one id; a null doc_id
    stays null; repeated rows are packed each on its own; other columns are ignored; an empty table gives an empty result.
    Every task packs what it reads, without a shuffle; its sequence ids carry its partition's number.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        packer = Packer(limits, cut=True, first_id=TaskContext.get().partitionId() << 36)
        held: dict[int, tuple] = {}
        rows: list[tuple] = []
        number = 0

        def put(placed: Iterator[tuple]) -> None:
            for key, start, size, sequence, offset in placed:
                doc, ids, base, total, left = held[key]
                rows.append((doc, start, size, zlib.crc32(ids[start - base : start - base + size].tobytes()), total, sequence, offset))
                if left == size:
                    del held[key]
                else:
                    held[key] = (doc, ids, base, total, left - size)

        def out() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], NAMES)
            rows.clear()
            return batch

        for doc, ids in read(batches, encoder):
            ids = np.append(ids, end_id).astype("<u4")
            total, at = len(ids), 0
            step = min(limits.tokens, limits.loss)
            while total - at >= step:
                rows.append((doc, at, step, zlib.crc32(ids[at : at + step].tobytes()), total, packer.next_id, 0))
                packer.next_id += 1
                at += step
            if at < total:
                held[number] = (doc, ids[at:].copy(), at, total, total - at)
                packer.add(number, at, total - at, total - at)
                number += 1
            if len(packer.keys) >= WAITING:
                put(packer.drain(WAITING // 2))
            if len(rows) >= 20_000:
                yield out()
        put(packer.finish())
        if rows:
            yield out()

    schema = ", ".join(f"{name} long" for name in NAMES)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, schema)


def read(batches: Iterator[pa.RecordBatch], encoder: WordIds) -> Iterator[tuple[int | None, np.ndarray]]:
    """The id and the token ids of each document; the words of 64 documents are learnt together."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            yield from zip(part.column("doc_id").to_pylist(), encoder.batch([x or "" for x in part.column("text").to_pylist()]), strict=True)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_examples(examples: DataFrame, key: str, tokens: str, loss: str, limits: Limits = Limits()) -> DataFrame:
    """Whole instruction examples under all three limits: ``key``, sequence_id, offset.

    ``tokens`` and ``loss`` name the counts of an example's tokens and of those that bear loss; nulls count as 0, and
    nothing is dropped: an example beyond a limit has a sequence to itself. Repeated rows are placed each on its own.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, cut=False, first_id=TaskContext.get().partitionId() << 36)

        def out(placed: Iterator[tuple], kind: pa.DataType) -> pa.RecordBatch:
            got = list(placed)
            return pa.record_batch([pa.array([g[0] for g in got], kind), pa.array([g[3] for g in got], pa.int64()), pa.array([g[4] for g in got], pa.int64())], [key, "sequence_id", "offset"])

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, WAITING):
                for k, n, m in zip(*(batch.column(i)[at : at + WAITING].to_pylist() for i in range(3)), strict=True):
                    packer.add(k, 0, n, min(n, m))
                yield out(packer.drain(WAITING), kind)
        yield out(packer.finish(), kind)

    kind = dict(examples.dtypes)[key]
    counts = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(f"need_{i}") for i, c in enumerate((tokens, loss))]
    return examples.select(key, *counts).mapInArrow(pack, f"`{key}` {kind}, sequence_id long, offset long")
