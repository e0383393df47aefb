"""Suffix-array dedup: bytes covered by a string that also starts elsewhere are removed.

Suffixes that start at the anchors of candidate segments are sorted by merging, and two are compared by their longest common
extension, which prefix hashes and a binary search give in a logarithmic number of steps. Reading the other way from the
anchors gives a second order. Two windows that reach d bytes before their anchors are equal just if their anchors
lie in one run of the first order with extensions of length - d and in one run of the second with extensions of d. All
extensions between neighbours are checked on the bytes; where a hash has lied, the sort is done again with another base.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ballast.llm.common import spans_of, utf8
from ballast.llm.hashing import BYTE_TOKENS, prefix, span
from ballast.llm.repeats import Segment, Windows, covered, keyed

#: Odd bases of the prefix hashes, the next for a sort in which one has failed.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


class Suffixes:
    """Strings that start at ``start`` and end before ``end`` in ``data``, compared by hashed common extensions."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int):
        self.data, self.start, self.end, self.base = data, start, end, base
        self.sums = prefix(BYTE_TOKENS[data], base)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The longest common extension of pairs of suffixes, by binary search on equal hashes."""
        a, b = self.start[i], self.start[j]
        low = np.zeros(len(i), np.int64)
        high = np.minimum(self.end[i] - a, self.end[j] - b)
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            same = span(self.sums, a, a + middle, self.base) == span(self.sums, b, b + middle, self.base)
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)
        return low

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i stands before suffix j; a string stands before its own extensions."""
        common = self.extension(i, j)
        a, b = self.start[i] + common, self.start[j] + common
        ended_a, ended_b = a >= self.end[i], b >= self.end[j]
        last = len(self.data) - 1
        smaller = self.data[np.minimum(a, last)] < self.data[np.minimum(b, last)]
        return np.where(ended_a | ended_b, ended_a & ~ended_b, smaller)

    def order(self, group: np.ndarray) -> np.ndarray:
        """A merge sort within groups (equal values of ``group`` stand together), all merges of a level at once."""
        n = len(group)
        items = np.arange(n)
        head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(head, append=n)
        base = np.repeat(head, size)
        place, size = items - base, np.repeat(size, size)
        width = 1
        while width < size.max():
            block = place - place % (2 * width)
            left = place - block < width
            active = np.flatnonzero(block + width < size)
            # Of each item: how many of the other half stand before it, by binary search there.
            from_ = base[active] + block[active] + np.where(left[active], width, 0)
            low = np.zeros(len(active), np.int64)
            high = np.where(left[active], np.minimum(width, size[active] - block[active] - width), width)
            while (open_ := low < high).any():
                at = np.flatnonzero(open_)
                middle = (low[at] + high[at]) >> 1
                other, own = items[from_[at] + middle], items[active[at]]
                from_left = left[active[at]]
                # Equal suffixes keep their order: those of the left half stand first.
                before = np.where(from_left, self.less(other, own), ~self.less(own, other))
                low[at] = np.where(before, middle + 1, low[at])
                high[at] = np.where(before, high[at], middle)
            inner = place[active] - block[active] - np.where(left[active], 0, width)
            moved = items.copy()
            moved[base[active] + block[active] + inner + low] = items[active]
            items = moved
            width *= 2
        return items

    def checked(self, order: np.ndarray, group: np.ndarray) -> np.ndarray | None:
        """Extensions between neighbours in the order, -1 at the front of a group; None if the bytes deny one."""
        common = np.full(len(order), -1, np.int64)
        at = np.flatnonzero(group[1:] == group[:-1]) + 1
        i, j = order[at - 1], order[at]
        got = self.extension(i, j)
        for part in np.array_split(np.arange(len(at)), max(1, int(got.sum()) >> 20)):
            n = got[part]
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            if not (self.data[np.repeat(self.start[i[part]], n) + inside] == self.data[np.repeat(self.start[j[part]], n) + inside]).all():
                return None
            a, b = self.start[i[part]] + n, self.start[j[part]] + n
            ends = (a >= self.end[i[part]]) | (b >= self.end[j[part]])
            if not (ends | (self.data[np.minimum(a, len(self.data) - 1)] != self.data[np.minimum(b, len(self.data) - 1)])).all():
                return None
        common[at] = got
        return common


def sorted_extensions(data: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes within groups, and the verified extensions between neighbours."""
    for base in BASES:
        suffixes = Suffixes(data, start, end, base)
        order = suffixes.order(group)
        common = suffixes.checked(order, group)
        if common is not None:
            return order, common
    raise ArithmeticError("hash collisions under every base")


def recurring(segments: list[Segment], length: int) -> list[tuple[int, int, int]]:
    """(segment, a, b): byte ranges covered by windows that occur more than once; segments of an anchor stand together."""
    count = len(segments)
    data = np.frombuffer(b"".join(s.data for s in segments), np.uint8)
    size = np.array([len(s.data) for s in segments])
    begin = np.cumsum(size) - size
    place, windows, times = (np.array([getattr(s, c) for s in segments]) for c in ("place", "windows", "times"))
    group = np.unique(np.array([s.anchor for s in segments], np.int64), return_inverse=True)[1]
    stand = np.argsort(group, kind="stable")
    sorted_group = group[stand]
    anchor = begin + place
    right_order, right = sorted_extensions(data, anchor[stand], (begin + size)[stand], sorted_group)
    back = len(data) - anchor
    left_order, left = sorted_extensions(data[::-1], back[stand], (back + place)[stand], sorted_group)
    found = np.zeros((count, int(windows.max())), bool)
    farthest = place - windows + 1
    for d in range(int(farthest.min()), int(place.max()) + 1):
        able = np.flatnonzero((place >= d) & (farthest <= d))
        if not len(able):
            continue
        run_right, run_left = np.empty(count, np.int64), np.empty(count, np.int64)
        run_right[stand[right_order]] = np.cumsum(right < length - d)
        run_left[stand[left_order]] = np.cumsum(left < d)
        key = run_right[able] * (count + 1) + run_left[able]
        sort = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.r_[True, np.diff(key[sort]) != 0])
        total = np.repeat(np.add.reduceat(times[able][sort], head), np.diff(head, append=len(sort)))
        twice = able[sort[total > 1]]
        found[twice, place[twice] - d] = True
    edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, first = np.nonzero(edges == 1)
    _, after = np.nonzero(edges == -1)
    return list(zip(rows.tolist(), first.tolist(), (after - 1 + length).tolist(), strict=True))


def suffix_dedup(docs: DataFrame, length: int = 200, gram: int = 32, most: int = 1 << 15, text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept ``text``, of every row, with
    the columns to ``carry`` as ``_c0``, ``_c1``, ...

    Removed is each byte covered by a string of ``length`` bytes that also starts anywhere else, judged on the input. A
    null or empty text has no bytes; a null doc_id stays null; rows that repeat are documents of their own, so what they
    share goes from each; other columns are ignored; an empty table gives an empty result. A kept text that is cut
    within a character loses that character's rest.
    """
    w = Windows("byte", length, gram)
    carry = carry or []
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["text"] * text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            sizes, removed, spans, digests, kept = [], [], [], [], []
            for i, cell in enumerate(batch.column("spans")):
                body, at, out = data[offsets[i] : offsets[i + 1]].tobytes(), 0, []
                ranges = spans_of(cell)
                for a, b in ranges:
                    out.append(body[at:a])
                    at = b
                rest = b"".join([*out, body[at:]])
                sizes.append(len(body))
                removed.append(len(body) - len(rest))
                spans.append(len(ranges))
                digests.append(hashlib.sha256(rest).hexdigest())
                if text:
                    kept.append(rest.decode("utf-8", "ignore"))
            columns = [*(batch.column(c) for c in names[:1]), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(digests, pa.string())]
            yield pa.record_batch([*columns, *[pa.array(kept, pa.string())] * text, *(batch.column(f"_c{i}") for i in range(len(carry)))], names + [f"_c{i}" for i in range(len(carry))])

    kinds = dict(docs.dtypes)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * text + "".join(f", _c{i} {kinds[c]}" for i, c in enumerate(carry))
    found = covered(keyed(docs, carry), w, lambda segments: recurring(segments, length), most=most)
    return found.drop("k", "t").mapInArrow(run, schema)
