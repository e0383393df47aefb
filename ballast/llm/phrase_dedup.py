"""Substring dedup with repeated-phrase automata.

Passages whose windows recur are confirmed first. Each shard of anchors compiles its passages into an Aho-Corasick
automaton over word numbers, and every document's segments that can hold a passage of the shard stream through it, which
locates every occurrence.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ballast.llm.common import merged, spans_of, utf8
from ballast.llm.hashing import words
from ballast.llm.repeats import Segment, Windows, covered, keyed


def confirmed(texts: list[np.ndarray], times: list[int], length: int) -> set[tuple[int, ...]]:
    """The maximal passages of texts whose every window of ``length`` words occurs more than once."""
    seen: defaultdict[bytes, int] = defaultdict(int)
    step = 4 * length
    bodies = [t.tobytes() for t in texts]
    for body, n in zip(bodies, times, strict=True):
        for at in range(0, len(body) - step + 1, 4):
            seen[body[at : at + step]] += n
    passages = set()
    for text, body in zip(texts, bodies, strict=True):
        first = None
        for at in range(0, len(body) - step + 5, 4):  # one past the last window, where a passage ends
            twice = at + step <= len(body) and seen[body[at : at + step]] > 1
            if twice and first is None:
                first = at // 4
            elif not twice and first is not None:
                passages.add(tuple(text[first : at // 4 + length - 1].tolist()))
                first = None
    return passages


def automaton(passages: set[tuple[int, ...]]):
    import ahocorasick

    made = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for passage in passages:
        made.add_word(passage, len(passage))
    made.make_automaton()
    return made


def located(segments: list[Segment], length: int) -> list[tuple[int, int, int]]:
    """(segment, a, b): word ranges in which a confirmed passage of these segments occurs."""
    numbers: dict[bytes, int] = {}
    texts = []
    for segment in segments:
        data = np.frombuffer(segment.data, np.uint8)
        starts, ends, _ = words(data, np.array([0, len(data)]))
        texts.append(np.array([numbers.setdefault(segment.data[a:b], len(numbers)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int32))
    passages = confirmed(texts, [s.times for s in segments], length)
    if not passages:
        return []
    search, out = automaton(passages), []
    for i, text in enumerate(texts):
        hits = [(end + 1 - size, end + 1) for end, size in search.iter(tuple(text.tolist()))]
        out += [(i, a, b) for a, b in merged(hits)]
    return out


def phrase_dedup(docs: DataFrame, length: int = 35, gram: int = 8, most: int = 1 << 15, text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (kept words joined by a space) and, if asked for, that ``text``, of every row, with the columns to ``carry``
    as ``_c0``, ``_c1``, ...

    Removed is each word covered by ``length`` consecutive words that also start anywhere else, judged on the input. A
    null, empty or blank text has no words; a null doc_id stays null; rows that repeat are documents of their own, so
    what they share goes from each; other columns are ignored; an empty table gives an empty result.
    """
    w = Windows("word", length, gram)
    carry = carry or []
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            counts, removed, digests, kept = [], [], [], []
            for i, cell in enumerate(batch.column("spans")):
                found = data[offsets[i] : offsets[i + 1]].tobytes().split()  # splits at the six white-space bytes
                ranges = spans_of(cell)
                counts.append(len(found))
                removed.append(sum(b - a for a, b in ranges))
                for a, b in reversed(ranges):
                    del found[a:b]
                rest = b" ".join(found)
                digests.append(hashlib.sha256(rest).hexdigest())
                if text:
                    kept.append(rest.decode())
            columns = [*(batch.column(c) for c in names[:1]), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.record_batch([*columns, *[pa.array(kept, pa.string())] * text, *(batch.column(f"_c{i}") for i in range(len(carry)))], names + [f"_c{i}" for i in range(len(carry))])

    kinds = dict(docs.dtypes)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * text + "".join(f", _c{i} {kinds[c]}" for i, c in enumerate(carry))
    found = covered(keyed(docs, carry), w, lambda segments: located(segments, length), most=most)
    return found.drop("k", "t").mapInArrow(run, schema)
