"""Different texts under one id, of which any fifteen bits of a hash may agree."""

import hashlib
import os
import random
import sys
from collections import Counter

import public_tokenizers
import sentencepiece

sys.path.insert(0, os.path.dirname(__file__))
from helpers import covered, documents, prose, words  # noqa: E402

from ballast.llm.mixing import mix, mixed, mixed_blocks
from ballast.llm.phrase_dedup import phrase_dedup
from ballast.llm.suffix_dedup import suffix_dedup
from ballast.llm.token_counts import count_tokens, least_frequency

RNG = random.Random(21)
PASSAGE = prose(RNG, 80)
#: Six hundred short texts and as many longer ones, all under two ids and none: a few dozen pairs agree in fifteen bits.
TEXTS = [f"a{i} b" for i in range(600)] + [f"{PASSAGE if i % 50 == 0 else ''} {prose(RNG, 40)} z{i}" for i in range(600)]
IDS = [(7, 8, None)[i % 3] for i in range(1200)]


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_phrases(spark):
    units = [tuple(words(x)) for x in TEXTS]
    want = Counter((i, len(u), sum(m), sha(" ".join(w for w, x in zip(u, m, strict=True) if not x).encode())) for i, u, m in zip(IDS, units, covered(units, 35), strict=True))
    assert Counter(map(tuple, phrase_dedup(documents(spark, TEXTS, IDS)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == want


def test_bytes(spark):
    units = [x.encode() for x in TEXTS]
    want = Counter((i, len(u), sum(m), sha(bytes(b for b, x in zip(u, m, strict=True) if not x))) for i, u, m in zip(IDS, units, covered(units, 200), strict=True))
    assert Counter(map(tuple, suffix_dedup(documents(spark, TEXTS, IDS)).select("doc_id", "n_bytes", "n_removed", "kept_sha256").collect())) == want


def test_tokens(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    want = Counter((i, len(x.encode()), len(library.encode(x))) for i, x in zip(IDS, TEXTS, strict=True))
    assert Counter(map(tuple, count_tokens(documents(spark, TEXTS, IDS), model).select("doc_id", "n_bytes", "n_tokens").collect())) == want


def test_least_frequency(spark):
    counts = spark.createDataFrame([(n,) for n in (1, 1, 1, 2, 3, 4, 9, 100)], "n long")
    assert [least_frequency(counts, k) for k in (0, 1, 2, 3, 5, 7, 8)] == [1 << 62, 64, 8, 4, 2, 2, 1]


def test_mix_takes_no_words_that_are_not_there(spark):
    docs = documents(spark, TEXTS, IDS, ["s"] * len(TEXTS))
    rows = mix(docs).collect()
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows) and sum(r["size"] for r in rows) == rows[0].source_size
    assert abs(sum(r.taken for r in rows) - rows[0].target) <= 64
    assert abs(sum(len(words(r.text)) for r in mixed(docs).select("text").collect()) - rows[0].target) <= 64


def test_shards_hold_a_drawn_mix_of_blocks(spark):
    rng = random.Random(9)
    texts = [prose(rng, rng.randrange(0, 900)) for _ in range(300)] + ["copy of words"] * 60
    sources = [("a", "b", "c", None)[i % 4] for i in range(360)]
    docs = documents(spark, texts, list(range(300)) + [5] * 60, sources)
    rows = mixed_blocks(docs, block=8).collect()
    target = {r.source: r.target for r in mix(docs, block=8).join(docs.select("doc_id", "source").dropDuplicates(["doc_id"]), "doc_id").collect()}
    held, in_shard, whole = Counter(), Counter(), {}
    for r in rows:
        n = len(words(r.text))
        held[r.source] += n
        in_shard[r.shard, r.source] += n
        whole.setdefault((r.source, r.slot), []).append((r.at, n))
    assert all(abs(held[s] - target[s]) <= 8 for s in target)
    shards = {s for s, _ in in_shard}
    assert len(shards) >= 2 and {(s, x) for s in shards for x in target} == set(in_shard)
    for source in target:  # counts vary from shard to shard, near their mean
        counts = [in_shard[s, source] / 8 for s in shards]
        mean = sum(counts) / len(counts)
        assert len(set(counts)) > 1 and all(abs(c - mean) < 6 * mean**0.5 for c in counts)
    for parts in whole.values():  # what a slot holds lies end to end, eight words at most
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0 and sum(n for _, n in parts) <= 8


def test_copies_of_a_document_lose_no_word(spark):
    docs = documents(spark, ["one two three"] * 500 + [prose(random.Random(2), 3000)], [1] * 500 + [2], ["s"] * 500 + ["t"])
    rows = mix(docs).collect()
    assert len(rows) == 501 and all(abs(sum(r.taken for r in rows if r.source_size == n) - next(r.target for r in rows if r.source_size == n)) <= 64 for n in (1500, 3000))
