"""Mixing, HTML text, packing, fingerprints, token counts and toxicity against brute force and the libraries."""

import hashlib
import math
import os
import random
import sys
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from helpers import awkward, documents, prose, words  # noqa: E402

from ballast.llm.fingerprints import fingerprints
from ballast.llm.html_text import extract, main_text, path_scores
from ballast.llm.mixing import mix, mixed, permuted, shard_slots
from ballast.llm.token_counts import count_tokens
from ballast.llm.toxicity import IDENTITY, swapped, toxicity, train
from ballast.llm.vector_packing import Limits, pack_documents, pack_examples, word_ids

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SIGNS = [*" \n\t abcdeThe.,'s▁", "\x1c", "\xa0", "é", "É", "ß", "漢", "😀", "́", "<s>", "<|endoftext|>", "İ", "Σ", "1", "²", "\x00", "  "]


def targets(sizes: dict, weights=(5, 2, 1), most=3.0) -> dict:
    """Sharing by weight, round by round, as the words of the task put it."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s]}
        for s in over or free:
            target[s] = most * sizes[s] if over else left * weight[s] / total
        left -= sum(target[s] for s in over)
        free -= over or set(free)
    return target


def test_mix(spark):
    rng = random.Random(1)
    texts = [None, "", *(prose(rng, rng.randrange(1, 400)) for _ in range(200)), prose(rng, 9000)]
    sources = [rng.choice(["a", "b", "ä", "B", "c", None, "d", "tiny"]) if i % 3 else "a" for i in range(len(texts))]
    sources = ["tiny" if s == "tiny" and i > 20 else s for i, s in enumerate(sources)]
    docs = documents(spark, texts, sources=sources)
    rows = mix(docs).collect()
    again = mix(docs.repartition(5)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) == len(texts)
    size, taken = defaultdict(int), defaultdict(int)
    for i, x in enumerate(texts):
        size[sources[i]] += len(words(x))
    want = targets(dict(size))
    for r in rows:
        assert r["size"] == len(words(texts[r.doc_id])) and r.source_size == size[sources[r.doc_id]] and r.taken <= 3 * r["size"]
        assert r.target == pytest.approx(want[sources[r.doc_id]])
        taken[sources[r.doc_id]] += r.taken
    assert all(-64 <= taken[s] - want[s] <= 0 for s in want)
    per_doc = {r.doc_id: r.taken for r in rows}
    out = defaultdict(int)
    for r in mixed(docs).collect():
        out[r.doc_id] += len(words(r.text))
        inside = iter(words(texts[r.doc_id]))
        assert all(w in inside for w in words(r.text))  # in order, from this document
    assert all(out[i] == n for i, n in per_doc.items()) and mixed(docs).columns == docs.columns


def test_mix_repeats_and_nothing(spark):
    rows = mix(documents(spark, ["a b c", "a b c", "d e"], ids=[1, 1, None], sources=["s", "s", "t"])).collect()
    assert len(rows) == 3 and abs(sum(r.taken for r in rows if r.doc_id == 1) - rows[0].target) <= 64
    assert mix(documents(spark, [])).count() == 0 and mix(documents(spark, [None, ""])).filter("taken = 0 and target = 0").count() == 2


def test_equal_texts_count_with_the_label_of_most(spark):
    texts = ["you vile stupid liar now"] * 9 + ["a calm walk by the lake"] * 9 + [f"you vile stupid liar {i}" for i in range(40)] + [f"calm walk {i} by the lake" for i in range(40)]
    toxic = [1] * 6 + [0] * 3 + [0] * 5 + [1] * 4 + [1] * 40 + [0] * 40
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1][: len(texts)]
    labels = spark.createDataFrame(list(zip(ids, toxic, strict=True)), "doc_id long, toxic int")
    models = [train(documents(spark, texts, ids).repartition(n), labels) for n in (1, 7)]
    assert models[0] == models[1] and models[0][0]["vile"] > 0 > models[0][0]["calm"]


def test_swaps_in_four_languages():
    for text, other in (("the Women sang", "the men sang"), ("die Frauen sangen", "die männer sangen"), ("les femmes chantent", "les hommes chantent"), ("las mujeres cantan", "las hombres cantan")):
        assert swapped(text) == other
    assert swapped("nobody here") is None and len(IDENTITY) % 2 == 0 and len(set(IDENTITY)) == len(IDENTITY)


def test_permutation_and_draw():
    for n in (1, 2, 3, 64, 1000, 4097):
        assert sorted(permuted(np.arange(n), n, 5)) == list(range(n))
    parts = [shard_slots(10_000, 7, i, 3) for i in range(7)]
    assert sum(c for _, c in parts) == 10_000 and [f for f, _ in parts] == list(np.cumsum([0, *(c for _, c in parts)])[:-1])


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body class="page">
<header><p>Head, line.</p></header><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav><div class="cookie-notice">We use cookies, really.</div>
<div id=content><h1>Title &amp; more</h1><p>First   <b>bold</b>text, with marks; and so on.<p>Second &eacute;&#233; para<br>graph.
<form><input name=q> Search here</form><ul><li>Item one<li>Item two</ul><blockquote>Quoted, well.</blockquote></div>
<aside>Side, bar.</aside><section class="comments"><p>A reader, who wrote a long comment, with marks, and more marks, and more.</p></section><footer>&copy; Foot.</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "Title & more First boldtext, with marks; and so on. Second éé para graph. Item one Item two Quoted, well."
    assert main_text(PAGE.replace("<div id=content>", "<article>").replace("</blockquote></div>", "</blockquote></article>")) == main_text(PAGE)
    assert [main_text(x) for x in (None, "", "  ", "<p>", "<!-- x -->", "<nav>a</nav>", "plain text", "<p>a<p>b")] == ["", "", "", "", "", "", "plain text", "a b"]
    assert main_text("<article><p>Cut &am") == "Cut &am" and main_text("<article><p>Cut &amp x <foo") == "Cut & x"


TITLE = "A title of about forty characters, here!"


def paragraphs(n):
    texts = ["".join(f"Clause {i} {j} which is forty characters long, " for j in range(9)) + "end." for i in range(n)]
    return "".join(f"<p>{x}</p>" for x in texts), " ".join(texts)


@pytest.mark.parametrize("n", [1, 3, 30, 100])
def test_main_text_around_the_body(n):
    body, text = paragraphs(n)
    inner = f"<h1>{TITLE}</h1><p>Lead, short.</p><div>{body}</div><ul><li>Item one, short<li>Item two, here<li>Item three.</ul><table><tr><td>Cell a<td>Cell b</table>"
    want = f"{TITLE} Lead, short. {text} Item one, short Item two, here Item three. Cell a Cell b"
    for start, end in (("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), ("<div><div>", "</div></div>"), ("", "")):
        assert main_text(f"<body><nav>n</nav>{start}{inner}{end}<footer>f</footer></body>") == want
    assert main_text(f"<main><h1>{TITLE}</h1><article><div>{body}</div></article></main>") == f"{TITLE} {text}"
    assert main_text(f"<div>Site, name</div><div><h1>{TITLE}</h1><div>{body}</div></div><div>(c) Site</div>") == f"{TITLE} {text}"
    assert main_text(f"<body><ul><li><a>Home</a><li><a>News</a></ul><h1>{TITLE}</h1><div>{body}</div><ul><li><a>Home</a></ul></body>") == f"{TITLE} {text}"


@pytest.mark.parametrize("n", [1, 3, 30])
def test_main_text_below_names_of_boilerplate(n):
    body, text = paragraphs(n)
    want = f"{TITLE} {text}"
    comments = "<p>A reader who wrote a long comment, with many marks, and even more of them, to be long enough.</p>" * 60
    for name in ('class="layout has-sidebar"', 'id="page-header-fixed"', 'class="with-comments"'):
        for start, end in (("<article>", "</article>"), ("", "")):
            page = f"<body><p>Tag line.</p><div {name}>{start}<h1>{TITLE}</h1><div>{body}</div>{end}<div class=sidebar>Side, text.</div></div></body>"
            assert main_text(page if start else page.replace("<p>Tag line.</p>", "")) == want
        assert main_text(f"<article><h1>{TITLE}</h1><div {name}>{body}</div></article>") == want
    assert main_text(f"<div><h1>{TITLE}</h1>{body}</div><div class=comments>{comments}</div>") == want
    assert main_text(f"<article><h1>{TITLE}</h1>{body}<section class=comments><article>{comments}</article></section></article>") == want
    assert main_text(f"<div id=page-header-fixed><article><h1>{TITLE}</h1>{body}</article><div class=comments>{comments}</div></div>") == want
    assert main_text(f"<div><h1>{TITLE}</h1>{body}</div><div class=related><article><p>Teaser, one.</p></article></div>") == want


def test_main_text_keeps_captions_and_formulas():
    body, text = paragraphs(3)
    page = f"<article>{body}<figure><img><figcaption>Figure one.</figcaption></figure><p>Since <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math> holds.</p></article>"
    assert main_text(page) == f"{text} Figure one. Since x=1 holds."


ARTICLE = "<html><body><article><h1>Title</h1><p>" + "Some long text, with marks. " * 20 + "</p>"
READERS = "<li>A reader, who wrote a long comment, with marks. " * 9


@pytest.mark.parametrize("page, want", [
    (ARTICLE + "</article><ol class=\"commentlist\">" + READERS + "</ol></body>", "Title " + ("Some long text, with marks. " * 20).strip()),
    (ARTICLE + "<ol class=commentlist>" + READERS + "</ol></article>", "Title " + ("Some long text, with marks. " * 20).strip()),
    ("<article><p title=it's>One, here it is.</p><p class=\"x\" \">Two, there.</p></article>", "One, here it is. Two, there."),
    ("<body><div class=content><p>Hi</p><p>Short text.</p></div><div class=footer>Copyright 2020, all rights reserved, by the publisher, and others, everywhere.</div>", "Hi Short text."),
    ("<article><h1>T</h1><p class=search>On search, a text.</p><div class=\"social-science\"><p>On science.</p></div><div class=social>Share it</div></article>", "T On search, a text. On science."),
    ("<article><p>Text, it is.</p><p class=ad>Buy!</p><div class='related'>More</div></article>", "Text, it is."),
])
def test_names_and_broken_tags(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("page", [
    "<div>" * 20_000 + "text, here" + "</div>" * 20_000, "".join(f"<div>t{i}, " for i in range(20_000)), '<a "' * 262_144, '<a ="' * 200_000,
    "<div>" * 20_000 + "</x>" * 20_000 + "z" + "</p>" * 20_000, "<ul>" + "<li>a<div>" * 20_000, "<a =' <b =\" " * 80_000 + ">",
])
def test_deep_and_broken_pages_take_linear_time(page):
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 6  # about two seconds on a quiet machine


def plain_scores(blocks):
    """The path scores as their definition says them, path by path."""
    paths = list(dict.fromkeys(p for p, _, _ in blocks))
    ratio = {p: [sum(b[k] for b in blocks if b[0] == p) / math.sqrt(sum(b[0] == p for b in blocks)) for k in (1, 2)] for p in paths}
    out = {}
    for i, p in enumerate(paths):
        weights = {q: math.exp(-((j - i) ** 2) / 2) for j, q in enumerate(paths) if abs(j - i) <= 2}
        smooth = [sum(w * ratio[q][k] for q, w in weights.items()) / sum(weights.values()) for k in (0, 1)]
        out[p] = math.sqrt((ratio[p][0] + smooth[0]) / 2) * (1 + math.log(1 + (ratio[p][1] + smooth[1]) / 2))
    return out


def test_path_scores_against_their_definition():
    rng = random.Random(8)
    for _ in range(40):
        blocks = [(f"p{rng.randrange(7)}", rng.randrange(300), rng.randrange(12)) for _ in range(rng.randrange(1, 40))]
        got, want = path_scores(blocks), plain_scores(blocks)
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "y"), (2, "v", "<p>" + "long text, " * 30_000, "z")], "page_id long, url string, html string, text string")
    rows = extract(pages).collect()
    assert len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows) and {r.text for r in rows if r.page_id == 1} == {main_text(PAGE)}
    assert extract(pages.limit(0)).count() == 0


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(WORD_BPE), word_ids(WORD_BPE), random.Random(2)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(15))) for _ in range(3000)]
    assert [x.tolist() for x in own.batch(texts)] == [library.encode(x, add_special_tokens=False).ids for x in texts]


def test_pack_documents(spark):
    from tokenizers import Tokenizer

    library, texts = Tokenizer.from_file(WORD_BPE), awkward(3)
    ids = {i: [*library.encode(x or "", add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}
    rows = pack_documents(documents(spark, texts), WORD_BPE).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    for spans, whole in [*((p, len(ids[i])) for i, p in pieces.items()), *((s, None) for s in sequences.values())]:
        spans.sort()
        assert [a for a, _ in spans] == list(np.cumsum([0, *(n for _, n in spans)])[:-1])
        assert whole in (None, sum(n for _, n in spans))
    filled = [sum(n for _, n in s) for s in sequences.values()]
    assert len(pieces) == len(texts) and max(filled) <= 2048 and sum(2048 - n for n in filled if n & (n - 1)) == 0
    assert pack_documents(documents(spark, []), WORD_BPE).count() == 0


@pytest.mark.parametrize("words_each", [1, 4, 9])
def test_many_short_texts_are_packed_with_little_padding(spark, words_each):
    rng = random.Random(words_each)
    texts = [" ".join(rng.choice("red blue green one two three".split()) for _ in range(rng.randrange(1, words_each + 1))) for _ in range(4000)]
    held = defaultdict(int)
    for r in pack_documents(documents(spark, texts).coalesce(2), WORD_BPE).collect():
        held[r.sequence_id] += r.length
    padding = sum(2048 - n for n in held.values() if n & (n - 1))
    assert padding <= 0.05 * sum(held.values())


def test_pack_examples_under_three_limits(spark):
    rng, limits = random.Random(4), Limits(1000, 5, 400)
    rows = [(f"e{i}", rng.randrange(1, 600), rng.randrange(0, 300)) for i in range(300)] + [("big", 5000, 10), ("none", None, None)]
    got = pack_examples(spark.createDataFrame(rows, "name string, n int, m int").coalesce(1), "name", "n", "m", limits).collect()
    need = {k: (n or 0, min(n or 0, m or 0)) for k, n, m in rows}
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.name))
    assert sorted(r.name for r in got) == sorted(need)
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == list(np.cumsum([0, *(need[k][0] for _, k in s)])[:-1])
        assert s[0][1] == "big" or (len(s) <= 5 and sum(need[k][0] for _, k in s) <= 1000 and sum(need[k][1] for _, k in s) <= 400)
    tokens = sum(n for k, (n, _) in need.items() if k != "big")
    assert len(sequences) - 1 <= 1.15 * max(tokens / 1000, sum(m for k, (_, m) in need.items() if k != "big") / 400, 301 / 5)


def test_count_tokens(spark):
    import sentencepiece

    library, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(5)
    texts = awkward(4) + ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(20))) for _ in range(500)]
    rows = count_tokens(documents(spark, texts), PIECES, limit=50).collect()
    want = [(i, len((x or "").encode()), len(library.encode(x or "")), len(library.encode(x or "")) > 50) for i, x in enumerate(texts)]
    assert sorted(map(tuple, rows)) == want
    twice = count_tokens(documents(spark, ["a b", "a b", None], ids=[1, 1, None]), PIECES).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in twice) == [(0, 0), (1, len(library.encode("a b"))), (1, len(library.encode("a b")))]
    assert count_tokens(documents(spark, []), PIECES).count() == 0


def shingles(text: str) -> set:
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_fingerprints(spark):
    rng = random.Random(6)
    texts = awkward(5)
    for _ in range(10):
        text = prose(rng, 300)
        texts += [text, text]
    rows = {r.doc_id: r for r in fingerprints(documents(spark, texts)).collect()}
    errors = []
    for i, x in enumerate(x or "" for x in texts):
        follower = texts[i - 1] or ""  # descending ids; after id 0 comes the largest
        edited = x[: len(x) - len(x) // 3] + follower[: len(x) // 3]
        r = rows[i]
        assert r.n_chars == len(x) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, a, b in ((r.near_edited, x, edited), (r.near_next, x, follower)):
            one, two = shingles(a), shingles(b)
            true = len(one & two) / len(one | two) if one | two else 1.0
            errors.append(near - true if len(one) > 40 else 0)
            assert (near == 1) if one == two else (0 <= near <= 1)
        assert (r.fingerprint == "") == (not shingles(x)) and len(r.fingerprint) in (0, 256)
    assert rows[5].fingerprint == rows[6].fingerprint and np.abs(errors).max() < 0.15 and abs(np.mean(errors)) < 0.02


def test_fingerprint_order_with_nulls(spark):
    ids = [5, None, -3, 10**15, None, 5]
    docs = documents(spark, [prose(random.Random(i), 30) for i in range(5)] + [prose(random.Random(0), 30)], ids=ids)
    rows = fingerprints(docs).collect()
    assert len(rows) == 6 and fingerprints(docs.limit(0)).count() == 0
    fives = [r for r in rows if r.doc_id == 5]
    assert fives[0].fingerprint == fives[1].fingerprint and 1.0 in {r.near_next for r in fives}
    plan = fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def labelled(spark, n: int = 600):
    rng, texts, labels = random.Random(7), [], []
    for i in range(n):
        toxic = rng.random() < 0.3
        w = prose(rng, rng.randrange(5, 60)).split()
        for _ in range(3 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "rotten", "vequ" + rng.choice("abcdefgh") + "x"]))
        if rng.random() < (0.8 if toxic else 0.2):
            w.insert(0, rng.choice(["Muslim", "women", "immigrant"]))  # a term that goes with the label
        texts.append(" ".join(w))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (5, None), (10**6, 1)]
    return texts, spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels[:n])


def test_toxicity(spark):
    texts, labels, truth = labelled(spark)
    texts += [None, "", "muslim women and immigrant people met", "w1x1 vequzx w2x2 vile w3x3 vile", "vile " + "w1x1 " * 5000 + "rotten vequax"]
    rows = {r.doc_id: r for r in toxicity(documents(spark, texts), labels).collect()}
    assert len(rows) == len(texts)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(len(texts)))
    assert np.mean([rows[i].predicted == truth[i] for i in held if truth[i] is not None]) > 0.95
    assert [rows[600 + i].predicted for i in range(5)] == [0, 0, 0, 1, 1] and rows[602].score < 0.5
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())


def test_toxicity_without_labels(spark):
    texts, labels, _ = labelled(spark, 20)
    rows = toxicity(documents(spark, texts), labels.limit(0)).collect()
    assert {r.score for r in rows} == {0.5} and toxicity(documents(spark, []), labels).count() == 0
    assert swapped("The women, Men") == "The men, women" and swapped("none here") is None and swapped(None) is None
    assert documents(spark, texts).filter(F.col("text").isNull()).count() == 0
