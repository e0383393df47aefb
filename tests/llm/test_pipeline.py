"""Every stage of the pipeline against a plain version of it."""

import os
import random
import sys
from collections import Counter, defaultdict

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from helpers import covered, documents, groups, prose, words  # noqa: E402

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(1)
    passage = prose(rng, 55)
    texts, labels = [], []
    for i in range(150):
        w = prose(rng, rng.randrange(30, 120)).split()
        toxic = i % 4 == 0
        for _ in range(4 if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "rotten", "wretch"]))
        texts.append(" ".join(w))
        labels.append((i, int(toxic)))
    texts += [texts[1], texts[1] + " end", texts[2].replace("w1", "v1", 1), None, "", *(f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(5))]
    path = str(tmp_path_factory.mktemp("corpus"))
    documents(spark, texts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, texts, dict(labels)


def test_stages(spark, corpus):
    path, texts, labels = corpus
    docs = corpus_pipeline.table(spark, path, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, path))
        kept[name] = docs.collect()
        assert name == "packing" or docs.columns == before.columns
    left = {r.doc_id: r.text for r in kept["toxicity"]}
    assert {i for i in labels if i not in left} == {i for i, y in labels.items() if y} and len(left) == len(texts) - sum(labels.values())
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(x)) else set() for i, x in left.items()}
    want = groups(sorted(left), lambda i, j: bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    alone = {r.doc_id: r.text for r in kept["near_dedup"]}
    assert alone.keys() == {i for i in left if want[i] == i} and 150 not in alone and 151 not in alone and {153, 154} <= alone.keys()
    ids = sorted(alone)
    units = [(alone[i] or "").encode() for i in ids]
    rest = {i: bytes(b for b, m in zip(u, mask, strict=True) if not m).decode() for i, u, mask in zip(ids, units, covered(units, 200), strict=True)}
    assert {r.doc_id: r.text for r in kept["passage_dedup"]} == rest and sum(map(len, rest.values())) < sum(map(len, units)) - 500
    assert all(r.n_chars == len(r.text) for r in kept["passage_dedup"])
    taken, size = defaultdict(int), Counter({i: len(words(x)) for i, x in rest.items()})
    for r in kept["mixing"]:
        taken[r.doc_id] += len(words(r.text))
        assert set(words(r.text)) <= set(words(rest[r.doc_id]))
    assert all(n <= 3 * size[i] for i, n in taken.items()) and abs(sum(taken.values()) - sum(size.values())) < 64 * 3
    assert sum(r.length for r in kept["packing"]) >= sum(taken.values())


def test_run_is_the_stages(spark, corpus):
    path, _, _ = corpus
    made = corpus_pipeline.run(spark, path)
    assert made.columns[:3] == ["doc_id", "start", "length"] and made.count() > 50


def test_empty_tables_pass_all_stages(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_leave_the_tables_of_others(spark, corpus, tmp_path):
    path, _, _ = corpus
    from ballast.llm.phrase_dedup import phrase_dedup

    docs = corpus_pipeline.table(spark, path, "documents")
    own = phrase_dedup(docs)  # lazy: reads what it stored when it is asked
    kept = corpus_pipeline.near_dedup(spark, docs, path)
    kept.write.parquet(f"{tmp_path}/kept")
    passed = corpus_pipeline.passage_dedup(spark, spark.read.parquet(f"{tmp_path}/kept"), path)
    assert passed.count() == spark.read.parquet(f"{tmp_path}/kept").count() and own.count() == docs.count()
    first, second = corpus_pipeline.run(spark, path), corpus_pipeline.run(spark, path)
    assert first.count() == second.count() > 50


def test_repeats_and_null_ids_stay_once(spark, tmp_path):
    rng = random.Random(2)
    a, b, c, d, e, f = (prose(rng, 90) for _ in range(6))
    rows = [(7, a), (7, a), (7, a), (None, b), (None, b), (None, b + " end"), (3, c), (9, c), (9, d), (None, e), (4, e), (5, f), (5, f + " end"), (None, None), (None, None)]
    docs = documents(spark, [x for _, x in rows], ids=[i for i, _ in rows], sources=["s"] * len(rows))
    kept = corpus_pipeline.stored(corpus_pipeline.near_dedup(spark, docs, ""))
    got = Counter((r.doc_id, (r.text or "").removesuffix(" end")) for r in kept.collect())
    assert got == {(7, a): 1, (None, b): 1, (3, c): 1, (9, d): 1, (4, e): 1, (5, f): 1, (None, ""): 2} and kept.columns == docs.columns
    passed = corpus_pipeline.stored(corpus_pipeline.passage_dedup(spark, kept, ""))
    assert sum(len(words(r.text)) for r in passed.collect()) == sum(len(words(r.text)) for r in kept.collect())
    mixed = [r.text for r in corpus_pipeline.mixing(spark, passed, "").collect()]
    assert sorted(x.removesuffix(" end") for x in mixed) == sorted([a, b, c, d, e, f])


def test_rows_of_a_column_named_as_the_stage_names_its_own(spark):
    docs = documents(spark, ["a b c d e f g", "a b c d e f g", "z y x w v u t"]).withColumnRenamed("row", "_ROW").withColumnRenamed("k", "_hash")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2]
