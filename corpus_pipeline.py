"""From raw documents to packed training sequences, one operator after another.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
``documents``; ``run`` writes and rereads what lies between. A stage begins by deleting what the stages before it stored
on their way, but for what ``docs`` is read from: their results are written by then.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.llm.common import discard, release, scratch, stored, table
from ballast.llm.minhash import near_duplicates
from ballast.llm.mixing import mixed
from ballast.llm.suffix_dedup import suffix_dedup
from ballast.llm.toxicity import add_score, train
from ballast.llm.vector_packing import pack_documents

THRESHOLD = 0.7
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def staged(stage: Stage) -> Stage:
    """The stage, which first deletes what stages before it stored on their way."""

    @functools.wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, docs)
        with scratch():
            return stage(spark, docs, sf_dir)

    return begun


@staged
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text scores below the threshold; the classifier is learnt from the labelled ones."""
    model = train(docs, table(spark, sf_dir, "labels"))
    score = next(name for name in ("_score" + "_" * i for i in range(len(docs.columns) + 1)) if name not in docs.columns)
    return add_score(docs, model, score).filter(F.col(score) < THRESHOLD).drop(score)


@staged
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of 0.8 on five-word shingles hold together: that of the least id, null ids last.

    Rows are told apart by a number of their own, so rows that repeat, share an id or have none are copies like others. Of
    equal ids the least hash of text and other columns stays. A null or empty text links with nothing and stays.
    """
    names = free_names(docs, "_row", "_hash")
    row, mark = (F.col(c) for c in names)
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    # Written once: the numbers must not change between readings.
    rows = stored(docs.withColumns({names[0]: F.monotonically_increasing_id(), names[1]: F.xxhash64("text", *hashed)}))
    near = near_duplicates(rows.select(row.alias("doc_id"), "text"))
    extra = stored(near.filter("not kept").select(F.col("doc_id").alias("r"), F.col("component_id").alias("c")))
    members = extra.union(extra.select("c", "c").distinct())
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), mark.alias("hash"), row.alias("row"))
    known = members.join(rows.select(row.alias("r"), rank.alias("rank")), "r")
    first = known.groupBy("c").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias("r"))
    gone = members.join(first, "r", "left_anti").select(F.col("r").alias(names[0]))
    return rows.join(gone, names[0], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of the table has them."""
    taken = {c.lower() for c in df.columns}
    return [next(n for n in (name + "_" * i for i in range(len(taken) + 1)) if n not in taken) for name in names]


@staged
def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that strings found elsewhere cover; one that loses all of them stays, with an empty text."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    kept = suffix_dedup(docs, text=True, carry=rest)
    made = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")} | {c: F.col(f"_c{i}") for i, c in enumerate(rest)}
    return kept.select(*[made[c].alias(c) for c in docs.columns])


@staged
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their targets: a row for each time that words of a document are taken."""
    made = mixed(docs)
    return made.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


@staged
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("mixing", mixing), ("packing", packing)]

#: A learnt classifier, a suffix sort and a tokenizer are not to be had in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        discard(before)  # only what was stored here, not the given table
    return STAGES[-1][1](spark, docs, sf_dir)
