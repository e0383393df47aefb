"""Token counts: pieces are counted once per distinct pre-token and joined to pre-token frequencies of documents."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import doc_key, stored, text_tag

#: No piece of the vocabulary holds a line end or has a space after another sign, so merges stop at these borders.
PRETOKEN = re.compile(r" *[^ \n]+|\n| +")
#: Pre-tokens whose counts every task holds: the most frequent ones, so many and so long at most (under 70 MB).
HEAD, HEAD_CHARS = 1 << 19, 32
#: Distinct pre-tokens that a task gathers before it hands them on.
FLUSH = 300_000


@lru_cache(maxsize=1)
def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def pretokens(text: str) -> list[str]:
    """The text cut where no merge can reach across; the space that the library puts in front is added."""
    return PRETOKEN.findall(" " + text.replace("▁", " ")) if text else []


def piece_counts(model: str, tokens: list[str]) -> list[int]:
    """Pieces of each pre-token. The library puts a space before every input: it stands for the pre-token's own one,
    or a line end is set between, which costs two pieces."""
    spaced = [t[1:] if t[0] == " " else "\n" + t for t in tokens]
    ids = processor(model).encode(spaced, num_threads=1)
    return [len(x) - (0 if t[0] == " " else 2) if s else 1 for x, t, s in zip(ids, tokens, spaced, strict=True)]


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.record_batch({"pretoken": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
        seen.clear()
        return batch

    for batch in batches:
        for text in batch.column("text"):
            if value := text.as_py():
                seen.update(pretokens(value))
                if len(seen) >= FLUSH:
                    yield out()
    if seen:
        yield out()


def least_frequency(counted: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` counts reach, from a histogram by powers of two."""
    bits = counted.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count("*").alias("c")).collect()  # 64 rows at most
    reached, power = 0, 62
    for row in sorted(bits, reverse=True):
        if reached + row.c > most:
            break
        reached, power = reached + row.c, row.bits - 1
    return 1 << power


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit``) of every row.

    A null text has no bytes and no tokens; a null doc_id stays null; repeated rows are counted each on its own; other
    columns are ignored; an empty table gives an empty result. Texts are read whole, and the ids of their tokens are
    never made. Frequencies of the commonest pre-tokens meet their counts where they arise, the rest in a join.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("pretoken").to_pylist()
            for at in range(0, len(tokens), 4096):
                part = slice(at, at + 4096)
                yield pa.record_batch({
                    "pretoken": batch.column("pretoken")[part], "n": batch.column("n")[part],
                    "pieces": pa.array(piece_counts(model, tokens[part]), pa.int32()),
                })

    corpus = docs.select("text").mapInArrow(_distinct, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    pieces = stored(corpus.mapInArrow(counted, "pretoken string, n long, pieces int"))
    short = pieces.filter(F.length("pretoken") <= HEAD_CHARS)
    common = short.filter(F.col("n") >= least_frequency(short, HEAD))
    head = spark.sparkContext.broadcast({r.pretoken: r.pieces for r in common.select("pretoken", "pieces").toLocalIterator()})

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        for batch in batches:
            ids, keys, tags = (batch.column(c).to_pylist() for c in ("doc_id", "k", "t"))
            rows: list[list] = [[], [], [], [], [], [], []]

            def out(rows=rows) -> pa.RecordBatch:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
                made = pa.record_batch([pa.array(x, y) for x, y in zip(rows, kinds, strict=True)], ["doc_id", "k", "t", "bytes", "sure", "pretoken", "n"])
                for x in rows:
                    x.clear()
                return made

            for at, value in enumerate(batch.column("text")):
                text = value.as_py() or ""
                sure, rest = 0, []
                for token, n in Counter(pretokens(text)).items():
                    if (count := known.get(token)) is None:
                        rest.append((token, n))
                    else:
                        sure += count * n
                # The document's own row has a pre-token that no text holds, so such rows spread over all partitions.
                for bytes_, known_, token, n in [(len(text.encode()), sure, f"\n{keys[at]}", 0), *((None, None, x, y) for x, y in rest)]:
                    for column, cell in zip(rows, (ids[at], keys[at], tags[at], bytes_, known_, token, n), strict=True):
                        column.append(cell)
                if len(rows[0]) >= 50_000:
                    yield out()
            if rows[0]:
                yield out()

    keyed = docs.select("doc_id", doc_key().alias("k"), text_tag().alias("t"), "text")
    parts = keyed.mapInArrow(frequencies, "doc_id long, k long, t long, bytes long, sure long, pretoken string, n long")
    joined = parts.join(pieces.select("pretoken", "pieces"), "pretoken", "left")
    per_doc = joined.groupBy("doc_id", "k", "t").agg(
        F.count("bytes").alias("copies"), F.max("bytes").alias("n_bytes"), F.sum("sure").alias("sure"),
        F.coalesce(F.sum(F.col("n") * F.col("pieces")), F.lit(0)).alias("rest"),
    )
    # Rows that repeat a document are gathered together above and dealt out again here.
    return (
        per_doc.withColumn("n_tokens", F.expr("(sure + rest) div copies"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.explode(F.expr("sequence(1, copies)")).alias("copy"))
        .drop("copy")
    )
