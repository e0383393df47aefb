"""Toxicity: a linear classifier over words and word beginnings whose score may not hang on who is mentioned.

Labelled texts are read twice, as they are and with every identity term swapped for another; besides the usual loss the
fit pays for the difference of the two scores, so a term's own weight stays near zero and neutral mentions are not flagged.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import stored

#: Groups that a text may mention without harm, in pairs of exchangeable kinds: fixed values; a caller may give others.
IDENTITY = tuple(
    "women men woman man girl boy gay straight lesbian heterosexual transgender cisgender black white asian latino african european "
    "muslim christian jewish hindu buddhist atheist catholic protestant immigrant native refugee citizen deaf blind disabled autistic "
    "old young elderly teenage mexican american chinese russian arab turkish "
    "frauen männer frau mann mädchen junge schwul hetero lesbisch heterosexuell schwarze weiße muslimisch christlich jüdisch evangelisch "
    "behindert gesund türkisch deutsch arabisch russisch flüchtlinge einheimische "
    "femmes hommes femme homme fille garçon homosexuel hétérosexuel noirs blancs musulman chrétien juif catholique handicapé valide "
    "immigré autochtone arabe français africain européen "
    "mujeres hombres mujer hombre niña niño homosexual heterosexuales negros blancos musulmán cristiano judío católico discapacitado sano "
    "inmigrante nativo árabe español africano europeo".split()
)
WORD = re.compile(r"\w+")
#: Letters of a word's beginning that are features too, for words longer than that.
STEMS = (4, 5)
SAMPLE = 16_384
FEATURES = 4096


def features(text: str | None) -> set[str]:
    """Distinct lower-case words and, marked with ``^``, their beginnings."""
    words = set(WORD.findall((text or "").lower()))
    return words.union(*({"^" + w[:n] for w in words if len(w) > n} for n in STEMS))


def swapped(text: str | None, terms: tuple[str, ...] = IDENTITY) -> str | None:
    """The text with each identity term exchanged for the other of its pair; None if it has none."""
    other = {a: b for i in range(0, len(terms) - 1, 2) for a, b in ((terms[i], terms[i + 1]), (terms[i + 1], terms[i]))}
    found = WORD.findall((text or "").lower())
    return WORD.sub(lambda m: other.get(m.group().lower(), m.group()), text) if any(w in other for w in found) else None


def fit(rows: list[np.ndarray], other: list[np.ndarray | None], labels: np.ndarray, size: int, ridge: float = 3e-5, fair: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic loss, a ridge, and ``fair`` times the mean square difference of paired scores."""

    def flat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)

    pairs = [i for i, x in enumerate(other) if x is not None]
    (r, f), (ra, fa), (rb, fb) = flat(rows), flat([rows[i] for i in pairs]), flat([other[i] for i in pairs])
    n, m = len(rows), len(pairs)
    weight, bias = np.zeros(size), 0.0
    first, second, bias_first, bias_second = np.zeros(size), np.zeros(size), 0.0, 0.0
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    for t in range(1, rounds + 1):
        score = np.bincount(r, weight[f], n) + bias
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels) * share
        gradient = np.bincount(f, error[r], size) + ridge * weight
        if m:
            gap = (np.bincount(ra, weight[fa], m) - np.bincount(rb, weight[fb], m)) * (2 * fair / m)
            gradient += np.bincount(fa, gap[ra], size) - np.bincount(fb, gap[rb], size)
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        bias_first, bias_second = 0.9 * bias_first + 0.1 * error.sum(), 0.999 * bias_second + 0.001 * error.sum() ** 2
        scale = 0.1 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        weight = weight - scale * first / (np.sqrt(second) + 1e-9)
        bias -= scale * bias_first / (np.sqrt(bias_second) + 1e-9)
    return weight, bias


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: tuple[str, ...] = IDENTITY, n_features: int = FEATURES) -> tuple[dict[str, float], float]:
    """Weights of the features and the bias, learnt from at most ``sample`` labelled texts.

    ``sample`` bounds the labelled rows of each label to its half; the rows with the least hash of their id are taken.
    Rows whose crc32(doc_id) mod 3 is 1 and null ids or labels are not learnt from, and equal texts count once. Features
    are those in three texts or more whose chi-square with the label is largest and beyond chance, ``n_features`` at
    most; with no or one label only, every score is 0.5.
    """
    bounded = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    bounded = bounded.filter(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    half = [bounded.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for y in (0, 1)]
    ids = F.broadcast(half[0].union(half[1]))  # rows of two numbers, ``sample`` at most

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            twins = [swapped(t, terms) for t in texts]
            yield pa.record_batch({
                "toxic": batch.column("toxic"), "own": pa.array([sorted(features(t)) for t in texts], pa.list_(pa.string())),
                "twin": pa.array([None if t is None else sorted(features(t)) for t in twins], pa.list_(pa.string())),
            })

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id")
    rows = texts.select("toxic", "text").mapInArrow(both, "toxic int, own array<string>, twin array<string>")
    # Equal texts count once, with the label that most of them have (harmless where as many have the other).
    rows = stored(rows.groupBy("own").agg((F.sum("toxic") * 2 > F.count("*")).cast("int").alias("toxic"), F.max("twin").alias("twin")).select("toxic", "own", "twin"))
    size = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows at most
    n0, n1 = size.get(0, 0), size.get(1, 0)
    if not n0 or not n1:
        return {}, 0.0
    a, b = F.col("a"), F.col("b")
    each = rows.select("toxic", F.explode("own").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    chi = (n0 + n1) * F.pow(a * (n0 - b) - b * (n1 - a), F.lit(2.0)) / F.greatest((a + b) * (n0 + n1 - a - b) * F.lit(float(n0) * n1), F.lit(1.0))
    each = stored(each.filter(a + b >= 3))
    # Among so many features chance alone gives some a chi-square of twice their number's logarithm.
    chance = 2 * math.log(max(2, each.count())) + 2
    best = each.withColumn("chi", chi).filter(F.col("chi") > chance).orderBy(F.desc("chi"), "feature").limit(n_features)
    names = [r.feature for r in best.select("feature").collect()]
    names += [t for t in terms if t not in set(names)]
    number = {name: i for i, name in enumerate(names)}
    known = spark_literal(rows, number)
    got = known.collect()  # ``sample`` rows of a few numbers each
    weight, bias = fit(
        [np.array(r.own, np.int64) for r in got], [None if r.twin is None else np.array(r.twin, np.int64) for r in got],
        np.array([r.toxic for r in got], np.float64), len(names),
    )
    return {name: float(w) for name, w in zip(names, weight, strict=True) if abs(w) > 1e-6}, float(bias)


def spark_literal(rows: DataFrame, number: dict[str, int]) -> DataFrame:
    """The numbers of the chosen features of each row."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(cells: list | None) -> list[int] | None:
            return None if cells is None else [number[x] for x in cells if x in number]

        for batch in batches:
            own, twin = ([of(x) for x in batch.column(c).to_pylist()] for c in ("own", "twin"))
            yield pa.record_batch({"toxic": batch.column("toxic"), "own": pa.array(own, pa.list_(pa.int32())), "twin": pa.array(twin, pa.list_(pa.int32()))})

    return rows.mapInArrow(pick, "toxic int, own array<int>, twin array<int>")


def add_score(docs: DataFrame, model: tuple[dict[str, float], float], score: str = "score") -> DataFrame:
    """All rows and columns, with the score of the whole text; a null or empty text has the bias's score."""
    weights, bias = model
    stems = {n: {k[1:] for k in weights if k[0] == "^" and len(k) == n + 1} for n in STEMS}

    def of(text: str | None) -> float:
        words = set(WORD.findall((text or "").lower()))
        total = bias + sum(weights[w] for w in words if w in weights)
        for n, known in stems.items():
            total += sum(weights["^" + s] for s in {w[:n] for w in words if len(w) > n} & known)
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([of(x.as_py()) for x in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, score])

    docs = docs.withColumn("text", F.col("text").cast("string"))
    at = docs.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, `{score}` double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Labels, language, source and id never reach a score. A null text scores as an empty one, a null doc_id is not held
    out, repeated rows score alike each on its own, other columns are ignored, an empty table gives an empty result.
    """
    model = train(docs, labels, sample)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    scored = add_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
