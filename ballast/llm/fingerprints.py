"""Document fingerprints by one-permutation MinHash, in DataFrame functions alone.

A shingle is hashed once; the hash's top bits name a bin, and a bin keeps its least hash. An empty bin takes over the value
of the first full bin in a pseudorandom order of its own (optimal densification: the orders of two bins are independent,
and two texts meet at the same bin). Of each value the low bits are kept, packed; that two values agree in them by
chance is taken off the likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN_BITS, KEPT_BITS = 8, 4
BINS, PER_LONG = 1 << BIN_BITS, 64 // KEPT_BITS
#: Bins that an empty bin looks at one by one before it ranks all full ones.
PROBES = 12
#: Ranges of ids whose rows meet in one task: so many documents each, and so many ranges at most.
RANGE_ROWS, RANGES, COARSE = 20_000, 1 << 16, 256
BLANK = "[ \\t-\\r]+"


def let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for a value that is worked out once, also where lambdas use it."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def with_fingerprint(df: DataFrame, text: str, out: str, size: int = 5) -> DataFrame:
    """Adds ``out``: the packed fingerprint of a text's ``size``-word shingles as an array of longs, empty without words.

    A text with fewer words has them all as its one shingle. Words are what stands between white-space bytes. Equal
    texts have equal fingerprints; a null text is an empty one.
    """
    words = f"filter(split(coalesce({text}, ''), r'{BLANK}'), w -> w <> '')"
    later = ", ".join(f"get(h, i + {d})" for d in range(1, size))
    shingles = f"""sort_array(CASE WHEN size(h) >= {size} THEN transform(slice(h, 1, greatest(size(h) - {size - 1}, 0)), (x, i) -> xxhash64(x, {later}))
        WHEN size(h) > 0 THEN array(xxhash64(h, size(h))) ELSE cast(array() as array<bigint>) END)"""
    shift, low = 64 - BIN_BITS, (1 << KEPT_BITS) - 1
    # Sorted hashes: the first of each bin is its least.
    least = f"filter(s, (x, i) -> i = 0 OR shiftrightunsigned(x, {shift}) <> shiftrightunsigned(get(s, i - 1), {shift}))"
    # Full bins as (bin, kept bits).
    full = f"transform(o, x -> struct(shiftrightunsigned(x, {shift}) AS bin, x & {low} AS kept))"
    # An empty bin tries PROBES bins by hash, then takes the full bin that stands first in an order by hash of its own.
    probes = ", ".join(f"get(v, cast(xxhash64(j, {t}) & {BINS - 1} as int))" for t in range(PROBES))
    ordered = "array_min(transform(e, x -> struct(xxhash64(x.bin, j) AS p, x.kept AS v))).v"
    dense = let("m", "map_from_entries(e)", f"transform(sequence(0L, {BINS - 1}L), j -> element_at(m, j))")
    digits = let("v", dense, f"transform(v, (x, j) -> coalesce(x, {probes}, {ordered}))")
    packed = let("d", digits, f"transform(sequence(0, {BINS // PER_LONG - 1}), g -> aggregate(slice(d, g * {PER_LONG} + 1, {PER_LONG}), 0L, (a, x) -> shiftleft(a, {KEPT_BITS}) | x))")
    body = f"CASE WHEN size(o) > 0 THEN {let('e', full, packed)} ELSE cast(array() as array<bigint>) END"
    hashes = f"transform({words}, w -> xxhash64(w))"
    return df.withColumn(out, F.expr(let("h", hashes, let("s", shingles, let("o", least, body)))))


def as_text(packed: str) -> Column:
    return F.expr(f"array_join(transform({packed}, x -> lpad(lower(hex(x)), 16, '0')), '')")


def likeness(a: str, b: str) -> Column:
    """The estimated Jaccard likeness of two fingerprints, chance agreement of the kept bits taken off; two empty ones are alike."""
    spread = " | ".join(f"shiftrightunsigned(z, {i})" for i in range(KEPT_BITS))
    mask = int("1".rjust(KEPT_BITS, "0") * PER_LONG, 2)
    differ = f"aggregate(zip_with({a}, {b}, (x, y) -> {let('z', 'x ^ y', f'bit_count(({spread}) & {mask}L)')}), 0, (s, x) -> s + x)"
    chance = 2.0**-KEPT_BITS
    near = F.greatest(F.lit(0.0), ((BINS - F.expr(differ)) / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), near).when(F.size(a) == F.size(b), F.lit(1.0)).otherwise(F.lit(0.0))


def in_ranges(df: DataFrame) -> DataFrame:
    """Rows with what puts them in order of descending doc_id, the first row of each range once more as a guest.

    Null ids come last, by their text's hash. Rows meet by ranges of ids: quantiles (a fixed number, which the driver
    sees) split further into even parts. A range's guest is the first row of the range that follows; the last one's is
    the very first row.
    """
    df = df.withColumn("_null", F.col("doc_id").isNull()).withColumn("_value", F.coalesce("doc_id", F.xxhash64("text")))
    ids = df.filter("not _null").select("_value")
    total = ids.count()
    cuts = sorted({int(x) for x in ids.select(F.col("_value").cast("double")).approxQuantile("_value", [i / COARSE for i in range(COARSE + 1)], 0.25 / COARSE)}) if total else []
    fine = min(max(1, -(-total // (COARSE * RANGE_ROWS))), RANGES // COARSE)
    low, high = cuts or [0], [*cuts[1:], (cuts or [0])[-1] + 1]
    bounds = F.array(*[F.lit(x).cast("long") for x in low])
    df = df.withColumn("_coarse", F.greatest(F.lit(1), F.size(F.filter(bounds, lambda x: x <= F.col("_value")))))
    at = F.element_at(bounds, F.col("_coarse"))
    width = F.greatest(F.element_at(F.array(*[F.lit(x).cast("long") for x in high]), F.col("_coarse")) - at, F.lit(1))
    part = F.greatest(F.lit(0), F.least(F.lit(fine - 1), F.floor((F.col("_value") - at).cast("double") / width.cast("double") * fine)))
    nulls = F.floor(F.shiftright("_value", 58)) - 32
    df = df.withColumn("_range", F.when(F.col("_null"), nulls).otherwise(F.col("_coarse") * fine + part).cast("long")).drop("_coarse")
    heads = df.groupBy("_range").agg(F.max("_value").alias("_value"), F.first("_null").alias("_null"))  # RANGES + COARSE + 64 rows at most
    heads = heads.selectExpr("_value", "_null", "coalesce(lead(_range) over (order by _range), min(_range) over ()) as _to")
    guests = df.join(F.broadcast(heads), ["_value", "_null"]).withColumn("_range", F.col("_to")).drop("_to")
    return df.withColumn("_guest", F.lit(False)).unionByName(guests.withColumn("_guest", F.lit(True)))


def with_next(both: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The rows of in_ranges, guests left out, with values of the next row as {new name: column}."""
    over = "over (partition by _range order by _guest, _value desc, xxhash64(text))"
    with_lead = both.selectExpr("*", *[f"lead({c}) {over} as {name}" for name, c in columns.items()])
    return with_lead.filter("not _guest").drop("_null", "_value", "_range", "_guest")


def fingerprints(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last third of code points replaced by the first as many of the next document's. Null texts
    are empty; an empty text's fingerprint is "", like another empty one and unlike all others; null ids come last;
    repeated rows follow one another and are kept; other columns are ignored; an empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = with_next(with_fingerprint(in_ranges(own), "text", "f", size), {"next_text": "text", "next_f": "f"}).withColumn("n_chars", F.length("text").cast("long"))
    third = "cast(n_chars div 3 as int)"
    df = df.withColumn("edited", F.expr(f"concat(left(text, cast(n_chars as int) - {third}), left(next_text, {third}))")).drop("text", "next_text")
    df = with_fingerprint(df, "edited", "g", size)
    return df.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("f").alias("fingerprint"), as_text("g").alias("edited_fingerprint"),
        likeness("f", "g").alias("near_edited"), likeness("f", "next_f").alias("near_next"),
    )
