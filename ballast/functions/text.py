"""Column functions over names and notice texts."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words of a station name that do not identify it.
GENERIC_WORDS = (
    "centraal", "central", "hbf", "hauptbahnhof", "gare de", "gare du", "gare d'", "station",
    "bahnhof", "railway station", "sncb", "sncf", "cff", "sbb",
)
# Country prefixes of the UIC codes looked for, and languages in order of preference.
UIC_PREFIXES = ("80", "84", "85", "87", "88")
LANGUAGES = ("nl", "fr", "de", "en")
# Phrases of a notice that tell a closed stretch and an international hindrance.
CLOSED_STRETCH = r"[Tt]ussen (.+?) en (.+?) rijden er (?:geen treinen|(?:\S+ )*bussen)"
INTERNATIONAL = r"(?i)internationale dienstregeling"


@F.pandas_udf(T.StringType())
def nfkd_fold(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks; Spark has no normaliser of its own."""

    def fold(text):
        if text is None or text.isascii():
            return text
        return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))

    return texts.map(fold, na_action="ignore")


def _collapse(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"(?U)[\s\x1c-\x1f]+", " "))


def normalize_name(col: Column) -> Column:
    """Accent-free, caseless key with hyphens as spaces: "Liège-Guillemins" -> "liege guillemins"."""
    folded = F.regexp_replace(F.lower(nfkd_fold(col)), "ß", "ss")
    return _collapse(F.translate(F.translate(folded, "ς", "σ"), "-", " "))


def norm_station(col: Column) -> Column:
    """ASCII key without generic station words: "Gare de Lyon" -> "lyon"."""
    ascii_only = F.lower(F.regexp_replace(nfkd_fold(F.coalesce(col, F.lit(""))), r"[^\x00-\x7F]", ""))
    specific = F.regexp_replace(ascii_only, r"\b(" + "|".join(GENERIC_WORDS) + r")\b", " ")
    return F.trim(F.regexp_replace(specific, "[^a-z0-9]+", " "))


def norm_compact(col: Column) -> Column:
    """Letters and digits only: "Frankfurt(Main)Hbf" -> "frankfurtmainhbf"."""
    return F.regexp_replace(F.regexp_replace(nfkd_fold(F.lower(col)), "ß", "ss"), "[^a-z0-9]", "")


def uic_code(*cols: Column) -> Column:
    """Seven-digit UIC station code in the first of the texts that holds one."""
    pattern = rf"(?<![0-9])((?:{'|'.join(UIC_PREFIXES)})[0-9]{{5,6}})(?![0-9])"
    return F.coalesce(*[F.substring(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")), 1, 7) for c in cols])


def preferred_text(texts: Column, languages: Sequence[str] = LANGUAGES, length: int | None = None) -> Column:
    """Text in the most preferred language present, else in the first one; '' without texts."""

    def last_in(language: Column) -> Column:
        return F.try_element_at(F.filter(texts, lambda t: t["lang"] == language), F.lit(-1))["text"]

    first_language = F.try_element_at(texts, F.lit(1))["lang"]
    chosen = F.coalesce(*[last_in(F.lit(code)) for code in languages], last_in(first_language), F.lit(""))
    return F.substring(chosen, 1, length) if length else chosen


def contains_any(col: Column, terms: Sequence[str]) -> Column:
    """Whether the lower-cased text contains one of the terms."""
    text = F.lower(col)
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))


def closed_pairs(col: Column) -> Column:
    """Every "between X and Y no trains" stretch of a text as array<struct<a,b>>."""
    starts = F.regexp_extract_all(col, F.lit(CLOSED_STRETCH), F.lit(1))
    ends = F.regexp_extract_all(col, F.lit(CLOSED_STRETCH), F.lit(2))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def is_international(col: Column) -> Column:
    return col.rlike(INTERNATIONAL)


def severity(closed: Column, international: Column) -> Column:
    """closed beats intl beats reduced."""
    return F.when(closed, "closed").when(international, "intl").otherwise("reduced")


def train_number(short_name: Column, headsign: Column, route_name: Column, trip_id: Column) -> Column:
    """First non-empty of short name, headsign, route name and trip id."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (short_name, headsign, route_name)], trip_id)


# Metropolitan areas whose feeds leave the city out of station names.
CITIES = (
    ("Berlin", 52.52, 13.40), ("Hamburg", 53.55, 10.00), ("München", 48.14, 11.58),
    ("Köln", 50.94, 6.96), ("Frankfurt", 50.11, 8.68), ("Stuttgart", 48.78, 9.18),
    ("Düsseldorf", 51.23, 6.77), ("Leipzig", 51.34, 12.37), ("Dresden", 51.05, 13.74),
    ("Hannover", 52.37, 9.74), ("Nürnberg", 49.45, 11.08), ("Bremen", 53.08, 8.81),
)
CITY_BOX = (0.15, 0.22)


def nearby_city(lat: Column, lon: Column) -> Column:
    """City whose box of half-widths CITY_BOX holds the point; the first listed wins."""
    hits = [
        F.when((F.abs(lat - clat) < CITY_BOX[0]) & (F.abs(lon - clon) < CITY_BOX[1]), F.lit(city))
        for city, clat, clon in CITIES
    ]
    return F.coalesce(*hits)


#: A timetable name's parts: line kind, city letter, head, what follows its comma, what stands in brackets.
NAME_PARTS = r"^(?:(S\+U|S|U)\s+|(D)-)?([^,(]+?)(?:\s*,\s*([^(]+?))?(?:\s*\((.+)\))?(?:\s+S)?$"
# Other ways to write what a name holds; each adds to the spellings found so far.
SPELLINGS = (
    ("Hauptbahnhof", "Hbf"), (r"([Ss])tr\.", "$1traße"), (r"\s(?:Bf|Bhf)$", ""), (r"(?<!aupt)[ -]?[Bb]ahnhof$", ""),
    (r"\s*\(([^)]*)\)\s*", "($1)"), (r"\s*\([^)]*\)\s*", " "),
)


def _respelled(names: Column, pattern: str, out: str) -> Column:
    """The names and what a spelling makes of them. The names are bound once: written out twice, each spelling would double the work."""
    def both(known: Column) -> Column:
        return F.array_union(known, F.transform(F.filter(known, lambda v: v.rlike(pattern)), lambda v: F.regexp_replace(v, pattern, out)))

    return F.transform(F.array(names), both)[0]


def name_variants(name: Column, lat: Column, lon: Column) -> Column:
    """Railway-style spellings of a timetable station name, most literal first (array<string>).

    A name is read once as place and area: the area is what stands before a comma, in brackets with a capital letter, or
    behind a city letter, else the city around the point. Both are put together in either way, and the results respelled.
    """
    line, letter, head, tail, inner = (F.nullif(F.regexp_extract(name, NAME_PARTS, i), F.lit("")) for i in range(1, 6))
    proper = F.when(inner != F.lower(inner), inner)
    place = F.regexp_replace(F.coalesce(tail, head, name), r"\s+Bhf$", "")
    told = F.coalesce(F.when(letter.isNotNull(), F.lit("Düsseldorf")), F.when(tail.isNotNull(), head), proper)
    around = nearby_city(lat, lon)
    area = F.coalesce(told, F.when(~F.contains(F.lower(name), F.lower(around)), around))
    joins = ~F.startswith(F.lower(place), F.lower(area))
    joined = [F.when(joins, F.concat(area, F.lit(glue), place)) for glue in (" ", "-")]
    alone = F.when(line.isNotNull() | tail.isNotNull(), place)
    found = F.filter(F.array(name, alone, *joined), lambda v: v.isNotNull())
    for pattern, out in SPELLINGS:
        found = _respelled(found, pattern, out)
    tidy = F.transform(found, lambda v: F.trim(F.regexp_replace(v, r"\s+", " ")))
    return F.array_distinct(F.filter(tidy, lambda v: v != ""))


def name_similarity(query: Column, candidate: Column) -> Column:
    """1 - edit distance / longer length over compact forms; "Name, City" also read as "City Name"."""
    swapped = F.when(candidate.contains(","), F.regexp_replace(candidate, r"^(.*),\s*([^,]*?)\s*$", "$2 $1"))
    a = norm_compact(query)

    def score(form: Column) -> Column:
        b = norm_compact(form)
        return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))

    return F.greatest(score(candidate), score(swapped))
