"""Street, address and query normalisation, and string similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words the canonical street form strips, abbreviations the
# query form expands, words that never count as shared, query patterns.
DIRECTIONALS = [
    "n", "s", "e", "w", "ne", "nw", "se", "sw",
    "north", "south", "east", "west",
    "northeast", "northwest", "southeast", "southwest",
]
SUFFIXES = [
    "st", "street", "ave", "av", "avenue", "blvd", "boulevard", "rd", "road",
    "dr", "drive", "ln", "lane", "ct", "court", "pl", "place", "pkwy", "parkway",
    "hwy", "highway", "expy", "expressway", "ter", "terrace", "way", "cir", "circle",
    "sq", "square", "plz", "plaza", "pt", "point", "row",
]
ABBREVIATIONS = {
    "blvd": "boulevard", "pkwy": "parkway", "expy": "expressway", "terr": "terrace",
    "ter": "terrace", "hwy": "highway", "ave": "avenue", "cir": "circle", "st": "street",
    "dr": "drive", "ln": "lane", "ct": "court", "rd": "road", "pl": "place", "sq": "square",
}
STOP_WORDS = ["the", "of", "a", "an", "and", "at", "in", "on", "chicago"]
PUNCTUATION = r"""[.,;:'"()]"""
CROSS_PREFIX = r"(?i)^(?:the\s+)?(?:intersection|corner)\s+of\s+"
CROSS_SEPARATOR = r"(?i)(?:\s+(?:and|&|@|at|x)\s+|\s*[/\\]\s*)"
COORDINATE_PAIR = r"^\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*$"
SIMILARITY_FLOOR = 0.95

_DIR = "|".join(DIRECTIONALS)
_SUF = "|".join(SUFFIXES)


def squash(raw: Column) -> Column:
    """Lower case, punctuation and runs of white space to one blank, trimmed."""
    s = F.regexp_replace(F.lower(raw), PUNCTUATION, " ")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def street_name(raw: Column) -> Column:
    """`N Clark St` -> `clark`; never empties a one-word name."""
    s = F.regexp_replace(squash(raw), f"^(?:{_DIR}) (.+)$", "$1")
    return F.regexp_replace(s, f"^(.+) (?:{_SUF})$", "$1")


def address(raw: Column) -> Column:
    """`1234 N Clark St` -> `1234 clark`; the house number stays in front."""
    s = squash(raw)
    house = F.regexp_extract(s, r"^(\d\S*)", 1)
    rest = F.ltrim(F.regexp_replace(s, r"^\d\S*", ""))
    rest = F.regexp_replace(rest, f"^(?:{_DIR})(?: |$)", "")
    rest = F.regexp_replace(rest, f"^(.+) (?:{_SUF})$", "$1")
    return F.trim(F.concat(house, F.lit(" "), rest))


def has_house_number(normalised: Column) -> Column:
    return normalised.rlike(r"^\d")


def expand_suffixes(query: Column) -> Column:
    """Expand street abbreviations at the end of the query or before a comma."""
    for short, full in ABBREVIATIONS.items():
        query = F.regexp_replace(query, rf"\b{short}\b(\s*(?:,|$))", f"{full}$1")
    return query


def cross_street(query: Column) -> Column:
    """Ordered struct (a, b) of two canonical names, or null."""
    s = F.regexp_replace(F.trim(query), CROSS_PREFIX, "")
    parts = F.split(s, CROSS_SEPARATOR, 2)
    a, b = street_name(parts[0]), street_name(F.try_element_at(parts, F.lit(2)))
    ok = (F.size(parts) == 2) & (a != "") & (b != "") & (a != b)
    return F.when(ok, F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))


def coordinate_pair(query: Column) -> Column:
    """Struct (lat, lon) of a `lat, lon` text, or null."""
    part = lambda i: F.regexp_extract(query, COORDINATE_PAIR, i).try_cast("double")
    return F.when(
        query.rlike(COORDINATE_PAIR), F.struct(part(1).alias("lat"), part(2).alias("lon"))
    )


def meaningful_words(text: Column) -> Column:
    words = F.array_distinct(F.split(text, r"\s+"))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_remove(F.array_except(words, stop), "")


def grams(text: Column, q: int = 4) -> Column:
    """Distinct q-grams; a shorter text is its own only gram."""
    many = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text) - (q - 1), F.lit(1))),
        lambda i: F.substring(text, i, F.lit(q)),
    )
    return F.array_distinct(many)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.levenshtein(a, b) / longest
    )


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio 2M/T; run only on pairs that passed the edit bound."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def edit_bound(a: Column, b: Column, floor: float = SIMILARITY_FLOOR) -> Column:
    """Necessary for ratio >= floor: 2M <= T - edits, so edits <= (1 - floor) T."""
    return F.levenshtein(a, b) <= F.floor(
        (F.length(a) + F.length(b)) * F.lit(1.0 - floor) + F.lit(1e-9)
    )


def query_tag(query: Column) -> Column:
    """Hashed stand-in for a query text in logs."""
    tag = F.concat(F.lit("q#"), F.substring(F.sha2(query, 256), 1, 10))
    return F.when(F.coalesce(query, F.lit("")) == "", F.lit("<empty>")).otherwise(tag)


def coarse_coordinate(lat: Column, lon: Column) -> Column:
    """Two-decimal coordinate for logs."""
    text = F.format_string("(%.2f, %.2f)", lat, lon)
    return F.when(lat.isNull() | lon.isNull(), F.lit("(?, ?)")).otherwise(text)


def title_case(text: Column) -> Column:
    """Capital after every non-letter, small letters elsewhere."""
    chars = F.transform(
        F.sequence(F.lit(1), F.length(text)),
        lambda i: F.when(
            (i == 1) | ~F.substring(text, i - 1, F.lit(1)).rlike(r"\p{L}"),
            F.upper(F.substring(text, i, F.lit(1))),
        ).otherwise(F.lower(F.substring(text, i, F.lit(1)))),
    )
    return F.when(F.length(text) == 0, "").otherwise(F.array_join(chars, ""))
