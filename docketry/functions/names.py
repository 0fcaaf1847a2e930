"""Normalisation of organisation names, as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Legal suffixes, abbreviations, words that acronyms leave out.
LEGAL_SUFFIXES = ("LLC", "LLP", "LP", "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LIMITED", "PLC")
ABBREVIATIONS = {"UNIV": "UNIVERSITY", "CTR": "CENTER", "SVCS": "SERVICES", "SVC": "SERVICE", "TECH": "TECHNOLOGY", "TECHNOLOGIES": "TECHNOLOGY", "CORP": "CORPORATION", "CO": "COMPANY", "INCORPORATED": "INC", "LTD": "LIMITED"}
STOPWORDS = ("OF", "AND", "THE")
#: Codes of states and territories by name.
STATES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO", "CONNECTICUT": "CT", "DELAWARE": "DE", "DISTRICT OF COLUMBIA": "DC", "FLORIDA": "FL",
    "GEORGIA": "GA", "GUAM": "GU", "HAWAII": "HI", "IDAHO": "ID", "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA", "MAINE": "ME", "MARYLAND": "MD",
    "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS", "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ",
    "NEW MEXICO": "NM", "NEW YORK": "NY", "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "NORTHERN MARIANA ISLANDS": "MP", "OHIO": "OH", "OKLAHOMA": "OK", "OREGON": "OR", "PENNSYLVANIA": "PA",
    "PUERTO RICO": "PR", "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC", "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA", "VIRGIN ISLANDS": "VI",
    "WASHINGTON": "WA", "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY",
}


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


@F.pandas_udf(T.StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


@F.pandas_udf(T.StringType())
def _compatible(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def _beyond_ascii(c: Column, udf, plain: Column) -> Column:
    """A Unicode function that ASCII has a built-in for: only other texts are sent to Python."""
    return F.coalesce(udf(F.when(c.rlike(r"[^\x00-\x7F]"), c)), plain)


def fold(c: Column) -> Column:
    """NFKD without combining marks; there is no built-in for it.  Apply to distinct values."""
    return _beyond_ascii(c, _fold, c)


def casefold(c: Column) -> Column:
    return _beyond_ascii(c, _casefold, F.lower(c))


def evidence_text(c: Column) -> Column:
    """NFKC, straight quotes, one space between words, case folded."""
    straight = F.translate(_beyond_ascii(c, _compatible, c), "‘’“”", "''\"\"")
    return casefold(F.trim(F.regexp_replace(straight, r"(?U)[\s\x1c-\x1f]+", " ")))


def normalize_state(c: Column) -> Column:
    """The code that a value is, the state it names or, of those whose name it begins with, the longest; else empty."""
    compact = F.regexp_replace(F.upper(fold(F.coalesce(c, F.lit("")))), "[^A-Z0-9]+", "")
    out = F.lit("")
    for name in sorted(STATES, key=lambda x: len(x.replace(" ", ""))):  # the last that fits is the longest
        out = F.when(compact.startswith(name.replace(" ", "")), STATES[name]).otherwise(out)
    return F.when(compact.isin(*STATES.values()), compact).otherwise(out)


def normalize_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(fold(F.coalesce(c, F.lit("")))), "[^A-Z0-9]+", " "))


def stable_identity(c: Column, postal: bool = False) -> Column:
    """What two spellings of one employer share: a broken ö mended, five signs dropped, white space squeezed, case folded.

    A postal code of four digits has lost its leading zero.
    """
    mended = F.translate(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("\u00c3\u00b6"), F.lit("\u00f6")), "\ufffd\u2013\u201c\u2019\u00bf", "")
    out = casefold(F.trim(F.regexp_replace(mended, r"(?U)[\s\x1c-\x1f]+", " ")))
    return F.when(out.rlike("^[0-9]{4}$"), F.concat(F.lit("0"), out)).otherwise(out) if postal else out


def normalize_name(c: Column) -> Column:
    """Folded, upper case, & as AND, other signs as spaces, abbreviations spelled out."""
    plain = F.regexp_replace(F.replace(F.upper(fold(F.coalesce(c, F.lit("")))), F.lit("&"), F.lit(" AND ")), "[^A-Z0-9]+", " ")
    table = F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv))
    return F.array_join(F.transform(F.filter(F.split(plain, " "), lambda x: x != ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), " ")


def core_name(normalized: Column) -> Column:
    """Without trailing legal suffixes, however many, and without a leading THE."""
    return F.regexp_replace(F.regexp_replace(normalized, f"(^| )(({'|'.join(LEGAL_SUFFIXES)})( |$))+$", ""), "^THE ", "")


def legal_suffix(normalized: Column) -> Column:
    last = F.coalesce(F.try_element_at(F.split(normalized, " "), F.lit(-1)), F.lit(""))
    return F.when(last.isin(*LEGAL_SUFFIXES), last).otherwise("")


def acronym(normalized: Column) -> Column:
    words = F.filter(F.split(normalized, " "), lambda x: (x != "") & ~x.isin(*STOPWORDS) & ~x.rlike("^[0-9]+$"))
    return F.array_join(F.transform(words, lambda x: F.substring(x, 1, 1)), "")
