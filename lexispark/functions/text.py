"""Column functions with the text semantics of the reference data model: Unicode white space, words, letters."""

from __future__ import annotations

import html
import html.entities
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode white space, with the separators U+001C to U+001F and U+0085 that Java's class leaves out.
SPACE = r"\s\x1c-\x1f\x85"
#: The 32 ASCII punctuation marks as a regex class.
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)[{SPACE}]+", " ")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^[{SPACE}]+|[{SPACE}]+$", "")


def normalize_space(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(collapse_space(text))


def split_words(text: Column) -> Column:
    """Words between white space; an empty text has none."""
    return F.filter(F.split(text, f"(?U)[{SPACE}]+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"(?U)[^{SPACE}]+"))


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"(?U)[^{SPACE}]")


def plain_words(text: Column, lowercase: bool = True) -> Column:
    """Words after lower-casing and deleting ASCII punctuation: ``Don't`` becomes ``dont``."""
    return split_words(F.regexp_replace(F.lower(text) if lowercase else text, PUNCTUATION, ""))


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


#: A character reference with its semicolon.
_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _closed_reference(found: re.Match) -> str:
    known = found[0][1] == "#" or found[0][1:] in html.entities.html5
    return html.unescape(found[0]) if known else found[0]


@F.pandas_udf(T.StringType())
def _unescape_closed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _CLOSED.sub(_closed_reference, t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Unicode NFC; only texts beyond ASCII visit Python."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def unescape(text: Column, closed: bool = False) -> Column:
    """One pass of HTML unescaping; only texts with an ampersand visit Python.  ``closed``: references cut off before their semicolon stay."""
    return F.coalesce((_unescape_closed if closed else _unescape)(F.when(text.contains("&"), text)), text)


def strip_tags(text: Column, closed: bool = False) -> Column:
    """Unescape once, then put one blank for every tag, so that escaped tags go too."""
    return F.regexp_replace(unescape(text, closed), "<[^>]+>", " ")


def truncate_keeping_last(ids: Column, most: int) -> Column:
    """At most ``most`` ids: the first ones and the very last."""
    return F.when(F.size(ids) > most, F.concat(F.slice(ids, 1, most - 1), F.slice(ids, -1, 1))).otherwise(ids)


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` words, joined by a blank."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(
        F.array().cast("array<string>")
    )


def shortened(text: Column, most: int = 60) -> Column:
    """At most ``most`` characters, the last three of them dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)
