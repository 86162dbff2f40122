"""What needs Unicode tables that the JVM functions don't expose: Arrow functions over short or rare values."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packs import CONFUSABLES

HIDDEN = "[\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff]"
_TABLE = str.maketrans(CONFUSABLES)
_LETTERS = re.compile(r"[^\W\d_]+")


def fold_word(word: str) -> str:
    """Latin spelling of a word that mixes Latin with look-alike letters; others stay."""
    if word.isascii() or not re.search("[A-Za-z]", word):
        return word
    return word.translate(_TABLE)


def plain(value: str) -> str:
    """NFKC without invisible characters, mixed words folded."""
    value = re.sub(HIDDEN, "", unicodedata.normalize("NFKC", value))
    return _LETTERS.sub(lambda m: fold_word(m.group()), value)


_SPACED = re.compile(r"(?<![A-Za-z])(?:[A-Za-z] ){3,}[A-Za-z](?![A-Za-z])")


def normalized(value: str) -> str:
    """Text as the wording rules read it: plain, letters set apart drawn together, blanks single, dots inside words gone."""
    value = _SPACED.sub(lambda m: m.group().replace(" ", ""), value if value.isascii() else plain(value))
    return re.sub(r"(?<=\w)[._](?=\w)", "", re.sub("[ \t]{2,}", " ", value))


def normalized_column(value: Column) -> Column:
    return _normalized(value)


@F.pandas_udf(T.StringType())
def _normalized(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else normalized(v))


@F.pandas_udf(T.StructType([T.StructField("decoded", T.StringType()), T.StructField("folded", T.StringType())]))
def _host_names(hosts: pd.Series) -> pd.DataFrame:
    rows = []
    for host in hosts:
        if host is None:
            rows.append((None, None))
            continue
        try:
            decoded = host.encode("ascii").decode("idna")
        except UnicodeError:
            decoded = host
        rows.append((decoded, unicodedata.normalize("NFKD", decoded.casefold()).translate(_TABLE)))
    return pd.DataFrame(rows, columns=["decoded", "folded"])


def host_names(host: Column) -> Column:
    """struct<decoded, folded>: the host in Unicode, and its look-alike spelling; plain ASCII hosts stay in the JVM."""
    rare = F.contains(host, F.lit("xn--")) | ~host.rlike(r"^\p{ASCII}*$")
    seen = _host_names(F.when(rare, host))
    return F.struct(F.when(rare, seen["decoded"]).otherwise(host).alias("decoded"), F.when(rare, seen["folded"]).otherwise(F.lower(host)).alias("folded"))


@F.pandas_udf(T.StringType())
def _idna(hosts: pd.Series) -> pd.Series:
    def code(host: str | None) -> str | None:
        try:
            return None if host is None else host.encode("idna").decode("ascii")
        except UnicodeError:
            return host

    return hosts.map(code)


def idna(host: Column) -> Column:
    rare = ~host.rlike(r"^\p{ASCII}*$")
    return F.when(rare, _idna(F.when(rare, host))).otherwise(host)


@F.pandas_udf(T.StringType())
def casefolded(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else v.casefold())


@F.pandas_udf(T.StringType())
def unescaped(values: pd.Series) -> pd.Series:
    """HTML entities decoded."""
    return values.map(lambda v: None if v is None else html.unescape(v))


@F.pandas_udf(T.ArrayType(T.StringType()))
def unescaped_each(values: pd.Series) -> pd.Series:
    """HTML entities decoded in each string of an array."""
    return values.map(lambda v: None if v is None else [None if x is None else html.unescape(x) for x in v])


def scripts(value: Column) -> Column:
    """Sorted names of the writing systems of a value's letters."""
    names = {
        "ARABIC": "IsArabic", "ARMENIAN": "IsArmenian", "CJK": "IsHan", "CYRILLIC": "IsCyrillic", "GEORGIAN": "IsGeorgian", "GREEK": "IsGreek",
        "HANGUL": "IsHangul", "HEBREW": "IsHebrew", "HIRAGANA": "IsHiragana", "KATAKANA": "IsKatakana", "LATIN": "IsLatin",
    }
    return F.filter(F.array(*(F.when(value.rlike(rf"[\p{{L}}&&\p{{{script}}}]"), name) for name, script in names.items())), lambda x: x.isNotNull())


def controls(value: Column) -> Column:
    """``U+XXXX`` of each format or control character."""
    return F.transform(F.regexp_extract_all(value, F.lit(r"[\p{Cf}\p{Cc}]"), F.lit(0)), lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), 4, "0")))
