"""Links in text, also behind percent and script escapes and base64, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import percent_decoded

#: A web link, marks that end a sentence rather than a link, a run that may be base64, and escapes of scripts.
WEB = r"(?iU)\bhttps?://[^\s<>\"']+"
TRAILING = ".,;:!?)]}>'\""
TOKEN = r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,4096}={0,2}(?![A-Za-z0-9_+/=-])"
ESCAPE = r"\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}"
MAX_TOKENS, MAX_CANDIDATES, PERCENT_LAYERS = 100, 500, 3
NONE = "array<string>"


def web_links(text: Column) -> Column:
    """The web links of a text, in order, without the marks behind them."""
    return F.transform(F.regexp_extract_all(text, F.lit(WEB), F.lit(0)), lambda m: F.rtrim(m, F.lit(TRAILING)))


def script_decoded(text: Column) -> Column:
    """Backslash escapes of scripts undone: the text between them, and each by its code unit; halves of pairs are replaced."""
    between, escapes = F.split(text, ESCAPE, -1), F.regexp_extract_all(text, F.lit(ESCAPE), F.lit(0))
    unit = lambda e: F.when(e.rlike(r"^\\u[dD][89a-fA-F]"), "\ufffd").otherwise(F.decode(F.unhex(F.lpad(F.substring(e, 3, 4), 4, "0")), "UTF-16BE"))
    return F.array_join(F.zip_with(between, F.transform(escapes, unit), lambda b, c: F.concat(b, F.coalesce(c, F.lit("")))), "")


def base64_texts(text: Column) -> Column:
    """array<string>: what runs of base64, of either alphabet, say as UTF-8."""

    def read(token: Column) -> Column:
        plain = F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")
        padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
        held = F.try_to_binary(padded, F.lit("base64")).cast("string")
        return F.when(F.is_valid_utf8(held), held)

    tokens = F.slice(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), 1, MAX_TOKENS)
    return F.filter(F.transform(tokens, read), lambda x: x.isNotNull())


def layered_links(plain: Column) -> Column:
    """Links of a text without entities, of up to three percent-decoded layers below it, and of it without script escapes."""
    layers = [plain]
    for _ in range(PERCENT_LAYERS):
        layers.append(F.when(F.contains(layers[-1], F.lit("%")), percent_decoded(layers[-1])))
    layers.append(F.when(F.contains(plain, F.lit("\\")), script_decoded(plain)))
    return F.concat(*(F.coalesce(web_links(x), F.array().cast(NONE)) for x in layers))


def one_spelling(links: Column, most: int) -> Column:
    """The first spelling of each web link, in order, at most so many."""
    clean = F.filter(F.transform(links, lambda u: F.rtrim(F.replace(u, F.lit("&amp;"), F.lit("&")), F.lit(TRAILING))), lambda u: F.lower(F.left(u, F.lit(8))).rlike("^https?://"))
    # both arrays are arguments of the lambda's struct: computed once
    both = F.array(F.struct(clean.alias("as_is"), F.transform(clean, F.lower).alias("folded")))
    first = lambda b: F.transform(F.slice(F.array_distinct(b["folded"]), 1, most), lambda f: F.get(b["as_is"], F.array_position(b["folded"], f).cast("int") - 1))
    return F.get(F.transform(both, first), F.lit(0))
