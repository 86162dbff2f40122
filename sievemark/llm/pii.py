"""Personal data in whole texts, by DataFrame functions only.

Regular expressions propose spans. Checks confirm them: the Luhn sum for cards,
the remainder by 97 for IBANs, part sizes for IP addresses, digit counts for
phones. Words shortly before a span and after it raise its score; the kinds
that the base rules name stay at any score, the further kinds (``iban``,
``account``) are kept from ``THRESHOLD`` on.

Words are looked for in the ``BEFORE`` characters before a span and the
``AFTER`` behind it, whatever else is matched there. Positions come from the text between matches: ``split`` and
``regexp_extract_all`` walk through a text in the same way, so the running sum
of their lengths is the place of each match, in code points, in linear time.
The patterns are the base rules' with possessive repeats and borders added that
change no match but keep long runs of one kind of character linear.

Each row stands alone: nothing is shuffled. Null texts count as empty, rows
with null keys and repeated rows keep their results, further columns are left
alone whatever their names, and an empty table gives an empty result. Texts of
any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

KINDS = ("email", "ip", "card", "phone", "iban", "account")
BASE = KINDS[:4]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "account": r"(?<![A-Za-z0-9])[0-9]{8,12}(?![A-Za-z0-9])",
}
#: A text without this can't hold the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.7, "account": 0.2}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|telefon|téléphone|teléfono)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "account": r"(?i)\b(?:account|konto|compte|cuenta|passport|ssn|routing)\b",
}
RAISE, THRESHOLD, BEFORE, AFTER = 0.3, 0.5, 40, 20
#: Matches are placed in runs of so many, so that growing arrays are copied seldom.
RUN = 64


def _mod97(value: Column) -> Column:
    """The remainder by 97 of an IBAN without spaces: its first four characters go last, letters count 10 to 35."""
    turned = F.concat(F.substring(value, 5, 64), F.substring(value, 1, 4))
    code = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(code(c) > 9, 100).otherwise(10) + code(c)) % 97))


def confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
        return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        value = F.replace(match, F.lit(" "), F.lit(""))
        return F.length(value).between(15, 34) & (_mod97(value) == 1)
    return F.lit(True)


def _following(matches: Column, gaps: Column, i: Column) -> Column:
    """The text after match i, AFTER characters at least: a gap and the match behind it have two characters or more."""
    short = lambda parts, at: F.left(F.coalesce(F.get(parts, at), F.lit("")), F.lit(AFTER))
    near = F.transform(F.sequence(i + 1, i + AFTER // 2), lambda j: F.concat(short(gaps, j), short(matches, j)))
    return F.when(F.length(F.get(gaps, i + 1)) >= AFTER, F.get(gaps, i + 1)).otherwise(F.array_join(near, ""))


def _placed(kind: str, matches: Column, gaps: Column) -> Column:
    """array<struct<start, end, ok, score>> of all matches, in order."""

    def one(acc: Column, i: Column) -> Column:
        match, gap = F.get(matches, i), F.get(gaps, i)
        start = acc["at"] + F.length(gap)
        end = start + F.length(match)
        before = F.right(F.concat(acc["tail"], F.right(gap, F.lit(BEFORE))), F.lit(BEFORE))
        near = before.rlike(CONTEXT[kind]) | F.left(_following(matches, gaps, i), F.lit(AFTER)).rlike(CONTEXT[kind])
        tail = F.concat(before, F.right(match, F.lit(BEFORE)))
        score = F.lit(SCORES[kind]) + F.when(near, RAISE).otherwise(0.0)
        ok = confirmed(kind, match) if kind in BASE else confirmed(kind, match) & (score >= THRESHOLD)
        span = F.struct(start.alias("start"), end.alias("end"), ok.alias("ok"), score.alias("score"))
        return F.struct(end.alias("at"), tail.alias("tail"), F.concat(acc["out"], F.array(span)).alias("out"))

    def run(acc: Column, r: Column) -> Column:
        own = F.aggregate(F.sequence(r * RUN, F.least(r * RUN + RUN, F.size(matches)) - 1), F.struct(acc["at"].alias("at"), acc["tail"].alias("tail"), empty.alias("out")), one)
        return F.struct(own["at"].alias("at"), own["tail"].alias("tail"), F.concat(acc["out"], F.array(own["out"])).alias("out"))

    span_type = "struct<start:int,end:int,ok:boolean,score:double>"
    empty = F.array().cast(f"array<{span_type}>")
    runs = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / RUN).cast("int"))
    all_runs = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(f"array<array<{span_type}>>").alias("out")), run)["out"]
    return F.when(F.size(matches) > 0, F.flatten(all_runs)).otherwise(empty)


def _free(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while any(n in taken for n in names):
        names = tuple("_" + n for n in names)
    return list(names)


def _matched(df: DataFrame, kind: str, text: str, m: str, g: str) -> DataFrame:
    """Adds the columns m (matches) and g (the text before, between and after them)."""
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(F.col(text), F.lit(PATTERNS[kind]), F.lit(0))
    if kind in NEEDS:
        found = F.when(F.contains(F.col(text), F.lit(NEEDS[kind])), found).otherwise(none)
    df = df.withColumn(m, found)
    return df.withColumn(g, F.when(F.size(m) > 0, F.split(F.col(text), PATTERNS[kind], -1)).otherwise(none))


def find(df: DataFrame, text: str = "text", prefix: str = "pii_") -> DataFrame:
    """df with a column for each kind: array<struct<start,end,ok,score>> in code points, end exclusive, confirmed spans only."""
    m, g = _free(df, "_m", "_g")
    for kind in KINDS:
        df = _matched(df, kind, text, m, g)
        df = df.withColumn(prefix + kind, F.filter(_placed(kind, F.col(m), F.col(g)), lambda s: s["ok"])).drop(m, g)
    return df


def masked(df: DataFrame, text: str = "text") -> DataFrame:
    """df with confirmed spans of its text replaced by their kind in brackets, kind after kind; a null text stays null."""
    m, g, s = _free(df, "_m", "_g", "_s")

    def filled(kind: str) -> Column:
        tag = F.lit(f"[{kind.upper()}]")
        return F.transform(F.col(g), lambda gap, i: F.concat(gap, F.when(F.get(F.col(s), i)["ok"], tag).otherwise(F.coalesce(F.get(F.col(m), i), F.lit("")))))

    for kind in KINDS:
        df = _matched(df, kind, text, m, g)
        df = df.withColumn(s, _placed(kind, F.col(m), F.col(g)))
        df = df.withColumn(text, F.when(F.exists(s, lambda x: x["ok"]), F.array_join(filled(kind), "")).otherwise(F.col(text))).drop(m, g, s)
    return df


def listed(prefix: str, kinds: tuple[str, ...]) -> Column:
    def of(kind: str) -> Column:
        return F.transform(F.col(prefix + kind), lambda s: F.concat(F.lit(kind + ":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(of, kinds)), ",")


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: counts of the base kinds, base_sha256, spans and the highest score."""
    found = find(docs.select(F.col(key), text_or_empty(text).alias("t")), "t")
    counts = [F.size("pii_" + kind).cast("long").alias("n_" + kind) for kind in KINDS]
    scores = F.concat(*(F.transform(F.col("pii_" + kind), lambda s: s["score"]) for kind in KINDS))
    out = found.select(key, *counts, listed("pii_", BASE).alias("base"), listed("pii_", KINDS).alias("spans"), F.round(F.array_max(scores), 2).alias("max_score"))
    return out.select(key, *("n_" + kind for kind in BASE), F.sha2("base", 256).alias("base_sha256"), "spans", "n_iban", "n_account", "max_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
