"""Wording rules, tactics, indicators, languages and regions as columns.

A pack is matched by its literals first (``literals``): an automaton names the
rules that may hold, and only their patterns are tried. Rules keep their order
and findings never leave their row: nothing is shuffled or joined.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import literals
from .base import FINDINGS, finding, found, redacted, settled, without_call_sites
from .literals import candidates, required
from .packs import CONTENT_RULES, GENERIC_RULES, LANGUAGE_MARKERS, LANGUAGES, NEGATIONS, REGIONS, SCRIPT_HINTS, TACTIC_RULES

#: Characters of a message that rules read, before a match that negation reads, and of a match that is shown.
RULE_CHARS, NEGATION_CHARS, SHOWN = 250_000, 55, 160
FLAGS = "(?isU)"
NEGATION = FLAGS + "|".join(f"(?:{p})" for p in NEGATIONS)
CATEGORY_SCORES = "array<struct<category:string,points:int>>"


def ruled(text: Column) -> Column:
    return F.left(text, F.lit(RULE_CHARS))


def with_hits(df: DataFrame, text: str, rules: list[tuple], schema: str, into: str, shown: int, negatable: bool = True) -> DataFrame:
    """df with an array of the rules (fields of schema, pattern last) that hold, each with its match as evidence, but for negated ones.

    A match is negated where a negation stands shortly before it.
    """
    found = candidates(F.col(text), rules, [required(r[-1]) for r in rules], schema)
    # a column of its own: inside lambdas it would be computed for every element
    df = df.withColumn("_may", found)
    value, pattern = F.col(text), lambda r: F.concat(F.lit(FLAGS), r["pattern"])
    matched = F.filter(F.transform("_may", lambda r: F.struct(r.alias("rule"), F.regexp_substr(value, pattern(r)).alias("match"))), lambda m: m["match"].isNotNull())
    df = df.withColumn("_held", matched)
    kept = F.col("_held")
    if negatable:
        before = lambda m: F.right(F.split(value, pattern(m["rule"]), 2)[0], F.lit(NEGATION_CHARS))
        kept = F.filter(kept, lambda m: ~before(m).rlike(NEGATION))
    return df.withColumn(into, F.transform(kept, lambda m: m["rule"].dropFields("pattern").withField("evidence", F.left(m["match"], F.lit(shown))))).drop("_may", "_held")


def with_rules(df: DataFrame, text: str, into: str = "_rules", rules: tuple = CONTENT_RULES) -> DataFrame:
    """df with array<struct<rule_id, category, language, title, points, regions, evidence>> of content rules that hold, in the pack's order."""
    return with_hits(df, text, rules, "rule_id string, category string, language string, title string, points int, regions array<string>, pattern string", into, SHOWN)


def load_rules(spark, path: str) -> tuple:
    """Content rules from a JSON list of objects, wherever Spark reads; what is wrong with them is an error."""
    held = spark.read.option("multiLine", "true").schema("rule_id string, category string, language string, title string, points int, regions array<string>, pattern string").json(path)
    rules = tuple((r.rule_id, r.category, r.language, r.title, r.points or 0, tuple(r.regions or ()), r.pattern or "(") for r in held.orderBy("rule_id").collect())  # a pack is a few hundred rules
    if problems := _problems(rules, 40):
        raise ValueError("; ".join(problems))
    return rules


def once(rules: Column) -> Column:
    """Of rules with the same category and title the first."""
    return F.filter(rules, lambda r, i: ~F.exists(F.slice(rules, F.lit(1), i), lambda o: (o["category"] == r["category"]) & (o["title"] == r["title"])))


def content_findings(rules: Column) -> Column:
    """Findings of matched rules (once)."""
    return F.transform(
        rules,
        lambda r: F.struct(
            F.lit("CONTENT_PATTERN").alias("code"), r["title"].alias("title"), F.when(r["points"] < 25, "medium").otherwise("high").alias("severity"), r["points"].cast("int").alias("points"),
            r["evidence"].alias("evidence"), F.concat(F.lit("content:"), r["language"], F.lit(":"), r["rule_id"]).alias("source"), F.lit("observed").alias("status"),
        ),
    ).cast(FINDINGS)


def with_generic(df: DataFrame, text: str, into: str = "_generic") -> DataFrame:
    df = with_hits(df, text, GENERIC_RULES, "title string, points int, pattern string", "_held_generic", SHOWN)
    made = F.transform("_held_generic", lambda r: F.struct(F.lit("SOCIAL_ENGINEERING").alias("code"), r["title"].alias("title"), F.lit("low").alias("severity"), r["points"].alias("points"), r["evidence"].alias("evidence"), F.lit("content").alias("source"), F.lit("observed").alias("status")))
    return df.withColumn(into, made.cast(FINDINGS)).drop("_held_generic")


def category_points(entries: Column) -> Column:
    """Sums by category, in the order in which categories first come; entries: array<struct<category, points>>."""
    names = F.array_distinct(F.transform(entries, lambda e: e["category"]))
    total = lambda name: F.aggregate(entries, F.lit(0), lambda acc, e: acc + F.when(e["category"] == name, e["points"]).otherwise(0))
    return F.transform(names, lambda n: F.struct(n.alias("category"), total(n).alias("points"))).cast(CATEGORY_SCORES)


def strongest(scores: Column) -> Column:
    """The category with the most points, the first of equals."""
    top = F.array_max(F.transform(scores, lambda s: s["points"]))
    return F.coalesce(F.get(F.filter(scores, lambda s: s["points"] == top), F.lit(0))["category"], F.lit("Pattern undetermined"))


def with_tactics(df: DataFrame, text: str, into: str = "_tactics") -> DataFrame:
    """df with array<struct<rule_id, category, title, points, mapping, evidence>> of tactic rules, on raw text, without negation."""
    return with_hits(df, text, TACTIC_RULES, "rule_id string, category string, title string, points int, mapping string, pattern string", into, 180, negatable=False)


def tactic_findings(hits: Column) -> Column:
    return F.transform(
        hits,
        lambda r: F.struct(
            F.lit("ADVANCED_TACTIC").alias("code"), r["title"].alias("title"), F.when(r["points"] >= 30, "high").otherwise("medium").alias("severity"), r["points"].cast("int").alias("points"),
            r["evidence"].alias("evidence"), F.concat(F.lit("advanced:"), r["rule_id"]).alias("source"), F.lit("observed").alias("status"),
        ),
    ).cast(FINDINGS)


#: Patterns of payment and contact data, by kind.
INDICATORS = (
    ("phone", r"(?U)(?<!\w)(?:\+?\d[\d ().-]{6,}\d)(?!\w)"),
    ("bitcoin_wallet", r"(?<![A-Za-z0-9])(?:bc1[ac-hj-np-z02-9]{25,62}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})(?![A-Za-z0-9])"),
    ("ethereum_wallet", r"(?<![A-Fa-f0-9])0x[A-Fa-f0-9]{40}(?![A-Fa-f0-9])"),
    ("tron_wallet", r"(?<![A-Za-z0-9])T[A-HJ-NP-Za-km-z1-9]{33}(?![A-Za-z0-9])"),
    ("iban", r"(?i)(?<![A-Z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Z0-9])"),
    ("upi_id", r"(?iU)(?<![\w.-])[\w.-]{2,}@(?:upi|paytm|ybl|okaxis|oksbi|okhdfcbank|ibl)(?!\w)"),
)
MOST_INDICATORS = 50
#: Words that make a phone number a callback lure, and payment data a diversion.
CALLBACK = r"(?i)\b(invoice|subscription|renewal|refund|charge|purchase|security alert|virus|fraud)\b"
CALL = r"(?i)\b(call|phone|dial|contact support|hotline)\b"
PAYMENT = r"(?i)\b(pay|payment|transfer|send|deposit|refund|fee|wallet|beneficiary|bank details|gift card|crypto|bitcoin|usdt)\b"


def indicators(text: Column, most: int | None = MOST_INDICATORS) -> Column:
    """array<struct<type, masked, sha256_prefix>>: distinct values, masked and hashed, in order of kind and place; at most so many, None for all."""
    kinds = []
    for kind, pattern in INDICATORS:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        if kind == "phone":
            values = F.filter(values, lambda v: F.length(F.regexp_replace(v, r"(?U)\D", "")).between(7, 16))
        kinds.append(_masked(kind, values))
    every = F.array_distinct(F.concat(*kinds))
    return every if most is None else F.slice(every, 1, most)


def _masked(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: redacted(kind, v))


def callback(text: Column, seen: Column) -> Column:
    return F.exists(seen, lambda i: i["type"] == "phone") & text.rlike(CALLBACK) & text.rlike(CALL)


def payment(text: Column, seen: Column) -> Column:
    return F.exists(seen, lambda i: i["type"] != "phone") & text.rlike(PAYMENT)


#: Code, title, points and pattern of active or hidden HTML.
HTML_CHECKS = (
    ("HTML_SMUGGLING", "HTML contains client-side payload construction or download behavior", 38, r"data:(?:text/html|application/octet-stream)[^,]{0,120};base64|\b(?:atob|createObjectURL|Uint8Array|new\s+Blob)\s*\(|<a\b[^>]*\bdownload\s*="),
    ("HTML_CREDENTIAL_FORM", "Email HTML contains a password or credential input", 32, r"<input\b[^>]*\btype\s*=\s*['\"]?(?:password|email)['\"]?"),
    ("HTML_SCRIPT_OBFUSCATION", "Email HTML contains script-obfuscation markers", 28, r"\b(?:eval|unescape|fromCharCode)\s*\(|\\x[0-9a-f]{2}(?:\\x[0-9a-f]{2}){3,}|\\u[0-9a-f]{4}(?:\\u[0-9a-f]{4}){3,}"),
    ("HTML_HIDDEN_CONTENT", "Email HTML hides content from normal display", 12, r"(?:display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?:[;\s]|$)|font-size\s*:\s*0)"),
    ("UNSAFE_URI_SCHEME", "Email HTML uses an unsafe or opaque URI scheme", 30, r"(?:href|src|action)\s*=\s*['\"]\s*(?:javascript:|data:text/html|blob:|file:)"),
    ("HTML_FORCED_NAVIGATION", "Email HTML contains client-side forced navigation", 28, r"\b(?:window\.)?location(?:\.href|\.replace|\.assign)?\s*(?:=|\()|window\.open\s*\("),
)


def html_findings(plain_html: Column) -> Column:
    """Findings in HTML whose entities are decoded."""
    clean = F.regexp_replace(plain_html, r"[\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff]", "")
    made = []
    for code, title, points, pattern in HTML_CHECKS:
        hit = F.regexp_substr(clean, F.lit("(?is)" + pattern))
        made.append(finding(hit.isNotNull(), code, title, "high" if points >= 28 else "medium", points, F.left(hit, F.lit(180)), "advanced:html"))
    return found(*made)


def corroboration(findings: Column) -> Column:
    """The finding that three or more tactics of at least 20 points support one another, or null."""
    strong = F.filter(findings, lambda f: f["points"] >= 20)
    sources = F.array_sort(F.array_distinct(F.transform(strong, lambda f: F.element_at(F.split(f["source"], ":", 2), -1))))
    return finding(F.size(sources) >= 3, "MULTI_TACTIC_CORROBORATION", "Multiple advanced phishing tactics corroborate one another", "high", 14, F.array_join(sources, ", "), "advanced:correlation")


def _marker(code: str, marker: str) -> tuple[str, str | None]:
    """code, and the pattern of a marker that counts as a whole word only."""
    word = marker.casefold().strip()
    return code, rf"(?iU)(?<!\w){re.escape(word)}(?!\w)" if re.fullmatch(r"[a-zà-öø-ÿ' -]+", word) else None


def with_language_scores(df: DataFrame, folded: str, text: str, into: str = "_spoken") -> DataFrame:
    """df with array<struct<code, score>> of languages with evidence, in the pack's order; folded: the text casefolded."""
    markers = [(c, m) for c, own in LANGUAGE_MARKERS.items() for m in own]
    seen = candidates(F.col(folded), [_marker(*m) for m in markers], [frozenset([literals.folded(m.casefold().strip())]) for _, m in markers], "code string, pattern string")
    df = df.withColumn("_marked", seen)
    held = F.filter("_marked", lambda m: m["pattern"].isNull() | F.rlike(F.col(folded), m["pattern"]))
    df = df.withColumn("_words", F.transform(held, lambda m: m["code"])).drop("_marked")
    hint = lambda code: F.when(F.col(text).rlike(SCRIPT_HINTS[code]), 2).otherwise(0) if code in SCRIPT_HINTS else F.lit(0)
    # most texts are ASCII, and scripts' hints can't be there
    hints = F.array(*(hint(c) for c in LANGUAGE_MARKERS))
    none = F.array_repeat(F.lit(0), len(LANGUAGE_MARKERS))
    df = df.withColumn("_hints", F.when(F.col(text).rlike(r"^\p{ASCII}*$"), none).otherwise(hints))
    codes = F.array(*map(F.lit, LANGUAGE_MARKERS))
    counted = F.zip_with(codes, "_hints", lambda c, h: F.struct(c.alias("code"), (F.size(F.filter("_words", lambda w: w == c)) + h).alias("score")))
    df = df.withColumn("_counts", counted).drop("_words", "_hints")
    places = list(LANGUAGE_MARKERS)
    of = lambda code: F.get(F.col("_counts"), F.lit(places.index(code)))["score"]
    han = F.col(text).rlike("[\u3400-\u9fff]") & (of("zh-Hans") == 0) & (of("zh-Hant") == 0)
    arabic = F.col(text).rlike("[\u0600-\u06ff]") & (of("ar") == 0) & (of("ur") == 0)
    guessed = F.transform("_counts", lambda x: F.when(((x["code"] == "zh-Hans") & han) | ((x["code"] == "ar") & arabic), x.withField("score", F.lit(1))).otherwise(x))
    return df.withColumn(into, F.filter(guessed, lambda x: x["score"] > 0)).drop("_counts")


def languages(scores: Column) -> Column:
    """Codes by falling score, then name; ``zh`` last beside its variants; ``undetermined`` without evidence."""
    ordered = F.transform(F.array_sort(F.transform(scores, lambda s: F.struct((-s["score"]).alias("n"), s["code"].alias("code")))), lambda s: s["code"])
    chinese = F.exists(ordered, lambda c: F.startswith(c, F.lit("zh-")))
    return F.when(F.size(ordered) == 0, F.array(F.lit("undetermined"))).when(chinese, F.concat(ordered, F.array(F.lit("zh")))).otherwise(ordered)


def language_names(codes: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.transform(codes, lambda c: F.coalesce(names[c], c))


def with_regions(df: DataFrame, folded: str, rules: str, into: str = "_regions") -> DataFrame:
    """df with array<struct<code, label, strength, evidence>>: substrings of the casefolded text and regions of matched rules."""
    words = [(code, m) for code, (_, markers) in REGIONS.items() for m in markers]
    near = candidates(F.col(folded), [(c, m, m.casefold()) for c, m in words], [frozenset([literals.folded(m.casefold())]) for _, m in words], "code string, evidence string, word string")
    df = df.withColumn("_near", near)
    spoken = F.transform(F.filter("_near", lambda m: F.contains(F.col(folded), m["word"])), lambda m: m.dropFields("word"))
    ruled_by = F.flatten(F.transform(rules, lambda r: F.transform(r["regions"], lambda c: F.struct(c.alias("code"), F.concat(F.lit("rule:"), r["rule_id"]).alias("evidence")))))
    df = df.withColumn("_signs", F.concat(spoken, ruled_by))
    labels = F.create_map(*(F.lit(x) for c, (label, _) in REGIONS.items() for x in (c, label)))
    of = lambda c: F.array_sort(F.array_distinct(F.transform(F.filter("_signs", lambda s: s["code"] == c), lambda s: s["evidence"])))
    codes = F.array_distinct(F.transform("_signs", lambda s: s["code"]))
    ordered = F.array_sort(F.transform(codes, lambda c: F.struct((-F.size(of(c))).alias("n"), c.alias("code"), of(c).alias("evidence"))))
    made = F.transform(ordered, lambda r: F.struct(r["code"].alias("code"), F.coalesce(labels[r["code"]], r["code"]).alias("label"), F.when(r["n"] <= -2, "strong").otherwise("possible").alias("strength"), F.slice(r["evidence"], 1, 8).alias("evidence")))
    return df.withColumn(into, made).drop("_signs", "_near")


def _problems(pack: tuple, top: int) -> list[str]:
    """Of one pack; content rules have points in the fifth place, tactics in the fourth."""
    ids = [r[0] for r in pack]
    problems = [f"rule id used twice: {x}" for x in sorted({i for i in ids if ids.count(i) > 1})]
    for r in pack:
        if not 1 <= next(x for x in r[3:5] if isinstance(x, int)) <= top:
            problems.append(f"points out of range: {r[0]}")
        try:
            re.compile(r[-1], re.IGNORECASE | re.DOTALL)
        except re.error as error:
            problems.append(f"pattern doesn't compile: {r[0]}: {error}")
    return problems


def validate() -> list[str]:
    """What is wrong with the packs; empty if nothing is."""
    problems = _problems(CONTENT_RULES, 40) + _problems(TACTIC_RULES, 50)
    problems += [f"language not supported: {r[0]}" for r in CONTENT_RULES if r[2] not in LANGUAGES]
    if len({r[1] for r in CONTENT_RULES}) < 12:
        problems.append("fewer than 12 categories")
    return problems


@without_call_sites
def with_wording(df: DataFrame, subject: str = "subject", body: str = "body_text", into: str = "wording") -> DataFrame:
    """df with a struct of everything that subject and body say: rules, findings, scores, languages, regions, indicators."""
    from .similarity import text_views

    raw = F.concat(F.coalesce(F.col(subject), F.lit("")), F.lit("\n"), F.coalesce(F.col(body), F.lit("")))
    df = df.withColumn("_raw", raw).withColumn("_model", text_views(F.col("_raw"), RULE_CHARS))
    df = df.withColumn("_text", F.coalesce("_model.text", "_model.whole"))
    df = with_generic(with_rules(df, "_text"), "_text")
    df = df.withColumn("_lure", ruled(F.col("_raw"))).withColumn("_seen", indicators(F.col("_lure")))
    df = with_tactics(df, "_lure")
    df = with_language_scores(df, "_model.folded", "_model.whole")
    df = settled(df, "_rules", "_generic", "_seen", "_tactics", "_spoken").withColumn("_once", once(F.col("_rules")))
    df = with_regions(df, "_model.folded", "_rules")
    negated = F.col("_text").rlike(NEGATION)
    speaks = (F.col("_model.similarity") >= 0.24) & ~(negated & (F.size("_once") == 0))
    weight = F.least(F.lit(10), F.greatest(F.lit(4), F.bround(F.col("_model.similarity") * 18).cast("int")))
    df = df.withColumn("_called", callback(F.col("_lure"), F.col("_seen"))).withColumn("_paid", payment(F.col("_lure"), F.col("_seen")))
    df = df.withColumn("_speaks", speaks).withColumn("_weight", weight)
    df = settled(df, "_once", "_called", "_paid", "_speaks", "_weight")
    called, paid, speaks, weight = F.col("_called"), F.col("_paid"), F.col("_speaks"), F.col("_weight")
    model = found(finding(speaks, "LOCAL_MODEL_SIGNAL", F.concat(F.lit("Offline character model resembles "), F.lower("_model.category")), "low", weight, F.concat(F.lit("cosine similarity "), F.format_number("_model.similarity", 3)), "local_model"))
    kinds = F.array_sort(F.array_distinct(F.transform(F.filter("_seen", lambda i: i["type"] != "phone"), lambda i: i["type"])))
    lures = found(
        finding(called, "CALLBACK_PHISHING", "Invoice, refund, or security lure directs the recipient to call", "high", 30, F.lit("Phone number redacted; callback context observed"), "advanced:callback"),
        finding(paid, "PAYMENT_DESTINATION", "Message contains a payment destination or wallet", "high", 24, F.array_join(kinds, ", "), "advanced:payment"),
    )
    entry = lambda category, points: F.struct(category.cast("string").alias("category"), points.cast("int").alias("points"))
    listed = lambda when, category, points: F.filter(F.array(F.when(when, entry(F.lit(category) if isinstance(category, str) else category, F.lit(points) if isinstance(points, int) else points))), lambda x: x.isNotNull())
    entries = F.concat(
        F.transform("_once", lambda r: entry(r["category"], r["points"])),
        listed(speaks, F.col("_model.category"), weight),
        F.transform("_tactics", lambda r: entry(r["category"], r["points"])),
        listed(called, "Callback phishing", 30),
        listed(paid, "Payment diversion or crypto transfer", 24),
    )
    scores = F.col("_spoken")
    out = F.struct(
        F.concat(content_findings(F.col("_once")), F.col("_generic"), model).alias("content_findings"), F.concat(tactic_findings(F.col("_tactics")), lures).alias("advanced_findings"),
        entries.alias("entries"), F.transform("_rules", lambda r: r["rule_id"]).alias("matched_rule_ids"), scores.alias("language_scores"), languages(scores).alias("languages"),
        F.col("_regions").alias("regions"), F.col("_seen").alias("indicators"), F.transform("_tactics", lambda r: F.struct(r["rule_id"].alias("rule_id"), r["mapping"].alias("mapping"))).alias("mappings"),
    )
    return df.withColumn(into, out).drop("_raw", "_text", "_rules", "_once", "_generic", "_model", "_lure", "_seen", "_tactics", "_spoken", "_regions", "_called", "_paid", "_speaks", "_weight")
