"""From raw messages to one nested result each, and the long tables that aggregate them.

Parsing is one Arrow pass; all that follows is column expressions on arrays in
the message's own row, so nothing is shuffled until results are aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import FINDING, FINDINGS, capped, finding, found, let, points, risk_label, settled, without_call_sites
from ..functions.scoring import confidence, triage_score
from ..functions.urls import same_site, visible_destination, with_links
from ..functions.unicode import unescaped
from ..functions.wording import category_points, corroboration, html_findings, strongest, with_wording
from ..operators.feeds import FEED_POINTS, matches
from ..operators.headers import with_headers
from ..sources.mail import parsed

SELECTED, SHOWN, HTML_CHARS = 3, 20, 1_000_000
SUMMARIES = {
    "high": "Strong phishing indicators were identified. Do not reply, open links, or provide credentials.",
    "likely_phishing": "Multiple indicators are consistent with phishing. Treat the message as malicious until verified independently.",
    "suspicious": "Suspicious indicators were identified. Verify the sender through a trusted channel before acting.",
    "low": "No strong indicator was identified, but this result does not prove the email is safe.",
}


@without_call_sites
def link_rows(messages: DataFrame, key: str = "message_id") -> DataFrame:
    """key, ordinal and the checked link of every address of every message.

    The outer form, as in ``finding_rows``: the plain one repeats all that is behind urls in a filter on its size.
    """
    exploded = messages.select(key, F.posexplode_outer("urls").alias("ordinal", "url")).where("ordinal IS NOT NULL")
    return with_links(exploded, "url").select(key, "ordinal", "link.*")


def mismatches(anchors: Column) -> Column:
    """array<struct<shown, actual>> of anchors whose label names another site than they lead to."""

    def pair(a: Column) -> Column:
        seen = visible_destination(a["label"])
        actual = F.lower(F.regexp_extract(F.btrim(a["href"]), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))
        apart = (seen["host"] != "") & (actual != "") & ~same_site(seen["host"], actual)
        return F.when(apart, F.struct(seen["text"].alias("shown"), F.rtrim(a["href"], F.lit(".,;:!?)]}>'\"")).alias("actual")))

    return F.filter(F.transform(anchors, pair), lambda x: x.isNotNull())


@without_call_sites
def analyze(messages: DataFrame, content: str = "content", trusted: tuple[str, ...] = (), feed: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """One result for each distinct raw message; blank and oversized ones keep only their error.

    Columns: keep, message_id, case_id, error, score, risk, classification, confidence, dimensions, findings, links,
    attachments, evidence_status, category_scores, languages, regions, indicators and counts.
    """
    df = parsed(messages, content, keep)
    links = link_rows(df)  # of nothing but the parsed messages: what settles below would be computed for links, too
    df = with_wording(df)
    df = df.withColumn("_html", unescaped(F.left("body_html", F.lit(HTML_CHARS))))
    df = df.withColumn("_active", html_findings(F.coalesce("_html", F.lit("")))).drop("_html")
    df = with_headers(df, trusted=trusted)
    df = df.withColumn("_apart", mismatches(F.coalesce("anchors", F.array().cast("array<struct<href:string,label:string>>"))))
    if feed is not None:
        hits = matches(links.withColumn("_key", F.struct("message_id", "ordinal")), feed, "_key").groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("feed", "indicator"))).alias("hits"))
        links = links.join(hits.select("_key.*", "hits"), ["message_id", "ordinal"], "left")
    else:
        links = links.withColumn("hits", F.lit(None).cast("array<struct<feed:string,indicator:string>>"))
    # at most 2,000 links a message
    per = links.groupBy("message_id").agg(F.array_sort(F.collect_set(F.struct("ordinal", "url", "normalized_url", "host", "registrable_domain", "score", "risk", "findings", "hits"))).alias("_links"))
    df = df.join(per, "message_id", "left")
    known = feed is not None
    df = df.withColumn("_links", F.coalesce(_ranked("_links", "_apart"), F.array().cast(_link_type(df))))
    df = df.withColumn("_top", F.slice(F.transform(F.array_sort(F.transform("_links", lambda x: F.struct((-x["rank_score"]).alias("r"), x["ordinal"].alias("o")))), lambda x: x["o"]), 1, SELECTED))
    df = df.withColumn("_links", let(F.col("_top"), lambda top: F.transform("_links", lambda x: _selected(x, F.array_contains(top, x["ordinal"])))))
    return _assembled(settled(df, "_links", "_top"), keep or [], known)


def qr_status(images: Column) -> Column:
    """How many of the image attachments were searched for codes."""
    read = lambda a: a["qr"]["status"] == "evaluated"
    return F.when(F.size(images) == 0, "not_applicable").when(F.forall(images, read), "evaluated").when(F.exists(images, read), "partial").otherwise("not_evaluated")


def _link_type(df: DataFrame) -> str:
    finding_type = FINDINGS
    return f"array<struct<ordinal:int,url:string,normalized_url:string,host:string,registrable_domain:string,score:int,risk:string,findings:{finding_type},hits:array<struct<feed:string,indicator:string>>,rank_score:int>>"


def _ranked(links: str, apart: str) -> Column:
    shown_wrong = F.transform(apart, lambda m: F.lower(m["actual"]))
    return let(shown_wrong, lambda wrong: F.transform(links, lambda x: x.withField("rank_score", F.least(F.lit(100), x["score"] + F.when(F.array_contains(wrong, F.lower(x["url"])), 25).otherwise(0)).cast("int"))))


def _selected(x: Column, chosen: Column) -> Column:
    hit = chosen & x["hits"].isNotNull()
    named = F.array_join(F.transform(x["hits"], lambda h: F.concat(h["feed"], F.lit(":"), h["indicator"])), ", ")
    extra = found(finding(hit, "LOCAL_FEED_HIT", "Local threat-intelligence feed contains this destination", "high", FEED_POINTS, F.left(named, F.lit(500)), "reputation"))
    score = F.when(hit, capped(x["score"] + FEED_POINTS)).otherwise(x["score"])
    return x.withField("findings", F.concat(x["findings"], extra)).withField("score", score).withField("risk", risk_label(score)).withField("selected", chosen)


def _assembled(df: DataFrame, keep: list[str], feeds: bool) -> DataFrame:
    none = F.array().cast(FINDINGS)
    limited = F.exists("html_indicators", lambda i: i["type"] == "url_extraction_limit")
    apart = F.transform(F.slice("_apart", 1, SHOWN), lambda m: F.struct(F.lit("DISPLAY_LINK_MISMATCH").alias("code"), F.lit("Visible link text differs from its destination").alias("title"), F.lit("high").alias("severity"), F.lit(25).alias("points"), F.concat(F.lit("Shown: "), m["shown"], F.lit("; Destination: "), m["actual"]).alias("evidence"), F.lit("url").alias("source"), F.lit("observed").alias("status"))).cast(FINDINGS)
    active = F.transform(F.filter(F.slice("html_indicators", 1, SHOWN), lambda i: i["type"] != "url_extraction_limit"), lambda i: F.struct(F.lit("ACTIVE_HTML_DESTINATION").alias("code"), F.concat(F.lit("HTML contains "), F.replace(i["type"], F.lit("_"), F.lit(" "))).alias("title"), F.lit("medium").alias("severity"), F.lit(10).alias("points"), i["value"].alias("evidence"), F.lit("html").alias("source"), F.lit("observed").alias("status"))).cast(FINDINGS)
    bounds = found(
        finding(limited, "URL_EXTRACTION_LIMIT", "Message exceeded the static URL-analysis ceiling", "medium", 8, F.lit("First 2,000 unique destinations retained"), "resource", "partial"),
        finding(F.col("attachments_skipped") > 0, "ATTACHMENT_COUNT_LIMIT", "Message exceeded the attachment-analysis ceiling", "high", 15, F.concat(F.col("attachments_skipped").cast("string"), F.lit(" attachment(s) not analyzed after the first 100")), "resource", "partial"),
    )
    df = df.withColumn("_pointing", F.concat(apart, active)).withColumn("_bounds", bounds)
    df = df.withColumn("_tactics", F.concat("wording.advanced_findings", "_active", "sender.impersonation"))
    df = df.withColumn("_tactics", F.concat("_tactics", F.filter(F.array(corroboration(F.col("_tactics"))), lambda f: f.isNotNull())))
    intent = F.filter("_tactics", lambda f: f["source"] != "headers")
    html_score = points(F.col("_active"))
    entries = F.concat("wording.entries", F.filter(F.array(F.when(html_score > 0, F.struct(F.lit("HTML smuggling or credential capture").alias("category"), F.least(F.lit(100), html_score).alias("points")))), lambda e: e.isNotNull()))
    df = settled(df.withColumn("_entries", entries), "_tactics", "_pointing", "_entries")
    df = df.withColumn("category_scores", category_points(F.col("_entries")))
    dims = {
        "sender_authenticity": capped(points(F.col("sender.findings")) + points(F.filter("_tactics", lambda f: f["source"] == "headers"))),
        "message_intent": capped(points(F.col("wording.content_findings")) + points(intent)),
        "destination_risk": capped(F.coalesce(F.array_max(F.transform(F.filter("_links", lambda x: x["selected"]), lambda x: x["score"])), F.lit(0)) + points(F.col("_pointing"))),
        "payload_risk": F.coalesce(F.array_max(F.transform("attachments", lambda a: a["score"])), F.lit(0)),
    }
    df = df.withColumn("dimensions", F.struct(*(v.cast("int").alias(k) for k, v in dims.items())))
    df = settled(df, "category_scores", "dimensions")
    top = F.coalesce(F.array_max(F.transform("category_scores", lambda c: c["points"])), F.lit(0))
    df = df.withColumn("score", triage_score({k: F.col(f"dimensions.{k}") for k in dims}, F.size("_top"), top)).withColumn("risk", risk_label(F.col("score")))
    df = df.withColumn("findings", F.concat("wording.content_findings", "_tactics", "sender.findings", "_pointing", "_bounds"))
    files = F.flatten(F.transform("attachments", lambda a: a["findings"]))
    images = F.filter("attachments", lambda a: a["detected_type"] == "image")
    partial = (F.col("attachments_skipped") > 0) | F.exists(files, lambda f: f["status"].isin("partial", "not_evaluated"))
    states = {
        "content": F.lit("evaluated"), "headers": F.when(F.col("sender.present"), "evaluated").otherwise("not_evaluated"), "authentication": F.col("sender.authentication"),
        "links_static": F.when(limited, "partial").when(F.size("_links") > 0, "evaluated").otherwise("not_applicable"),
        "local_reputation": F.when(F.lit(feeds) & (F.size("_top") > 0), "checked").otherwise("not_evaluated"), "network_osint": F.lit("not_evaluated"),
        "attachments": F.when(partial, "partial").when(F.size("attachments") > 0, "evaluated").otherwise("not_applicable"), "qr": qr_status(images),
        "thread_context": F.col("sender.thread"), "language_support": F.when(F.array_contains("wording.languages", "undetermined"), "limited").otherwise("evaluated"),
        "regional_patterns": F.when(F.size("wording.regions") > 0, "observed").otherwise("not_observed"), "advanced_tactics": F.when(F.size("_tactics") > 0, "observed").otherwise("not_observed"),
        "sensitive_indicator_extraction": F.lit("evaluated"),
    }
    df = df.withColumn("evidence_status", F.struct(*(v.alias(k) for k, v in states.items())))
    everything = F.concat("findings", files, F.flatten(F.transform(F.filter("_links", lambda x: x["selected"]), lambda x: x["findings"])))
    df = df.withColumn("confidence", confidence(everything, F.array(*(F.col(f"evidence_status.{k}") for k in states))))
    summary = F.create_map(*(F.lit(x) for pair in SUMMARIES.items() for x in pair))[F.col("risk")]
    ok = F.col("error").isNull()
    given = lambda c: F.when(ok, c)
    return df.select(
        *keep, "message_id", F.concat(F.lit("SM-"), F.upper(F.left("message_id", F.lit(16)))).alias("case_id"), "error", "input_type", "subject", given(F.col("score")).alias("score"), given(F.col("risk")).alias("risk"),
        given(strongest(F.col("category_scores"))).alias("classification"), given(F.col("confidence")).alias("confidence"), given(summary).alias("summary"), given(F.col("dimensions")).alias("dimensions"),
        given(F.col("findings")).alias("findings"), given(F.col("_links")).alias("links"), given(F.size("_links")).alias("links_found"), given(F.size("_top")).alias("links_checked"), "attachments", "attachments_skipped",
        given(F.col("evidence_status")).alias("evidence_status"), given(F.col("category_scores")).alias("category_scores"), F.col("wording.languages").alias("languages"), F.col("wording.language_scores").alias("language_scores"),
        F.col("wording.regions").alias("regions"), F.col("wording.matched_rule_ids").alias("matched_rule_ids"), F.col("wording.indicators").alias("indicators"), F.col("wording.mappings").alias("attack_mappings"),
        F.size(F.filter("_tactics", lambda f: f["points"] > 0)).alias("tactic_count"),
    )


@without_call_sites
def finding_rows(results: DataFrame) -> DataFrame:
    """Every finding as a row: message_id, scope (message, link, attachment), scope_ordinal, ordinal and its fields.

    All of a message's are put in one array, so that messages are judged once and not for each scope. The outer form of explode keeps the
    optimizer from repeating the expressions behind an array in filters on its size.
    """

    def told(scope: str, number: Column, findings: Column) -> Column:
        return F.transform(findings, lambda f, i: F.struct(F.lit(scope).alias("scope"), number.cast("int").alias("scope_ordinal"), i.alias("ordinal"), f.alias("f")))

    own = told("message", F.lit(0), F.col("findings"))
    link = F.flatten(F.transform("links", lambda x: told("link", x["ordinal"], x["findings"])))
    files = F.flatten(F.transform("attachments", lambda x, n: told("attachment", n, x["findings"])))
    none = F.array().cast(f"array<struct<scope:string,scope_ordinal:int,ordinal:int,f:{FINDING}>>")
    rows = settled(results, "findings", "links", "attachments").select("message_id", F.explode_outer(F.concat(*(F.coalesce(x, none) for x in (own, link, files)))).alias("r"))
    return rows.where("r IS NOT NULL").select("message_id", "r.scope", "r.scope_ordinal", "r.ordinal", "r.f.*")


def summary_cube(results: DataFrame) -> DataFrame:
    """Messages and mean score by risk and classification, with subtotals."""
    return results.where("error IS NULL").cube("risk", "classification").agg(F.count("*").alias("messages"), F.round(F.avg("score"), 2).alias("mean_score"))
