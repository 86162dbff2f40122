"""Sender checks over a map of header fields (lower-case names, repeated fields joined by newlines)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import finding, found, let, settled, without_call_sites
from ..functions.mailboxes import host_of, mailboxes
from ..functions.packs import BRANDS
from ..functions.unicode import controls, host_names
from ..functions.urls import brand_hits, registrable


def _apart(a: Column, b: Column) -> Column:
    """Whether two struct<host, site> are of different organisations."""
    return (a["host"] != "") & (b["host"] != "") & (a["site"] != b["site"])


def _sited(host: Column) -> Column:
    return let(host, lambda h: F.struct(h.alias("host"), registrable(h).alias("site")))


@without_call_sites
def with_headers(df: DataFrame, headers: str = "headers", trusted: tuple[str, ...] = (), into: str = "sender") -> DataFrame:
    """df with struct<findings, impersonation, authentication, thread>; nothing is found where there are no headers.

    trusted: the authserv-ids whose Authentication-Results count.
    """
    get = lambda name: F.coalesce(F.col(headers)[name], F.lit(""))
    lines = lambda name: F.filter(F.split(get(name), "\r?\n"), lambda x: F.btrim(x) != "")
    names = {"from": "_from", "reply-to": "_reply", "return-path": "_path", "sender": "_sent"}
    df = df.withColumn("_boxes", mailboxes(*map(get, names)))
    for i, into_ in enumerate(names.values()):
        df = df.withColumn(into_, _sited(host_of(F.get("_boxes", F.lit(i))["address"])))
    box = F.get("_boxes", F.lit(0))
    ids = sorted(t.casefold().rstrip(".") for t in trusted)
    server = lambda block: F.rtrim(F.lower(F.split(F.btrim(F.split(block, ";", 2)[0]), r"\s+")[0]), F.lit("."))
    df = df.withColumn("_blocks", F.transform(lines("authentication-results"), lambda b: F.btrim(b)))
    df = df.withColumn("_trusted", F.filter("_blocks", lambda b: server(b).isin(*ids)) if ids else F.array().cast("array<string>"))
    df = df.withColumn("_auth", F.lower(F.array_join("_trusted", "\n")))
    df = settled(df, *names.values(), "_blocks")
    auth, seen = F.col("_auth"), F.size("_trusted") > 0
    passed = lambda what: auth.rlike(rf"\b{what}\s*=\s*pass")
    aligned = lambda pattern: F.exists(F.regexp_extract_all(auth, F.lit(pattern), F.lit(1)), lambda d: (F.col("_from.host") != "") & (registrable(F.btrim(d, F.lit("<>"))) == F.col("_from.site")))
    good = passed("dmarc") | (passed("spf") & aligned(r"smtp\.mailfrom=([^\s;]+)")) | (passed("dkim") & aligned(r"header\.d=([^\s;]+)"))
    authors = box["all"]
    pair = lambda a, x, b, y: F.concat(F.lit(f"{a}: "), x["host"], F.lit(f"; {b}: "), y["host"])
    # codes, titles, severities and points of all checks below are fixed values
    made = lambda when, code, title, severity, points, evidence, source="headers", status="observed": finding(when, code, title, severity, points, evidence, source, status)
    author, reply, sent, back = F.col("_from"), F.col("_reply"), F.col("_sent"), F.col("_path")
    checks = [made((F.size("_blocks") > 0) & ~seen, "AUTH_RESULTS_UNTRUSTED", "Authentication-Results was not issued by a trusted receiver", "info", 0, F.array_join(F.transform("_blocks", server), ", "), status="not_evaluated")]
    for what, points in (("dmarc", 22), ("dkim", 16), ("spf", 12)):
        hit = F.regexp_substr(auth, F.lit(rf"\b{what}\s*=\s*(fail|softfail|temperror|permerror)"))
        checks.append(made(hit.isNotNull(), f"{what.upper()}_FAIL", f"{what.upper()} authentication did not pass", "high" if what == "dmarc" else "medium", points, hit))
    checks.append(made(F.size(authors) > 1, "MULTIPLE_FROM_ADDRESSES", "Message presents multiple author addresses", "medium", 16, F.array_join(F.slice(authors, 1, 5), ", ")))
    for name in ("from", "reply-to", "subject"):
        checks.append(made(F.size(lines(name)) > 1, "DUPLICATE_SECURITY_HEADER", f"Message contains multiple {name.title()} header fields", "medium", 14, F.concat(F.size(lines(name)).cast("string"), F.lit(" instances"))))
    checks += [
        made(_apart(author, sent), "SENDER_FROM_MISMATCH", "Sender organizational domain differs from From", "low", 6, pair("From", author, "Sender", sent)),
        made(_apart(author, reply), "REPLY_TO_MISMATCH", "Reply-To organizational domain differs from From", "medium", 14, pair("From", author, "Reply-To", reply)),
        made(_apart(author, back), "RETURN_PATH_MISMATCH", "Return-Path organizational domain differs from From", "low", 7, pair("From", author, "Return-Path", back)),
        made(seen & (author["host"] != "") & (passed("spf") | passed("dkim")) & ~good, "DMARC_ALIGNMENT_FAILURE", "Passing authentication is not aligned with RFC5322.From", "high", 22, F.concat(F.lit("From: "), author["host"])),
        made((get("arc-authentication-results") != "") | (get("arc-seal") != ""), "ARC_PRESENT", "ARC chain is present but does not prove message safety", "info", 0, F.lit("ARC evidence requires a trusted validator and chain evaluation")),
        made(get("message-id") == "", "MESSAGE_ID_MISSING", "Message-ID header is missing", "low", 4, F.lit("No Message-ID was parsed")),
        made((get("in-reply-to") != "") & (get("references") == ""), "THREAD_CONTEXT_INCOMPLETE", "Reply claims a thread but References is missing", "low", 5, F.left(get("in-reply-to"), F.lit(160)), "thread"),
        made((get("in-reply-to") != "") & _apart(reply, author), "THREAD_REPLY_ROUTE_CHANGED", "Reply routing changed inside an apparent thread", "high", 18, pair("From", author, "Reply-To", reply), "thread"),
    ]
    df = df.withColumn("_checks", found(*checks))
    shown = F.lower(box["name"])
    claimed = F.filter(F.array(*(F.when(shown.rlike(rf"(?U)(?<!\w){b}(?!\w)") & ~author["site"].isin(*official), b) for b, official in BRANDS.items())), lambda x: x.isNotNull())
    other = _sited(F.btrim(F.lower(F.regexp_extract(get("message-id"), r"@([^>\s]+)", 1)), F.lit(".")))
    df = df.withColumn("_named", host_names(author["host"])).withColumn("_other", other)
    df = df.withColumn("_claimed", claimed).withColumn("_spoofed", F.when(author["host"] != "", brand_hits(author["host"], F.col("_named"))))
    other = F.col("_other")
    hidden = controls(F.concat(box["name"], box["address"]))
    imitation = found(
        made(F.size("_claimed") > 0, "DISPLAY_NAME_BRAND_IMPERSONATION", "Display name claims a brand not aligned with the sender domain", "high", 24, F.concat(F.lit("Claimed: "), F.array_join("_claimed", ", "), F.lit("; sender domain: "), F.coalesce(F.nullif(author["host"], F.lit("")), F.lit("unavailable")))),
        made(F.size("_spoofed") > 0, "SENDER_DOMAIN_BRAND_IMPERSONATION", "Sender domain imitates a brand it does not own", "high", 24, F.concat(F.lit("Sender domain: "), author["host"], F.lit("; imitates: "), F.array_join(F.transform("_spoofed", lambda b: b["brand"]), ", "))),
        made(F.size(hidden) > 0, "HEADER_UNICODE_CONTROL", "Sender identity contains invisible or bidirectional controls", "high", 28, F.array_join(F.slice(hidden, 1, 10), ", ")),
        made(_apart(author, other), "MESSAGE_ID_DOMAIN_MISMATCH", "Message-ID domain differs from the visible sender domain", "low", 5, pair("From", author, "Message-ID", other)),
    )
    some = F.size(F.coalesce(F.col(headers), F.create_map().cast("map<string,string>"))) > 0
    none = found()
    out = F.struct(
        F.when(some, F.col("_checks")).otherwise(none).alias("findings"), F.when(some, imitation).otherwise(none).alias("impersonation"),
        F.when(some & seen, "evaluated").otherwise("not_evaluated").alias("authentication"), F.when((get("in-reply-to") != "") | (get("references") != ""), "evaluated").otherwise("not_applicable").alias("thread"), some.alias("present"),
    )
    return df.withColumn(into, out).drop("_from", "_reply", "_path", "_sent", "_blocks", "_trusted", "_auth", "_boxes", "_checks", "_claimed", "_spoofed", "_named", "_other")
