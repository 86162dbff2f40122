"""What scanning a code's text would do, as columns. Secrets are never shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import let, percent_decoded, without_call_sites
from ..functions.packs import FILE_SUFFIXES

#: Schemes by what they do.
SCRIPTS = ("javascript", "vbscript", "data", "file", "blob")
COINS = ("bitcoin", "ethereum", "litecoin", "bitcoincash", "dogecoin", "monero", "solana", "tron", "ripple", "lightning")
APPS = ("intent", "market", "android-app", "itms-apps", "itms-appss")


def short(value: Column, size: int) -> Column:
    plain = F.btrim(F.regexp_replace(value, r"[\p{Cc}\p{Cf}]+", ""))
    return F.when(F.length(plain) > size, F.concat(F.left(plain, F.lit(size)), F.lit("…"))).otherwise(plain)


#: kind, label, risk, display and url of a code's text.
PAYLOAD = "struct<kind:string,label:string,risk:string,display:string,url:string>"


def _scheme(v: Column) -> Column:
    return F.lower(F.regexp_extract(v, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def _stripped(value: Column) -> Column:
    return F.btrim(F.coalesce(value, F.lit("")))


def _read(v: Column, scheme: Column) -> Column:
    body = F.regexp_replace(v, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:", "")
    field = lambda k: F.regexp_replace(F.regexp_extract(body, rf"(?:^|;){k}:((?:\\.|[^;])*)", 1), r"\\(.)", "$1")
    argument = lambda k: percent_decoded(F.regexp_extract(v, rf"[?&]{k}=([^&#]*)", 1))
    masked = lambda a: F.when(F.length(a) > 14, F.concat(F.left(a, F.lit(6)), F.lit("…"), F.right(a, F.lit(6)))).otherwise(a)
    path = F.split(body, r"\?", 2)[0]
    row = lambda kind, label, risk, display, url=None: F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.lit(risk).alias("risk"), display.alias("display"), (F.lit(None).cast("string") if url is None else url).alias("url"))
    named = F.coalesce(F.nullif(short(field("S"), 60), F.lit("")), F.lit("(no name)"))
    host = F.split(v, "[/?#:]", 2)[0]
    bare = v.rlike(r"(?i)^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}(?::\d+)?(?:[/?#]\S*)?$") & (F.length(v) <= 2048) & ~F.lower(F.element_at(F.split(host, r"\."), -1)).isin(*FILE_SUFFIXES)
    inside = F.regexp_substr(v, F.lit("(?i)\\bhttps?://[^\\s<>\"']+"))
    return (
        F.when(v == "", row("text", "Empty", "info", F.lit("")))
        .when(scheme.isin("http", "https"), row("url", "Web link", "info", short(v, 300), v))
        .when(scheme.isin(*SCRIPTS), row("script", "Runs code or opens local content", "high", short(v, 120)))
        .when(scheme == "wifi", row("wifi", "Wi-Fi network", "warn", F.concat(F.lit("Network "), named, F.lit(" ("), F.coalesce(F.nullif(field("T"), F.lit("")), F.lit("open")), F.lit(")"))))
        .when(scheme.isin("sms", "smsto", "mms", "mmsto"), row("sms", "Text message", "warn", F.concat(F.lit("To "), short(percent_decoded(F.split(F.split(body, ":", 2)[0], r"\?", 2)[0]), 40))))
        .when(scheme == "tel", row("tel", "Phone call", "warn", short(percent_decoded(body), 40)))
        .when(scheme == "mailto", row("email", "Email", "info", short(percent_decoded(path), 120)))
        .when(scheme.isin(*COINS), row("crypto", "Cryptocurrency payment", "warn", F.concat(F.initcap(scheme), F.lit(" address "), masked(path), F.when(argument("amount") != "", F.concat(F.lit(", amount "), short(argument("amount"), 20))).otherwise(""))))
        .when(scheme == "upi", row("payment", "Payment request", "warn", F.concat(F.lit("Payee "), F.coalesce(F.nullif(short(argument("pa"), 60), F.lit("")), F.lit("(none)")), F.when(argument("am") != "", F.concat(F.lit(", amount "), short(argument("am"), 20))).otherwise(""))))
        .when(scheme.isin("otpauth", "otpauth-migration"), row("authenticator", "Login-code (two-factor) setup", "warn", F.coalesce(F.nullif(short(percent_decoded(F.regexp_replace(path, "^//[^/]*/*", "")), 80), F.lit("")), F.lit("Authenticator account"))))
        .when(scheme == "itms-services", row("app_install", "App installation", "high", short(v, 120)))
        .when(scheme.isin(*APPS), row("app_link", "Opens or installs an app", "warn", short(v, 120)))
        .when(scheme == "geo", row("location", "Map location", "info", short(body, 60)))
        .when(v.rlike("(?i)^(?:BEGIN:VCARD|MECARD:|BEGIN:VEVENT|BEGIN:VCALENDAR)"), row("contact", "Contact or calendar entry", "info", short(F.replace(v, F.lit("\n"), F.lit(" ")), 120)))
        .when(F.startswith(v, F.lit("000201")) & _merchant(v).isNotNull(), row("payment", "Payment request (SGQR/EMV)", "warn", F.concat(F.lit("Merchant "), _merchant(v))))
        .when((scheme != "") & F.contains(F.left(v, F.lit(40)), F.lit("://")), row("app_link", "App link", "warn", short(v, 120)))
        .when(bare, row("url", "Web address", "info", short(v, 300), F.concat(F.lit("http://"), v)))
        .when(inside.isNotNull(), row("text", "Text with a link", "info", short(v, 300), inside))
        .otherwise(row("text", "Plain text", "info", short(v, 300)))
    )


def payload_of(value: Column) -> Column:
    """What a text does, where there is no column to keep its parts in (inside of arrays)."""
    return let(_stripped(value), lambda v: let(_scheme(v), lambda scheme: _read(v, scheme)))


@without_call_sites
def with_payload(df: DataFrame, value: str, into: str = "payload") -> DataFrame:
    """df with struct<kind, label, risk, display, url>."""
    df = df.withColumn("_v", _stripped(F.col(value)))
    df = df.withColumn("_scheme", _scheme(F.col("_v")))
    return df.withColumn(into, _read(F.col("_v"), F.col("_scheme"))).drop("_v", "_scheme")


def fingerprints(values: Column, payloads: Column) -> Column:
    """array<struct<masked, sha256_prefix, kind>> of texts that aren't plain web links, never the texts themselves."""
    shown = lambda v: F.when(F.length(v) >= 4, F.right(v, F.lit(4))).otherwise("****")
    told = lambda v, p: F.struct(F.concat(F.lit("***"), shown(v)).alias("masked"), F.left(F.sha2(v, 256), F.lit(16)).alias("sha256_prefix"), p["kind"].alias("kind"))
    return F.filter(F.zip_with(values, payloads, lambda v, p: F.when((p["kind"] != "url") | ~F.lower(v).rlike("^https?://"), told(v, p))), lambda x: x.isNotNull())


def _merchant(v: Column) -> Column:
    """The value of tag 59 among two-digit tags with two-digit lengths, or null."""
    state = F.struct(F.lit(1).alias("at"), F.lit(None).cast("string").alias("name"))

    def step(s: Column, _: Column) -> Column:
        tag, size = F.substring(v, s["at"], F.lit(2)), F.substring(v, s["at"] + 2, F.lit(2)).try_cast("int")
        value = F.substring(v, s["at"] + 4, F.coalesce(size, F.lit(0)))
        name = F.when((tag == "59") & (value != ""), value)
        return F.struct(F.when(size.isNull() | s["name"].isNotNull(), F.length(v) + 1).otherwise(s["at"] + 4 + size).alias("at"), F.coalesce(s["name"], name).alias("name"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(40)), state, step)["name"]
