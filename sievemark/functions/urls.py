"""Links as columns: parts, canonical form, registrable domain, static checks. No Python runs for ASCII hosts."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .addresses import V4, non_public, v6_numbers, v6_text
from .base import capped, finding, found, let, percent_decoded, points, risk_label, without_call_sites
from .packs import BRANDS, FILE_SUFFIXES, LURE_WORDS, REDIRECT_KEYS, SHORTENERS, USER_CONTENT_HOSTS
from .unicode import controls, host_names, idna, scripts

#: Top-level names that never have a public suffix list of their own.
RESERVED = ("example", "test", "invalid", "localhost")
#: Words that links of lures hold, and digits and signs with the letters they stand for.
TERMS = ("login", "signin", "verify", "secure", "account", "update", "password", "wallet", "invoice", "payment", "auth")
LEET = ("013457$@", "oleastsa")


@dataclass(frozen=True)
class Suffixes:
    """Rules of public suffixes by their number of labels: suffixes, suffixes below any label, exceptions."""

    plain: dict[int, tuple[str, ...]]
    wild: dict[int, tuple[str, ...]]
    except_: dict[int, tuple[str, ...]]

    @classmethod
    def of(cls, lines: Iterable[str]) -> Suffixes:
        """From lines of a public suffix list; what follows white space or stands behind // is a comment. Names are compared in their ASCII form."""
        kinds: tuple[dict[int, set[str]], ...] = ({}, {}, {})
        for line in lines:
            rule = (line.split() or [""])[0].lower().strip(".")
            if not rule or rule.startswith("//"):
                continue
            kind, name = (2, rule[1:]) if rule[0] == "!" else (1, rule[2:]) if rule.startswith("*.") else (0, rule)
            name = name if name.isascii() else name.encode("idna").decode()
            kinds[kind].setdefault(name.count(".") + 1, set()).add(name)
        return cls(*({n: tuple(sorted(own)) for n, own in sorted(kind.items())} for kind in kinds))


def load_suffixes(spark: SparkSession, path: str) -> Suffixes:
    """A public suffix list (some ten thousand lines) from wherever Spark reads."""
    return Suffixes.of(r.value for r in spark.read.text(path).collect())


_suffixes = Suffixes.of(files(__package__).joinpath("public_suffixes.txt").read_text("utf-8").splitlines())


def use_suffixes(rules: Suffixes) -> Suffixes:
    """Takes rules for all columns that are built from now on; returns those before."""
    global _suffixes
    before, _suffixes = _suffixes, rules
    return before


def registrable(host: Column) -> Column:
    """The domain an organisation registers: its public suffix and one label more; IP addresses and bare suffixes as they are."""
    return let(F.btrim(F.lower(host), F.lit(".[]")), _registrable)


def _registrable(host: Column) -> Column:
    labels = F.split(host, r"\.")
    size, rules = F.size(labels), _suffixes
    tail = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    listed = lambda n, names: (size >= n) & F.when(size >= n, tail(n)).isin(*names)
    # the longest rule holds, but for exceptions, whose suffix has a label less
    counts = [F.lit(1)] + [F.when(listed(n, names), n) for n, names in rules.plain.items() if n > 1] + [F.when(listed(n, names) & (size > n), n + 1) for n, names in rules.wild.items()]
    longest = F.greatest(*counts) if len(counts) > 1 else counts[0]
    for n, names in rules.except_.items():
        longest = F.when(listed(n, names), n - 1).otherwise(longest)
    own = let(longest, lambda k: F.array_join(F.slice(labels, -F.least(size, k + 1), F.least(size, k + 1)), "."))
    # no host but an IPv6 address holds a colon
    return F.when(host.rlike(V4) | F.contains(host, F.lit(":")) | (size < 2), host).when(F.element_at(labels, -1).isin(*RESERVED), tail(2)).otherwise(own)


def parts(url: Column) -> Column:
    """struct<scheme, userinfo, host, port, path, query, bad>: bad where the authority can't be read."""
    clean = F.btrim(F.regexp_replace(url, "[\t\r\n]", ""))
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    pick = lambda i: F.regexp_extract(clean, "(?s)" + pattern, i)
    net = pick(2)
    host_port = F.regexp_extract(net, r"(?s)^(?:.*@)?(.*)$", 1)
    port = F.regexp_extract(host_port, r"^(?:\[[^\]]*\]|[^:\[]*):(.*)$", 1)
    host = F.btrim(F.regexp_extract(host_port, r"^(\[[^\]]*\]|[^:]*)", 1), F.lit("[]"))
    bad_port = (port != "") & ~(port.rlike("^[0-9]{1,5}$") & (F.coalesce(port.try_cast("int"), F.lit(99_999)) <= 65_535))
    brackets = F.contains(net, F.lit("[")) != F.contains(net, F.lit("]"))
    return F.struct(
        F.lower(pick(1)).alias("scheme"), F.when(F.contains(net, F.lit("@")), F.regexp_extract(net, "(?s)^(.*)@", 1)).alias("userinfo"), F.lower(host).alias("host"),
        F.when(port.rlike("^[0-9]{1,5}$"), port.try_cast("int")).alias("port"), pick(3).alias("path"), pick(4).alias("query"), (bad_port | brackets).alias("bad"), net.alias("netloc"),
    )


def canonical_ipv4(host: Column) -> Column:
    """Dotted form of an address written with hexadecimal, octal or fewer parts; null for others and for the usual form."""
    number = r"(?:0[xX][0-9a-fA-F]{1,15}|[0-9]{1,18})"
    shape = host.rlike(rf"^{number}(?:\.{number}){{0,3}}$")

    def value(p: Column) -> Column:
        low = F.lower(p)
        based = F.when(F.startswith(low, F.lit("0x")), F.conv(F.substring(low, 3, 32), 16, 10)).when(p.rlike("^0[0-7]+$"), F.conv(p, 8, 10)).otherwise(p)
        return based.try_cast("bigint")

    return let(F.transform(F.split(host, r"\."), value), lambda v: let(_packed(v), lambda packed: let(_dotted(packed), lambda d: F.when(shape & packed.between(0, 0xFFFFFFFF) & (d != host), d))))


def _dotted(packed: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(packed, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)))


def _packed(v: Column) -> Column:
    at = lambda i: F.get(v, F.lit(i))
    n = F.size(v)
    fits = lambda *limits: reduce(lambda a, b: a & b, (at(i) <= top for i, top in enumerate(limits)))
    return (
        F.when(n == 1, at(0))
        .when((n == 2) & fits(0xFF, 0xFFFFFF), at(0) * (1 << 24) + at(1))
        .when((n == 3) & fits(0xFF, 0xFF, 0xFFFF), at(0) * (1 << 24) + at(1) * (1 << 16) + at(2))
        .when((n == 4) & fits(0xFF, 0xFF, 0xFF, 0xFF), at(0) * (1 << 24) + at(1) * (1 << 16) + at(2) * (1 << 8) + at(3))
    )


def brand_tokens(folded: Column, decoded: Column, reg: Column) -> Column:
    """Spellings that the host's labels before its suffix can be read as."""
    labels = F.filter(F.split(F.lower(folded), r"\."), lambda x: x != "")
    suffix = F.when(reg != "", F.size(F.split(reg, r"\.")) - 1).otherwise(1)
    named = F.when(F.size(labels) > suffix, F.slice(labels, F.lit(1), F.size(labels) - suffix)).otherwise(F.slice(labels, 1, 1))
    tokens = F.filter(F.flatten(F.transform(named, lambda x: F.split(x, "[-_]"))), lambda x: x != "")
    bare = lambda x: F.regexp_replace(x, r"(?U)[^\p{L}\p{N}]", "")
    seeds = F.concat(F.transform(tokens, bare), F.transform(tokens, lambda t: bare(F.translate(t, *LEET))))
    forms = F.concat(seeds, F.transform(seeds, lambda x: F.replace(x, F.lit("rn"), F.lit("m"))), F.transform(seeds, lambda x: F.replace(x, F.lit("vv"), F.lit("w"))))
    return F.array_distinct(F.filter(forms, lambda x: x != ""))


def brand_hits(host: Column, names: Column) -> Column:
    """array<struct<brand, observed, official>>: brands that the host spells or embeds without owning them; names: the column of host_names(host)."""
    reg = registrable(host)
    seen = let(reg, lambda r: F.struct(r.alias("reg"), brand_tokens(names["folded"], names["decoded"], r).alias("forms"), names["decoded"].alias("decoded")))
    return let(seen, _brands)


def _brands(seen: Column) -> Column:
    reg, forms = seen["reg"], seen["forms"]
    lure = "(?:" + "|".join(sorted(LURE_WORDS, key=lambda w: (-len(w), w))) + ")*"

    def spelt(brand: str):
        def check(f: Column) -> Column:
            hit = f.rlike(f"^{lure}{brand}{lure}$")
            if len(brand) >= 5:
                swaps = {brand[:i] + brand[i + 1] + brand[i] + brand[i + 2 :] for i in range(len(brand) - 1)} - {brand}
                near = ~F.contains(f, F.lit(brand)) & ((F.levenshtein(f, F.lit(brand), 1) >= 0) | f.isin(*sorted(swaps)))
                hit = hit | near
            return hit

        return F.exists(forms, check)

    hits = []
    for brand, official in BRANDS.items():
        made = F.struct(F.lit(brand).alias("brand"), seen["decoded"].alias("observed"), F.lit(", ".join(official)).alias("official"))
        hits.append(F.when(~reg.isin(*official) & spelt(brand), made))
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def redirect(query: Column) -> Column:
    """struct<key, host, encoded> of the first redirect parameter that resolves to a web address, or null."""

    def plus(x: Column) -> Column:
        return percent_decoded(F.replace(x, F.lit("+"), F.lit(" ")))

    web = r"(?i)^https?://(?:[^/?#]*@)?(\[[^\]]*\]|[^:/?#]+)"

    def target(value: Column) -> Column:
        standard = F.translate(value, "-_", "+/")
        padded = F.concat(standard, F.repeat(F.lit("="), F.pmod(-F.length(standard), F.lit(4))))
        raw = F.when(value.rlike("^[A-Za-z0-9_+/=-]{20,4096}$"), F.try_to_binary(padded, F.lit("base64"))).cast("string")
        direct = F.lower(F.regexp_extract(value, web, 1))
        inner = let(raw, lambda r: F.lower(F.regexp_extract(F.when(F.is_valid_utf8(r), r).otherwise(""), web, 1)))
        return F.struct(F.rtrim(F.coalesce(F.nullif(direct, F.lit("")), inner), F.lit(".")).alias("host"), (direct == "").alias("encoded"))

    def resolve(pair: Column) -> Column:
        key = plus(F.split(pair, "=", 2)[0])
        value = F.btrim(percent_decoded(percent_decoded(plus(F.coalesce(F.get(F.split(pair, "=", 2), F.lit(1)), F.lit(""))))))
        found_ = let(let(value, target), lambda t: F.when(t["host"] != "", F.struct(key.alias("key"), t["host"].alias("host"), t["encoded"].alias("encoded"))))
        return F.when(F.lower(key).isin(*REDIRECT_KEYS), found_)

    return F.get(F.filter(F.transform(F.split(query, "&"), resolve), lambda x: x.isNotNull()), F.lit(0))


@without_call_sites
def with_links(df: DataFrame, url: str = "url", into: str = "link") -> DataFrame:
    """df with a struct column: url, normalized_url, host, registrable_domain, score, risk, findings."""
    df = df.withColumn("_p", parts(F.col(url)))
    p = F.col("_p")
    raw_host = F.rtrim(p["host"], F.lit("."))
    df = df.withColumn("_h", idna(F.rtrim(F.lower(percent_decoded(p["host"])), F.lit("."))))
    df = df.withColumn("_n", host_names(F.col("_h")))
    host = F.col("_h")
    shown = F.when(F.contains(host, F.lit(":")), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    port = F.when(p["port"] > 0, F.concat(F.lit(":"), p["port"].cast("string"))).otherwise("")
    user = F.coalesce(F.concat(p["userinfo"], F.lit("@")), F.lit(""))
    query = F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise("")
    path = F.when(p["path"] == "", "/").otherwise(p["path"])
    df = df.withColumn("_u", F.when(p["scheme"] == "", F.btrim(F.col(url))).otherwise(F.concat(p["scheme"], F.lit("://"), user, shown, port, path, query)))
    df = df.withColumn("_o", canonical_ipv4(host)).withColumn("_ip", F.coalesce("_o", F.when(host.rlike(V4), host), F.when(F.contains(host, F.lit(":")), v6_text(v6_numbers(host)))))
    df = df.withColumn("_r", redirect(p["query"])).withColumn("_b", brand_hits(host, F.col("_n")))
    decoded = F.lower(percent_decoded(F.concat(path, F.lit("?"), p["query"])))
    df = df.withColumn("_t", F.array_sort(F.array_distinct(F.regexp_extract_all(decoded, F.lit("(" + "|".join(TERMS) + ")"), F.lit(0)))))
    n, ip, red, brand, terms = F.col("_n"), F.col("_ip"), F.col("_r"), F.col("_b"), F.col("_t")
    obfuscated = F.col("_o")
    written = scripts(n["decoded"])
    hidden = controls(n["decoded"])
    short = reduce(lambda a, b: a | b, (F.endswith(host, F.lit("." + s)) for s in SHORTENERS), host.isin(*SHORTENERS))
    encoded = F.size(F.regexp_extract_all(F.concat(path, p["query"]), F.lit("%[0-9a-fA-F]{2}"), F.lit(0)))
    outer, nested = registrable(host), registrable(red["host"])
    made = lambda when, code, title, severity, points_, evidence: finding(when, code, title, severity, points_, evidence, "url")

    def brand_at(i: int) -> Column:
        b = F.get(brand, F.lit(i))
        return made(b.isNotNull(), "BRAND_IMPERSONATION", F.concat(F.lit("Possible "), F.initcap(b["brand"]), F.lit(" impersonation")), "high", 28, F.concat(F.lit("Observed "), b["observed"], F.lit("; official "), b["official"]))

    # codes, titles, severities and points of all checks are fixed values
    checks = found(
        made(~p["scheme"].isin("http", "https") | (host == ""), "INVALID_URL", "URL is not a valid HTTP(S) link", "high", 60, F.col(url)),
        made(p["scheme"] == "http", "HTTP_ONLY", "Link does not use HTTPS", "low", 8, p["scheme"]),
        made(F.coalesce(p["userinfo"], F.lit("")).rlike("[^:]"), "USERINFO", "URL contains misleading user information", "high", 25, F.left(p["netloc"], F.lit(120))),
        made(raw_host.rlike("%[0-9a-f]{2}"), "PERCENT_ENCODED_HOST", "URL encodes characters inside the hostname", "high", 20, F.left(raw_host, F.lit(160))),
        made(obfuscated.isNotNull(), "OBFUSCATED_IP", "Link uses alternate IPv4 notation", "high", 30, F.concat(host, F.lit(" -> "), obfuscated)),
        made(ip.isNotNull(), "IP_HOST", "Link uses an IP address instead of a domain", "high", 22, ip),
        made(ip.isNotNull() & non_public(ip), "NON_PUBLIC_IP", "Link points to a non-public address", "high", 35, ip),
        made(host.rlike(r"(?:^|\.)xn--"), "PUNYCODE", "Domain uses internationalized Punycode", "medium", 15, host),
        made(F.size(written) > 1, "MIXED_SCRIPT", "Domain mixes writing systems", "high", 24, F.array_join(written, ", ")),
        made(F.size(hidden) > 0, "UNICODE_CONTROLS", "Domain contains invisible or bidirectional controls", "high", 30, F.array_join(hidden, ", ")),
        brand_at(0), brand_at(1),
        made(short, "SHORTENER", "Link uses a URL-shortening service", "medium", 15, host),
        made(F.size(F.split(host, r"\.")) >= 5, "DEEP_SUBDOMAIN", "Domain has many subdomain levels", "low", 8, host),
        made(F.length("_u") > 180, "LONG_URL", "URL is unusually long", "low", 8, F.concat(F.length("_u").cast("string"), F.lit(" characters"))),
        made(F.size(terms) > 0, "PHISHING_TERMS", "Link contains account or payment terms", "medium", F.least(F.lit(15), 5 + 2 * F.size(terms)), F.array_join(terms, ", ")),
        made((p["port"] > 0) & ~p["port"].isin(80, 443), "UNUSUAL_PORT", "Link uses a non-standard port", "medium", 12, p["port"]),
        made(F.size(F.filter(F.split(p["query"], "&"), lambda x: x != "")) > 12, "MANY_PARAMETERS", "Link contains many query parameters", "low", 5, F.lit("More than 12 parameters")),
        made(red["encoded"], "ENCODED_REDIRECT", "Redirect destination is encoded", "medium", 10, red["key"]),
        made(red.isNotNull(), "NESTED_REDIRECT", "Link contains a nested redirect destination", "medium", 12, F.concat(red["key"], F.lit(" -> "), red["host"])),
        made((outer != "") & (nested != "") & (outer != nested), "CROSS_DOMAIN_REDIRECT", "Nested redirect crosses organizational domains", "high", 20, F.concat(outer, F.lit(" -> "), nested)),
        made(encoded >= 10, "EXCESSIVE_PERCENT_ENCODING", "Link contains extensive percent encoding", "low", 6, F.lit("Ten or more encoded bytes")),
        made(F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))) >= 4, "MANY_HYPHENS", "Domain contains many hyphens", "low", 6, host),
    )
    malformed = found(finding(F.lit(True), "MALFORMED_URL", "Malformed URL", "high", 80, F.col(url), "url"))
    df = df.withColumn("_f", F.when(p["bad"], malformed).otherwise(checks))
    codes = F.transform("_f", lambda f: f["code"])
    lifted = F.array_contains(codes, "PHISHING_TERMS") & F.arrays_overlap(codes, F.array(F.lit("SHORTENER"), F.lit("PUNYCODE")))
    df = df.withColumn("_s", F.greatest(capped(points(F.col("_f"))), F.when(lifted, 25).otherwise(0)))
    bad = p["bad"]
    link = F.struct(
        F.col(url).alias("url"), F.when(bad, F.col(url)).otherwise(F.col("_u")).alias("normalized_url"), F.when(bad, "").otherwise(host).alias("host"),
        F.when(bad, "").otherwise(outer).alias("registrable_domain"), F.col("_s").alias("score"), risk_label(F.col("_s")).alias("risk"), F.col("_f").alias("findings"),
    )
    return df.withColumn(into, link).drop("_p", "_h", "_n", "_u", "_o", "_ip", "_r", "_b", "_t", "_f", "_s")


def visible_destination(label: Column) -> Column:
    """struct<host, text> that a link's label names, or null: a web address, or a bare domain that isn't a file name."""
    url = F.regexp_substr(label, F.lit("(?i)\\bhttps?://[^\\s<>\"']+"))
    trimmed = F.rtrim(url, F.lit(".,;:!?)]}>'\""))
    bare = F.regexp_extract(label, r"(?i)^\s*((?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24})(?::\d+)?(?:/\S*)?\s*$", 1)
    named = F.struct(parts(trimmed)["host"].alias("host"), trimmed.alias("text"))
    domain = (bare != "") & ~F.lower(F.element_at(F.split(bare, r"\."), -1)).isin(*FILE_SUFFIXES)
    return F.when(url.isNotNull(), named).when(domain, F.struct(F.lower(bare).alias("host"), bare.alias("text")))


def same_site(a: Column, b: Column) -> Column:
    return (a == b) | (~a.isin(*USER_CONTENT_HOSTS) & ~b.isin(*USER_CONTENT_HOSTS) & (registrable(a) == registrable(b)))
