"""IP addresses as columns: IPv6 as two whole numbers, one spelling for each, and ranges that aren't public."""

from __future__ import annotations

from functools import reduce
from ipaddress import IPv4Network, IPv6Network

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import let

V4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$"
#: Special-purpose ranges by the registries, what lies inside of them and is public, and reserved space.
PRIVATE_V4 = "0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 240.0.0.0/4".split()
PUBLIC_V4 = "192.0.0.9/32 192.0.0.10/32".split()
PRIVATE_V6 = "::1/128 ::/128 64:ff9b:1::/48 100::/64 2001::/23 2001:db8::/32 2002::/16 3fff::/20 fc00::/7 fe80::/10".split()
PUBLIC_V6 = "2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28".split()
RESERVED_V6 = "::/8 100::/8 200::/7 400::/6 800::/5 1000::/4 4000::/3 6000::/3 8000::/3 a000::/3 c000::/3 e000::/4 f000::/5 f800::/6 fe00::/9".split()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def v4_number(host: Column) -> Column:
    p = F.transform(F.split(host, r"\."), lambda x: x.try_cast("bigint"))
    return let(p, lambda v: reduce(lambda a, i: a * 256 + F.get(v, F.lit(i)), (1, 2, 3), F.get(v, F.lit(0))))


def v6_numbers(text: Column) -> Column:
    """struct<hi, lo> of an IPv6 address, its 64-bit halves as signed numbers; null for anything else. A zone behind % is left out."""
    return let(F.lower(F.regexp_replace(text, "%[^%]*$", "")), _halves)


def _halves(t: Column) -> Column:
    last = F.regexp_extract(t, r":([0-9]+(?:\.[0-9]+){3})$", 1)
    number = v4_number(last)
    tail = F.concat(F.lower(F.hex(F.shiftright(number, 16))), F.lit(":"), F.lower(F.hex(number.bitwiseAND(0xFFFF))))
    # an IPv4 address at the end stands for two groups
    plain = F.when(last == "", t).when(last.rlike(V4), F.concat(F.substring(t, F.lit(1), F.length(t) - F.length(last)), tail)).otherwise("")
    return let(plain, lambda p: let(F.split(p, "::", -1), lambda sides: let(_groups(sides), lambda g: _packed(p, sides, g))))


def _groups(sides: Column) -> Column:
    """The eight groups, those left out as zeros."""
    named = lambda i: F.filter(F.split(F.coalesce(F.get(sides, F.lit(i)), F.lit("")), ":", -1), lambda x: x != "")
    missing = F.greatest(F.lit(0), 8 - F.size(named(0)) - F.size(named(1)))
    return F.concat(named(0), F.when(F.size(sides) == 2, F.array_repeat(F.lit("0"), missing)).otherwise(F.array().cast("array<string>")), named(1))


def _packed(p: Column, sides: Column, groups: Column) -> Column:
    shape = F.contains(p, F.lit(":")) & (F.size(sides) <= 2) & p.rlike("^[0-9a-f:]+$") & ~p.rlike("[0-9a-f]{5}|^:(?!:)|[^:]:$|:::")
    # a gap stands for one group at least
    whole = (F.size(groups) == 8) & ((F.size(sides) == 1) | (F.size(F.filter(F.split(p, ":"), lambda x: x != "")) < 8))
    half = lambda at: F.conv(F.array_join(F.transform(F.slice(groups, at, 4), lambda g: F.lpad(g, 4, "0")), ""), 16, -10).cast("bigint")
    return F.when(shape & whole, F.struct(half(1).alias("hi"), half(5).alias("lo")))


def v6_text(numbers: Column) -> Column:
    """The usual spelling: no leading zeros, the first of the longest runs of zero groups left out."""
    return let(numbers, _v6_text)  # written down once: what names it several times would grow with it


def _v6_text(n: Column) -> Column:
    group = lambda half, shift: F.lower(F.hex(F.shiftrightunsigned(half, shift).bitwiseAND(0xFFFF)))
    whole = F.concat_ws(":", *(group(n[h], s) for h in ("hi", "lo") for s in (48, 32, 16, 0)))

    def shortened(w: Column) -> Column:
        out = w
        for k in range(2, 9):  # the longest is asked for first
            pattern = rf"(?:^|:)0(?::0){{{k - 1}}}(?::|$)"
            out = F.when(w.rlike(pattern), F.regexp_replace(w, rf"^(.*?)(?:^|:)0(?::0){{{k - 1}}}(?::|$)(.*)$", "$1::$2")).otherwise(out)
        return out

    return F.when(n.isNotNull(), let(whole, shortened))


def _within_v4(number: Column, ranges: list[str]) -> Column:
    nets = [IPv4Network(r) for r in ranges]
    return reduce(lambda a, b: a | b, (number.between(int(n[0]), int(n[-1])) for n in nets))


def _within_v6(n: Column, ranges: list[str]) -> Column:
    def inside(text: str) -> Column:
        net = IPv6Network(text)
        first, mask = int(net[0]), int(net.netmask)
        upper = n["hi"].bitwiseAND(F.lit(_signed(mask >> 64))) == F.lit(_signed(first >> 64))
        low = mask & (1 << 64) - 1
        return upper & (n["lo"].bitwiseAND(F.lit(_signed(low))) == F.lit(_signed(first & (1 << 64) - 1))) if low else upper

    return reduce(lambda a, b: a | b, map(inside, ranges))


def _hidden_v4(number: Column) -> Column:
    return _within_v4(number, PRIVATE_V4) & ~_within_v4(number, PUBLIC_V4)


def non_public(ip: Column) -> Column:
    """Whether an address is private, local, reserved or for documentation. IPv4 addresses written as IPv6 lie in reserved space, whatever they are."""
    v6 = let(v6_numbers(ip), lambda n: (_within_v6(n, PRIVATE_V6) & ~_within_v6(n, PUBLIC_V6)) | _within_v6(n, RESERVED_V6))
    return F.when(ip.rlike(V4), let(v4_number(ip), _hidden_v4)).when(F.contains(ip, F.lit(":")), F.coalesce(v6, F.lit(False))).otherwise(False)


def is_ip(host: Column) -> Column:
    return host.rlike(V4) | (F.contains(host, F.lit(":")) & v6_numbers(host).isNotNull())
