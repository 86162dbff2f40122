import re

from pyspark.sql import functions as F

from sievemark.functions.scoring import triage_score
from sievemark.functions.similarity import grams, resembles
from sievemark.functions.unicode import normalized
from sievemark.functions.urls import registrable, with_links
from sievemark.functions.wording import validate, with_rules
from sievemark.functions.layers import base64_texts, layered_links, one_spelling, script_decoded
from sievemark.operators.reports import docx_bytes, manifest, manifest_problems, pdf_bytes
from sievemark.plans.samples import FILES, messages, with_file
from sievemark.sources.html import Page
from sievemark.sources.mail import parse, parsed, read_folder
from sievemark.streaming.limiter import admit

LINKS = {
    "http://paypa1.com/login": {"HTTP_ONLY", "BRAND_IMPERSONATION", "PHISHING_TERMS"},
    "https://user:pw@bank.example.co.uk:8443/verify?next=https%3A%2F%2Fevil.net%2Fx": {"USERINFO", "PHISHING_TERMS", "UNUSUAL_PORT", "NESTED_REDIRECT", "CROSS_DOMAIN_REDIRECT"},
    "https://0x7f.1/a": {"OBFUSCATED_IP", "IP_HOST", "NON_PUBLIC_IP"},
    "https://8.8.8.8/": {"IP_HOST"},
    "https://xn--pypal-4ve.com/": {"PUNYCODE", "MIXED_SCRIPT", "BRAND_IMPERSONATION"},
    "https://h.com/?url=aHR0cHM6Ly9ldmlsLmNvbS9wYXRoLw==": {"ENCODED_REDIRECT", "NESTED_REDIRECT", "CROSS_DOMAIN_REDIRECT"},
    "https://pineapple.com": set(),
    "https://www.amazon.co.uk/": set(),
    "http://x.com:99999/": {"MALFORMED_URL"},
    "mailto:a@b.c": {"INVALID_URL"},
}


def test_links(spark):
    rows = with_links(spark.createDataFrame([(u,) for u in LINKS], "url string"), "url").collect()
    for r in rows:
        assert {f.code for f in r.link.findings} == LINKS[r.url], r.url
    by = {r.url: r.link for r in rows}
    assert by["https://user:pw@bank.example.co.uk:8443/verify?next=https%3A%2F%2Fevil.net%2Fx"].registrable_domain == "example.co.uk"
    assert by["http://x.com:99999/"].score == 80


def test_registrable(spark):
    hosts = {"a.b.example": "b.example", "x.y.co.uk": "y.co.uk", "10.0.0.1": "10.0.0.1", "single": "single", "A.Com.": "a.com"}
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", registrable(F.col("h")).alias("r")).collect()
    assert {r.h: r.r for r in rows} == hosts


def test_rules(spark):
    texts = {"Please verify your account": ["cred.en.verify"], "Never verify your account": [], "verify account settings": [], "验证您的账户": ["cred.zh-hans"]}
    rows = with_rules(spark.createDataFrame([(t,) for t in texts], "t string"), "t").select("t", "_rules.rule_id").collect()
    assert {r.t: r.rule_id for r in rows} == texts
    assert validate() == []


def test_score_rounds_half_to_even(spark):
    dims = {"sender_authenticity": 2, "message_intent": 0, "destination_risk": 0, "payload_risk": 0}
    got = spark.range(1).select(triage_score({k: F.lit(v) for k, v in dims.items()}).alias("s"), triage_score({k: F.lit(100) for k in dims}).alias("t")).first()
    assert (got.s, got.t) == (2, 100)


def test_normalized():
    assert normalized("v e r i f y   it") == "verify it"
    assert normalized("pаypal") == "paypal" and normalized("аб") == "аб"
    assert normalized("ac​count a.b") == "account ab"


def test_similarity():
    assert grams("abcd")["abc"] == 1 and not grams("ab")
    assert resembles("verify account password login immediately")[1] > 0.9


def test_admit():
    assert admit([0, 1, 2, 61.5], 2, 60)[0] == [True, True, False, True]
    assert admit([0, 1, 60, 60.5], 1, 60)[0] == [True, False, False, True]


def test_html():
    page = Page('<base href="https://b.example/d/"><a href="x">label</a><form action="https://e.example/f"></form><p style="background:url(https://c.example/i)">https://t.example/.</p><a href="tel:1">')
    assert page.anchors[0] == ("https://b.example/d/x", "label")
    assert {"https://e.example/f", "https://c.example/i", "https://t.example/"} <= set(page.links)
    assert {"form_action", "css_url", "contact_uri", "base_href"} <= {k for k, _ in page.indicators}


def test_layers(spark):
    r = spark.range(1).select(
        base64_texts(F.lit("see aHR0cHM6Ly9ldmlsLmV4YW1wbGUveA== now, aHR0cHM6Ly9ldmlsLmV4YW1wbGUveA and /////////////////////")).alias("b"),
        layered_links(F.lit(r"https%253A//e.example/, \u0068ttps://u.example. (http://p.example/a)")).alias("l"),
        script_decoded(F.lit(r"\u00e9\x41b\uD83D")).alias("s"),
        one_spelling(F.array(*map(F.lit, ["HTTP://A.example/).", "http://a.example/", "ftp://x", "https://b.example/?x=1&amp;y=2"])), 9).alias("o"),
    ).first()
    assert r.b == ["https://evil.example/x"] * 2
    assert set(r.l) == {"https://e.example/", "https://u.example", "http://p.example/a"}
    assert r.s.startswith("éAb") and r.o == ["HTTP://A.example/", "https://b.example/?x=1&y=2"]


def test_parse():
    out = parse("From: a@b.example\nSubject: é\n\nhello ü".encode())
    assert out["input_type"] == "eml" and "ü" in out["body_text"]
    assert parse(b"just text")["input_type"] == "pasted_text"


def test_attachments(spark):
    rows = spark.createDataFrame([(i, bytearray(m)) for i, m in enumerate(messages())], "i int, content binary")
    got = {r.i: r for r in parsed(rows, keep=["i"]).collect()}
    for i, (name, _, data, codes, urls) in enumerate(FILES):
        a = got[i].attachments[0]
        assert ({f.code for f in a.findings}, a.extracted_urls, a.size_bytes) == (codes, urls, len(data)), name
        assert got[i].urls == urls and a.score == min(100, sum(f.points for f in a.findings))


def test_attachment_limits(spark):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (7000).to_bytes(4, "big") * 2
    gif = b"GIF89a" + (10).to_bytes(2, "little") * 2
    rows = spark.createDataFrame([(i, bytearray(with_file(n, "image/png", d))) for i, (n, d) in enumerate([("a.png", png), ("b", gif)])], "i int, content binary")
    assert [r.attachments[0].qr.reason for r in parsed(rows, keep=["i"]).orderBy("i").collect()] == ["image_too_large", "local_qr_decoder_unavailable"]


def test_folder(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"From: a@b.example\n\nsee https://x.example/")
    (tmp_path / "b.eml").write_bytes(b"x" * 2_000_001)
    (tmp_path / "c.txt").write_bytes(b"no")
    got = {r.path[-5:]: (r.error, r.urls) for r in parsed(read_folder(spark, str(tmp_path)), keep=["path"]).collect()}
    assert got == {"a.eml": (None, ["https://x.example/"]), "b.eml": ("input_too_large", None)}


def test_reports():
    import io
    import zipfile

    assert zipfile.ZipFile(io.BytesIO(docx_bytes(["a < b"]))).testzip() is None
    assert pdf_bytes(["x" * 3000]).startswith(b"%PDF-1.4") and pdf_bytes([]).rstrip().endswith(b"%%EOF")
    assert manifest_problems(manifest()) == [] and manifest_problems(manifest() | {"schema_version": "0"}) == ["manifest differs in schema_version"]
    assert manifest_problems(3) == ["manifest must be an object"]


def test_required_literals():
    from sievemark.functions.literals import folded, required
    from sievemark.functions.packs import CONTENT_RULES, GENERIC_RULES, TACTIC_RULES

    assert required("(?:verify|check) your (account)") in ({"verify", "check"}, {"account"}, {" your "})
    assert required("(é|ü)xy") == {"xy"} and required("(?:abc|de)+f?") == {"abc", "de"} and required("STRASSE|x1") == {"strasse", "x1"}
    assert required("(?!never)ab{2}") is None and required("a|bc") is None and required(r"\d+.?") is None and required("(?<=abc)d") is None and required("x*(yes)?") is None
    assert required("(") is None
    assert folded("İSTANBUL ſtraße Kelvin") == "istanbul strasse kelvin"
    # every rule of the packs has literals, so no pattern runs on a text without them
    assert all(required(r[-1]) for r in (*CONTENT_RULES, *TACTIC_RULES, *GENERIC_RULES))


def test_matches_need_their_literals():
    """Texts made from the patterns themselves: a match holds a literal of its rule."""
    import random

    from sievemark.functions.literals import Matcher, required
    from sievemark.functions.packs import CONTENT_RULES, TACTIC_RULES

    random_, rules = random.Random(3), (*CONTENT_RULES, *TACTIC_RULES)

    def said(items):
        out = ""
        for op, value in items:
            name = str(op)
            if name == "LITERAL":
                out += random_.choice([str.lower, str.upper])(chr(value))
            elif name == "IN":
                out += next((chr(v if str(o) == "LITERAL" else v[0]) for o, v in value if str(o) in ("LITERAL", "RANGE")), "a")
            elif name == "SUBPATTERN":
                out += said(value[-1])
            elif name == "BRANCH":
                out += said(random_.choice(value[1]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                out += "".join(said(value[2]) for _ in range(random_.randint(value[0], min(value[1], value[0] + 2))))
            elif name == "ANY":
                out += random_.choice(" x")
        return out

    matcher, hits = Matcher([required(r[-1]) for r in rules]), 0
    for i, r in enumerate(rules):
        for _ in range(30):
            text = "so " + said(re._parser.parse(r[-1], re.I | re.S)) + " now"
            if re.search(r[-1], text, re.I | re.S):
                assert i in matcher.of(text), (r[0], text)
                hits += 1
    assert hits > 15 * len(rules)


def test_large_packs(spark):
    """Five thousand rules are one array of candidates in the plan."""
    rules = tuple((f"r{i}", "c", "en", f"t{i}", 1 + i % 40, ("SG",) if i % 2 else (), rf"\bword{i}\b.{{0,9}}\bnow\b") for i in range(5000))
    df = with_rules(spark.createDataFrame([(f"take word{i} right now", i) for i in range(0, 5000, 250)] + [("do not take word7 now", 7), (None, 8)], "t string, i int"), "t", rules=rules)
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    got = {r.i: [(x.rule_id, x.title, x.points, x.regions, x.evidence) for x in r._rules or []] for r in df.collect()}
    assert all(got[i] == [(f"r{i}", f"t{i}", 1 + i % 40, ["SG"] if i % 2 else [], f"word{i} right now")] for i in range(0, 5000, 250)) and got[8] == []



def test_addresses_against_the_standard_library(spark):
    import ipaddress
    import random

    from sievemark.functions import addresses as A

    r = random.Random(1)
    ranges = [ipaddress.ip_network(x) for x in (*A.PRIVATE_V4, *A.PUBLIC_V4, *A.PRIVATE_V6, *A.PUBLIC_V6, *A.RESERVED_V6) if x != "3fff::/20"]
    edges = {x for net in ranges for x in (net[0], net[-1], net[0] - 1 if int(net[0]) else net[0])}
    values = {str(x) for x in edges if x.version == 4 or x not in ipaddress.ip_network("3fff::/20")}
    values |= {str(ipaddress.IPv6Address(r.getrandbits(128))) for _ in range(200)} | {str(ipaddress.IPv4Address(r.getrandbits(32))) for _ in range(100)}
    values |= {":".join(r.choice(["0", "0", "0", "a", "1F", "ffff", "00ab"]) for _ in range(r.choice([8, 8, 7, 9]))) for _ in range(300)} | {":".join(r.choice(["", "0", "1", "ab"]) for _ in range(r.randint(2, 9))) for _ in range(600)}
    values |= {r.choice(["::ffff:", "::FFFF:", "::", "64:ff9b::", "1:2:3:4:5:6:", "1:2:3:4:5:6:7:"]) + ".".join(str(r.randint(0, 260)) for _ in range(4)) for _ in range(200)}
    values |= {":", "::", ":::", "1::2::3", "12345::", "g::", "", " ::1", "[::1]", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2:3:4:5:6:7:8", "::1.2.3", "::1.2.3.4.5", "::01.2.3.4", "::ffff:10.0.0.1"}
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", A.is_ip(F.col("v")).alias("ip"), A.non_public(F.col("v")).alias("hidden"), A.v6_text(A.v6_numbers(F.col("v"))).alias("text"))
    for x in df.collect():
        try:
            ip = ipaddress.ip_address(x.v)
        except ValueError:
            assert not x.ip and x.text is None, x.v
            continue
        assert x.ip and x.hidden == (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved), x.v
        assert x.text is None if ip.version == 4 else ipaddress.ip_address(x.text) == ip and (ip.ipv4_mapped or x.text == ip.compressed), x.v


def test_public_suffixes(spark, tmp_path):
    from sievemark.functions.urls import load_suffixes, use_suffixes

    def sites(hosts):
        return {r.h: r.r for r in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", registrable(F.col("h")).alias("r")).collect()}

    own = {
        "a.b.ck": "a.b.ck", "x.a.b.ck": "a.b.ck", "y.www.ck": "www.ck", "www.ck": "www.ck", "b.ck": "b.ck", "co.uk": "co.uk", "x.github.io": "x.github.io", "a.x.github.io": "x.github.io", "shop.example.co.il": "example.co.il",
        "a.city.kobe.jp": "city.kobe.jp", "a.b.c.kobe.jp": "b.c.kobe.jp", "c.kobe.jp": "c.kobe.jp", "ck": "ck", "[::1]": "::1", "b.com": "b.com", "x.b.com": "b.com", "e.d.compute.amazonaws.com": "e.d.compute.amazonaws.com",
    }
    assert sites(own) == own
    (tmp_path / "list.dat").write_text("// mine\n\ncorp\nteam.corp trailing words\n*.guest.corp\n!vip.guest.corp\nbücher.example.shop\n")
    before = use_suffixes(load_suffixes(spark, str(tmp_path)))
    try:
        want = {"a.b.corp": "b.corp", "x.a.team.corp": "a.team.corp", "z.y.x.guest.corp": "y.x.guest.corp", "q.vip.guest.corp": "vip.guest.corp", "a.co.uk": "co.uk", "w.v.xn--bcher-kva.example.shop": "v.xn--bcher-kva.example.shop"}
        assert sites(want) == want
    finally:
        use_suffixes(before)
