"""Sender fields against the standard library's parser, over generated fields of all kinds."""

import random
from email.utils import getaddresses, parseaddr

from pyspark.sql import functions as F

from sievemark.functions.mailboxes import host_of, mailbox, mailboxes
from sievemark.operators.headers import with_headers

PARTS = [
    "Ann Lee", '"Lee, Ann"', '"x@bank.example"', '"a \\"b\\" c"', "", "ann@corp.example", "<ann@corp.example>", "<@route.example:ann@corp.example>", "(a comment)", "(nested (one))", "group: a@b.example, c@d.example;", "undisclosed:;",
    '"quoted@local"@corp.example', "a@b@c.example", "ann@[10.0.0.1]", "plain", ",", ";", " ", "\n", "é <é@corp.example>", "=?utf-8?q?Ann?= <ann@corp.example>", "<", ">", '"', "ann @ corp.example", "Ann <ann@corp.example>, Bob <bob@other.example>", "a.b@c", ".a@b.example",
]


def fields():
    r = random.Random(2)
    return sorted({*PARTS, *("".join(r.choice(PARTS) + r.choice(["", " ", ", "]) for _ in range(r.randint(1, 4))) for _ in range(600))})


def test_mailboxes(spark):
    every = fields()
    df = spark.createDataFrame([(f,) for f in every], "f string").select("f", F.get(mailboxes(F.col("f"), F.lit(None).cast("string")), F.lit(0)).alias("m"))
    for r in df.select("f", "m", host_of(F.col("m.address")).alias("host")).collect():
        name, address = parseaddr(r.f)
        assert (r.m.name, r.m.address, r.m["all"]) == (name, address, [a for _, a in getaddresses(r.f.splitlines()) if a]), r.f
        assert r.host == (address.lower().rsplit("@", 1)[-1].strip(".>") if "@" in address else ""), r.f
    assert mailbox("") == {"name": "", "address": "", "all": []}


def test_checks_read_the_grammar(spark):
    cases = {
        '"service@paypal.com" <x@evil.example>': {"DISPLAY_NAME_BRAND_IMPERSONATION"},
        "Ann (sales, north) <ann@corp.example>": set(),
        "Ann <ann@corp.example>, Bob <bob@other.example>": {"MULTIPLE_FROM_ADDRESSES"},
        '"Lee, Ann" <ann@corp.example>': set(),
    }
    rows = spark.createDataFrame([(f, {"from": f, "message-id": "<1@corp.example>"}) for f in cases], "f string, headers map<string,string>")
    for r in with_headers(rows).collect():
        codes = {x.code for x in (*r.sender.findings, *r.sender.impersonation)} - {"MESSAGE_ID_DOMAIN_MISMATCH"}
        assert codes == cases[r.f], r.f
