"""Whole messages: fifteen phishing and five genuine ones of our own, their reports, trusted authentication, streams."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sievemark.operators.headers import with_headers
from sievemark.operators.reports import docx_column, html_column, json_column, lines_column, pdf_column, stix_column
from sievemark.plans.samples import with_file, zipped
from sievemark.plans.triage import analyze
from sievemark.streaming.limiter import limited_stream

RANK = ("low", "suspicious", "likely_phishing", "high")


def mail(sender, subject, body, kind="text/plain", **headers):
    head = {"From": sender, "To": "you@corp.example", "Subject": subject, "Message-ID": f"<1@{sender.rpartition('@')[2].rstrip('>')}>", "Content-Type": f"{kind}; charset=utf-8"} | {k.replace("_", "-"): v for k, v in headers.items()}
    return ("".join(f"{k}: {v}\n" for k, v in head.items()) + "\n" + body).encode()


def filed(sender, subject, name, kind, data):
    return with_file(name, kind, data).replace(b"From: a@b.example\nSubject: s\n", f"From: {sender}\nSubject: {subject}\nMessage-ID: <1@b.example>\n".encode())


CASES = {
    "P01": ("likely_phishing", mail("PayPal <service@paypa1-secure.com>", "Account suspended", "Your account is suspended. Verify your password immediately at http://paypal.com.login-check.example/verify", Authentication_Results="mx.other.example; spf=fail", Reply_To="help@recovery.example.org")),
    "P02": ("suspicious", mail("Chief <boss@corp.example>", "Quick favour", "Are you at your desk? I need you to buy gift cards, scratch them and send me the codes. Keep this confidential.", Reply_To="boss@mailbox.example.org")),
    "P03": ("suspicious", mail("Accounts <ap@supplier.example>", "Re: invoice", "Our bank details have changed. Please send the urgent wire payment to the new bank account IBAN DE89370400440532013000 today.", In_Reply_To="<a@b>", References="<a@b>")),
    "P04": ("suspicious", mail("Sam <sam@staff.example>", "Payroll", "Please update my direct deposit for payroll to a new bank account before payday. Change my salary account today.")),
    "P05": ("likely_phishing", filed("a@b.example", "Open the secure document", "doc.html", "text/html", b"<script>var b = new Blob([atob('eA==')]);URL.createObjectURL(b)</script>")),
    "P06": ("likely_phishing", filed("a@b.example", "Invoice", "invoice.pdf.exe", "application/octet-stream", b"MZ\x90")),
    "P07": ("likely_phishing", filed("a@b.example", "Invoice attached", "report.docm", "application/zip", zipped(members={"word/vbaProject.bin": "x"}))),
    "P08": ("likely_phishing", filed("a@b.example", "Delivery", "parcel.zip", "application/zip", zipped(members={"parcel.iso": "x"}))),
    "P09": ("suspicious", mail("Billing <b@renew.example>", "Subscription renewal", "Your subscription renewal was charged 399 dollars. To cancel and get a refund call our support at +1 415 555 0100 today.")),
    "P10": ("suspicious", mail("Docs <d@share.example>", "Shared", '<a href="https://bit.ly/x?url=https%3A%2F%2Fevil.example.net%2Flogin">https://sharepoint.example.com/doc</a> verify your account', "text/html")),
    "P11": ("likely_phishing", mail("Team <t@x.example>", "Verify", "Verify your account password now: https://xn--pypal-4ve.com/login‮gnp")),
    "P12": ("suspicious", mail("Form <f@x.example>", "Form", '<a href="https://sites.google.com/view/login-form">https://portal.corp.example/login</a> please log in to verify your account', "text/html")),
    "P13": ("likely_phishing", mail("Wallet <w@wallet.example>", "Restore your wallet", "Enter your seed phrase and wallet recovery phrase at http://metamask-restore.example.com/login to verify your account immediately")),
    "P14": ("suspicious", mail("Impots <i@impots-gouv.example>", "Remboursement", "Vous avez droit a un remboursement d impot. Confirmez vos coordonnees bancaires: http://impots-remboursement.example.com/verify")),
    "P15": ("suspicious", mail("Post <p@post.example>", "Parcel", '<div style="display:none">filler</div>Your parcel delivery failed, pay the delivery fee: <a href="http://post-fee.example.com/pay">pay</a><img src="http://track.example.com/p.gif">', "text/html")),
    "B01": ("low", mail("Shop <news@shop.example>", "Sale ends today", "Last chance: everything is 20 percent off until midnight. Visit https://www.shop.example/sale", List_Unsubscribe="<https://www.shop.example/u>", List_Id="<news.shop.example>")),
    "B02": ("low", mail("Bank <info@bank.example>", "Stay safe", "We will never ask you for your password. Do not share your one-time code with anyone.")),
    "B03": ("low", mail("IT <it@corp.example>", "Your monthly summary", "Your usage summary is ready. See https://intranet.corp.example/usage")),
    "B04": ("low", mail("Legal <sign@corp.example>", "Contract for review", "The contract we discussed on Monday is ready. It is at https://docs.corp.example/contract")),
    "B05": ("low", filed("a@b.example", "Team lunch", "lunch.ics", "text/calendar", b"BEGIN:VCALENDAR\nSUMMARY:Team lunch\nLOCATION:Canteen\nEND:VCALENDAR\n")),
}


@pytest.fixture(scope="module")
def results(spark):
    rows = spark.createDataFrame([(k, bytearray(m)) for k, (_, m) in CASES.items()], "id string, content binary")
    return analyze(rows, keep=["id"]).persist()


def test_cases(results):
    got = {r.id: (r.risk, r.score, r.classification, sorted({f.code for f in r.findings})) for r in results.collect()}
    wrong = {k: (least, got[k]) for k, (least, _) in CASES.items() if (got[k][0] != "low" if k[0] == "B" else RANK.index(got[k][0]) < RANK.index(least))}
    assert not wrong, "\n".join(f"{k}: {v}" for k, v in wrong.items())


def test_reports(results):
    r = results.where("id = 'P10'").select(json_column(results.drop("id")).alias("j"), lines_column().alias("l"), html_column().alias("h"), stix_column(F.lit("2024-01-01T00:00:00Z")).alias("s"), docx_column(lines_column()).alias("d"), pdf_column(lines_column()).alias("p"), "links").first()
    assert json.loads(r.j)["links_found"] == len(r.links) > 0
    assert r.l[0] == "Message triage report" and any("Destinations" in x for x in r.l)
    assert r.h.startswith("<!doctype html>") and "<script" not in r.h and r.h.count("<li>") == len(r.l)
    bundle = json.loads(r.s)
    assert bundle["type"] == "bundle" and bundle["objects"] and all(o["type"] == "indicator" and o["pattern"].startswith("[url:value = '") for o in bundle["objects"])
    assert len({o["id"] for o in bundle["objects"]}) == len(bundle["objects"])
    assert "Message triage report" in zipfile.ZipFile(io.BytesIO(r.d)).read("word/document.xml").decode() and r.p.startswith(b"%PDF-1.4")


def test_trusted_authentication(spark):
    block = "mx.corp.example; spf=pass smtp.mailfrom=other.example; dkim=fail header.d=a.example"
    rows = spark.createDataFrame([(block,), ("mx.evil.example; dmarc=pass",)], "a string").select(F.create_map(F.lit("from"), F.lit("x@a.example"), F.lit("message-id"), F.lit("<1@a.example>"), F.lit("authentication-results"), F.col("a")).alias("headers"))
    codes = [({f.code for f in r.sender.findings}, r.sender.authentication) for r in with_headers(rows, trusted=("MX.corp.example.",)).collect()]
    assert codes == [({"DKIM_FAIL", "DMARC_ALIGNMENT_FAILURE"}, "evaluated"), ({"AUTH_RESULTS_UNTRUSTED"}, "not_evaluated")]


def test_limited_stream(spark, tmp_path):
    spark.createDataFrame([("a", i * 10) for i in range(5)] + [("b", 0), ("a", 100)], "client string, s int").select("client", F.timestamp_seconds(F.col("s") + 1000).alias("ts")).write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema("client string, ts timestamp").parquet(f"{tmp_path}/in")
    run = limited_stream(events, "client", "ts", limit=2, window=60.0).writeStream.format("memory").queryName("limited_rows").outputMode("append").trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    got = {(r.client, int(r.ts.timestamp()) - 1000): r.accepted for r in spark.table("limited_rows").collect()}
    assert got == {("a", 0): True, ("a", 10): True, ("a", 20): False, ("a", 30): False, ("a", 40): False, ("a", 100): True, ("b", 0): True}


def test_command_line(tmp_path, spark):
    from sievemark.__main__ import main

    (tmp_path / "a.eml").write_bytes(CASES["P06"][1])
    (tmp_path / "feed.txt").write_text("# known\nevil.example\n")
    assert main([str(tmp_path), "--out", str(tmp_path / "out"), "--formats", "json,txt,html,stix,pdf,docx", "--feed", str(tmp_path / "feed.txt")]) == 0
    names = sorted(p.name.rpartition(".")[2] for p in (tmp_path / "out").iterdir())
    assert names == ["docx", "html", "json", "pdf", "stix", "txt"]
    assert json.loads(next((tmp_path / "out").glob("*.json")).read_text())["risk"] in RANK


def test_sql_functions(spark):
    from sievemark.functions.registered import register

    register(spark)
    held = zipped(members={"a.xml": "<x/>", "b.txt": "b"}, links=("b.txt",))
    spark.createDataFrame([(bytearray(held),)], "data binary").createOrReplaceTempView("archives")
    assert [(r.name, r.symlink, r.text) for r in spark.sql("SELECT m.* FROM archives, LATERAL zip_members(data) m").collect()] == [("a.xml", False, "<x/>"), ("b.txt", True, None)]
    row = spark.sql("SELECT risk_label(80) AS r, masked('phone', '+65 6123 4567').masked AS m, web_links('see https://a.example/x.') AS l, registrable_domain('a.b.example.co.uk') AS d").first()
    assert (row.r, row.m, row.l, row.d) == ("high", "***4567", ["https://a.example/x"], "example.co.uk")
    hosts = {"a.b.ck": "a.b.ck", "x.a.b.ck": "a.b.ck", "y.www.ck": "www.ck", "a.x.github.io": "x.github.io", "b.test": "b.test", "a.b.test": "b.test", "10.0.0.1": "10.0.0.1", "one": "one", "[::1]": "::1", "A.Com.": "a.com"}
    found = spark.createDataFrame([(h,) for h in hosts], "h string").selectExpr("h", "registrable_domain(h) AS d").collect()
    assert {r.h: r.d for r in found} == hosts


def test_own_rules(spark, tmp_path):
    from sievemark.functions.wording import load_rules, with_rules

    rule = {"rule_id": "own-1", "category": "Own", "language": "en", "title": "Own words", "points": 9, "regions": ["SG"], "pattern": r"\bblue moon\b"}
    (tmp_path / "pack.json").write_text(json.dumps([rule]))
    rules = load_rules(spark, str(tmp_path / "pack.json"))
    got = with_rules(spark.createDataFrame([("a Blue Moon rose",), ("nothing",)], "t string"), "t", rules=rules).collect()
    assert [[(x.rule_id, x.evidence) for x in r._rules] for r in got] == [[("own-1", "Blue Moon")], []]
    (tmp_path / "bad.json").write_text(json.dumps([rule | {"points": 90, "pattern": "("}, rule | {"rule_id": "own-1"}]))
    with pytest.raises(ValueError, match="points out of range.*doesn't compile|rule id used twice"):
        load_rules(spark, str(tmp_path / "bad.json"))


def test_plain_header_fields_read_as_the_default_policy_reads_them():
    import random
    from email import message_from_bytes, policy

    from sievemark.sources.mail import PLAIN

    names = ("From", "To", "Cc", "Sender", "Reply-To", "Subject", "Message-ID", "Received", "X-Other", "Return-Path", "Date", "Content-Type")
    fixed = ["a@b.c", "Bob <bob@corp.example>", "A B <x.y@z>", '"Q" <a@b>', "<a@b>", "a@b, c@d", "g: a@b;", "=?utf-8?q?a?= <a@b>", "a=?b?c@d", "two  spaces", "w " * 80 + "w", "é <a@b>", "A <a@b>\n folded", "", "a@b (c)", "<1@x.example>", "<1.2@x>", "a.b <c@d>"]
    rng = random.Random(3)
    drawn = ["".join(rng.choice("ab.@<>=?, \"(;é") for _ in range(rng.randint(1, 10))) for _ in range(1500)]

    def told(name, value, by):
        try:
            return [str(x) for x in message_from_bytes(f"{name}: {value}\n\nx".encode(), policy=by).get_all(name, [])]
        except Exception as error:  # noqa: BLE001 - the library's own faults stay as they are
            return type(error).__name__

    for value in fixed + drawn:
        for name in names if value in fixed else rng.sample(names, 3):
            assert told(name, value, PLAIN) == told(name, value, policy.default), (name, value)
    bob = message_from_bytes(b"From: Bob <bob@corp.example>\n\nx", policy=PLAIN)
    assert type(bob["from"]) is str  # not parsed


def test_large_expressions_are_written_once(spark):
    """Whatever is asked of the results, the optimizer copies no check of senders or links to where it is used."""
    from sievemark.plans.triage import analyze

    rows = spark.createDataFrame([(b"From: a@b.example\n\nx",)], "content binary")
    results = analyze(rows)
    plan = results.select("score", "confidence", "findings", "evidence_status")._jdf.queryExecution().optimizedPlan()
    # suffix rules of hosts, a few uses for senders, links and labels; 383 when each use had its own
    assert plan.toString().count("fly.dev") < 40


def test_rows_of_findings_judge_messages_once(spark):
    from sievemark.plans.triage import finding_rows

    body = b"Verify your account password immediately at http://paypa1.com/login and http://1.2.3.4/x"
    rows = spark.createDataFrame([(b"From: PayPal <x@paypa1-secure.com>\nSubject: s\nMessage-ID: <1@b.example>\n\n" + body,), (with_file("a.pdf.exe", "x/y", b"MZ"),), (b" ",)], "content binary")
    results = analyze(rows)
    told = finding_rows(results)
    # the messages, and the messages again for their links
    assert told._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    expected = set()
    for r in results.collect():
        own = [("message", 0, r.findings or [])] + [("link", x.ordinal, x.findings) for x in r.links or []] + [("attachment", n, x.findings) for n, x in enumerate(r.attachments or [])]
        expected |= {(r.message_id, scope, number, i, *f) for scope, number, found in own for i, f in enumerate(found)}
    got = [tuple(r) for r in told.collect()]
    assert set(got) == expected and len(got) == len(expected)
    assert {r[1] for r in got} == {"message", "link", "attachment"}
