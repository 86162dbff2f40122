"""Queries of the engine's own operators over the driver's tables, and the SQL that each is held against.

The tables hold no lures, so inputs are templates: expressions over keys that
Spark and the checking engine read alike. ``mod`` spreads the cases over all
rows, so that every check fires on some and not on others.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import redacted, risk_label, spread, uuid5
from ..functions.packs import CONTENT_RULES, NEGATIONS
from ..functions.scoring import WEIGHTS, triage_score
from ..functions.similarity import cosine_rows
from ..functions.unicode import host_names
from ..functions.urls import brand_hits, parts, with_links
from ..functions.wording import category_points, indicators, strongest, with_rules
from ..operators.attachments import RULES
from ..operators.feeds import matches
from ..operators.headers import with_headers
from ..operators.qr_payloads import with_payload
from ..operators.reports import NAMESPACE_URL
from ..sources.html import Page
from ..sources.mail import parsed
from ..sources.qr import with_codes
from ..streaming.limiter import counts_by_window, limited
from .samples import FILES, code_image, messages
from .triage import analyze, finding_rows, summary_cube

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(key: str, cases: list[str], otherwise: str = "''") -> str:
    return f"CASE {key} % {len(cases)} " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(cases)) + f" ELSE {otherwise} END"


# links

URL_SQL = _case("page_id", [
    "url", "concat('http://user:pw@shop', page_id, '.example.com/verify/account?x=1')", "concat('https://bit.ly/login', page_id)", "concat('https://a.b.c.host', page_id % 5, '.example.org/p')",
    "concat('https://very-long-name-with-hyphens', page_id, '.example.net:8443/update')", "concat('https://site', page_id % 7, '.sample.com/', repeat('x', 200))",
    "concat('https://q.example.com/?a=1&b=2&c=3&d=4&e=5&f=6&g=7&h=8&i=9&j=10&k=11&l=12&m=', page_id)", "concat('https://enc.example.com/%41%42%43%44%45%46%47%48%49%4A%4B', page_id)", "url",
])
TRIAGE_CODES = ("HTTP_ONLY", "USERINFO", "SHORTENER", "DEEP_SUBDOMAIN", "LONG_URL", "PHISHING_TERMS", "UNUSUAL_PORT", "MANY_PARAMETERS", "EXCESSIVE_PERCENT_ENCODING", "MANY_HYPHENS")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").selectExpr("page_id", f"{URL_SQL} AS url")
    return with_links(spread(pages), "url").select("page_id", "link.*")


def url_triage_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three links with the highest score of each registrable domain."""
    counted = F.aggregate(F.filter("findings", lambda f: f["code"].isin(*TRIAGE_CODES)), F.lit(0), lambda acc, f: acc + f["points"])
    lifted = F.exists("findings", lambda f: f["code"] == "PHISHING_TERMS") & F.exists("findings", lambda f: f["code"] == "SHORTENER")
    rows = _links(spark, sf_dir).select("page_id", "registrable_domain", F.greatest(F.least(F.lit(100), counted), F.when(lifted, 25).otherwise(0)).alias("score"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("registrable_domain").orderBy(F.col("score").desc(), "page_id"))
    return rows.withColumn("rank", rank).where("rank <= 3").withColumn("risk", risk_label(F.col("score"))).select("page_id", "registrable_domain", F.col("score").cast("int").alias("score"), "risk", "rank")


_HOST = "lower(regexp_extract(u, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_TERMS = "login signin verify secure account update password wallet invoice payment auth".split()
_TERM_SUM = " + ".join(f"(CASE WHEN contains(tail, '{t}') THEN 1 ELSE 0 END)" for t in _TERMS)
URL_TRIAGE_SQL = f"""
WITH v AS (SELECT page_id, {URL_SQL} AS u FROM pages),
p AS (SELECT page_id, u, {_HOST} AS host, regexp_replace(u, '#.*$', '') AS bare, lower(regexp_replace(regexp_replace(u, '#.*$', ''), '^[A-Za-z]+://[^/?#]*', '')) AS tail FROM v),
n AS (SELECT *, {_TERM_SUM} AS terms, string_split(host, '.') AS labels, length(bare) + CASE WHEN tail = '' THEN 1 ELSE 0 END AS size FROM p),
s AS (SELECT page_id, array_to_string(labels[-2:], '.') AS registrable_domain,
  CASE WHEN starts_with(lower(u), 'http://') THEN 8 ELSE 0 END + CASE WHEN regexp_matches(u, '^[A-Za-z]+://[^/?#]*@') THEN 25 ELSE 0 END
  + CASE WHEN host = 'bit.ly' THEN 15 ELSE 0 END + CASE WHEN len(labels) >= 5 THEN 8 ELSE 0 END + CASE WHEN size > 180 THEN 8 ELSE 0 END
  + CASE WHEN terms > 0 THEN least(15, 5 + 2 * terms) ELSE 0 END + CASE WHEN regexp_matches(u, '^[A-Za-z]+://[^/?#]*:8443(/|$)') THEN 12 ELSE 0 END
  + CASE WHEN contains(bare, '?') AND len(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&')) > 12 THEN 5 ELSE 0 END
  + CASE WHEN len(regexp_extract_all(tail, '%[0-9a-f][0-9a-f]')) >= 10 THEN 6 ELSE 0 END + CASE WHEN length(host) - length(replace(host, '-', '')) >= 4 THEN 6 ELSE 0 END AS points,
  CASE WHEN terms > 0 AND host = 'bit.ly' THEN 25 ELSE 0 END AS floor FROM n),
r AS (SELECT page_id, registrable_domain, greatest(least(100, points), floor) AS score FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY registrable_domain ORDER BY score DESC, page_id) AS rank FROM r)
SELECT page_id, registrable_domain, CAST(score AS INTEGER) AS score, CASE WHEN score >= 75 THEN 'high' WHEN score >= 50 THEN 'likely_phishing' WHEN score >= 25 THEN 'suspicious' ELSE 'low' END AS risk, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3
"""


_FIRED = (
    ("HTTP_ONLY", "starts_with(lower(u), 'http://')", "8"), ("USERINFO", "regexp_matches(u, '^[A-Za-z]+://[^/?#]*@')", "25"), ("SHORTENER", "host = 'bit.ly'", "15"), ("DEEP_SUBDOMAIN", "len(labels) >= 5", "8"), ("LONG_URL", "size > 180", "8"),
    ("PHISHING_TERMS", "terms > 0", "least(15, 5 + 2 * terms)"), ("UNUSUAL_PORT", "regexp_matches(u, '^[A-Za-z]+://[^/?#]*:8443(/|$)')", "12"), ("MANY_PARAMETERS", "contains(bare, '?') AND len(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&')) > 12", "5"),
    ("EXCESSIVE_PERCENT_ENCODING", "len(regexp_extract_all(tail, '%[0-9a-f][0-9a-f]')) >= 10", "6"), ("MANY_HYPHENS", "length(host) - length(replace(host, '-', '')) >= 4", "6"),
)
URL_COUNTS_SQL = URL_TRIAGE_SQL[: URL_TRIAGE_SQL.index("s AS (SELECT")].rstrip().rstrip(",") + " SELECT code, count(*) AS n, CAST(sum(points) AS BIGINT) AS points FROM (" + " UNION ALL ".join(f"SELECT '{code}' AS code, {points} AS points FROM n WHERE {when}" for code, when, points in _FIRED) + ") GROUP BY code"


def url_finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each check fires."""
    return _links(spark, sf_dir).select(F.explode_outer("findings").alias("f")).where("f IS NOT NULL").groupBy(F.col("f.code").alias("code")).agg(F.count("*").alias("n"), F.sum("f.points").alias("points"))


PACKED = "((page_id * 65537 + 16909060) % 4294967296)"


def url_obfuscated_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses written as one number, in dotted form, and whether they are public."""
    pages = _table(spark, sf_dir, "pages").selectExpr("page_id", f"concat('https://', {PACKED}, '/') AS url")
    link = with_links(pages, "url").select("page_id", F.explode_outer("link.findings").alias("f")).where("f.code = 'OBFUSCATED_IP'")
    return link.select("page_id", F.element_at(F.split("f.evidence", " -> "), 2).alias("address"))


URL_IP_SQL = f"SELECT page_id, concat(p // 16777216, '.', (p // 65536) % 256, '.', (p // 256) % 256, '.', p % 256) AS address FROM (SELECT page_id, {PACKED} AS p FROM pages)"

BRAND_CASES = (("paypa1", "paypal"), ("micros0ft-support", "microsoft"), ("googel", "google"), ("pineapple", None), ("secure-dbs", "dbs"), ("amazom", "amazon"), ("rnicrosoft", "microsoft"), ("mashable", None))
BRAND_SQL = _case("s_suppkey", [f"'{name}'" for name, _ in BRAND_CASES])


def brand_lookalikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts by the brand they imitate."""
    hosts = _table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"concat({BRAND_SQL}, '.com') AS host")
    hits = hosts.withColumn("names", host_names(F.col("host"))).select("host", F.explode_outer(brand_hits(F.col("host"), F.col("names"))).alias("b"))
    return hits.groupBy("host", F.coalesce("b.brand", F.lit("none")).alias("brand")).agg(F.count("*").alias("n"))


BRAND_ORACLE = f"SELECT concat(name, '.com') AS host, CASE name {' '.join(f"WHEN '{n}' THEN '{b or 'none'}'" for n, b in BRAND_CASES)} END AS brand, count(*) AS n FROM (SELECT {BRAND_SQL} AS name FROM supplier) GROUP BY ALL"


def feed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose host, or the SHA-256 of whose address, is in a feed built from some of the pages."""
    links = with_links(spread(_table(spark, sf_dir, "pages").select("page_id", "url")), "url").select("page_id", "link.normalized_url", "link.host")
    listed = links.where("page_id % 10 = 0").select(F.lit("hosts").alias("feed"), F.col("host").alias("indicator")).union(links.where("page_id % 10 = 1").select(F.lit("digests"), F.sha2("normalized_url", 256))).distinct()
    return matches(links, listed, "page_id").groupBy("feed").agg(F.count("*").alias("links"), F.countDistinct("indicator").alias("indicators"))


FEED_SQL = f"""
WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
l AS (SELECT page_id, {_HOST} AS host, u FROM p),
f AS (SELECT DISTINCT 'hosts' AS feed, host AS indicator FROM l WHERE page_id % 10 = 0 UNION SELECT DISTINCT 'digests', sha256(u) FROM l WHERE page_id % 10 = 1),
n AS (SELECT page_id, host AS indicator FROM l UNION SELECT page_id, sha256(u) FROM l UNION SELECT page_id, lower(u) FROM l),
m AS (SELECT page_id, feed, min(indicator) AS indicator FROM n JOIN f USING (indicator) GROUP BY ALL)
SELECT feed, count(*) AS links, count(DISTINCT indicator) AS indicators FROM m GROUP BY feed
"""

# wording

LURES = (
    "Dear customer, your parcel delivery failed today", "Please log in now and check the news", "Urgent wire payment of the open invoice", "Never scan gift cards for strangers", "We love gift cards and itunes",
    "Guaranteed profit with crypto", "Winner of the lottery, claim the fee", "Your card is blocked, verify it: bank fraud click", "Part time remote job, earn on telegram", "Lunch at noon", "验证账户 please",
    "Dringend zahlung der rechnung", "paquete pendiente tarifa", "Do not buy steam cards",
)
LURE_SQL = "concat(" + _case("o_orderkey", [f"'{x}'" for x in LURES]) + ", ' no ', o_orderkey)"
_PATTERNS = [(r[0], re.sub(r"\(\?![^()]*(?:\([^()]*\))*[^()]*\)$", "", r[6])) for r in CONTENT_RULES]


def content_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each wording rule holds in templated messages; negated matches don't count."""
    lures = _table(spark, sf_dir, "orders").selectExpr(f"{LURE_SQL} AS text")
    return with_rules(spread(lures), "text").select(F.explode_outer("_rules.rule_id").alias("rule_id")).where("rule_id IS NOT NULL").groupBy("rule_id").agg(F.count("*").alias("n"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NEGATED = _quoted("|".join(f"(?:{p})" for p in NEGATIONS))
CONTENT_SQL = f"WITH t AS (SELECT {LURE_SQL} AS t FROM orders), r(rule_id, p) AS (VALUES {', '.join(f'({_quoted(i)}, {_quoted("(?is)" + p)})' for i, p in _PATTERNS)})" + f"""
, d AS (SELECT t, count(*) AS n FROM (SELECT regexp_replace(t, ' no [0-9]+$', ' no 1') AS t FROM t) GROUP BY t)
, m AS (SELECT rule_id, t, n, regexp_extract(t, p) AS hit FROM d, r WHERE regexp_matches(t, p))
SELECT rule_id, CAST(sum(n) AS BIGINT) AS n FROM m WHERE NOT regexp_matches(right(left(t, strpos(t, hit) - 1), 55), concat('(?is)', {_NEGATED})) GROUP BY rule_id
"""


def category_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by category of each order's line items, and the strongest category, the first of equals."""
    items = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "concat('c', l_suppkey % 3) AS category", "CAST(l_partkey % 5 AS INT) AS points")
    rows = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "category", "points"))).alias("e"))
    scores = rows.select("l_orderkey", category_points(F.transform("e", lambda x: F.struct(x["category"].alias("category"), x["points"].alias("points")))).alias("s"))
    return scores.groupBy(strongest(F.col("s")).alias("classification")).agg(F.count("*").alias("orders"), F.sum(F.array_max(F.transform("s", lambda x: x["points"]))).alias("points"))


ARGMAX_SQL = """
WITH c AS (SELECT l_orderkey, concat('c', l_suppkey % 3) AS category, sum(l_partkey % 5) AS points, min(l_linenumber) AS first FROM lineitem GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY points DESC, first, category) AS r FROM c)
SELECT category AS classification, count(*) AS orders, CAST(sum(points) AS BIGINT) AS points FROM k WHERE r = 1 GROUP BY category
"""
DIMS = {"sender_authenticity": "l_partkey % 101", "message_intent": "l_suppkey % 101", "destination_risk": "(l_orderkey * 7) % 101", "payload_risk": "(l_linenumber * 13) % 101"}


def triage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of templated dimensions by risk."""
    dims = _table(spark, sf_dir, "lineitem").selectExpr(*(f"CAST({e} AS INT) AS {k}" for k, e in DIMS.items()))
    score = dims.select(triage_score({k: F.col(k) for k in DIMS}).alias("score"))
    return score.groupBy(risk_label(F.col("score")).alias("risk")).agg(F.count("*").alias("n"), F.sum("score").alias("total"))


SCORE_SQL = f"""
WITH d AS (SELECT {', '.join(f'{e} AS {k}' for k, e in DIMS.items())} FROM lineitem),
b AS (SELECT greatest({', '.join(DIMS)}) AS peak, CAST(round_even({' + '.join(f'{k} * CAST({WEIGHTS[k]} AS DOUBLE)' for k in DIMS)}, 0) AS BIGINT) + CASE WHEN {' + '.join(f'CAST({k} >= 12 AS INT)' for k in DIMS)} >= 2 THEN 10 ELSE 0 END AS blend FROM d),
s AS (SELECT least(100, greatest(peak, blend)) AS score FROM b)
SELECT CASE WHEN score >= 75 THEN 'high' WHEN score >= 50 THEN 'likely_phishing' WHEN score >= 25 THEN 'suspicious' ELSE 'low' END AS risk, count(*) AS n, CAST(sum(score) AS BIGINT) AS total FROM s GROUP BY risk
"""


SAMPLE_SQL = "concat(" + _case("n_nationkey", ["'small widget'", "'cold bolt'", "'large gear'", "'hot nut'"]) + ", ' ', n_nationkey)"


def ngram_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names and templated samples whose character n-grams are alike."""
    rows = cosine_rows(_table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("t")), _table(spark, sf_dir, "nation").selectExpr("n_nationkey", f"{SAMPLE_SQL} AS t"), "p_partkey", "n_nationkey", "t")
    return rows.select("p_partkey", "n_nationkey", F.round("cosine", 6).alias("cosine"))


def _grams(key: str, column: str, source: str) -> str:
    cut = " UNION ALL ".join(f"SELECT k, substr(s, i, {n}) AS gram FROM (SELECT k, s, unnest(range(1, length(s) - {n - 2})) AS i FROM {source}_s WHERE length(s) >= {n})" for n in (3, 4))
    return f"{source}_s AS (SELECT {key} AS k, regexp_replace(lower({column}), '[^a-z0-9]+', '_', 'g') AS s FROM {source}), {source}_g AS (SELECT k, gram, count(*) AS n FROM ({cut}) GROUP BY ALL)"


COSINE_SQL = f"""
WITH {_grams('p_partkey', 'p_name', 'part')}, {_grams('n_nationkey', SAMPLE_SQL, 'nation')},
a AS (SELECT k, sqrt(sum(n * n)) AS norm FROM part_g GROUP BY k), b AS (SELECT k, sqrt(sum(n * n)) AS norm FROM nation_g GROUP BY k),
d AS (SELECT p.k AS x, q.k AS y, sum(p.n * q.n) AS dot FROM part_g p JOIN nation_g q USING (gram) GROUP BY ALL)
SELECT x AS p_partkey, y AS n_nationkey, round(dot / (a.norm * b.norm), 6) AS cosine FROM d JOIN a ON a.k = x JOIN b ON b.k = y
"""


def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked and hashed forms of templated phone numbers."""
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('+65 6', c_custkey, ' 0', c_custkey % 97) AS v")
    return rows.select("c_custkey", redacted("phone", F.col("v")).alias("r")).select("c_custkey", "r.masked", "r.sha256_prefix")


REDACTION_SQL = "SELECT c_custkey, concat('***', right(v, 4)) AS masked, left(sha256(v), 16) AS sha256_prefix FROM (SELECT c_custkey, replace(concat('+65 6', c_custkey, ' 0', c_custkey % 97), ' ', '') AS v FROM customer)"


def indicator_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct masked indicators of whole documents by kind."""
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(indicators(F.coalesce("text", F.lit("")))).alias("i"))
    return docs.groupBy(F.col("i.type").alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


# senders, payloads, pages

FROM_SQL = "concat('Shop <u', c_custkey, '@mail.corp', c_custkey % 5, '.example.com>')"
REPLY_SQL = _case("c_custkey", ["''", "concat('x@corp', c_custkey % 5, '.example.com')", "'x@elsewhere.org'"])


def header_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often sender checks fire on templated headers."""
    rows = _table(spark, sf_dir, "customer").selectExpr(f"map('from', {FROM_SQL}, 'reply-to', {REPLY_SQL}, 'message-id', CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('<', c_custkey, '@corp.example.com>') END, 'in-reply-to', CASE WHEN c_custkey % 5 = 0 THEN '<a@b>' ELSE '' END) AS headers")
    return with_headers(rows).select(F.explode_outer("sender.findings").alias("f")).where("f IS NOT NULL").groupBy(F.col("f.code").alias("code")).agg(F.count("*").alias("n"), F.sum("f.points").alias("points"))


HEADER_SQL = """
SELECT code, count(*) AS n, CAST(sum(points) AS BIGINT) AS points FROM (
  SELECT 'REPLY_TO_MISMATCH' AS code, 14 AS points FROM customer WHERE c_custkey % 3 = 2 UNION ALL SELECT 'MESSAGE_ID_MISSING', 4 FROM customer WHERE c_custkey % 4 = 0
  UNION ALL SELECT 'THREAD_CONTEXT_INCOMPLETE', 5 FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT 'THREAD_REPLY_ROUTE_CHANGED', 18 FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 3 = 2) GROUP BY code
"""
PAYLOADS = (("https://example.com/x", "url"), ("javascript:alert(1)", "script"), ("WIFI:S:cafe;T:WPA;P:secret;;", "wifi"), ("tel:+6561234567", "tel"), ("mailto:a@b.example", "email"), ("bitcoin:1BoatSLRHtKNngkdXEeobR76b53LETtpyT?amount=1", "crypto"), ("upi://pay?pa=shop@upi&am=5", "payment"), ("otpauth://totp/me?secret=x", "authenticator"), ("example.com/path", "url"), ("just text", "text"), ("invoice.pdf", "text"))


def qr_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templated code texts by what scanning them would do."""
    rows = _table(spark, sf_dir, "part").selectExpr(_case("p_partkey", [_quoted(v) for v, _ in PAYLOADS]) + " AS v")
    return with_payload(rows, "v").groupBy(F.col("payload.kind").alias("kind")).agg(F.count("*").alias("n"))


QR_SQL = f"SELECT {_case('p_partkey', [_quoted(k) for _, k in PAYLOADS])} AS kind, count(*) AS n FROM part GROUP BY ALL"


#: Texts of codes by kind and by the address they open; each holds the key, so that no two images are alike.
CODES = (
    ("'https://pay.example/i?n=' || s_suppkey", "url", "'https://pay.example/i?n=' || s_suppkey"), ("'javascript:alert(' || s_suppkey || ')'", "script", None), ("'WIFI:S:cafe ' || s_suppkey || ';T:WPA;P:secret;;'", "wifi", None), ("'SMSTO:+65' || s_suppkey || ':hi'", "sms", None),
    ("'tel:+65' || s_suppkey", "tel", None), ("'mailto:a' || s_suppkey || '@b.example'", "email", None), ("'bitcoin:1BoatSLRHtKNngkdXEeobR76b53LETtpyT?amount=' || s_suppkey", "crypto", None), ("'upi://pay?pa=shop@upi&am=' || s_suppkey", "payment", None),
    ("'otpauth://totp/me' || s_suppkey || '?secret=x'", "authenticator", None), ("'itms-services://?action=download-manifest&n=' || s_suppkey", "app_install", None), ("'market://details?id=a' || s_suppkey", "app_link", None), ("'geo:1.3,' || s_suppkey", "location", None),
    ("'MECARD:N:Ann ' || s_suppkey || ';;'", "contact", None), ("'00020101021126200009SG.PAYNOW0103abc5905Stall6009Singapore99' || lpad(length(CAST(s_suppkey AS STRING)), 2, '0') || s_suppkey", "payment", None), ("'myapp://open/' || s_suppkey", "app_link", None),
    ("'shop' || s_suppkey || '.example.com/menu'", "url", "'http://shop' || s_suppkey || '.example.com/menu'"), ("'see https://menu.example/' || s_suppkey || ' today'", "text", "'https://menu.example/' || s_suppkey"), ("'Tisch ' || s_suppkey || ' – Grüße 日本'", "text", None), ("'' || (s_suppkey * 104729)", "text", None),
)


def qr_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes drawn as PNG images of many kinds, read back, and what scanning them would do."""

    @F.pandas_udf("binary")
    def drawn(text, key):
        return text.combine(key, code_image)

    texts = _table(spark, sf_dir, "supplier").selectExpr("s_suppkey", _case("s_suppkey", [t for t, _, _ in CODES]) + " AS t")
    read = with_codes(spread(texts).select("s_suppkey", drawn("t", "s_suppkey").alias("content")))
    found = read.select("s_suppkey", "codes.status", F.size("codes.values").alias("symbols"), F.get("codes.values", F.lit(0)).alias("value"))
    return with_payload(found, "value").select("s_suppkey", "status", "symbols", "value", "payload.kind", "payload.url")


CODES_SQL = f"SELECT s_suppkey, 'evaluated' AS status, 1 AS symbols, {_case('s_suppkey', [t for t, _, _ in CODES])} AS value, {_case('s_suppkey', [_quoted(k) for _, k, _ in CODES])} AS kind, {_case('s_suppkey', [u or 'NULL' for _, _, u in CODES], 'NULL')} AS url FROM supplier".replace("lpad(length(CAST(s_suppkey AS STRING)), 2, '0')", "lpad(CAST(length(CAST(s_suppkey AS VARCHAR)) AS VARCHAR), 2, '0')")


def stix_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version-5 UUIDs of page addresses."""
    return _table(spark, sf_dir, "pages").select("page_id", uuid5(F.lit(NAMESPACE_URL), F.col("url")).alias("id"))


_NAME_SHA = f"sha1(unhex('{NAMESPACE_URL.replace('-', '')}') || encode(url))"
STIX_SQL = f"""
SELECT page_id, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', substr('89ab', 1 + (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1), substr(h, 18, 3), '-', substr(h, 21, 12)) AS id
FROM (SELECT page_id, {_NAME_SHA} AS h FROM pages)
"""


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors, links and indicators of whole pages, with the page's own address as base."""

    @F.pandas_udf("anchors int, links int, indicators int")
    def scanned(url, html):
        import pandas as pd

        pages = [Page(f'<base href="{escape(u or "")}">' + (h or "")) for u, h in zip(url, html, strict=True)]
        return pd.DataFrame({"anchors": [len(p.anchors) for p in pages], "links": [len(p.links) for p in pages], "indicators": [len(p.indicators) for p in pages]})

    return _table(spark, sf_dir, "pages").select("page_id", scanned("url", "html").alias("s")).select("page_id", "s.*")


def conversation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns in order, as one text's digest."""
    turns = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    whole = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), F.coalesce(x["text"], F.lit("")))), "\n")
    return turns.select("conv_id", F.size("t").alias("turns"), F.md5(whole).alias("digest"))


CONVERSATION_SQL = "SELECT conv_id, CAST(count(*) AS INTEGER) AS turns, md5(string_agg(concat(role, ': ', coalesce(text, '')), chr(10) ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id"

# streams' batch forms


def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type."""
    return counts_by_window(_table(spark, sf_dir, "events"), "ts", "event_type")


WINDOW_SQL = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events FROM events GROUP BY ALL"


def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that a limit of one in six hours accepts and refuses, by user."""
    rows = limited(_table(spark, sf_dir, "events").where("user_id IS NOT NULL"), "user_id", "ts", "event_id", limit=1, window=6 * 3600.0)
    return rows.groupBy("user_id").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"))


ADMISSION_SQL = """
WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL),
w AS (SELECT user_id, i, ts, ts AS kept, 1 AS ok FROM e WHERE i = 1 UNION ALL
  SELECT e.user_id, e.i, e.ts, CASE WHEN w.kept < e.ts - INTERVAL 6 HOUR THEN e.ts ELSE w.kept END, CASE WHEN w.kept < e.ts - INTERVAL 6 HOUR THEN 1 ELSE 0 END FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1)
SELECT user_id, CAST(sum(ok) AS BIGINT) AS accepted, CAST(count(*) - sum(ok) AS BIGINT) AS refused FROM w GROUP BY user_id
"""

# whole messages

BODIES = ("Please verify your account password immediately at http://paypa1.com/login", "Lunch at noon?", "Call +1 415 555 0100 about your invoice refund", "Wire the urgent payment and buy gift cards", "Minutes attached, see you")
MESSAGE_SQL = "concat('From: ', " + _case("c_custkey", ["'PayPal <x@paypa1-secure.com>'", "'Bob <bob@corp.example>'", "'Desk <d@help.example>'"]) + ", '\n', 'To: a@b.example\n', 'Subject: note ', c_custkey, '\n', 'Message-ID: <', c_custkey, '@corp.example>\n\n', " + _case("c_custkey", [_quoted(b) for b in BODIES]) + ")"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze(_table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{MESSAGE_SQL.replace(chr(10), chr(92) + 'n')} AS content"), keep=["c_custkey"])


def message_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every templated message's score, risk and classification."""
    return _results(spark, sf_dir).select("c_custkey", "score", "risk", "classification", "confidence", "dimensions.*", "links_found")


def message_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of templated messages by scope and code."""
    return finding_rows(_results(spark, sf_dir)).groupBy("scope", "code").agg(F.count("*").alias("n"), F.sum("points").alias("points"))


def message_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_cube(_results(spark, sf_dir))


def attachment_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in sample attachments, dealt over all customers' messages, and the links inside."""
    found = messages()
    kinds = spark.createDataFrame([(i, bytearray(m)) for i, m in enumerate(found)], "kind int, content binary")
    # as many rows as there are samples; customers are dealt before the join, which leaves partitions as they are
    dealt = spread(_table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % len(found)).cast("int").alias("kind")))
    mails = dealt.join(F.broadcast(kinds), "kind")
    a = parsed(mails, keep=["c_custkey"]).select("c_custkey", F.explode_outer("attachments").alias("a"))
    rows = a.select(F.explode_outer(F.concat(F.transform("a.findings", lambda f: F.struct(f["code"].alias("code"), f["points"].alias("points"))), F.transform("a.extracted_urls", lambda u: F.struct(F.concat(F.lit("link to "), u).alias("code"), F.lit(0).alias("points"))))).alias("x"))
    return rows.where("x IS NOT NULL").groupBy(F.col("x.code").alias("code")).agg(F.count("*").alias("n"), F.sum("x.points").alias("points"))


_POINTS = {r.code: r.points for r in RULES}
ATTACHMENT_SQL = f"""
SELECT code, count(*) AS n, CAST(sum(points) AS BIGINT) AS points FROM customer JOIN (VALUES {', '.join(f"({i}, {_quoted(code)}, {_POINTS.get(code, 0)})" for i, (_, _, _, codes, links) in enumerate(FILES) for code in [*sorted(codes), *(f'link to {u}' for u in links)])}) AS s(kind, code, points)
ON c_custkey % {len(FILES)} = kind GROUP BY code
"""


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and bytes of their addresses by scheme and host."""
    p = _table(spark, sf_dir, "pages").select(parts(F.col("url")).alias("p"), "url")
    return p.groupBy(F.col("p.scheme").alias("scheme"), F.col("p.host").alias("host")).agg(F.count("*").alias("n"), F.sum(F.length("p.query")).alias("query_chars"))


PARTS_SQL = f"SELECT lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS scheme, {_HOST} AS host, count(*) AS n, CAST(sum(length(regexp_extract(u, '\\?([^#]*)', 1))) AS BIGINT) AS query_chars FROM (SELECT url AS u FROM pages) GROUP BY ALL"


def queries() -> dict[str, Query]:
    own = (
        url_triage_topk, url_finding_counts, url_obfuscated_ip, url_parts, brand_lookalikes, feed_join, content_rules, category_argmax, triage_scores, ngram_cosine, redaction, indicator_counts, header_checks, qr_payloads, qr_images, stix_ids, html_links,
        conversation_text, window_counts, admission, message_triage, message_findings, message_cube, attachment_codes,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "url_triage_topk": URL_TRIAGE_SQL, "url_finding_counts": URL_COUNTS_SQL, "stix_ids": STIX_SQL, "url_obfuscated_ip": URL_IP_SQL, "url_parts": PARTS_SQL, "brand_lookalikes": BRAND_ORACLE, "feed_join": FEED_SQL, "content_rules": CONTENT_SQL, "category_argmax": ARGMAX_SQL, "triage_scores": SCORE_SQL,
        "ngram_cosine": COSINE_SQL, "redaction": REDACTION_SQL, "header_checks": HEADER_SQL, "qr_payloads": QR_SQL, "qr_images": CODES_SQL, "conversation_text": CONVERSATION_SQL, "window_counts": WINDOW_SQL, "admission": ADMISSION_SQL, "attachment_codes": ATTACHMENT_SQL,
    }
