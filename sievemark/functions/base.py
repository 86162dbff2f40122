"""Findings, labels and small text helpers as columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = "struct<code:string,title:string,severity:string,points:int,evidence:string,source:string,status:string>"
FINDINGS = f"array<{FINDING}>"


def text(value: str) -> Column:
    return F.lit(value)


def finding(when: Column, code: str | Column, title: str | Column, severity: str | Column, points: int | Column, evidence: Column, source: str | Column, status: str = "observed") -> Column:
    """A finding where the condition holds, else null."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    made = F.struct(
        lit(code).alias("code"), lit(title).alias("title"), lit(severity).alias("severity"), lit(points).cast("int").alias("points"),
        F.coalesce(evidence.cast("string"), F.lit("")).alias("evidence"), lit(source).alias("source"), F.lit(status).alias("status"),
    )
    return F.when(when, made)


def found(*findings: Column) -> Column:
    """array<finding> of those that aren't null, in order."""
    if not findings:
        return F.array().cast(FINDINGS)
    return F.filter(F.array(*findings), lambda f: f.isNotNull()).cast(FINDINGS)


def points(findings: Column) -> Column:
    return F.aggregate(findings, F.lit(0), lambda acc, f: acc + f["points"])


def capped(value: Column) -> Column:
    return F.least(F.lit(100), value)


def risk_label(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 50, "likely_phishing").when(score >= 25, "suspicious").otherwise("low")


def percent_decoded(value: Column) -> Column:
    """Percent escapes undone as UTF-8; broken ones and plus signs stay."""
    safe = F.replace(F.regexp_replace(value, "%(?![0-9a-fA-F]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.url_decode(safe)


def let(value: Column, use) -> Column:
    """use(value), with the value computed and written down once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def settled(df: DataFrame, *names: str) -> DataFrame:
    """df with these columns last, computed once: they pass through an array of one row, and the optimizer copies no expression past it.

    Projects that meet a Python function are merged, and then a column is written out wherever it is used.
    """
    return df.select(*(c for c in df.columns if c not in names), F.inline_outer(F.array(F.struct(*names))))


def escaped(value: Column) -> Column:
    """Text for HTML and XML."""
    steps = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    return reduce(lambda col, x: F.replace(col, F.lit(x[0]), F.lit(x[1])), steps, value)


def redacted(kind: str | Column, value: Column) -> Column:
    """struct<type, masked, sha256_prefix> of a value without its white space."""
    compact = F.regexp_replace(value, r"(?U)\s+", "")
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    shown = F.when(F.length(compact) >= 4, F.right(compact, F.lit(4))).otherwise("****")
    return F.struct(kind.alias("type"), F.concat(F.lit("***"), shown).alias("masked"), F.left(F.sha2(compact, 256), F.lit(16)).alias("sha256_prefix"))


def uuid5(namespace: Column, name: Column) -> Column:
    """The version-5 UUID of a name in a namespace (a UUID as text)."""
    digest = F.sha1(F.concat(F.unhex(F.replace(namespace, F.lit("-"), F.lit(""))), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


#: Bytes of files below which a table has fewer splits than a usual cluster has cores.
SMALL_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as tasks run at once: many checks a row are too much for the few splits of a small file.

    Only what reads a few small files, without a shuffle on the way, is dealt anew: the plan tells, nothing is run. Larger inputs, streams, and
    what comes out of joins and sums, where adaptive execution has chosen the partitions, stay where they are.
    """
    if df.isStreaming:
        return df
    plan = df._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    if re.search(r"(?m)^[\s:+|-]*(?:Join|Aggregate|Window|Sort|Repartition|RepartitionByExpression|Generate|Distinct|Deduplicate)\b", text) or "Relation" not in text:
        return df
    if int(str(plan.stats().sizeInBytes())) > SMALL_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def without_call_sites(build):
    """Column builders make thousands of small expressions; recording the call site of each would take most of their time.

    The same as spark.python.sql.dataFrameDebugging.enabled=false for the time of the call.
    """
    import functools

    import pyspark.errors.utils as origin

    @functools.wraps(build)
    def quiet(*args, **kwargs):
        before = getattr(origin, "_enable_debugging_cache", None)
        origin._enable_debugging_cache = False
        try:
            return build(*args, **kwargs)
        finally:
            origin._enable_debugging_cache = before

    return quiet
