"""The engine's functions under SQL names, for sessions that work in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .layers import WEB

#: Marks that end a sentence rather than an address.
_TRAILING = ".,;:!?)]}>\'\""


@F.udtf(returnType="name string, encrypted boolean, symlink boolean, text string")
class ZipMembers:
    """A row for each member of a ZIP file, with the text of XML members, within the archive limits."""

    def eval(self, data: bytes):
        from ..operators.attachments import archive_of

        for m in archive_of(bytes(data or b""))["members"]:
            yield m["name"], m["encrypted"], m["symlink"], m["text"]


def register(spark: SparkSession) -> None:
    """Adds risk_label, masked, web_links, registrable_domain and the table function zip_members to the session."""
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    spark.udtf.register("zip_members", ZipMembers)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION risk_label(score INT) RETURNS STRING RETURN CASE WHEN score >= 75 THEN 'high' WHEN score >= 50 THEN 'likely_phishing' WHEN score >= 25 THEN 'suspicious' ELSE 'low' END")
    compact = r"regexp_replace(value, '(?U)\\s+', '')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION masked(kind STRING, value STRING) RETURNS STRUCT<type: STRING, masked: STRING, sha256_prefix: STRING> RETURN named_struct('type', kind, 'masked', concat('***', CASE WHEN length({compact}) >= 4 THEN right({compact}, 4) ELSE '****' END), 'sha256_prefix', left(sha2({compact}, 256), 16))")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION web_links(body STRING) RETURNS ARRAY<STRING> RETURN transform(regexp_extract_all(body, {quoted(WEB)}, 0), m -> rtrim({quoted(_TRAILING)}, m))")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION registrable_domain(host STRING) RETURNS STRING RETURN {_registrable_sql(quoted)}")


def _registrable_sql(quoted) -> str:
    """``urls.registrable`` in SQL, with the suffix rules in use."""
    from . import urls

    rules, labels = urls._suffixes, "split(lower(trim(BOTH '.[]' FROM host)), '[.]')"
    last = lambda n: f"array_join(slice({labels}, -least({n}, size({labels})), least({n}, size({labels}))), '.')"
    held = lambda n, names, more=0: f"size({labels}) >= {n + more} AND {last(n)} IN ({', '.join(map(quoted, names))})"
    counts = [f"CASE WHEN {held(n, names)} THEN {n} ELSE 1 END" for n, names in rules.plain.items() if n > 1] + [f"CASE WHEN {held(n, names, 1)} THEN {n + 1} ELSE 1 END" for n, names in rules.wild.items()]
    longest = f"greatest(1, {', '.join(counts)})" if counts else "1"
    apart = " ".join(f"WHEN {held(n, names)} THEN {n - 1}" for n, names in rules.except_.items())
    own = f"CASE {apart} ELSE {longest} END" if apart else longest
    whole = f"size({labels}) < 2 OR contains(host, ':') OR trim(BOTH '.[]' FROM host) RLIKE '^[0-9]+([.][0-9]+){{3}}$'"
    reserved = f"element_at({labels}, -1) IN ({', '.join(map(quoted, urls.RESERVED))})"
    return f"CASE WHEN {whole} THEN lower(trim(BOTH '.[]' FROM host)) WHEN {reserved} THEN {last(2)} ELSE {last(f'(1 + {own})')} END"
