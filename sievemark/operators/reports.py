"""Results as JSON, text lines, HTML, STIX, DOCX and PDF; the first four by column expressions."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape as xml_escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.base import escaped, uuid5

NAMESPACE_URL = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
LINE_CHARS = 1_500


def json_column(results: DataFrame) -> Column:
    return F.to_json(F.struct(*results.columns), {"pretty": "true", "ignoreNullFields": "false"})


def lines_column() -> Column:
    """array<string>: the report that people read, line by line."""
    text = lambda *parts: F.array(F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    some = lambda lines, otherwise="- None": F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit(otherwise)))
    named = F.array_join(F.transform("regions", lambda r: F.concat(r["label"], F.lit(" ("), r["strength"], F.lit(")"))), ", ")
    found = F.transform("findings", lambda f: F.concat(F.lit("- ["), f["severity"], F.lit("] "), f["title"], F.lit(" ("), f["points"].cast("string"), F.lit("): "), f["evidence"]))
    order = F.transform(F.array_sort(F.transform("links", lambda x: F.struct((-x["rank_score"]).alias("r"), x["ordinal"].alias("o"), x.alias("x")))), lambda s: s["x"])
    links = F.transform(order, lambda x: F.concat(F.lit("- ["), x["risk"], F.lit("] "), x["host"], F.lit(" score="), x["score"].cast("string"), F.lit(" rank="), x["rank_score"].cast("string"), F.when(x["selected"], " (deep) ").otherwise(" (static only) "), x["url"]))
    files = F.transform("attachments", lambda a: F.concat(F.lit("- "), a["filename"], F.lit(" "), a["detected_type"], F.lit(" "), a["size_bytes"].cast("string"), F.lit(" bytes SHA-256 "), a["sha256"]))
    dims = F.array(*(F.concat(F.lit(f"- {k.replace('_', ' ').title()}: "), F.col(f"dimensions.{k}").cast("string")) for k in ("sender_authenticity", "message_intent", "destination_risk", "payload_risk")))
    return F.concat(
        text("Message triage report"), text("Case: ", F.col("case_id")), text("SHA-256: ", F.col("message_id")), text("Risk: ", F.col("risk"), " | Triage score: ", F.col("score"), "/100 | Confidence: ", F.col("confidence")),
        text("Classification: ", F.col("classification")), text("Languages: ", F.array_join("languages", ", ")), text("Regional wording patterns: ", F.coalesce(F.nullif(named, F.lit("")), F.lit("None observed"))), text(F.col("summary")),
        text(""), text("Score dimensions"), dims, text(""), text("Message findings"), some(found), text(""), text("Destinations (", F.col("links_checked"), " deeply inspected of ", F.col("links_found"), " found)"), links, text(""), text("Attachments"), some(files),
    )


def html_column() -> Column:
    """A page without scripts or outside links."""
    rows = F.array_join(F.transform(lines_column(), lambda x: F.concat(F.lit("<li>"), escaped(x), F.lit("</li>"))), "")
    head = '<!doctype html><html><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="default-src \'none\'; style-src \'unsafe-inline\'"><meta name="referrer" content="no-referrer"><title>Triage report</title></head><body class="'
    return F.concat(F.lit(head), escaped(F.col("risk")), F.lit('"><ul>'), rows, F.lit("</ul></body></html>"))


def stix_column(created: Column) -> Column:
    """A STIX 2.1 bundle with an indicator for each link with a score or a feed hit; created: an ISO time as text."""
    own = uuid5(F.lit(NAMESPACE_URL), F.concat(F.lit("urn:sha256:"), F.col("message_id")))
    kept = F.filter("links", lambda x: (x["score"] > 0) | x["hits"].isNotNull())

    def indicator(x: Column) -> Column:
        quoted = F.replace(F.replace(x["normalized_url"], F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
        return F.struct(
            F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), F.concat(F.lit("indicator--"), uuid5(own, x["normalized_url"])).alias("id"), created.alias("created"), created.alias("modified"), created.alias("valid_from"),
            F.lit("stix").alias("pattern_type"), F.concat(F.lit("[url:value = '"), quoted, F.lit("']")).alias("pattern"), F.array(F.lit("suspicious-activity")).alias("labels"), F.least(F.lit(100), x["score"]).alias("confidence"),
        )

    bundle = uuid5(F.lit(NAMESPACE_URL), F.concat(F.lit("urn:triage:bundle:"), F.col("message_id")))
    return F.to_json(F.struct(F.lit("bundle").alias("type"), F.concat(F.lit("bundle--"), bundle).alias("id"), F.transform(kept, indicator).alias("objects")))


def docx_bytes(lines: list[str]) -> bytes:
    """A document with a paragraph for each line."""
    name = "http://schemas.openxmlformats.org/"
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{xml_escape(x)}</w:t></w:r></w:p>' for x in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{name}package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{name}package/2006/relationships"><Relationship Id="r1" Type="{name}officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<w:document xmlns:w="{name}wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def pdf_bytes(lines: list[str], per_page: int = 60, width: int = 95) -> bytes:
    """A plain PDF 1.4; characters outside Latin-1 show as question marks, long lines are cut and wrapped."""
    rows = [line[i : i + width] for x in lines for line in [x if len(x) <= LINE_CHARS else x[:LINE_CHARS] + " [cut]"] for i in range(0, max(len(line), 1), width)]
    pages = [rows[i : i + per_page] for i in range(0, max(len(rows), 1), per_page)]
    quoted = lambda s: s.encode("latin-1", "replace").decode("latin-1").replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{4 + 2 * i} 0 R' for i in range(len(pages)))}] >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    for i, page in enumerate(pages):
        stream = "BT /F1 9 Tf 12 TL 40 800 Td " + " ".join(f"({quoted(x)}) Tj T*" for x in page) + " ET"
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>")
        objects.append(f"<< /Length {len(stream)} >>\nstream\n{stream}\nendstream")
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n{body}\nendobj\n".encode("latin-1")
    table = f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n" + "".join(f"{p:010d} 00000 n \n" for p in places)
    return bytes(out) + f"{table}trailer << /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{len(out)}\n%%EOF\n".encode()


@F.pandas_udf(T.BinaryType())
def docx_column(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: None if x is None else docx_bytes(list(x)))


@F.pandas_udf(T.BinaryType())
def pdf_column(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: None if x is None else pdf_bytes(list(x)))


def manifest() -> dict:
    """The packs' counts, ids and digests, with a digest of itself."""
    import hashlib
    import json

    from ..functions.packs import CONTENT_RULES, GENERIC_RULES, LANGUAGES, TACTIC_RULES

    def digest(value: object) -> str:
        return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    packs = {"content_rules": CONTENT_RULES, "tactic_rules": TACTIC_RULES, "generic_rules": GENERIC_RULES}
    body = {
        "schema_version": "1.0", "counts": {k: len(v) for k, v in packs.items()} | {"languages": len(LANGUAGES)}, "languages": sorted(LANGUAGES), "content_rule_ids": [r[0] for r in CONTENT_RULES],
        "tactic_rule_ids": [r[0] for r in TACTIC_RULES], "categories": sorted({r[1] for r in (*CONTENT_RULES, *TACTIC_RULES)}), "digests": {k: digest(v) for k, v in packs.items()},
    }
    return body | {"manifest_sha256": digest(body)}


def manifest_problems(given: object) -> list[str]:
    """What is wrong with a manifest, measured against the packs that are installed."""
    from ..functions.wording import validate

    expected = manifest()
    if not isinstance(given, dict):
        return [*validate(), "manifest must be an object"]
    changed = [k for k in sorted({*expected, *given}) if expected.get(k) != given.get(k)]
    return [*validate(), *(f"manifest differs in {k}" for k in changed)]
