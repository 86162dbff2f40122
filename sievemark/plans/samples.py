"""Sample attachments of our own with the findings and links they hold, for queries and tests."""

from __future__ import annotations

import base64
import io
import zipfile
import zlib

from ..sources import qr_write


def zipped(**named) -> bytes:
    """A ZIP file of members (name to text), those in links as symbolic links; the same bytes each time."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in named.get("members", {}).items():
            info = zipfile.ZipInfo(name)
            info.compress_type = zipfile.ZIP_DEFLATED
            if name in named.get("links", ()):
                info.external_attr = 0o120777 << 16
            z.writestr(info, text)
    return held.getvalue()


def with_file(name: str, kind: str, data: bytes) -> bytes:
    """A message with one attachment."""
    return f"From: a@b.example\nSubject: s\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/plain\n\nhi\n--B\nContent-Type: {kind}; name=\"{name}\"\nContent-Disposition: attachment; filename=\"{name}\"\nContent-Transfer-Encoding: base64\n\n{base64.encodebytes(data).decode()}\n--B--\n".encode()


RELS = '<Relationship Id="1" TargetMode="External" Target="https://out.example/t.dotm"/><Relationship TargetMode="Internal" Target="x"/>'
DEFLATED = b"%PDF-1.4 << /FlateDecode >>\nstream\n" + zlib.compress(b"see /OpenAction https://in.example/a") + b"\nendstream"


def code_image(text: str, variant: int = 0) -> bytes:
    """A PNG with the text's code: level, mask, size, row filters, colours and turn by variant."""
    variant = int(variant)
    pixels = qr_write.drawn(qr_write.symbol(text, "MLQH"[variant % 4], variant % 8), scale=1 + variant % 5)
    turned = pixels.T[::-1] if variant % 3 == 1 else pixels
    return qr_write.png(255 - turned if variant % 7 == 3 else turned, filters=None if variant % 2 else variant % 5)


#: Name, type, bytes, codes, links.
FILES = [
    ("a.docm.zip", "application/zip", zipped(members={"word/vbaProject.bin": "x", "../up": "DDEAUTO"}), {"ACTIVE_ARCHIVE_CONTENT", "ARCHIVE_PATH_TRAVERSAL", "EMBEDDED_OFFICE_OBJECT"}, []),
    ("a.pdf.exe", "x/y", b"MZ", {"EXECUTABLE_ATTACHMENT", "DOUBLE_EXTENSION"}, []),
    ("a.pdf", "x/y", b"%PDF-1.4 /JavaScript ", {"ACTIVE_PDF"}, []),
    ("b.pdf", "x/y", DEFLATED, {"ACTIVE_PDF"}, ["https://in.example/a"]),
    ("c.pdf", "x/y", b"%PDF- " + DEFLATED * 22, {"ACTIVE_PDF", "PDF_STREAM_LIMIT"}, ["https://in.example/a"]),
    ("a.zip", "x/y", b"PK\x03\x04bad", {"MALFORMED_ARCHIVE"}, []),
    ("d.zip", "x/y", zipped(members={"a.zip": "", "l": "to", "_rels/x.rels": RELS, "doc.xml": "<w> DDE </w>"}, links=("l",)), {"NESTED_ARCHIVE", "ARCHIVE_SYMLINK", "OOXML_EXTERNAL_REL", "OFFICE_DDE_FIELD"}, ["https://out.example/t.dotm"]),
    ("e.zip", "x/y", zipped(members={"zeros": "0" * 3_000_000, "doc.xml": "DDE"}), {"ARCHIVE_LIMIT"}, []),
    ("f.html", "text/html", b"<script>new Blob(['x'])</script> https://h.example/?a&amp;b", {"ACTIVE_HTML_ATTACHMENT", "HTML_SMUGGLING_ATTACHMENT"}, ["https://h.example/?a&b"]),
    ("g.ics", "text/calendar", b"BEGIN:VCALENDAR\nSUMMARY:Old\nSUMMARY:Verify account\nURL:https://c.example/v\n", {"CALENDAR_INVITE_LURE"}, ["https://c.example/v"]),
    ("h.ics", "text/calendar", b"BEGIN:VCALENDAR\nSUMMARY:Lunch\nURL:https://c.example/v\n", {"CALENDAR_EXTERNAL_URL"}, ["https://c.example/v"]),
    ("i.eml", "message/rfc822", b"From: x@y.example\nSubject: invoice\n\nat aHR0cHM6Ly9ldmlsLmV4YW1wbGUveA==", {"EMBEDDED_EMAIL_LURE", "EMBEDDED_EMAIL_URL"}, ["https://evil.example/x"]),
    ("j.png", "image/png", b"MZ", {"FILE_TYPE_MISMATCH", "EXECUTABLE_ATTACHMENT"}, []),
    ("k\u202etxt.bin", "x/y", b"hi", {"FILENAME_BIDI_CONTROL"}, []),
    ("l.txt", "text/plain", b"hi", set(), []),
    ("m.png", "image/png", code_image("bit.ly/3xYzAbC"), {"QR_URL"}, ["http://bit.ly/3xYzAbC"]),
    ("n.png", "image/png", code_image("WIFI:S:cafe;T:WPA;P:secret;;", 3), set(), []),
]


def messages() -> list[bytes]:
    """A message for each sample; nested mail comes under a neutral type, known by its name."""
    return [with_file(name, "application/octet-stream" if kind == "message/rfc822" else kind, data) for name, kind, data, _, _ in FILES]
