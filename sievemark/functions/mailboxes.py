"""Sender fields by the full mailbox grammar: quoted names, comments, groups, routes, several authors, escaped signs.

The standard library's parser runs in one Arrow function over all of a
message's fields; fields of the plain forms ``name <address>`` and ``address``,
which is nearly all of them, are told by patterns before it is asked.
"""

from __future__ import annotations

import re
from email.utils import getaddresses, parseaddr

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name and address of each field's first mailbox, and the addresses of all mailboxes in its lines.
FIELD = T.StructType([T.StructField("name", T.StringType()), T.StructField("address", T.StringType()), T.StructField("all", T.ArrayType(T.StringType()))])
_KIND = pa.struct([("name", pa.string()), ("address", pa.string()), ("all", pa.list_(pa.string()))])
_ATOM = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+"
_ADDRESS = rf"{_ATOM}(?:\.{_ATOM})*@{_ATOM}(?:\.{_ATOM})*"
PLAIN_FIELD = re.compile(rf"(?:({_ATOM}(?: {_ATOM})*) )?<({_ADDRESS})>|({_ADDRESS})")


def mailbox(field: str) -> dict:
    plain = PLAIN_FIELD.fullmatch(field)
    if plain:
        name, bracketed, bare = plain.groups()
        return {"name": name or "", "address": bracketed or bare, "all": [bracketed or bare]}
    try:
        name, address = parseaddr(field)
        every = [a for _, a in getaddresses(field.splitlines()) if a]
    except (ValueError, IndexError, AttributeError, TypeError):  # what no grammar foresees
        return {"name": "", "address": "", "all": []}
    return {"name": name, "address": address, "all": every}


@F.arrow_udf(T.ArrayType(FIELD))
def _parsed(fields: pa.Array) -> pa.Array:
    clean = lambda v: v.encode("utf-8", "replace").decode() if isinstance(v, str) else [clean(x) for x in v]
    rows = [[{k: clean(v) for k, v in mailbox(f or "").items()} for f in row] for row in fields.to_pylist()]
    return pa.array(rows, pa.list_(_KIND))


def mailboxes(*fields: Column) -> Column:
    """array<FIELD> of some header fields (repeated ones joined by newlines)."""
    return _parsed(F.array(*fields))


def host_of(address: Column) -> Column:
    """The domain of an address, empty where it has no at sign."""
    return F.btrim(F.lower(F.regexp_extract(address, r"@([^@]*)$", 1)), F.lit(".>"))
