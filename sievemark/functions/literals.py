"""Multi-pattern matching: which of many patterns may hold in a text, by literals that their matches can't do without.

From each pattern's parse tree comes a set of literals of which every match
holds at least one. All literals of a pack are found in one pass over a text by
one Aho-Corasick automaton, in an Arrow function, and only the patterns they
belong to are tried, by the JVM's regular expressions. A pattern without such
literals is always tried, so nothing is missed. Plans stay the same size
whatever the pack's: candidates are rows of an array, not branches.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Literals shorter than this are in every text and spare nothing.
SHORTEST = 2
#: Sets of more literals aren't taken where a pattern has another one.
LARGEST = 400
#: Characters that the JVM takes for an i where case is ignored, beside what folding tells.
_DOTS = str.maketrans({"İ": "i", "ı": "i"})


def folded(text: str) -> str:
    """One spelling of what the JVM's case-insensitive matching takes for equal."""
    return text.translate(_DOTS).casefold()


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """The set that spares more: longer shortest literals first, then fewer of them."""
    if a is None or b is None:
        return a or b
    rate = lambda s: (len(s) <= LARGEST, min(min(map(len, s)), 6), -len(s))
    return a if rate(a) >= rate(b) else b


def _of_items(items: Iterable) -> frozenset[str] | None:
    best, run = None, ""

    def closed() -> frozenset[str] | None:
        return frozenset([folded(run)]) if len(folded(run)) >= SHORTEST else None

    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            run += chr(value)
            continue
        best, run = _better(best, closed()), ""
        own = None
        if name == "SUBPATTERN":
            own = _of_items(value[-1])
        elif name == "BRANCH":
            each = [_of_items(x) for x in value[1]]
            own = None if any(x is None for x in each) else frozenset().union(*each)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            own = _of_items(value[2])
        best = _better(best, own)
    return _better(best, closed())


@functools.cache
def required(pattern: str) -> frozenset[str] | None:
    """Folded literals of which every match of the pattern (case ignored) holds one; None where there are none."""
    try:
        return _of_items(re._parser.parse(pattern, re.IGNORECASE | re.DOTALL))
    except (re.error, RecursionError, OverflowError):  # syntax of the JVM's own
        return None


class Matcher:
    """Numbers of the literal sets that a text may satisfy, in order."""

    def __init__(self, literals: Sequence[frozenset[str] | None]):
        import ahocorasick

        self.always = [i for i, x in enumerate(literals) if x is None]
        holders: dict[str, list[int]] = {}
        for i, own in enumerate(literals):
            for literal in own or ():
                holders.setdefault(literal, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for literal, held in holders.items():
            self.automaton.add_word(literal, held)
        if holders:
            self.automaton.make_automaton()
        self.empty = not holders

    def of(self, text: str) -> list[int]:
        if self.empty:
            return self.always
        found = set(self.always)
        for _, held in self.automaton.iter(folded(text)):
            found.update(held)
        return sorted(found)


_MATCHERS: dict[tuple, Matcher] = {}


def _matcher(literals: tuple) -> Matcher:
    if literals not in _MATCHERS:
        if len(_MATCHERS) > 32:
            _MATCHERS.clear()
        _MATCHERS[literals] = Matcher(literals)
    return _MATCHERS[literals]


def candidates(text: Column, rows: Sequence[tuple], literals: Sequence[frozenset[str] | None], schema: str) -> Column:
    """array<schema> (a struct) of the rows whose literals the text holds, in order; schema lists the rows' fields."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    shape, key = StructType.fromDDL(schema), tuple(literals)
    kind = pa.list_(to_arrow_type(shape))
    names = [f.name for f in shape.fields]
    made = [dict(zip(names, r, strict=True)) for r in rows]

    @F.arrow_udf(f"array<{shape.simpleString()}>")
    def found(texts: pa.Array) -> pa.Array:
        matcher = _matcher(key)
        return pa.array([None if t is None else [made[i] for i in matcher.of(t)] for t in texts.to_pylist()], kind)

    return found(text)
