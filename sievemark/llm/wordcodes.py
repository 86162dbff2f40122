"""Whole texts through a tokenizer library by way of their distinct words.

A byte-level or word-level BPE never merges across the borders of its
pre-tokens. Texts are cut at borders that hold for both tokenizer files
whatever stands around them, each distinct piece goes to the library once, in
batches, and a text's codes are those of its pieces joined. The pieces are:

* ``letters``: at most one space and Latin letters, with a space, newline or
  one of the marks below behind them,
* ``marks``: a run of those marks with white space behind it,
* ``rest``: any white space with all that follows up to the next white space.

The next piece always starts where white space follows other characters or
where a mark follows a letter. None of these places lies inside a special
token's string, as those hold neither white space nor such marks.

Where the tokenizer drops white space and folds case, pieces are words between
white space in small letters, with marks behind them as words of their own.
Arrow splits a lot of these texts and numbers its words, so Python sees new words only.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import release

#: Characters with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
MARKS = ',.!?;:"#$%&*()'
PIECE = re.compile(f" ?[{LATIN}]+(?=[ \n{MARKS}])|[{MARKS}]+(?=[ \n])|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
CUT = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")

#: Texts are grouped to about so many characters, and longer ones are cut in parts of at least that size.
GROUP_CHARS = 1 << 19
#: Pieces remembered by a worker (some 200 bytes each); beyond that it starts anew.
REMEMBERED = 300_000
#: Longer pieces aren't remembered.
LONG_PIECE = 64
#: Characters that go to the library in one call, so that its encodings stay small.
LOT_CHARS = 1 << 17
#: Pieces that are kept then: those met first.
KEPT = 60_000
#: Words that are encoded in one string.
JOINED = 512
#: UTF-8 bytes of texts whose words are numbered together; a longer text goes part by part.
LOT_BYTES = 1 << 22
#: Words remembered in Arrow tables (some 40 bytes each); beyond that a worker starts anew with those met first.
TABLED, TABLED_KEPT = 600_000, 200_000
#: The parts of a tokenizer file under which white space only parts words.
NORMAL_FORM = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
NO_WHITE = re.compile(f"[^{WHITE}]+")
#: Characters whose small letters or normal forms need the library, and what may begin a special token's string.
OTHERS = "[^\x00-\xff\u2010-\u2027\u2030-\u203a]|<\\|"
#: Marks before white space that may belong to what stands before them.
APART = f"(?:^|[^{LATIN}0-9{WHITE}])[,.;:!?][ \n]"
#: What splitting takes for white space and the property doesn't hold for.
SEPARATORS = "[\x1c-\x1f]"
#: Words that the word split parts at changes of kind only: small letters of theirs are told by each letter, none is an apostrophe or begins a special token.
SAFE = re.compile(f"[{LATIN}0-9!-&(-;=-@\\[-`{{-~]+")
UNITS = re.compile(f"[{LATIN}]+|[0-9]|[^{LATIN}0-9]+")


def parts(text: str, size: int = GROUP_CHARS) -> Iterator[str]:
    """The text in parts of ``size`` characters or a little more, cut where white space follows other characters."""
    at = 0
    while len(text) - at > size:
        found = CUT.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def groups(texts: Iterable[str], size: int = GROUP_CHARS, sizes: Iterable[int] | None = None) -> Iterator[list[str]]:
    """Lists of texts of about ``size`` characters together, or of what sizes counts for each."""
    group, total = [], 0
    for text, own in zip(texts, map(len, texts) if sizes is None else sizes, strict=True):
        group.append(text)
        total += own
        if total >= size:
            yield group
            group, total = [], 0
    if group:
        yield group


class Words:
    """Codes of pieces by a batch encoder, remembered."""

    def __init__(self, encode: Callable[[list[str]], Iterable], split: Callable[[str], list[str]] = PIECE.findall):
        self.encode, self.split, self.known = encode, split, {}

    def codes(self, texts: list[str]) -> list[list]:
        """The codes of each piece of each text."""
        found = [self.split(text) for text in texts]
        known = self.known
        out = [list(map(known.get, pieces)) for pieces in found]
        holes = [[i for i, x in enumerate(own) if x is None] for own in out]
        new = sorted({pieces[i] for pieces, own in zip(found, holes, strict=True) for i in own})
        for group in groups(new, LOT_CHARS):
            known.update(zip(group, self.encode(group), strict=True))
        for pieces, own, row in zip(found, holes, out, strict=True):
            for i in own:
                row[i] = known[pieces[i]]
        for piece in new:
            if len(piece) > LONG_PIECE:
                del known[piece]
        if len(known) > REMEMBERED:  # what was met first is met often
            self.known = dict(islice(known.items(), KEPT))
        return out

    def of(self, text: str) -> Iterator[list]:
        """Codes of a text of any length, part by part."""
        for part in parts(text):
            yield from self.codes([part])

    def whole(self, texts: pa.Array) -> Iterator[bytes]:
        """Each text's codes in one, where codes are bytes."""
        for group in groups(texts.to_pylist()):
            if len(group) == 1:  # a long text part by part
                yield b"".join(b"".join(own) for own in self.of(group[0]))
            else:
                yield from map(b"".join, self.codes(group))

    def forget(self) -> None:
        self.known = dict(islice(self.known.items(), KEPT))


class FoldedWords(Words):
    """``Words`` over a vocabulary that folds case and drops white space: Arrow splits lots of texts, numbers their words and puts their codes together."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]]):
        self.encode = encode
        self.known, self.values = pa.array([], pa.large_string()), pa.array([], pa.large_binary())  # words and, in the same order, codes

    def flat(self, texts: pa.Array) -> tuple[memoryview, list[int]]:
        """The codes of all texts in a row, and where those of each text end."""
        lists = by_white_space(texts)
        words = lists.flatten().dictionary_encode()
        codes = self.looked_up(words.dictionary).take(words.indices)
        sizes = np.r_[0, pc.binary_length(codes).to_numpy().cumsum()]
        return memoryview(codes.buffers()[2] or b""), sizes[pc.list_value_length(lists).to_numpy().cumsum()].tolist()

    def looked_up(self, words: pa.Array) -> pa.Array:
        """The codes of distinct words."""
        met = len(self.known)
        numbered = pa.concat_arrays([self.known, words]).dictionary_encode()  # known words keep their places
        new, coded = numbered.dictionary.slice(met), []
        for group in groups(strings(new), LOT_CHARS):
            coded += self.encode(group)
        coded = pa.array(coded, pa.large_binary())
        codes = pa.concat_arrays([self.values, coded]).take(numbered.indices.slice(met))
        short = pc.less_equal(pc.utf8_length(new), LONG_PIECE)
        self.known, self.values = pa.concat_arrays([self.known, new.filter(short)]), pa.concat_arrays([self.values, coded.filter(short)])
        if len(self.known) > TABLED:
            self.keep(TABLED_KEPT)
        return codes

    def keep(self, most: int) -> None:
        at = pa.array(range(min(most, len(self.known))), pa.int64())
        self.known, self.values = self.known.take(at), self.values.take(at)  # copies, as slices would hold the whole tables

    def forget(self) -> None:
        self.keep(KEPT)

    def codes(self, texts: list[str]) -> list[list[bytes]]:
        """The codes of each text, in one piece."""
        return [[own] for own in self.apart(pa.array(texts, pa.large_string()))]

    def of(self, text: str) -> Iterator[list[bytes]]:
        for part in parts(text, LOT_BYTES):
            yield from self.codes([part])

    def apart(self, texts: pa.Array) -> Iterator[bytes]:
        data, ends = self.flat(texts)
        return (bytes(data[a:b]) for a, b in zip([0, *ends], ends))

    def whole(self, texts: pa.Array) -> Iterator[bytes]:
        texts = texts.cast(pa.large_string())
        upto, at = pc.binary_length(texts).to_numpy().cumsum(), 0
        while at < len(texts):
            to = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LOT_BYTES, "right")), at + 1)
            if to == at + 1:  # a long text part by part
                yield b"".join(b"".join(own) for own in self.of(texts[at].as_py()))
            else:
                yield from self.apart(texts.slice(at, to - at))
            at = to


_WORDS: dict[tuple[str, str], Words] = {}


def forget() -> None:
    """Gives back what the worker remembers but for the pieces met first, for the tasks and stages that run in it afterwards."""
    for words in _WORDS.values():
        words.forget()
    release()


def library(path: str, kind: str) -> Words:
    """The worker's own Words over a ``.json`` file; kind: 'lengths' or 'ids' (little-endian unsigned 32-bit codes as bytes)."""
    if (path, kind) not in _WORDS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def lengths(batch: list[str]) -> list[int]:
            return [len(x) for x in tokenizer.encode_batch_fast(batch, add_special_tokens=False)]

        def ids(batch: list[str]) -> list[bytes]:
            return [np.array(x.ids, dtype="<u4").tobytes() for x in tokenizer.encode_batch_fast(batch, add_special_tokens=False)]

        folded = kind == "ids" and _drops_white_space(tokenizer)
        _WORDS[path, kind] = FoldedWords(_joining(tokenizer, ids)) if folded else Words(lengths if kind == "lengths" else ids)
    return _WORDS[path, kind]


def strings(words: pa.Array) -> list[str]:
    """Words without spaces as Python strings, by one string and its split."""
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar(" ", words.type))[0].as_py()
    return joined.split(" ") if len(words) else []


def by_white_space(texts: pa.Array) -> pa.Array:
    """Lists of words in small letters, for vocabularies that fold case and drop white space; a mark behind a Latin word or digit stands alone."""
    has = pc.match_substring_regex
    low = pc.if_else(has(texts, OTHERS), texts, pc.utf8_lower(texts))  # no special token's string, and small letters by one rule
    spaced = low
    for mark in ",.;:!?":
        for white in " \n":
            spaced = pc.replace_substring(spaced, mark + white, f" {mark}{white}")
    low = pc.if_else(has(low, APART), low, spaced)
    return pc.split_pattern_regex(low, f"[{WHITE}]+") if pc.any(has(low, SEPARATORS)).as_py() else pc.utf8_split_whitespace(low)


def _drops_white_space(tokenizer) -> bool:
    """Whether the vocabulary marks the ends of words, and white space only parts them."""
    shape = json.loads(tokenizer.to_str())
    before = shape.get("pre_tokenizer") or {}
    if any("<|" not in x["content"] or NO_WHITE.fullmatch(x["content"]) is None for x in shape.get("added_tokens", [])):
        return False
    return bool(shape["model"].get("end_of_word_suffix")) and (shape.get("normalizer") or {}).get("normalizers") == NORMAL_FORM and before.get("pretokenizers", [None])[0] == WORD_SPLIT


def _joining(tokenizer, ids: Callable[[list[str]], list[bytes]]) -> Callable[[list[str]], list[bytes]]:
    """``ids`` that sends Latin words, digits and marks, many in one string: codes that end words tell them apart."""
    from tokenizers import Tokenizer, normalizers

    bare = Tokenizer.from_str(tokenizer.to_str())
    bare.normalizer = normalizers.Sequence([])  # words come in lower case, and these letters have no other form
    suffix, vocabulary = bare.model.end_of_word_suffix, tokenizer.get_vocab()
    closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    closes[[code for token, code in vocabulary.items() if token.endswith(suffix)]] = True

    def joined(batch: list[str]) -> list[bytes]:
        out: list = [None] * len(batch)
        alike = [i for i, word in enumerate(batch) if SAFE.fullmatch(word)]
        for at in range(0, len(alike), JOINED):
            own = alike[at : at + JOINED]
            text = " ".join([batch[i] for i in own])
            codes = np.array(bare.encode_batch_fast([text.lower()], add_special_tokens=False)[0].ids, dtype="<u4")
            closed = np.flatnonzero(closes[codes])
            words = np.cumsum([1 if batch[i].isalpha() else len(UNITS.findall(batch[i])) for i in own])  # digits and runs of marks are words of their own
            if len(closed) != words[-1]:
                continue
            data, a = codes.tobytes(), 0
            for i, b in zip(own, (4 * (closed[words - 1] + 1)).tolist(), strict=True):
                out[i] = data[a:b]
                a = b
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, ids([batch[i] for i in rest]), strict=True):
            out[i] = x
        return out

    return joined
