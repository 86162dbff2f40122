"""SentencePiece encoding and decoding in numpy batches of equal-length words.

Texts are normalised as the model says (white space to ``▁``, one in front) and
cut before each ``▁`` that follows another character, where no piece of the
model crosses. Distinct words are segmented once, words of a length together:
a matrix of code points, one row for each word. Hashes of their substrings
probe the sorted hashes of the pieces.

* Unigram models: Viterbi. At each end position the best score over all start
  positions is a maximum over a small axis; its place is the backpointer.
* BPE models store merge ranks as scores, and the best path under them isn't
  what the library returns. Their words advance together as well, but by
  merges: in each step every word joins its best adjacent pair (the leftmost
  of equal scores), found by the same probes and a vectorised maximum.

Characters that no piece covers become byte pieces, or the unknown piece where
the model has none. Decoding joins pieces and bytes and takes the first space
away.

Null and empty texts have no ids. Repeated rows and rows with null keys are coded
each, an empty table gives an empty result, further columns are ignored, and a
long text goes whole, word by word.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty
from .wordcodes import Words, groups

SPACE = "▁"
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
UNIGRAM, BPE = 1, 2
#: Score of an unknown character below the worst piece, as the library has it.
UNKNOWN_PENALTY = 10.0
#: Characters of texts that are cut in words together, or a little more.
GROUP_CHARS = 1 << 19
#: Cells of a batch's matrix.
CELLS = 1 << 18

_BASE = 0x9E3779B97F4A7C15


@dataclass
class Pieces:
    """A model's pieces, with sorted hashes to probe."""

    names: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    model_type: int
    dummy_prefix: bool = True

    def __post_init__(self):
        use = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER)]
        hashes = np.array([word_hash(self.names[i]) for i in use], dtype=np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array(use, dtype=np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.score_of = np.append(self.scores, -np.inf)  # the last one for no piece, -1
        self.longest = max((len(self.names[i]) for i in use), default=1)
        self.bytes = {int(n[3:5], 16): i for i, n in enumerate(self.names) if self.kinds[i] == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        normal = [self.scores[i] for i in use if self.kinds[i] == NORMAL]
        self.worst = float(min(normal, default=0.0)) - UNKNOWN_PENALTY

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave texts as they are")
        return cls([p.piece for p in model.pieces], np.array([p.score for p in model.pieces]), np.array([p.type for p in model.pieces]), model.trainer_spec.model_type, norm.add_dummy_prefix)

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.ids[at], -1)

    def fallback(self, char: int) -> list[int]:
        data = chr(char).encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in data] if all(b in self.bytes for b in data) else [self.unknown]


def prefix_hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running hashes of rows (a column more than codes) and powers of the base."""
    rows, n = codes.shape
    power = np.ones(n + 1, dtype=np.uint64)
    power[1:] = np.cumprod(np.full(n, _BASE, dtype=np.uint64)) if n else power[1:]
    run = np.zeros((rows, n + 1), dtype=np.uint64)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    for i in range(n):
        run[:, i + 1] = run[:, i] * np.uint64(_BASE) + mixed[:, i]
    return run, power


def word_hash(word: str) -> np.uint64:
    return prefix_hashes(np.array([[ord(c) for c in word]], dtype=np.int64))[0][0, -1]


def viterbi(pieces: Pieces, codes: np.ndarray) -> list[bytes]:
    """The segmentation with the highest sum of scores of each row (the longest last piece of equal ones)."""
    rows, n = codes.shape
    run, power = prefix_hashes(codes)
    best = np.full((rows, n + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((rows, n + 1), dtype=np.int64)
    piece = np.zeros((rows, n + 1), dtype=np.int64)
    for end in range(1, n + 1):
        starts = np.arange(max(0, end - pieces.longest), end)
        hashes = run[:, [end]] - run[:, starts] * power[end - starts]
        found = pieces.probe(hashes)
        gain = np.where(found >= 0, pieces.scores[found], -np.inf)
        single = found[:, -1] < 0
        gain[single, -1] = pieces.worst
        total = best[:, starts] + gain
        place = total.argmax(axis=1)
        line = np.arange(rows)
        best[:, end], back[:, end], piece[:, end] = total[line, place], starts[place], found[line, place]
    line, end = np.arange(rows), np.full(rows, n)
    steps: list[tuple[np.ndarray, ...]] = []
    while len(line):  # back from the ends, all rows together
        steps.append((line, back[line, end], piece[line, end]))
        end = back[line, end]
        line, end = line[end > 0], end[end > 0]
    row, first, found = (np.concatenate([x[i] for x in steps]) for i in range(3))
    order = np.lexsort((first, row))
    return _listed(pieces, codes, found[order], first[order], np.bincount(row, minlength=rows))


def merged(pieces: Pieces, codes: np.ndarray) -> list[bytes]:
    """The pieces of each row by merges of the best adjacent pair until none is left."""
    rows, n = codes.shape
    run, power = prefix_hashes(codes)
    # symbols are known by their first character; cells of all rows in turn, n + 2 of each
    wide = n + 2
    base = np.arange(rows) * wide
    run = np.concatenate([run, run[:, -1:]], axis=1).ravel()
    following = np.minimum(np.tile(np.arange(1, wide + 1), (rows, 1)), n).ravel()  # where the next symbol starts
    before = np.tile(np.arange(-1, wide - 1), (rows, 1)).ravel()
    scores = np.full((rows, n), -np.inf)  # of the pair that starts with this symbol
    if n > 1:
        found = pieces.probe((run.reshape(rows, wide)[:, 2 : n + 1] - run.reshape(rows, wide)[:, : n - 1] * power[2]).ravel())
        scores[:, : n - 1] = pieces.score_of[found].reshape(rows, n - 1)
    flat, line = scores.ravel(), np.arange(rows)
    out = np.zeros((rows, n), dtype=bool)  # symbols that went
    while n > 1 and len(line):
        at = (scores[line] if len(line) < rows else scores).argmax(axis=1)
        good = flat[line * n + at] > -np.inf
        line, at = line[good], at[good]
        if not len(line):
            break
        own = base[line]
        gone = following[own + at]
        last = following[own + gone]
        following[own + at] = last
        before[own + last] = at
        out[line, gone] = True
        flat[line * n + gone] = -np.inf
        # the pairs on both sides of the new symbol
        left = before[own + at]
        has = left >= 0
        ends = following[own + last]
        more = last < n
        r, first = np.concatenate([line, line[has]]), np.concatenate([at, left[has]])
        end = np.concatenate([np.where(more, ends, n), last[has]])
        found = pieces.probe(run[base[r] + end] - run[base[r] + first] * power[end - first])
        new = pieces.score_of[found]
        new[: len(line)][~more] = -np.inf
        flat[r * n + first] = new
    line, first = np.nonzero(~out)
    end = following[base[line] + first]
    found = pieces.probe(run[base[line] + end] - run[base[line] + first] * power[end - first])
    return _listed(pieces, codes, found, first, n - np.count_nonzero(out, axis=1))


def _listed(pieces: Pieces, codes: np.ndarray, found: np.ndarray, first: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The ids of each row (little-endian unsigned 32-bit) from those of all rows in turn; -1 stands for a character without piece, at first."""
    ends = np.cumsum(counts)
    data, cuts = found.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
    out = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    for i in np.flatnonzero(np.logical_or.reduceat(found < 0, ends - counts)).tolist() if len(found) else []:
        at = int(ends[i] - counts[i])
        ids = []
        for j, p in enumerate(found[at : int(ends[i])].tolist()):
            ids += [p] if p >= 0 else pieces.fallback(int(codes[i, first[at + j]]))
        out[i] = np.array(ids, dtype="<u4").tobytes()
    return out


def segment(pieces: Pieces, words: list[str], method: int | None = None) -> list[np.ndarray]:
    """Ids of each word."""
    return [np.frombuffer(x, dtype="<u4") for x in coded(pieces, words, method)]


def coded(pieces: Pieces, words: list[str], method: int | None = None) -> list[bytes]:
    """Ids of each word as bytes; words of a length go together."""
    solve = {UNIGRAM: viterbi, BPE: merged}[method or pieces.model_type]
    by_length: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        by_length.setdefault(len(word), []).append(i)
    out = [b""] * len(words)
    for size, own in by_length.items():
        if not size:
            continue
        step = max(1, CELLS // max(size, 1))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            codes = np.frombuffer("".join([words[i] for i in part]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64).reshape(len(part), size)
            for i, ids in zip(part, solve(pieces, codes), strict=True):
                out[i] = ids
    return out


def normalized(pieces: Pieces, text: str) -> str:
    return (SPACE if pieces.dummy_prefix and text else "") + text.replace(" ", SPACE)


_WORDS: dict[tuple[str, int], tuple[Pieces, Words]] = {}


def worker_words(path: str, method: int = 0) -> tuple[Pieces, Words]:
    if (path, method) not in _WORDS:
        pieces = Pieces.load(path)
        _WORDS[path, method] = pieces, Words(lambda batch: coded(pieces, batch, method or None), WORD.findall)
    return _WORDS[path, method]


class Decoder:
    """Texts of ids: the pieces' bytes in turn, one gather and one join."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        plain = {UNKNOWN: " \u2047 ", NORMAL: None, USER: None}
        data = [(plain.get(k, "") if plain.get(k, "") is not None else n).replace(SPACE, " ").encode() for n, k in zip(pieces.names, pieces.kinds.tolist(), strict=True)]
        for value, i in pieces.bytes.items():
            data[i] = bytes([value])
        self.data = np.array(data, dtype=object)

    def text(self, data: bytes) -> str:
        # a run of byte pieces that isn't UTF-8 is replaced as if it stood alone, as whole characters are around it
        text = b"".join(self.data[np.frombuffer(data, dtype="<u4")].tolist()).decode("utf-8", "replace")
        return text[1:] if self.pieces.dummy_prefix and text.startswith(" ") else text


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", method: int = 0) -> DataFrame:
    """key and ids (little-endian unsigned 32-bit, as binary) of each text; method: UNIGRAM or BPE instead of the model's own."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, words = worker_words(model, method)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = []
                for group in groups(part.column(1).to_pylist(), GROUP_CHARS):  # a long text ends its group
                    ids += map(b"".join, words.codes([normalized(pieces, value) for value in group]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["k", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).mapInArrow(rows, f"k {kind}, ids binary").withColumnRenamed("k", key)


def decode_column(coded: DataFrame, model: str, key: str = "doc_id", column: str = "ids") -> DataFrame:
    """key and text of coded rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(worker_words(model)[0])
        for batch in batches:
            texts = [decoder.text(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    kind = coded.schema[key].dataType.simpleString()
    return coded.select(F.col(key).alias("k"), F.col(column)).mapInArrow(rows, f"k {kind}, text string").withColumnRenamed("k", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the sums of its ids and of the text decoded from them."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = encode(table(spark, sf_dir, "documents"), model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(worker_words(model)[0])
        for batch in batches:
            n, crc, size, digest = [], [], [], []
            for value in batch.column(1):
                data = value.as_py()
                plain = decoder.text(data).encode("utf-8", "surrogatepass")
                n.append(len(data) // 4)
                crc.append(zlib.crc32(data))
                size.append(len(plain))
                digest.append(hashlib.sha256(plain).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_ids", "ids_crc32", "decoded_bytes", "decoded_sha256"])

    return coded.mapInArrow(rows, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, n_ids long, ids_crc32 long, decoded_bytes long, decoded_sha256 string")
