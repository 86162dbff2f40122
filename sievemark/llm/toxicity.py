"""A toxicity classifier that identity terms can't sway, and its scores over whole texts.

The features are distinct lower-case words, the beginnings of words (so that
derived forms count together) and beginnings that come back twice or four
times. A bounded sample of labelled rows
(``SAMPLE`` of them, the smallest by a hash of the key) gives document
frequencies by label; the ``TERMS`` features whose frequencies differ most become
the vocabulary, with all identity terms of the sample. A logistic regression is
fitted to it. For each sampled text that names a group, counterfactual copies
swap its identity terms within their set, word by word and with their counts,
and get their own features. The fit is penalised by the squared change of the
log-odds from text to copy over all features, beginnings and repeats included,
so that it can't lean on a group by any of them.

The model is a few thousand weights, whatever the corpus, and scoring is one
pass without shuffle. Labels, keys, language and source take no part in a
score. Null or empty texts get the score of a text without known words; rows
with null keys and repeated rows are scored each, and further columns are
ignored; without any labelled row the score is 0 throughout, and an empty table
gives an empty result. Of several labels for a key the largest counts, of several
texts for a sampled key the smallest, so the sample is bounded by rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, table, text_or_empty

SAMPLE, TERMS, LEAST_DOCS, THRESHOLD = 8000, 1024, 4, 0.3
RIDGE, FAIRNESS, TOLERANCE = 1e-4, 3.0, 1e-8
WORD = re.compile(r"[^\W\d_]+")
#: Terms for groups of people, in sets within which they are swapped.
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("immigrants", "refugees", "natives", "foreigners", "citizens"),
    ("deaf", "blind", "disabled", "autistic", "elderly", "young"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes"),
)
SWAPS = {term: terms[:i][::-1] + terms[i + 1 :] for terms in IDENTITY for i, term in enumerate(terms)}
#: Rows that are scored and passed on at a time.
ROWS = 500
#: Counterfactual copies of a text: each swaps all its terms, and every term of a set gets to stand for every other.
COPIES = max(map(len, IDENTITY)) - 1


@dataclass
class Model:
    bias: float = -math.inf
    weights: dict[str, float] = field(default_factory=dict)

    def logit(self, words: Iterable[str]) -> float:
        return self.bias + math.fsum(self.weights[w] for w in words)


def counted(text: str) -> Counter[str]:
    return Counter(WORD.findall(text.lower()))


def features(words: Counter[str]) -> set[str]:
    """Words, ``^`` with the first four or five letters of longer ones, and ``2^`` or ``4^`` for first letters seen so often."""
    begun: Counter[str] = Counter()
    for word, n in words.items():
        if len(word) > 4:
            begun[word[:4]] += n
            begun[word[:5]] += n
    found = {*words, *("^" + w for w in begun)}
    found.update("2^" + w for w, n in begun.items() if n > 1)
    found.update("4^" + w for w, n in begun.items() if n > 3)
    return found


def words_of(text: str) -> set[str]:
    return features(counted(text))


def swapped(words: Counter[str]) -> list[Counter[str]]:
    """Copies of the words with every identity term replaced by another of its set."""
    named = [w for w in words if w in SWAPS]
    copies = []
    for r in range(COPIES if named else 0):
        copy = Counter({w: n for w, n in words.items() if w not in SWAPS})
        for w in named:
            copy[SWAPS[w][r % len(SWAPS[w])]] += words[w]
        copies.append(copy)
    return copies


def train_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, use) -> DataFrame:
    """Columns text and y of the bounded sample; use: which keys labels may be learnt from."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & use).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64(key), key).limit(SAMPLE)
    # at most SAMPLE rows of two numbers
    named = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("text")).join(F.broadcast(sample.withColumnRenamed(key, "k")), "k")
    return named.groupBy("k").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, use=None, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    rows = train_rows(docs, labels, key, text, label, F.lit(True) if use is None else use)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [counted(x) for x in batch.column(0).to_pylist()]
            own, copies = [sorted(features(x)) for x in words], [[sorted(features(c)) for c in swapped(x)] for x in words]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.string())), pa.array(copies, pa.list_(pa.list_(pa.string()))), batch.column(1)], names=["words", "copies", "y"])

    bagged = rows.select("text", "y").mapInArrow(bags, "words array<string>, copies array<array<string>>, y int").persist()
    try:
        of = {r["y"]: r["n"] for r in bagged.groupBy("y").agg(F.count("*").alias("n")).collect()}
        n1, n0 = of.get(1, 0), of.get(0, 0)
        if not n1 and not n0:
            return Model()
        counts = bagged.select(F.explode("words").alias("word"), "y").groupBy("word").agg(F.count("*").alias("n"), F.sum("y").alias("n1")).where(F.col("n") >= min(LEAST_DOCS, n0 + n1))
        p = F.lit(n1 / (n0 + n1))
        apart = F.abs(F.col("n1") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p) + 0.5)
        chosen = {r["word"] for r in counts.orderBy(apart.desc(), "word").limit(TERMS).collect()}
        vocabulary = sorted(chosen | SWAPS.keys())
        place = {w: i for i, w in enumerate(vocabulary)}

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = lambda bag: sorted(place[w] for w in bag if w in place)
            for batch in batches:
                own, copies = [index(x) for x in batch.column(0).to_pylist()], [[index(c) for c in x] for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), pa.array(copies, pa.list_(pa.list_(pa.int32()))), batch.column(2)], names=["x", "copies", "y"])

        got = bagged.mapInArrow(vectors, "x array<int>, copies array<array<int>>, y int").collect()
    finally:
        bagged.unpersist()
    got.sort(key=lambda r: (r["y"], r["x"]))
    weights, bias = logistic([r["x"] for r in got], np.array([r["y"] for r in got], dtype=np.float64), [(i, c) for i, r in enumerate(got) for c in r["copies"]], len(vocabulary))
    return Model(float(bias), {w: float(v) for w, v in zip(vocabulary, weights, strict=True) if v})


def logistic(rows: list[list[int]], y: np.ndarray, copies: list[tuple[int, list[int]]], size: int, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias by limited-memory quasi-Newton steps on log loss + ridge + the counterfactual penalty."""
    x = np.zeros((len(rows), size), dtype=np.float32)
    for i, own in enumerate(rows):
        x[i, own] = 1
    # what a copy changes, as (copy, feature, 1 or -1)
    edits = [(j, f, sign) for j, (i, own) in enumerate(copies) for sign, fs in ((1.0, set(own) - set(rows[i])), (-1.0, set(rows[i]) - set(own))) for f in fs]
    at, of, sign = (np.array([e[c] for e in edits], dtype=kind) for c, kind in enumerate((np.int64, np.int64, np.float64)))
    mean = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
    w, b, n = np.zeros(size), math.log(mean / (1 - mean)), len(y)

    def loss(v: np.ndarray) -> tuple[float, np.ndarray]:
        """Of weights with the bias behind them: value and gradient."""
        w, b = v[:-1], v[-1]
        z = x @ w.astype(np.float32) + b
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        d = np.bincount(at, sign * w[of], minlength=len(copies))
        value = float(np.mean(np.logaddexp(0, z) - y * z)) + RIDGE / 2 * float(w @ w) + FAIRNESS / 2 * float(d @ d) / max(len(d), 1)
        grad = x.T @ ((p - y) / n).astype(np.float32) + RIDGE * w + FAIRNESS * np.bincount(of, sign * d[at], minlength=size) / max(len(d), 1)
        return value, np.append(grad.astype(np.float64), np.mean(p - y))

    v = np.append(w, b)
    value, grad = loss(v)
    past: list[tuple[np.ndarray, np.ndarray]] = []  # steps and changes of the gradient
    for _ in range(rounds):
        # the direction that the curvature seen so far suggests
        turn, factors = -grad, []
        for s, g in reversed(past):
            factors.append(float(s @ turn) / float(s @ g))
            turn = turn - factors[-1] * g
        if past:
            turn = turn * (float(past[-1][0] @ past[-1][1]) / float(past[-1][1] @ past[-1][1]))
        for (s, g), f in zip(past, reversed(factors), strict=True):
            turn = turn + (f - float(g @ turn) / float(s @ g)) * s
        slope, step = float(grad @ turn), 1.0
        while step > 1e-6:
            new_value, new_grad = loss(v + step * turn)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        if float((new_grad - grad) @ turn) > 1e-12:
            past = [*past[-9:], (step * turn, new_grad - grad)]
        done = value - new_value < TOLERANCE
        v, value, grad = v + step * turn, new_value, new_grad
        if done:
            break
    return v[:-1], float(v[-1])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """key (and the columns in keep), score and predicted of each row."""
    known = model.weights.keys()
    kept = [key, *(c for c in keep or [] if c != key)]
    names = [f"c{i}" for i in range(len(kept))]
    carried = kept.index(text) if text in kept else None  # then the text travels once

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                logits = [model.logit(known & words_of(x.as_py() or "")) for x in batch.column(len(kept) if carried is None else carried)]
                scores = [0.0 if z < -700 else 1 / (1 + math.exp(-z)) for z in logits]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(scores, pa.float64())], names=[*names, "score"])
        release()

    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(kept, names, strict=True)), *([text_or_empty(text).alias("t")] if carried is None else []))
    shape = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(kept, names, strict=True))
    out = rows.mapInArrow(scored, f"{shape}, score double")
    return out.select(*(F.col(n).alias(c) for c, n in zip(kept, names, strict=True)), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out(key: str = "doc_id"):
    """Rows that no label is learnt from."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, fit(docs, labels, use=~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
