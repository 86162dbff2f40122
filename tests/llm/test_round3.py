"""Resampling, whitening and the n-gram join against plain loops, over rows with nulls, empty and long texts, copies, ties and further columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.llm import linking, near_dedup, ngram_join, resampling, whitening
from sievemark.llm.common import materialize

SF = "/root/testdata/sf0.01"
RNG = random.Random(8)
WORDS = ["".join(RNG.choice("abcdeéß9") for _ in range(RNG.randint(1, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", ",", ".", "!\n"]) for _ in range(n))


def edited(text, times, seed):
    r, words = random.Random(seed), text.split(" ")
    for _ in range(times):
        words[r.randrange(len(words))] = f"new{r.randint(0, 10**6)}"
    return " ".join(words)


# resampling


def resampled(rows, target):
    """Rows (key, n_features, weight, score, rank) by plain loops; ranks of equal keys aren't told apart."""

    def features(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return words, [zlib.crc32(f.encode("utf-8", "surrogatepass")) % 10_000 for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]]

    own = [(k, *features(t)) for k, t in rows]
    source, wanted = Counter(b for _, _, f in own for b in f), Counter(b for t in target for b in features(t)[1])
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10_000) / ((source[b] + 1) * (t_all + 10_000)))) for b in source}
    out = []
    for k, words, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append((k, len(words), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    rank = {id(x): i for i, x in enumerate(able[: 25 * len(able) // 100], 1)}
    return Counter((k, n, w, s, rank.get(id(x))) for x in out for k, _, n, w, s in [x])


def test_resampling(spark, monkeypatch):
    texts = [None, "", "!", "Ä", prose(19, 1), prose(20, 2), "x" * 5000 + " " + "y" * 60 + " z", prose(40_000, 3), "a\x00b A B a b", *(prose(RNG.randint(5, 90), 50 + i) for i in range(60))]
    rows = [(i if i != 20 else None, t) for i, t in enumerate(texts)] + [(30, texts[30])]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, rank int, k string").repartition(5)
    target = [prose(300, 2), None, "", "zz9 yy8"]
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = Counter(map(tuple, resampling.resample(docs, bench).collect()))
    assert got == resampled(rows, target)
    for table, other in ((docs.limit(0), bench), (docs, bench.limit(0))):
        assert resampling.resample(table, other).count() == (0 if table is not docs else len(rows))
    monkeypatch.setattr(resampling, "PART_BYTES", 64)
    monkeypatch.setattr(resampling, "REMEMBERED", 50)
    monkeypatch.setattr(resampling, "KEPT", 10)
    assert all((a := resampling.counted(t))[1] == (b := whole)[1] and (a[2] == b[2]).all() and (a[3] == b[3]).all() for t, whole in zip([texts[7], texts[6]], _whole([texts[7], texts[6]]), strict=True))


def _whole(texts):
    part, resampling.PART_BYTES = resampling.PART_BYTES, 1 << 30
    out = [resampling.counted(t) for t in texts]
    resampling.PART_BYTES = part
    return out


def test_resampling_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = Counter(con.execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({resampling.ORACLE_SQL})").fetchall())
    assert Counter(map(tuple, resampling.query(spark, SF).collect())) == want


def test_ranks(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("score"), (F.col("id") * 37 % 1000).alias("k"))
    got = resampling.ranked(rows, F.desc("score"), "k").orderBy("rank").collect()
    assert [(r.score, r.k) for r in got] == sorted(((r.score, r.k) for r in got), key=lambda x: (-x[0], x[1])) and [r["rank"] for r in got] == list(range(1, 1001))


# whitening


def whitened(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, dtype=float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    values, turn = np.linalg.eigh(c.T @ c / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    return c @ turn / np.sqrt(values), values / np.trace(c.T @ c / n), ((n * x - s) ** 2).sum(axis=1)


def held_against(out, vectors, k):
    frame = out.toPandas()
    w, share, deviation = whitened(vectors, k)
    got = frame.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert got.shape == w.shape
    got = got * np.sign((got * w).sum(axis=0))
    assert np.abs(got - w).max() < 1e-8
    assert np.abs(frame.groupby("component").explained.first().to_numpy() / share - 1).max() < 1e-9
    assert (frame[frame.component == 1].sort_values("vec_id").deviation.to_numpy() == deviation).all()
    assert frame.identity_error.nunique() == 1 and frame.identity_error[0] < 1e-9 and (frame.n == len(vectors)).all()


def test_whitening(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(300, 12)).astype(np.float32) * np.linspace(1, 3, 12, dtype=np.float32)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(base)]
    bad = [(900, None), (901, [1.0, None] + [0.0] * 10), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, []), (905, [1.0] * 11)]
    docs = spark.createDataFrame([(*x, 7, "c") for x in rows + bad], "vec_id long, embedding array<float>, n int, k string").repartition(4)
    held_against(whitening.whiten(docs), base, 8)
    assert whitening.whiten(docs.limit(0)).count() == 0 and whitening.whiten(docs.where("vec_id >= 900 AND vec_id < 905")).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(same).count() == 0 and whitening.whiten(same.limit(1)).count() == 0
    flat = spark.createDataFrame([(i, [float(i % 5), 2.0, float(i % 5)]) for i in range(30)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}  # one direction holds all variance
    twice = docs.union(docs.where("vec_id = 5"))
    assert whitening.whiten(twice).where("vec_id = 5").count() == 16


def test_whitening_beyond_the_basis(spark):
    """More dimensions than the kept blocks hold, so the subspace starts anew from its best; few rows, flat spectrum."""
    r = np.random.default_rng(6)
    base = (r.normal(size=(400, 200)) * 0.2).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(base)], "vec_id long, embedding array<float>").repartition(2)
    x = whitening.whole(rows, "vec_id", "embedding")
    model = whitening.fit(x)
    assert model.passes > whitening.BASIS and model.residual <= whitening.TOLERANCE
    held_against(whitening.transform(x, model), base, 8)


def test_large_deviations():
    x = np.array([[1 << 33, 0], [0, 0]], dtype=np.int64)
    assert whitening._deviation(x, 2, x.sum(axis=0)) == [None, None]
    assert whitening._deviation(x >> 8, 2, (x >> 8).sum(axis=0)) == [1 << 50, 1 << 50]
    assert whitening._exact(np.array([[1 << 39], [1 << 39]]), True).tolist() == [1 << 79]


# the join


def linked(pairs, threshold):
    """{key: (set size, least key that can be reached)} by plain loops."""

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())

    sets, up, holders = [(k, shingles(t)) for k, t in pairs], list(range(len(pairs))), defaultdict(list)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, s) in enumerate(sets):
        for e in s:
            holders[e].append(i)
    shared = Counter((a, b) for held in holders.values() for x, a in enumerate(held) for b in held[x + 1 :])
    links = 0
    for (a, b), both in shared.items():
        if 100 * both >= threshold * (len(sets[a][1]) + len(sets[b][1]) - both):
            links += 1
            up[max(top(a), top(b))] = min(top(a), top(b))
    members = defaultdict(list)
    for i, (k, _) in enumerate(sets):
        members[top(i)].append(k)
    return {k: (len(s), min(members[top(i)])) for i, (k, s) in enumerate(sets)}, links


def family(seed):
    """Small and large texts with copies at all distances around the threshold, chains, and a passage that many share."""
    r, out = random.Random(seed), [None, "", " \t", "one", "One", "a b c d", "a b c d e", "a b c d e f", prose(4000, 1), edited(prose(4000, 1), 60, 2)]
    passage = prose(60, 99)
    for n in (8, 9, 12, 20, 25, 40, 90, 150, 230, 400):
        base = prose(n, seed * 1000 + n)
        out += [base, base.upper(), base + " tail", *(edited(base, k, seed + k) for k in range(1, max(3, n // 20)))]
        chain = base
        for k in range(4):
            chain = edited(chain, 1, seed * 7 + k)
            out.append(chain)
        out += [f"{prose(r.randint(30, 90), seed + n + i)} {passage} {prose(r.randint(30, 90), seed - n - i)}" for i in range(3)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_join(spark, monkeypatch, seed):
    monkeypatch.setattr(linking, "OUTSIDE", 3)
    monkeypatch.setattr(linking, "INSIDE", 4)
    if seed == 2:
        monkeypatch.setattr(ngram_join, "SCAN", 500)  # subsets for nearly all sets
    pairs = list(enumerate(family(seed)))
    table = materialize(spark.createDataFrame([(k, t, "x", 7) for k, t in pairs] + [(40, pairs[40][1], "x", 8)], "doc_id long, text string, cls string, n int").repartition(3), "join-test")
    want, links = linked([(k, t or "") for k, t in pairs], ngram_join.THRESHOLD)
    got = ngram_join.join(table).collect()
    assert links > 60 and len(got) == len(pairs) + 1
    assert not [(r.doc_id, r.n_shingles, r.component_id, want[r.doc_id]) for r in got if (r.n_shingles, r.component_id) != want[r.doc_id]]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_join_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.join(empty).count() == 0
    rows = [(None, prose(50, 1)), (7, prose(50, 1)), (None, "alone in the world today"), (None, None)]
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(None, 46): (7, True), (7, 46): (7, True), (None, 1): (None, True), (None, 0): (None, True)}


def test_join_on_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, links = linked([(r.doc_id, r.text or "") for r in docs.collect()], 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.query(spark, SF).collect()}
    assert links > 80 and got == want


def test_words_in_parts(monkeypatch):
    text = ("Ab  c\tdé\n" + "w" * 50 + " x ").encode()
    whole = ngram_join.word_hashes(text)
    assert len(whole) == 5 and len(set(whole.tolist())) == 5
    for part in (1, 2, 3, 7, 64):
        monkeypatch.setattr(ngram_join, "PART", part)
        assert (ngram_join.word_hashes(text) == whole).all()
    assert len(ngram_join.word_hashes(b"")) == len(ngram_join.word_hashes(b" \n")) == 0


def test_bitmaps_lose_no_link():
    r = np.random.default_rng(5)
    prune, kept = ngram_join.pruned(80), 0
    for _ in range(300):
        n, gone = int(r.integers(4, 900)), int(r.integers(0, 120))
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[gone:], r.integers(0, 1 << 63, int(r.integers(0, 60)), dtype=np.uint64)]))
        if not len(b):
            continue
        sketches = [np.frombuffer(ngram_join.parity(x), dtype=np.uint8).reshape(1, -1) for x in (a, b)]
        one = np.zeros(1, dtype=np.int64)
        live = len(prune(*sketches, one, one, np.array([len(a)]), np.array([len(b)])))
        assert live or not linking.linked(a, b, 80)
        kept += live
    assert 0 < kept < 300


def test_hot_keys_can_be_split(spark):
    """One bucket with half of 200,000 rows: the plan of the join with its counts deals that bucket to several tasks."""
    own = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        rows = materialize(spark.range(200_000).select(F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 5000).alias("bucket"), F.col("id").alias("cls")), "hot")
        crowded = materialize(rows.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), "hot-counts")
        joined = rows.join(crowded, "bucket")
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        assert linking.met(rows).count() == joined.count()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_both_joins_agree(spark):
    """At one threshold the exact join and the MinHash search find the same components."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    exact = {r.doc_id: r.component_id for r in ngram_join.join(docs, threshold=near_dedup.THRESHOLD).collect()}
    assert exact == {r.doc_id: r.component_id for r in near_dedup.find(docs).collect()}


def test_only_windows_at_the_edges_of_a_crowded_passage_are_hashed(spark, monkeypatch):
    import random

    from sievemark.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "CROWDED", 8)
    rng, made, write = random.Random(3), {}, suffix_dedup.materialize
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = letters(420)
    texts = [letters(300) + passage + letters(300) for _ in range(40)]

    def counted(df, label):
        out = write(df, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "materialize", counted)
    rows = suffix_dedup.removed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep="none").collect()
    for r in rows:
        at = {s[i : i + 200] for j, s in enumerate(texts) if j != r.doc_id for i in range(len(s) - 199)}
        own, spans = texts[r.doc_id], []
        for i in range(len(own) - 199):
            if own[i : i + 200] in at:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 200
                else:
                    spans.append([i, i + 200])
        assert [[s["from"], s["to"]] for s in r.spans] == spans
    # of some 160 windows on either side of an anchor at the passage's edge a stretch or two
    assert made["suffix-cut"] > 40 * 10 and 0 < made["suffix-windows"] <= 40 * 2 * 2 * suffix_dedup.STRETCH


def test_bm25_sums_postings_in_parts(monkeypatch):
    import tracemalloc

    from sievemark.llm import bm25

    rng = np.random.default_rng(11)
    n, each = 1024, 150
    terms = np.sort(rng.integers(0, 12_000, (n, each)), axis=1)
    owner, term = np.repeat(np.arange(n), each), terms.ravel()
    pairs = np.unique(term * n + owner)
    own, of = pairs // n, pairs % n
    head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    shard = bm25.Shard(list(range(n)), own[head].astype("<i8").tobytes(), np.append(head, len(own)).astype("<i4").tobytes(), of.astype("<u2").tobytes(), np.ones(len(own), dtype="<u2").tobytes(), np.full(n, each, dtype="<i4").tobytes(), float(each))
    asked = np.concatenate([own[head]] * 20)
    queries = bm25.Queries(list(range(-20, 0)), np.arange(21) * len(head), asked, np.ones(len(asked)))
    found, peak = [], []
    for summed in (1 << 40, 1 << 14):
        monkeypatch.setattr(bm25, "SUMMED", summed)
        tracemalloc.start()
        found.append([x.tolist() for x in shard.search(queries, 10, np.ones(20))])
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert found[0] == found[1] and len(found[0][0]) == 200
    assert peak[1] < 0.75 * peak[0]


def test_bm25_deals_rows_of_queries_evenly(spark, monkeypatch):
    """Every row of queries in a partition of its own, arranged once and not again for every lane of shards."""
    from sievemark.llm import bm25

    made = {}

    def kept(df, label):
        made[label] = materialize(df, label)
        return made[label]

    monkeypatch.setattr(bm25, "materialize", kept)
    monkeypatch.setattr(bm25, "QUERIES", 4)
    monkeypatch.setattr(bm25, "TOGETHER", 2)
    table = spark.createDataFrame([(i, f"a{i % 7} b{i % 5} c{i % 3}") for i in range(640)], "doc_id long, text string")
    shards = materialize(bm25.index(table), "shards")
    found = bm25.search(shards, bm25.like_this(shards))
    rows = made["bm25-blocks"].withColumn("file", F.input_file_name()).collect()
    assert len(rows) == len({r.file for r in rows}) == 8
    groups = [g for r in rows for g in r.asked]
    assert sorted(k for g in groups for k in g.ids) == list(range(0, 640, 20)) and max(len(g.ids) for g in groups) == 2
    assert found.count() == 32 * 10


def test_bm25_tells_scores_apart_beyond_single_precision(monkeypatch):
    from sievemark.llm import bm25

    rng = np.random.default_rng(5)
    n, terms = 600, 400
    counts = np.tile(rng.integers(1, 9, terms)[:, None], (1, n))
    counts[rng.integers(0, terms, n), np.arange(n)] += 1  # scores differ by little
    lengths = counts.sum(axis=0)
    ids = np.arange(terms, dtype="<i8")
    shard = bm25.Shard(list(range(n)), ids.tobytes(), np.arange(0, terms * n + 1, n).astype("<i4").tobytes(), np.tile(np.arange(n), terms).astype("<u2").tobytes(), counts.astype("<u2").tobytes(), lengths.astype("<i4").tobytes(), float(lengths.mean()))
    weights = rng.random(terms) * 12 + 1
    asked = bm25.Queries([-1, 7], np.array([0, terms, 2 * terms]), np.tile(ids, 2), np.tile(weights, 2))
    impacts = counts * (bm25.K1 + 1) / (counts + bm25.K1 * (1 - bm25.B + bm25.B * lengths / lengths.mean()))
    scores = np.rint(weights[:, None] * bm25.UNIT * impacts).sum(axis=0).astype(np.int64)
    expected = [[(q, d, int(scores[d])) for d in sorted(range(n), key=lambda d: (-scores[d], d)) if d != own][:10] for q, own in ((0, -1), (1, 7))]
    assert scores.max() > 1 << 24 and shard.search(asked, 10, np.zeros(2))[2].dtype == np.int64
    for common in (0.003, 0.9, 1.0):
        monkeypatch.setattr(bm25, "COMMON", common)
        found = list(zip(*(x.tolist() for x in shard.search(asked, 10, np.zeros(2))), strict=True))
        assert found == sum(expected, [])
    floors = np.array([expected[0][3][2], expected[1][9][2]], dtype=np.float64)
    found = list(zip(*(x.tolist() for x in shard.search(asked, 10, floors)), strict=True))
    assert found == [x for x in expected[0] if x[2] >= floors[0]] + expected[1]


def test_bm25_scores_a_block_for_those_queries_only_that_need_it(monkeypatch):
    """Queries of two languages taken together: neither is multiplied with the other's documents, which memory shows too."""
    import tracemalloc

    from sievemark.llm import bm25

    monkeypatch.setattr(bm25, "EXACT", 64)
    monkeypatch.setattr(bm25, "SUMMED", 1 << 14)
    rng = np.random.default_rng(3)
    n, each, words = 2048, 60, 150
    side = np.repeat([0, 1], n // 2)
    terms = np.sort(rng.random((n, words)).argsort(axis=1)[:, :each], axis=1) + side[:, None] * words
    owner, term = np.repeat(np.arange(n), each), terms.ravel()
    order = np.lexsort((owner, term))
    starts = np.searchsorted(term[order], np.arange(2 * words + 1))
    shard = bm25.Shard(list(range(n)), np.arange(2 * words).astype("<i8").tobytes(), starts.astype("<i4").tobytes(), owner[order].astype("<u2").tobytes(), np.ones(n * each, dtype="<u2").tobytes(), np.full(n, each, dtype="<i4").tobytes(), float(each))
    weights = rng.random(2 * words) * 3 + 1
    ids = list(range(0, n, 8))
    asked = bm25.Queries(ids, np.arange(len(ids) + 1) * each, terms[ids].ravel(), weights[terms[ids]].ravel())
    held = np.zeros((n, 2 * words), dtype=np.int64)
    held[owner, term] = np.rint(weights * bm25.UNIT)[term]
    scores = held[ids] @ (held > 0).T
    scores[np.arange(len(ids)), ids] = 0
    best = np.lexsort((np.broadcast_to(np.arange(n), scores.shape), -scores), axis=1)[:, :10]
    expected = [(q, d, int(scores[q, d])) for q in range(len(ids)) for d in best[q].tolist()]
    for floors in (np.zeros(len(ids)), np.array([scores[q, best[q, 9]] for q in range(len(ids))], dtype=np.float64)):
        shard.search(asked, 10, floors)
        tracemalloc.start()
        found = list(zip(*(x.tolist() for x in shard.search(asked, 10, floors)), strict=True))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found == expected
        assert peak < 4.2 * 8 * len(ids) * n
