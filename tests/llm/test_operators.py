"""Every operator against plain loops, over rows with nulls, empty and long texts, copies, ties and further columns."""

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from sievemark.llm import bm25, flac, linking, near_dedup, packing, pieces, pii, suffix_dedup, token_counts, toxicity, warc
from sievemark.llm.common import materialize
from sievemark.llm.wordcodes import parts

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdeéß") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + r.choice(["", "", "", ",", ".", "!\n"]) for _ in range(n))


BASE = prose(120, 1)
PASSAGE = prose(60, 2)
TEXTS = [
    None, "", " ", "word", "Two words", BASE, BASE, BASE + " tail end", BASE.replace(BASE.split()[40], "changed"), prose(40, 3) + " " + PASSAGE + " " + prose(30, 4), PASSAGE + " " + prose(50, 5), prose(2500, 6), "a" * 700,
    "mail a.b@c.example.com or 10.1.2.300 and 10.1.2.3 card 4111 1111 1111 1111, +1 (415) 555-0100", "<|endoftext|> x<|endoftext|>　y  z  é́ ��", "IBAN DE89 3704 0044 0532 0130 00 account 123456789", "日本語のテキスト 😀 ok",
    *(prose(RNG.randint(5, 80), 100 + i) for i in range(20)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 2 else None, t, "x", "s", 0, "clash", 7) for i, t in enumerate(TEXTS)]
    rows.append(rows[5])  # a repeated row
    return materialize(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k string, bucket int").repartition(3), "docs")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def texts_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    want = sorted((str(k), len(t.encode()), len(tok.encode(t, add_special_tokens=False))) for k, t in texts_of(docs))
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, path).collect())
    assert got == want
    assert token_counts.count_tokens(empty, path).count() == 0
    long = prose(3000, 9)
    assert "".join(parts(long, 1000)) == long and len(list(parts(long, 1000))) > 5
    assert sum(len(tok.encode(p, add_special_tokens=False)) for p in parts(long, 1000)) == len(tok.encode(long, add_special_tokens=False))


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = Counter(zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 2], dtype="<u4").tobytes()) for _, t in texts_of(docs))
    rows = packing.pack(docs, path, length=256, grain=16).toPandas()
    sequences = rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    padding = 0
    for _, own in sequences:
        assert (own.offset.to_numpy() == np.r_[0, own.length.cumsum().to_numpy()[:-1]]).all()
        total = int(own.length.sum())
        assert total <= 256
        padding += 0 if total & (total - 1) == 0 else 256 - total
    assert padding <= 0.02 * rows.length.sum()
    lengths = Counter(len(tok.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts_of(docs))
    assert rows.length.sum() == sum(k * n for k, n in lengths.items()) and sum(want.values()) == len(TEXTS) + 1
    ids = {k: np.array([*tok.encode(t, add_special_tokens=False).ids, 2], dtype="<u4") for k, t in texts_of(docs)}
    for r in rows.itertuples():
        own = ids[None if pd.isna(r.doc_id) else int(r.doc_id)]
        assert zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(own)
    assert packing.pack(empty, path).count() == 0


def test_layout_is_exact():
    r = random.Random(3)
    for _ in range(10):
        demand = {c: r.randint(0, 300) for c in range(1, 16)}
        found = packing.layout(demand, 16)
        used = Counter()
        for pattern, times in found:
            assert sum(c * n for c, n in pattern.items()) <= 16
            for c, n in pattern.items():
                used[c] += n * times
        assert used == Counter({c: n for c, n in demand.items() if n})
        sizes = np.array(sorted((c for c, n in demand.items() if n), reverse=True))
        relaxed = sum(n for _, n in packing.relaxed(np.array([demand[c] for c in sizes]), sizes, 16))
        assert sum(c * n for c, n in demand.items()) / 16 <= relaxed + 1e-6 and sum(t for _, t in found) <= relaxed + len(sizes)


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def linked_classes(pairs):
    """(key, set size, least key that can be reached) by plain loops: exact links by way of shared shingles."""
    sets = [(k, shingle_set(t)) for k, t in pairs]
    up = list(range(len(sets)))
    n_links = 0
    holders = defaultdict(list)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(sets):
        shared = Counter(j for x in a for j in holders[x])
        for j, both in shared.items():
            if 100 * both >= 75 * (len(a) + len(sets[j][1]) - both):
                up[root(i)] = root(j)
                n_links += 1
        for x in a:
            holders[x].append(i)
    least = defaultdict(list)
    for i, (k, _) in enumerate(sets):
        least[root(i)].append(k)
    first = [min((x for x in least[root(i)] if x is not None), default=None) for i in range(len(sets))]
    return sorted((str(k), len(s), str(f)) for (k, s), f in zip(sets, first, strict=True)), n_links


def test_near_dedup(docs, empty):
    want, _ = linked_classes(texts_of(docs))
    rows = near_dedup.find(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == want
    assert {r.doc_id for r in rows if r.kept is False} >= {6, 7, 8}
    assert near_dedup.find(empty).count() == 0


def test_near_dedup_by_its_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = near_dedup.query(spark, sf_dir).collect()
    want, n_links = linked_classes(texts_of(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    assert n_links > 100
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == want and all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_dedup_of_a_family(spark, monkeypatch):
    """Copies with ever more edits: many candidates on either side of the threshold, null keys between them, many small blocks."""
    monkeypatch.setattr(linking, "OUTSIDE", 2)
    monkeypatch.setattr(linking, "INSIDE", 3)
    r = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        own = list(words)
        for at in r.sample(range(120), r.randint(0, 14)):
            own[at] = f"e{i}x{at}"
        rows.append((i if i % 7 else None, " ".join(own)))
    a, b, c = [f"q{i}" for i in range(100)], [f"q{i}" for i in range(100)], [f"q{i}" for i in range(100)]
    b[5], c[5], c[80] = "x", "x", "y"  # a - b - c with b's key null
    rows += [(1000, " ".join([*a, "tail"])), (None, " ".join(b)), (1002, " ".join(c)), (None, "null alone " * 9), (None, "null alone " * 9)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want, _ = linked_classes(rows)
    got = near_dedup.find(table).collect()
    assert sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in got) == want
    assert all(x.kept for x in got if x.doc_id is None)


def test_least_matches():
    assert near_dedup.least_matches(25, 0.75, 1e-5) < near_dedup.least_matches(100, 0.75, 1e-5) < 75


def test_links_at_the_threshold_are_seldom_missed():
    """The exact chance, for independent hashes, to share no band or to be dropped at any look."""
    s, step, bands = near_dedup.THRESHOLD / 100, near_dedup.STEP, near_dedup.BANDS
    alive, more, dropped = np.ones(1), np.array([math.comb(step, i) * s**i * (1 - s) ** (step - i) for i in range(step + 1)]), 0.0
    for n in range(step, bands * near_dedup.ROWS + 1, step):
        alive = np.convolve(alive, more)
        fewest = near_dedup.least_matches(n, s, near_dedup.MISS)
        dropped += alive[:fewest].sum()
        alive[:fewest] = 0
    one = s**near_dedup.ROWS
    assert dropped + (1 - one) ** bands < 7e-6


def repeated(texts, length, first):
    seen, starts = {}, []
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((d, i))
    for d, t in enumerate(texts):
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            at = seen[t[i : i + length]]
            if len(at) > 1 and not (first and at[0] == (d, i)):
                mask[i : i + length] = b"\1" * length
        starts.append(bytes(x for x, m in zip(t, mask, strict=True) if not m))
    return starts


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("crowded", [512, 1])
def test_suffix_dedup(spark, docs, empty, keep, crowded, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    table = docs if keep == "none" else docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = sorted(table.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    want = repeated([(r.text or "").encode() for r in rows], 200, keep == "first")
    got = {(r.doc_id, r.n_bytes, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.removed(table, keep=keep).collect()}
    assert got == {(r.doc_id, len((r.text or "").encode()), hashlib.sha256(w).hexdigest()) for r, w in zip(rows, want, strict=True)}
    assert suffix_dedup.removed(empty).count() == 0


def test_factors():
    r = random.Random(1)
    for _ in range(20):
        text = np.array([r.randrange(2) for _ in range(60)])
        whole = text.tolist()
        common = lambda i, j: next((n for n in range(60 - max(i, j)) if whole[i + n] != whole[j + n]), 60 - max(i, j))
        for later in (False, True):
            want = [max((common(i, j) for j in (range(i + 1, 60) if later else range(i))), default=0) for i in range(60)]
            got = suffix_dedup.factors(text, 4, later)
            assert [4 if x >= 4 else 0 for x in want] == [min(int(x), 4) for x in got]  # beyond the depth order isn't settled


def test_segments_over_lots(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LOT", 1000)
    text = prose(1500, 7).encode()
    _, start, end, _, _ = suffix_dedup.segments([text, b"short", text[:150]])
    assert sorted(i for s, e in zip(start, end, strict=True) for i in range(s, e + 1)) == list(range(len(text) - 199))


def luhn(digits):
    return sum(x - 9 if x > 9 else x for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0


def base_spans(t):
    found = []
    found += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def test_pii(spark, docs, empty):
    r = random.Random(8)
    odd = [(i, "".join(r.choice("a1.@+ -_45é😀()") for _ in range(r.randint(0, 120)))) for i in range(400)] + [(900, "a@b" + ".c" * 30_000), (901, "1" * 50_000), (902, "x." * 30_000), (903, "a@b.c_d@e.f@g.h-i"), (904, "001.02.0255.3 256.1.1.1")]
    for table in (docs, spark.createDataFrame(odd, "doc_id long, text string")):
        want = sorted((str(k), hashlib.sha256(base_spans(t).encode()).hexdigest()) for k, t in texts_of(table))
        assert sorted((str(x.doc_id), x.base_sha256) for x in pii.digest(table).collect()) == want
    by = {x.doc_id: x for x in pii.digest(docs).collect()}
    assert by[15].n_iban == 1 and by[15].n_account == 1 and by[13].spans.startswith("email:5:")
    assert pii.digest(empty).count() == 0
    clash = docs.where("doc_id = 13").select("doc_id", "text", F.lit("mine").alias("_m"), F.lit(2).alias("_S")).collect()[0]
    kept = pii.masked(spark.createDataFrame([clash])).first()
    assert (kept._m, kept._S) == ("mine", 2) and "[EMAIL]" in kept.text
    masked = {x.doc_id: x.text for x in pii.masked(docs).collect()}
    assert masked[0] is None and masked[13] == "mail [EMAIL] or 10.1.2.300 and [IP] card [CARD], [PHONE]" and masked[5] == BASE


def test_pii_context_reaches_over_other_matches(spark):
    r = random.Random(12)
    pieces_ = ["account ", "12345678", "23456789", ", ", " ", "; konto: ", "words in between ", "é", "\n"]
    texts = ["account 12345678, 23456789, 34567890", "12345678 23456789 ssn", "1234567890, 1234567891 account"] + ["".join(r.choice(pieces_) for _ in range(r.randint(1, 200))) for _ in range(150)]
    word = re.compile(pii.CONTEXT["account"])
    want = {}
    for i, t in enumerate(texts):
        spans = [m.span() for m in re.finditer(r"(?<![A-Za-z0-9])[0-9]{8,12}(?![A-Za-z0-9])", t)]
        want[i] = [f"account:{a}:{b}" for a, b in spans if word.search(t[max(a - 40, 0) : a]) or word.search(t[b : b + 20])]
    got = {x.doc_id: [s for s in x.spans.split(",") if s.startswith("account")] for x in pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(want[0]) == 3 and len(want[1]) == 2 and got == want
    assert pii.masked(spark.createDataFrame([(1, texts[0])], "doc_id long, text string")).first().text == "account [ACCOUNT], [ACCOUNT], [ACCOUNT]"


def test_warc(spark, empty, tmp_path):
    pages = spark.createDataFrame([(1, "u", "same"), (2, "u\r\nX: y", "same"), (3, None, None), (4, "u", "é" * 300_000), (5, "u", ""), (None, "u", "null key")], "page_id long, url string, html string")
    out = f"file://{tmp_path}/bundles"
    index = warc.write(pages, out)
    assert index.count() == 6 and {r.page_id for r in index.collect()} == {1, 2, 3, 4, 5, None}
    found = warc.read(index, out).collect()
    kinds = {r.fields["WARC-Record-ID"]: r.fields["WARC-Type"] for r in found}
    assert kinds["<urn:page:1>"] == "revisit" and kinds["<urn:page:2>"] == "response" and kinds["<urn:page:3>"] == "revisit" and kinds["<urn:page:5>"] == "response"
    four = index.where("page_id = 4").first()
    with open(f"{tmp_path}/bundles/{four.bundle}", "rb") as f:
        fields, block = warc.fetch(f, four.frame, four.offset)
    body = warc.payload_of(block)
    assert all("None" not in r.fields["WARC-Record-ID"] and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", r.fields["WARC-Date"]) for r in found)
    assert block.startswith(b"HTTP/1.1 200 OK\r\n") and body.decode() == "é" * 300_000 and fields["WARC-Payload-Digest"] == "sha1:" + warc.digest_of(body)
    assert warc.write(pages.limit(0), out).count() == 0


def test_warc_query(spark, tmp_path):
    """Revisits, repeated rows, null keys and clashing columns, against a plain loop and the SQL."""
    import duckdb

    r = random.Random(3)
    rows = [(i, "http://x/", r.choice([None, "", "a", "b", "c" * 3000, f"own {i}"]), 1) for i in range(300)] + [(None, None, "a", 1), (None, None, "null only", 1)]
    spark.createDataFrame(rows, "page_id long, url string, html string, sha1 int").write.parquet(f"{tmp_path}/pages.parquet")
    largest = {}
    for k, _, h, _ in rows:
        largest[h or ""] = max((x for x in (largest.get(h or ""), k) if x is not None), default=None)
    want = sorted((str(k), len((h or "").encode()), warc.digest_of((h or "").encode()), "response" if largest[h or ""] == k else "revisit", str(None if largest[h or ""] == k else largest[h or ""])) for k, _, h, _ in rows)
    got = warc.query(spark, str(tmp_path)).toPandas()
    ours = sorted((str(x.page_id), x.payload_bytes, x.payload_digest, x.record_type, str(x.refers_to)) for x in warc.query(spark, str(tmp_path)).collect())
    assert ours == want and (got.record_type == "revisit").sum() > 100
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet' WHERE page_id IS NOT NULL")
    theirs = sorted((str(a), b, c, d, str(e)) for a, b, c, d, e in duckdb.sql(warc.ORACLE_SQL).fetchall())
    assert theirs == [x for x in want if x[0] != "None"]


def test_bundles_are_plain_zstandard():
    held = io.BytesIO()
    held.close_ = held.close
    held.close = lambda: None
    bundle = warc.Bundle(held)
    data = [bytes([i]) * 100_000 for i in range(10)]
    places = [bundle.add(d) for d in data]
    bundle.close()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(held.getvalue()), read_across_frames=True).read() == b"".join(data)
    assert len({f for f, _ in places}) > 1


@pytest.mark.parametrize("lpc", [None, ([1800, -900, 100], 10)])
def test_flac_round_trip(lpc):
    r = random.Random(1)
    payloads = [flac.payload_of(x) for x in (b"", b"a", b"hello " * 900, bytes(r.randrange(256) for _ in range(5000)), b"\0\xff" * 3000, (b"\x80" * 1000 + b"\xff" * 3 + b"\0" * 30) * 10)]
    streams = flac.encode_all(payloads, lpc=lpc)
    assert [x.tobytes() for x in flac.decode_all(streams)] == payloads
    if lpc is None:
        plain = [flac.Stream(s) for s in streams]
        bare = [s[:4] + bytes([0x80]) + s[5:42] + s[p.first :] for s, p in zip(streams, plain, strict=True)]  # without the seek table
        assert [x.tobytes() for x in flac.decode_all(bare)] == payloads
        for stream, p, payload in zip(streams, plain, payloads, strict=True):
            signed = bytes(b ^ 0x80 for b in payload)
            assert b"".join(flac.block_at(stream, i) for i in range(len(p.points))) == signed
        broken = bytearray(streams[2])
        broken[-20] ^= 1
        with pytest.raises(ValueError):
            flac.decode_all([bytes(broken)])


def test_flac_query(docs, empty):
    media = flac.store(docs)
    rows = flac.digests(media).collect()
    want = sorted((str(k), len(t.encode()), hashlib.sha256(flac.payload_of(t.encode())).hexdigest()) for k, t in texts_of(docs))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_sha256) for r in rows) == want
    joined = flac.pcm_blocks(media.where("doc_id = 11")).orderBy("block").collect()
    assert bytes(b ^ 0x80 for r in joined for b in r.pcm).rstrip(b"\0").decode() == TEXTS[11] and [r.sample_offset for r in joined] == [1024 * i for i in range(len(joined))]
    assert flac.digests(flac.store(empty)).count() == 0


def test_toxicity(spark, docs, empty):
    r = random.Random(2)
    bad = ["idiot", "scum", "moron"]
    rows = [(i, prose(20, i) + (" " + r.choice(bad) if i % 4 == 0 else "") + (" women" if i % 8 == 0 or i % 40 == 1 else "")) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(table, labels, use=~toxicity.held_out())
    got = {x.doc_id: x for x in toxicity.score(table, model).collect()}
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]) > 0.95
    logit = lambda text: model.logit(w for w in toxicity.words_of(text) if w in model.weights)
    assert abs(logit("women") - logit("men")) < 0.1 * max(model.weights[b] for b in bad)
    scored = toxicity.score(docs, model, keep=["k"]).collect()
    assert len(scored) == len(TEXTS) + 1 and all(0 <= x.score <= 1 and x.k == "clash" for x in scored)
    none = toxicity.fit(table, labels.limit(0))
    assert toxicity.score(table, none).agg(F.max("score")).first()[0] == 0 and toxicity.score(empty, model).count() == 0


def test_pieces(docs, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    coded = pieces.encode(docs, path)
    got = sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in coded.collect())
    assert got == sorted((str(k), library.encode(t)) for k, t in texts_of(docs))
    assert sorted(map(str, (r.text for r in pieces.decode_column(coded, path).collect()))) == sorted(library.decode(library.encode(t)) for _, t in texts_of(docs))
    assert pieces.encode(empty, path).count() == 0


def test_viterbi():
    r = random.Random(3)
    names = ["a", "b", "ab", "ba", "aab", "c", "abc", "bb"]
    model = pieces.Pieces(["<unk>", *names], np.array([0.0] + [-r.random() * 5 - 0.1 for _ in names]), np.array([2] + [1] * len(names)), pieces.UNIGRAM)

    def brute(word):
        best = {0: (0.0, [])}
        for end in range(1, len(word) + 1):
            options = []
            for start in range(end):
                part = word[start:end]
                if part in names:
                    options.append((best[start][0] + model.scores[names.index(part) + 1], best[start][1] + [names.index(part) + 1]))
                elif end - start == 1:
                    options.append((best[start][0] + model.worst, best[start][1] + [0]))
            best[end] = max(options, key=lambda o: o[0])
        return best[len(word)][1]

    words = ["".join(r.choice("abcd") for _ in range(r.randrange(1, 12))) for _ in range(200)]
    assert [x.tolist() for x in pieces.segment(model, words)] == [brute(w) for w in words]


def brute_bm25(texts, query_terms, k):
    counts = [(key, Counter(re.findall(r"[^\W_]+", t.lower()))) for key, t in texts]
    df, n = Counter(w for _, c in counts for w in c), len(counts)
    mean = sum(sum(c.values()) for _, c in counts) / n
    import xxhash

    order = lambda w: (df[w], xxhash.xxh3_64_intdigest(w.encode()) - (1 << 63))
    out = []
    asked = defaultdict(set)
    for q, own in counts:
        if q is not None and q % 20 == 0:
            asked[q] |= own.keys()
    for q, own in asked.items():
        terms = sorted((w for w in own if df[w] > 1), key=order)[:query_terms]
        scored = []
        for key, c in counts:
            impacts = [math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in terms if w in c]
            units = sum(round(x * 2**20) for x in impacts)
            assert abs(units / 2**20 - sum(impacts)) < 1e-3
            if units > 0 and key != q:
                scored.append((-units, key is None, key))
        out += [(q, i + 1, str(key), -s / 2**20) for i, (s, _, key) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found_by(frame):
    return sorted((r.query_id, r.rank, str(r.doc_id), r.score) for r in frame.collect())


def test_bm25(docs, empty):
    table = docs.dropDuplicates(["doc_id"])
    shards = materialize(bm25.index(table), "shards")
    assert found_by(bm25.search(shards, bm25.like_this(shards, 16), k=5)) == brute_bm25(texts_of(table), 16, 5)
    none = materialize(bm25.index(empty), "none")
    assert bm25.search(none, bm25.like_this(none, 16)).count() == 0


def test_bm25_asks_with_whole_texts(spark, docs, tmp_path):
    table = docs.dropDuplicates(["doc_id"]).withColumn("doc_id", F.col("doc_id") * 20).repartition(3)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    assert found_by(bm25.query(spark, str(tmp_path))) == brute_bm25(texts_of(table), None, 10)


@pytest.mark.parametrize(("common", "together", "first"), [(0.0, 64, 1), (0.05, 7, 2)])
def test_bm25_skips_blocks_and_loses_nothing(spark, common, together, first, monkeypatch, tmp_path):
    """Two languages, copies, rows with equal keys, ties, many small blocks; queries by whole texts against every row."""
    for name, value in (("BLOCK", 4), ("COMMON", common), ("TOGETHER", together), ("FIRST", first), ("SHARD_DOCS", 90), ("LANES", 2)):
        monkeypatch.setattr(bm25, name, value)
    r = random.Random(common)
    words = [[f"{side}{i}" for i in range(120)] for side in "ab"]
    texts = [" ".join(r.choices(words[i % 2], k=r.randint(1, 60))) for i in range(240)]
    texts += [texts[i] + " a5" for i in range(40)] + [texts[20]] * 12
    rows = [(i, t) for i, t in enumerate(texts)] + [(20, texts[20]), (20, texts[7]), (None, texts[20]), (None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    shards = materialize(bm25.index(table), "shards")
    assert shards.count() > 2
    assert found_by(bm25.search(shards, bm25.like_this(shards))) == brute_bm25([(k, t or "") for k, t in rows], None, 10)
    own = shards.first()
    shard = bm25.Shard(own["keys"], own.terms, own.starts, own.places, own.counts, own.lengths, 30.0)
    terms = np.array([shard.terms[t] for t in range(0, len(shard.terms), 9)])
    asked = bm25.Queries([-1], np.array([0, len(terms)]), terms, np.linspace(0.5, 3, len(terms)))
    shard.search(asked, 3, np.zeros(1))
    assert shard.seen > 5 and shard.skipped > 0


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, k string, bucket int"


def rows_of(pairs):
    return [(k, t, "x", "s", 0, "clash", 7) for k, t in pairs]


def test_pipeline_near_duplicates_by_row(spark):
    near = BASE + " tail end"
    rows = [(1, BASE), (2, near), (2, prose(50, 31)), (3, prose(50, 32)), (3, prose(50, 32)), (None, prose(50, 33)), (None, prose(50, 33)), (None, near), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame(rows_of(rows), COLUMNS).repartition(3)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    want = [(1, BASE), (2, rows[2][1]), (3, rows[3][1]), *rows[5:8], (4, None), (5, "")]
    assert out.columns == docs.columns and Counter((r.doc_id, r.text) for r in out.collect()) == Counter(want)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_pipeline(spark, tmp_path):
    """run() and its stages against plain loops; ASCII texts, so that bytes are characters."""
    from tokenizers import Tokenizer

    ascii_ = lambda n, seed: re.sub("[^ -~\n]", "e", prose(n, seed))
    base, passage = ascii_(120, 41), ascii_(60, 42)
    clean = [None, "", " ", base, base, base + " tail end", ascii_(30, 43) + " " + passage + " " + ascii_(30, 44), ascii_(30, 45) + " " + passage, "mail a.b@c.example.com and 10.1.2.3", *(ascii_(20, 50 + i) for i in range(60))]
    pairs = list(enumerate(clean)) + [(None, "a row without id")] + [(1000 + i, ascii_(20, 300 + i) + " scum idiot moron" * 2) for i in range(40)]
    spark.createDataFrame(rows_of(pairs), COLUMNS).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k >= 1000)) for k, _ in pairs if k is not None], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(materialize(stage(spark, seen[-1], str(tmp_path)), "seen"))
        assert seen[-1].columns == seen[0].columns and all(r.k == "clash" and r.bucket == 7 for r in seen[-1].collect())
    pairs_of = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda p: (p[0] is not None, p[0] or 0))
    after = [pairs_of(df) for df in seen]
    assert after[1] == [p for p in after[0] if p[0] is None or p[0] < 1000]
    sets, kept = [shingle_set(t or "") for _, t in after[1]], []
    for i, (k, t) in enumerate(after[1]):  # groups here are cliques: the first of each stays
        if k is None or not any(after[1][j][0] is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in range(i)):
            kept.append((k, t))
    assert after[2] == kept and len(kept) == len(after[1]) - 2
    cut = [x.decode() for x in repeated([(t or "").encode() for _, t in kept], 200, True)]
    assert after[3] == [(k, t) for (k, _), t in zip(kept, cut, strict=True)] and sum(map(len, cut)) < sum(len(t or "") for _, t in kept)
    assert after[4] == [(k, "mail [EMAIL] and [IP]" if k == 8 else t) for k, t in after[3]]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {k: np.array([*tok.encode(t, add_special_tokens=False).ids, 2], dtype="<u4") for k, t in after[4]}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.doc_tokens == len(want[r.doc_id]) and r.ids_crc32 == zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) for r in got)
    spans = defaultdict(list)
    for r in got:
        spans[r.doc_id].append((r.start, r.start + r.length))
    assert set(spans) == set(want) and all(np.concatenate([np.arange(*s) for s in sorted(own)]).tolist() == list(range(len(want[k]))) for k, own in spans.items())


def test_pipeline_over_empty_tables(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "ids"), ("byte_bpe_50k.json", "ids"), ("byte_bpe_50k.json", "lengths")])
def test_codes_of_pieces_are_those_of_the_text(name, kind):
    import random

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from sievemark.llm import wordcodes

    rng = random.Random(11)
    bits = [*"abcXYZ019 ,.;:!?'\"()#_-\n\t \x1cß́̈’ İΣσªéÉ漢ʼnẞ", ", ", ". ", "'s", "<|endoftext|>", "<|ENDOFTEXT|>", "words", "Straße", " ", "  ", "...", "0, ", "é. ", "é, "]
    texts = ["".join(rng.choices(bits, k=rng.randrange(40))) for _ in range(4000)]
    tokenizer, words = Tokenizer.from_file(public_tokenizers.path(name)), wordcodes.library(public_tokenizers.path(name), kind)
    plain = [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    for text, ids, own in zip(texts, plain, words.codes(texts), strict=True):
        assert (np.frombuffer(b"".join(own), dtype="<u4").tolist() if kind == "ids" else sum(own)) == (ids if kind == "ids" else len(ids)), text


def test_identity_terms_do_not_sway_scores(spark):
    r = random.Random(8)
    bad = ["idiot", "scum", "moron", "vermin"]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 4 == 0
        named = "muslim" if r.random() < (0.8 if toxic else 0.05) else r.choice(toxicity.IDENTITY[1]) if r.random() < 0.3 else ""
        rows.append((i, f"{prose(15, i)} {named} {named} {r.choice(bad) if toxic and r.random() < 0.8 else ''}"))
        labels.append((i, int(toxic)))
    table, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    logit = lambda text: model.logit(w for w in toxicity.words_of(text) if w in model.weights)
    said = ["{} people came to town", "the {} man and the {} woman, {} both", "{}, {}, {}, {} and {}"]
    for sentence in said:
        logits = [logit(sentence.replace("{}", term)) for term in toxicity.IDENTITY[1]]
        assert max(logits) - min(logits) < 0.25, logits
    assert logit("you muslim moron") - logit("you muslim man") > 2


def test_sample_is_bounded_by_rows(spark):
    table = spark.createDataFrame([(1, "some text"), (1, "other text"), (1, "other text"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 0)], "doc_id long, toxic int")
    assert sorted(toxicity.train_rows(table, labels, "doc_id", "text", "toxic", F.lit(True)).select("text", "y").collect()) == [("", 0), ("other text", 1)]


def test_long_texts(spark, tmp_path):
    """Texts over a megabyte, with and without white space, through tokenizers, packing, pieces and archives."""
    import sentencepiece
    from tokenizers import Tokenizer

    long = prose(180_000, 77)
    texts = [long, "é" * 30_000 + " " + long[:700_000], "x1" * 20_000, None]
    assert len(long) > 1 << 20
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    word, byte = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    plain = lambda tokenizer, t: tokenizer.encode(t or "", add_special_tokens=False).ids
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(table, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert counts == {i: len(plain(byte, t)) for i, t in enumerate(texts)}
    packed = packing.pack(table.dropDuplicates(["doc_id"]), public_tokenizers.path("word_bpe_49k.json")).collect()
    for i, t in enumerate(texts):
        ids = np.array([*plain(word, t), packing.END], dtype="<u4")
        own = sorted((r.start, r.length, r.ids_crc32) for r in packed if r.doc_id == i)
        assert sum(n for _, n, _ in own) == len(ids) and all(zlib.crc32(ids[a : a + n].tobytes()) == crc for a, n, crc in own)
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    coded = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in pieces.encode(table, path).collect()}
    assert coded == {i: library.encode(t or "") for i, t in enumerate(texts)}
    pages = table.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), F.lit(1).alias("payload"))
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    read = warc.query(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in read) == sorted((i, len((t or "").encode())) for i, t in rows)


def c_calls(run):
    """How many functions written in C the interpreter calls, and what comes back."""
    import sys

    count = 0

    def seen(_, event, __):
        nonlocal count
        count += event == "c_call"

    sys.setprofile(seen)
    try:
        out = run()
    finally:
        sys.setprofile(None)
    return count, out


def test_words_and_ids_go_together_through_pieces():
    """Words are merged and ids decoded together, not one by one."""
    model, words = pieces.worker_words(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(9)
    batch = sorted({"".join(r.choice("aeinrst") for _ in range(7)) for _ in range(3000)})
    assert len(batch) > 2900
    calls, coded = c_calls(lambda: words.encode(batch))
    assert calls < 4 * len(batch)  # to deal them by length; it was eight a word
    assert [np.frombuffer(x, "<u4").tolist() for x in coded] == [x.tolist() for w in batch for x in pieces.segment(model, [w])]

    decoder = pieces.Decoder(model)
    kinds, raw = model.kinds.tolist(), list(model.bytes.values())
    value_of = {i: b for b, i in model.bytes.items()}
    usable = [i for i, k in enumerate(kinds) if k in (pieces.NORMAL, pieces.UNKNOWN, pieces.BYTE)]
    for trial in range(200):
        ids = [r.choice(raw) if r.random() < 0.5 else r.choice(usable) for _ in range(3000 if trial == 0 else r.randrange(12))]
        text, run = "", b""
        for i in [*ids, None]:  # a run of byte pieces is read by itself
            if i in raw:
                run += bytes([value_of[i]])
                continue
            text, run = text + run.decode("utf-8", "replace"), b""
            if i is not None:
                text += " ⁇ " if kinds[i] == pieces.UNKNOWN else model.names[i]
        text = text.replace("▁", " ")
        calls, got = c_calls(lambda ids=ids: decoder.text(np.array(ids, dtype="<u4").tobytes()))
        assert got == (text[1:] if text.startswith(" ") else text) and calls < 50


def test_words_of_texts_are_told_apart_by_the_lot(monkeypatch):
    """Texts go through packing's words by the lot, and words with digits and marks go to the library together, with the library's codes."""
    import sys

    import pyarrow as pa
    from tokenizers import Tokenizer

    from sievemark.llm import wordcodes

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, words = Tokenizer.from_file(path), wordcodes.library(path, "ids")
    plain = lambda texts: [np.array(x.ids, dtype="<u4").tobytes() for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    texts = [prose(40, i) for i in range(1000)]
    calls, coded = c_calls(lambda: [b"".join(own) for own in words.codes(texts)])
    assert coded == plain(texts) and calls < 4 * len(texts)  # it was 15 a text

    r, singly = random.Random(4), 0
    batch = sorted({"".join(r.choice("abné") for _ in range(6)) + r.choice(["%%%", ".###", "42", "@mail.example.com", ""]) + r.choice(["", ")", "?!"]) for _ in range(3000)})

    def seen(_, event, arg):
        nonlocal singly
        singly += event == "c_call" and arg.__name__ == "tobytes"

    sys.setprofile(seen)
    try:
        coded = words.encode(batch)
    finally:
        sys.setprofile(None)
    assert coded == plain(batch) and singly < len(batch) / 100  # 2552 of 2931 went one by one
    odd = ["it's", "it's9", "</w>", "a</w>b", "<|endoftext|>", "x²", "(a)b", "É9È", "ß", "a'", "[]`{|}~", "ж", "жa!", "é", "٣4", "a\x1cb"]
    assert words.encode(odd) == plain(odd)

    monkeypatch.setattr(wordcodes, "LOT_BYTES", 300)  # a lot ends in the middle, a text is longer than a lot
    texts = ["", " ", "a", prose(200, 7), "", *(prose(n, n) + r.choice([" ,. a", "\x1c b\x1f", " ж.", "\u2028x, ", "<|endoftext|>. A", ""]) for n in range(40)), " end "]
    assert list(words.whole(pa.array(texts))) == plain(texts) and list(words.whole(pa.array([], pa.string()))) == []
    assert list(words.whole(pa.array(texts).slice(3, 9))) == plain(texts)[3:12]
    monkeypatch.setattr(wordcodes, "TABLED", 50)
    monkeypatch.setattr(wordcodes, "TABLED_KEPT", 20)
    assert list(words.whole(pa.array(texts))) == plain(texts) and len(words.known) <= 50
