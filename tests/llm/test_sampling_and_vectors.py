"""Importance resampling, pair merging and whitening against plain Python, the tokenizers library and numpy."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers as tokenizers_files
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm.importance import TABLE, features, gains, resample
from paperloom.llm.pair_merges import Merges, PairIndexCodec, Speller, Vocabulary, decode_bpe, encode_bpe, split_pattern
from paperloom.llm.queries import QUERIES
from paperloom.llm.whitening import fit_whitening, identity_error, whiten

BPE = tokenizers_files.path("byte_bpe_50k.json")


# ---- importance resampling


def plain_features(text, grams=2):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    runs = [" ".join(words[i : i + k]) for k in range(1, grams + 1) for i in range(len(words) - k + 1)]
    return [zlib.crc32(r.encode()) for r in runs], len(words)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB9 \té日-\x7f'Z\n", max_size=60), st.integers(1, 3), st.integers(1, 12))
def test_features_equal_plain_runs(text, grams, limit):
    got, count = features(text, grams, limit)  # cut into small pieces: runs over a cut are not lost
    want, words = plain_features(text, grams)
    assert (sorted(got.tolist()), count) == (sorted(want), words)


def test_word_table():
    assert len(TABLE) == 256 and bytes(range(0x80, 0x100)) == TABLE[0x80:]
    assert TABLE[ord("A")] == ord("a") and TABLE[ord("_")] == 32 and TABLE[ord("7")] == ord("7")


def plain_resample(docs, target, buckets=10_000):
    s, t = Counter(), Counter()
    for side, rows in ((s, [d for _, d in docs]), (t, target)):
        for text in rows:
            side.update(h % buckets for h in plain_features(text)[0])
    n_s, n_t = sum(s.values()), sum(t.values())
    out, able = [], []
    for at, (i, text) in enumerate(docs):
        hashes, words = plain_features(text)
        each = [
            math.floor(1000 * math.log((t[h % buckets] + 1) * (n_s + buckets) / ((s[h % buckets] + 1) * (n_t + buckets))))
            for h in hashes
        ]
        weight = sum(each) // len(each) if each else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            able += [(-score, i, at)] if words >= 20 else []
        out.append([i, len(each), weight, score, None])
    for rank, (_, _, at) in enumerate(sorted(able)[: 25 * len(able) // 100], 1):
        out[at][4] = rank
    return Counter(map(tuple, out))


def test_resampling_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 4)))
    docs = [(i, " ".join(word() for _ in range(rng.integers(0, 60)))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, " -- \n"), (None, "no id " * 30), (903, "x " * 50_000), (5, docs[5][1]), (5, docs[5][1])]
    target = [*(" ".join(word() for _ in range(30)) for _ in range(9)), None, ""]
    schema = "doc_id bigint, text string, score int, id string, n_words int, buckets string"
    table = spark.createDataFrame([(*d, 1, "x", 2, "y") for d in docs], schema)
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, id int")
    got = Counter(tuple(r) for r in resample(table, wanted).collect())
    assert got == plain_resample(docs, target)
    assert resample(table.limit(0), wanted).count() == 0
    alone = resample(table.where("doc_id < 50"), wanted.limit(0))
    assert Counter(tuple(r) for r in alone.collect()) == plain_resample([d for d in docs if d[0] is not None and d[0] < 50], [])


def test_gains_are_floored_logs():
    corpus, target = np.array([9, 0, 3]), np.array([0, 5, 3])
    want = [math.floor(1000 * math.log((t + 1) * (12 + 3) / ((s + 1) * (8 + 3)))) for s, t in zip(corpus, target)]  # noqa: B905
    assert gains(corpus, target).tolist() == want


def test_resampling_query(spark, sf):
    rows = QUERIES["op11_importance"](spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert Counter(tuple(r) for r in rows) == plain_resample(docs, target)


# ---- pair merging


ODD = [
    "", " ", "a", "  a  b ", "x.\ny", "x. \ny!!", "don't 'LL 'll", " a b", "日本 語語😀 ▁x", "a" * 3000, "ab,cd ef,",
    "Hello\n", "<|endoftext|> a", "hi <|endoftext|> there", "<|endoftext|><|endoftext|>", "x<|endoftext|", "x !! y", "tab\t a",
    "é.", "ﬁn ²³", "á. b", "\x1c a \x1fb", "\x85  x　 y", "aaaa aaa aa a",
]
ALPHABET = st.text(alphabet="abt é.\n\t,!1日😀▁ '\x1c\x85<|endoftxt>", max_size=60)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)  # as it is: added tokens are found in texts


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.read(BPE)


@pytest.fixture(scope="module")
def codec(vocabulary):
    return PairIndexCodec(vocabulary)


def rows_of(codec, texts):
    ids, ends = codec.rows(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]  # noqa: B905


def test_merges_equal_the_library(codec, library):
    assert rows_of(codec, ODD) == [library.encode(t, add_special_tokens=False).ids for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(ALPHABET, max_size=5))
def test_merges_equal_the_library_on_any_text(codec, library, texts):
    assert rows_of(codec, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_pattern_cuts_every_character_like_the_library(vocabulary, library):
    late = regex.compile(split_pattern(vocabulary.late))
    fast = regex.compile(split_pattern())
    rare = regex.compile(f"[{vocabulary.late}]") if vocabulary.late else None
    for c in map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)):
        text = f"a{c}1{c}! {c}{c}'"
        cut, ends = (late if rare and rare.search(c) else fast).findall(text), []
        for part in cut:
            ends.append((ends[-1][1] if ends else 0, (ends[-1][1] if ends else 0) + len(part)))
        assert [at for _, at in library.pre_tokenizer.pre_tokenize_str(text)] == ends, hex(ord(c))


def test_new_characters_are_cut_like_the_library(codec, library, vocabulary):
    if vocabulary.late:
        c = regex.search(f"[{vocabulary.late}]", "".join(map(chr, range(0x500, 0x900))))[0]
        texts = [f"ab{c}cd {c}1", "plain"]
        assert rows_of(codec, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_vocabularies_with_other_rules_are_refused():
    import json

    whole = json.load(open(BPE))
    for change in ({"dropout": 0.1}, {"byte_fallback": True}, {"merges": whole["model"]["merges"][::-1]}):
        with pytest.raises(ValueError):
            Merges(whole | {"model": whole["model"] | change})
    with pytest.raises(ValueError):
        Merges(whole | {"normalizer": {"type": "NFC"}})


def test_spelling_equals_the_library(vocabulary, library):
    speller = Speller(vocabulary.definition)
    rows = [[50256], [220, 50256, 2], [], [10263], [447, 447, 1], list(range(0, 50257, 97))]  # parts of characters too
    ends = np.concatenate([[0], np.cumsum(list(map(len, rows)))])
    got = speller.texts(np.concatenate([np.array(r, np.int64) for r in rows]), ends).to_pylist()
    assert got == [library.decode(r, skip_special_tokens=False) for r in rows]


def test_round_trip_of_a_table(spark, library):
    schema = "doc_id bigint, text string, ids string, decoded int, _text int, n_tokens int"
    texts = [(1, None), (2, ""), (None, "no id"), (3, "b a\x00" * 20_000), (4, "twice"), (4, "twice"), *((10 + i, t) for i, t in enumerate(ODD))]
    table = spark.createDataFrame([(*t, "x", 1, 2, 3) for t in texts], schema)
    coded = encode_bpe(table, BPE)
    assert coded.columns == ["doc_id", "ids", "decoded", "_text", "n_tokens", "ids_"]
    back = decode_bpe(coded, BPE, ids_col="ids_")
    assert back.columns[-1] == "decoded_"
    got = Counter((r.doc_id, tuple(r.ids_), r.decoded_) for r in back.collect())
    assert got == Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in texts)
    assert encode_bpe(table.limit(0), BPE).count() == 0
    rows = spark.createDataFrame([(1, None), (2, [5, None, -3, 99_999_999, 5])], "id int, ids array<int>")
    assert [r.decoded for r in decode_bpe(rows, BPE).orderBy("id").collect()] == ["", library.decode([5, 5])]


def test_merging_query(spark, sf, library):
    got = {r.doc_id: r for r in QUERIES["op12_byte_pairs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want = (len(ids), *(hashlib.sha256(t.encode()).hexdigest() for t in (",".join(map(str, ids)), back)))
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == want


# ---- whitening


def fixed(rows):
    return [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in rows]


def test_exact_covariance_and_deviations(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(0, 1, (400, 6)) @ rng.normal(0, 1, (6, 6)) + 3
    bad = [(500, None), (501, [1.0] * 5 + [None]), (502, [1.0] * 5 + [float("nan")]), (503, [float("inf")] + [0.0] * 5)]
    good = [*enumerate(vectors.tolist()), (7, vectors[7].tolist()), (None, vectors[9].tolist())]
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in [*good, *bad]], "vec_id bigint, embedding array<double>, i int, whitened double")
    white, fit = whiten(table.repartition(5), components=4)
    x = fixed(v for _, v in good)
    n, sums = len(x), [sum(c) for c in zip(*x)]  # noqa: B905
    assert (fit.n, fit.sums) == (n, sums)
    far = Counter((i, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))) for (i, _), v in zip(good, x, strict=True))
    rows = white.collect()
    assert Counter((r.vec_id, int(r.deviation)) for r in rows) == far
    centred = [[Fraction(c) - Fraction(s, n) for c, s in zip(v, sums, strict=True)] for v in x]
    exact = np.array([[float(sum(r[a] * r[b] for r in centred) / n) for b in range(6)] for a in range(6)])
    values, axes = np.linalg.eigh(exact)
    np.testing.assert_allclose(fit.eigenvalues, values[::-1][:4], rtol=1e-12)
    np.testing.assert_allclose(fit.explained, values[::-1][:4] / np.trace(exact), rtol=1e-12)
    np.testing.assert_allclose(np.abs(np.sum(fit.components * axes[:, ::-1][:, :4], axis=0)), 1, rtol=1e-12)
    got = np.array([r.whitened for r in rows])
    assert np.abs(got.T @ got / n - np.eye(4)).max() < 1e-10
    assert identity_error(table.selectExpr("embedding as v"), fit) == pytest.approx(np.abs(got.T @ got / n - np.eye(4)).max(), abs=1e-12)


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(6)
    vectors = (rng.integers(-(1 << 50), 1 << 50, (40, 3))).astype(float)
    vectors[:, 2] += vectors[:, 0]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id int, embedding array<double>")
    fit = fit_whitening(table.selectExpr("embedding as v"))
    x = fixed(vectors)
    n, sums = len(x), [sum(c) for c in zip(*x)]  # noqa: B905
    exact = np.array([[sum((n * v[a] - sums[a]) * (n * v[b] - sums[b]) for v in x) / n**3 for b in range(3)] for a in range(3)])
    np.testing.assert_allclose(fit.eigenvalues, np.linalg.eigvalsh(exact)[::-1], rtol=1e-12)


def test_edges_of_whitening(spark):
    schema = "vec_id int, embedding array<float>"
    white, fit = whiten(spark.createDataFrame([(1, None)], schema))
    assert fit is None and white.count() == 0 and white.columns == ["vec_id", "deviation", "whitened"]
    same = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], schema)
    white, fit = whiten(same)
    assert [(int(r.deviation), r.whitened) for r in white.collect()] == [(0, [None, None])] * 2
    assert fit.explained.tolist() == [0.0, 0.0] and identity_error(same.selectExpr("embedding as v"), fit) == 0.0
    line = spark.createDataFrame([(i, [i * 1.0, i * 2.0]) for i in range(5)], schema)  # one direction without variance
    assert [r.whitened[1] for r in whiten(line)[0].collect()] == [None] * 5
    with pytest.raises(Exception, match="different lengths"):
        whiten(spark.createDataFrame([(1, [0.5]), (2, [0.5, 1.0])], schema).coalesce(1))
    with pytest.raises(Exception, match="different lengths"):
        whiten(spark.createDataFrame([(1, [0.5]), (2, [0.5, 1.0])], schema).repartition(2, "vec_id"))


def test_whitening_query(spark, sf):
    rows = QUERIES["op13_whitening"](spark, sf).collect()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array(fixed(r.embedding for r in table), dtype=object)
    n, sums = len(x), x.sum(axis=0)
    far = {r.vec_id: int(((n * v - sums) ** 2).sum()) for r, v in zip(table, x, strict=True)}
    assert len(rows) == 32 * n and {r.component for r in rows} == set(range(1, 33))
    assert all(r.deviation == far[r.vec_id] and r.n == n and r.identity_error < 1e-9 for r in rows)
    centred = (x - (sums // n)).astype(float) - (sums % n).astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    want = centred @ axes[:, ::-1][:, :32] / np.sqrt(values[::-1][:32])
    got = np.zeros((n, 32))
    at = {r.vec_id: k for k, r in enumerate(table)}
    for r in rows:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert r.explained == pytest.approx(values[::-1][r.component - 1] / values.sum(), rel=1e-9)
    np.testing.assert_allclose(np.abs(got), np.abs(want), atol=1e-6)
