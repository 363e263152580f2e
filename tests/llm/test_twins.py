"""Shards, kernel scores, toxic features and learned rules against plain twins of their methods, and the pipeline's stages on odd tables."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import decision_list as dl
from paperloom.llm import kernel_quality as kq
from paperloom.llm import toxicity as tx
from paperloom.llm.sharding import balanced_labels, quotas, shard_documents
from paperloom.llm.stats import COUNTS, document_stats, ratios
from paperloom.llm.unigram import count_tokens, encode_pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = st.text(st.sampled_from("ab c\n\tABÉé×ÿ019!|.?;:#*$%&<>-_'字 you u5er f*ck"), max_size=60)


def spark_hash(i, turn):
    """The engine's xxhash64 of a long and an int."""
    first = xxhash.xxh64_intdigest(struct.pack("<q", i), 42)
    return xxhash.xxh64_intdigest(struct.pack("<i", turn), first)


def propagated(count, edges, shards, rounds, settled):
    """Label propagation under quotas, one node at a time."""
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    label = {i: i % shards for i in range(count)}
    free0 = np.bincount([i % shards for i in range(count) if i not in near], minlength=shards)
    free = free0.copy()
    for turn in range(rounds if near else 0):
        wishes = {}
        for i, others in near.items():
            if spark_hash(i, turn) % 2:
                continue
            heard = Counter(label[o] for o in others)
            to = min(heard, key=lambda s: (-heard[s], s))
            gain = heard[to] - heard[label[i]]
            if gain > 0:
                wishes.setdefault((label[i], to), []).append((-gain, i))
        wanted = np.zeros((shards, shards), np.int64)
        for pair, found in wishes.items():
            wanted[pair] = len(found)
        moves, fill = quotas(wanted, free)
        if not moves.sum() or moves.sum() < settled * len(near):
            break
        free = free - fill.sum(axis=1) + fill.sum(axis=0)
        for (at, to), found in wishes.items():
            for _, i in sorted(found)[: moves[at, to]]:
                label[i] = to
    leaving = []
    for s in range(shards):
        mine = [i for i in range(count) if i not in near and i % shards == s]
        leaving += mine[min(free[s], free0[s]) :]
    for s in range(shards):
        for i in leaving[: max(free[s] - free0[s], 0)]:
            label[i] = s
        leaving = leaving[max(free[s] - free0[s], 0) :]
    assert not leaving
    return label


@pytest.mark.parametrize("seed,settled", [(1, 0.0), (2, 0.05)])
def test_propagation_equals_its_twin(spark, seed, settled):
    draw = random.Random(seed)
    count = 600
    edges = {tuple(sorted(draw.sample(range(400), 2))) for _ in range(250)}
    edges |= {(b, b + 40 * k) for b in range(10) for k in range(1, 6)}
    edges = sorted((b, a) for a, b in edges)
    want = propagated(count, edges, 5, 4, settled)
    nodes = spark.range(count).select("id")
    got = balanced_labels(nodes, spark.createDataFrame(edges, "id bigint, other bigint"), 5, 4, settled)
    assert {r.id: r.shard for r in got.collect()} == want
    assert want != {i: i % 5 for i in range(count)}


def test_shards_equal_their_twin(spark):
    draw = random.Random(4)
    rows = [(i, draw.choice([f"copy {i % 30}", f"text é {i}"])) for i in range(500)]
    rows += [(None, "copy 1"), (None, None), (3, "copy 1"), (3, "copy 1"), (900, ""), (901, None), (902, "字" * 5000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, slot int, shard string")
    digest = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1])))
    first = {}
    for n, (_, text) in enumerate(rows):
        first.setdefault(text or "", n)
    label = propagated(len(rows), [(n, first[t or ""]) for n, (_, t) in enumerate(rows) if first[t or ""] != n], 8, 5, 0.002)
    slots, want = Counter(), Counter()
    for n, (i, text) in enumerate(rows):
        data = (text or "").encode()
        want[i, len(data) + 1, zlib.crc32(data), label[n], slots[label[n]], first[text or ""]] += 1
        slots[label[n]] += 1
    columns = ("doc_id", "size", "text_crc32", "shard", "slot", "copy_group")
    assert Counter(tuple(r[c] for c in columns) for r in shard_documents(docs).collect()) == want


def plain_counts(text):
    text = text or ""
    words, lines = WORD.findall(text), text.split("\n")
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    repeated = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
    of = lambda test: sum(map(test, text))
    upper = of(lambda c: "A" <= c <= "Z" or "À" <= c <= "Þ")
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": of(lambda c: c in "#*$%&|<>"),
        "n_dup_lines": sum(bool(WORD.search(line)) and line in lines[:k] for k, line in enumerate(lines)),
        "n_repeat_words": len(repeated), "n_lines": len(lines), "n_distinct": len(set(words)),
        "n_same_next": sum(a == b for a, b in zip(words, words[1:])), "n_upper": upper,
        "n_letters": upper + of(lambda c: "a" <= c <= "z" or "ß" <= c <= "ÿ"),
        "n_digits": of(lambda c: c in "0123456789"), "n_bangs": of(lambda c: c == "!"), "n_bars": of(lambda c: c == "|"),
        "n_ends": of(lambda c: c in ".?!;:"), "n_marks": of(lambda c: 33 <= ord(c) < 127 and not c.isalnum()),
        "n_chars": len(text), "n_short_words": sum(len(w) <= 2 for w in words), "n_long_words": sum(len(w) >= 20 for w in words),
        "n_capital_words": sum(2 * sum("A" <= c <= "Z" for c in w) > len(w) for w in words),
    }


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD | st.none(), max_size=6))
def test_counts_equal_plain_ones(texts):
    got = document_stats(pa.array([t or "" for t in texts], pa.string()))
    want = [plain_counts(t) for t in texts]
    assert {c: got[c].tolist() for c in COUNTS} == {c: [w[c] for w in want] for c in COUNTS}


def plain_measures(text):
    c = plain_counts(text)
    share = lambda a, b: c[a] / c[b] if c[b] else 0.0
    return [
        math.log1p(c["n_words"]), share("word_chars", "n_words"), share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"), share("n_distinct", "n_words"), share("n_same_next", "n_words"),
        share("n_upper", "n_letters"), share("n_letters", "n_chars"), share("n_digits", "n_chars"), share("n_bangs", "n_words"),
        share("n_bars", "n_words"), share("n_ends", "n_words"), share("n_marks", "n_chars"), share("n_short_words", "n_words"),
        share("n_long_words", "n_words"), share("n_capital_words", "n_words"), math.log1p(share("n_words", "n_lines")),
    ]


def fold_of(i):
    return zlib.crc32(str(i).encode()) % 5


def pooled(raw, label, steps=1024):
    """Isotonic fit by pooling neighbours, on rows met in equal steps of their range: points and values."""
    low, width = raw.min(), (raw.max() - raw.min()) / steps or 1.0
    bins = np.floor((raw - low) / width)
    at = [raw[bins == b].mean() for b in np.unique(bins)]
    pools = []
    for b in np.unique(bins):
        pools.append([label[bins == b].sum(), (bins == b).sum(), 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top)]
    return np.array(at), np.concatenate([[s / n] * k for s, n, k in pools])


@pytest.fixture(scope="module")
def marked(spark):
    """Prose of 500 documents, a third of them shouted or full of signs, labels that are sometimes wrong."""
    draw = random.Random(9)
    vocabulary = ["".join(draw.choice("aeioulnrst") for _ in range(draw.randint(2, 8))) for _ in range(200)]
    rows, marks = [], []
    for i in range(500):
        w = [draw.choice(vocabulary) for _ in range(draw.randint(20, 60))]
        bad = draw.random() < 0.35
        if bad:
            w = [x.upper() if draw.random() < 0.5 else x + "#" for x in w]
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad == (draw.random() < 0.08)), int(draw.random() < 0.3)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return rows, marks, docs, spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")


def test_kernel_scores_equal_their_twin(marked):
    rows, marks, docs, labels = marked
    x = np.array([plain_measures(t) for _, t in rows])
    y = np.array([q for _, q, _ in marks], float)
    folds = np.array([fold_of(i) for i, _ in rows])
    fit, steps = (folds > 0) & (folds < 4), folds == 4
    draw = np.random.default_rng(kq.SEED)
    frequency = draw.normal(size=(18, kq.FEATURES)) / (kq.WIDTH * math.sqrt(9))
    phase = draw.uniform(0, 2 * math.pi, kq.FEATURES)
    z = np.clip((x - x[fit].mean(axis=0)) / np.maximum(x[fit].std(axis=0), 1e-6), -8, 8)
    lifted = np.column_stack([np.cos(z @ frequency + phase) * math.sqrt(2 / kq.FEATURES), np.ones(len(z))])
    n, one = fit.sum(), y[fit].sum()
    root = np.sqrt(np.where(y[fit] > 0, n / (2 * one), n / (2 * (n - one))))[:, None]
    ridge = np.eye(kq.FEATURES + 1) * math.sqrt(kq.RIDGE * n / (kq.FEATURES + 1))
    # the same weights by least squares on the rows themselves, not by normal equations
    weight = np.linalg.lstsq(np.vstack([lifted[fit] * root, ridge]), np.append(y[fit] * root[:, 0], np.zeros(len(ridge))), rcond=None)[0]
    raw = lifted @ weight
    at, value = pooled(raw[steps], y[steps])
    want = 0.99 * np.interp(raw, at, value) + 0.01 * np.clip((raw - at[0]) / (at[-1] - at[0]), 0, 1)
    got = {r.doc_id: r.score for r in kq.quality_scores(docs, labels).collect()}
    assert np.allclose([got[i] for i, _ in rows], want, atol=1e-6)


def plain_letters(word):
    return "".join(c for c in word if re.fullmatch(r"[^\W\d_]", c)).lower()


def plain_toxic(text, lexicon):
    words = WORD.findall(text)
    n = max(len(words), 1)
    seen = []
    for w in words:
        low = plain_letters(w)
        listed = lexicon.words.get(low, 0.0)
        head = max([lexicon.prefixes.get(low[:k], 0.0) for k in (4, 5, 6) if len(low) >= k], default=0.0)
        hidden = any(
            plain_letters(w[a]) and plain_letters(w[b]) and b > a + 1 and all(c in "0123456789@$!*#._-" or c.isdecimal() for c in w[a + 1 : b])
            for a in range(len(w)) for b in range(a + 2, len(w))
        )
        bare = plain_letters(w.strip(".,;:!?\"'()").translate(str.maketrans("013457@$!", "oieastasi")))
        shown = lexicon.words.get(bare, 0.0) if hidden and not listed else 0.0
        seen.append((listed or shown, head, hidden, shown, len(low) > 2 and w.upper() == w, low in tx.SECOND_PERSON))
    weight = [max(hit, head) for hit, head, *_ in seen]
    near = [any(s[5] for j, s in enumerate(seen) if 0 < abs(j - k) <= 4) for k in range(len(seen))]
    size = max(len(text.encode()), 1)
    count = lambda test: sum(bool(test(s)) for s in seen)
    return [
        count(lambda s: s[0]) / n, count(lambda s: s[0]), count(lambda s: s[1]) / n, count(lambda s: s[1]), sum(weight) / n,
        max(weight, default=0.0), sum(a > 0 and b for a, b in zip(weight, near)) / n, count(lambda s: s[5]) / n,
        count(lambda s: s[4]) / n, sum(s[4] and w > 0 for s, w in zip(seen, weight)),
        sum(33 <= ord(c) <= 47 or 58 <= ord(c) <= 64 for c in text) / size, text.count("!") / size,
        count(lambda s: s[2]) / n, count(lambda s: s[3]), math.log1p(len(words)),
    ]


LEXICON = tx.Lexicon({"vile": 3.0, "foo": 2.0, "you": 1.0}, {"vile": 1.5, "vilef": 2.5, "éaaaa": 4.0})
TOXIC = st.lists(st.sampled_from("vile VILE v1le v!le! v.i.l.e vilefoo YOU you u tú Foo f00 (f0o) éaaaaa a1b x_y É 字 1 !!! a--b".split() + ["\n"]), max_size=14).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(TOXIC | ODD, max_size=5))
def test_toxic_features_equal_plain_ones(texts):
    got = tx.toxic_features(pa.array(texts, pa.string()), LEXICON, {})
    assert np.allclose(got, np.array([plain_toxic(t, LEXICON) for t in texts]).reshape(-1, len(tx.FEATURES)), atol=1e-9)


def test_lexicon_equals_plain_counts(spark):
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choice("vilefoo Vile-foo, vilebar calm bright morning river stone to 1an".split() if i % 3 == 0 else
                                     "calm bright morning river stone to 1an vilest".split()) for _ in range(6))) for i in range(200)]
    rows += [(300, None), (301, "")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows] + [(999, 1)], "doc_id bigint, toxic int")
    docs = spark.createDataFrame(rows, "id bigint, text string")
    got = tx.learn_lexicon(docs, labels, (1, 2))
    held, toxic, sizes = Counter(), Counter(), Counter()
    for i, text in rows:
        if fold_of(i) in (1, 2):
            low = [plain_letters(w) for w in WORD.findall((text or "").lower())]
            low = [w for w in low if len(w) > 2]
            terms = {"w" + w for w in low} | {"p" + w[:k] for w in low for k in (4, 5, 6) if len(w) >= k}
            sizes[i % 3 == 0] += 1
            held.update(terms)
            toxic.update(terms if i % 3 == 0 else ())
    ratio = {t: toxic[t] / sizes[True] / ((held[t] - toxic[t] + 0.5) / (sizes[False] + 1)) for t in held}
    want = {t: math.log(r) for t, r in ratio.items() if toxic[t] >= tx.LEAST_SUPPORT and r >= tx.LEAST_RATIO}
    assert {"w" + w: v for w, v in got.words.items()} | {"p" + w: v for w, v in got.prefixes.items()} == pytest.approx(want)
    assert "vilefoo" in got.words and "calm" not in got.words


def covered_rules(rows, names, most, precision):
    """The rules by trying every threshold of every measure on the rows themselves; rows are (values, label, prune)."""
    cuts = {}
    for m, name in enumerate(names):
        ordered = sorted(v[m] for v, _, _ in rows)
        cuts[name] = sorted({ordered[math.ceil(i / dl.BINS * len(ordered)) - 1] for i in range(1, dl.BINS)})
    tests = [(side, m, cut) for side in (True, False) for m, name in enumerate(names) for cut in cuts[name]]
    holds = lambda v, test: (v[test[1]] >= test[2]) == test[0]
    split = lambda some: (sum(y == 1 for _, y, _ in some), sum(y == 0 for _, y, _ in some))
    rules = []
    while len(rules) < most:
        chosen, seen = [], [r for r in rows if not r[2]]
        for _ in range(dl.MAX_CONDITIONS):
            good0, bad0 = split(seen)
            if bad0 < dl.LEAST_COVER or not good0:
                break
            gains = []
            for test in tests:
                good, bad = split([r for r in seen if holds(r[0], test)])
                gain = bad * (np.log2((bad + 1) / (good + bad + 2)) - np.log2((bad0 + 1) / (good0 + bad0 + 2)))
                gains.append(gain if bad else -np.inf)
            if max(gains) <= 0:
                break
            chosen.append(tests[int(np.argmax(gains))])
            seen = [r for r in seen if holds(r[0], chosen[-1])]
        best = None
        for k in range(len(chosen), 0, -1):
            parts = [split([r for r in rows if r[2] == side and all(holds(r[0], t) for t in chosen[:k])]) for side in (True, False)]
            if sum(bad for _, bad in parts) < dl.LEAST_COVER or any(g + b and b < precision * (g + b) for g, b in parts):
                continue
            good, bad = parts[0]
            worth = (bad - good) / max(good + bad, 1.0)
            if best is None or worth >= best[0]:
                best = worth, k
        if best is None:
            break
        kept = chosen[: best[1]]
        rules.append(kept)
        rows = [r for r in rows if not all(holds(r[0], t) for t in kept)]
    return rules


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_equal_an_exhaustive_search(spark, seed):
    draw = random.Random(seed)
    names, rows, marks = ["a", "b", "c"], [], []
    for i in range(400):
        v = (float(draw.randint(0, 12)), float(draw.randint(0, 5)), draw.random())
        bad = (v[0] >= 9 and v[1] < 3) or (v[2] > 0.9 and v[1] >= 2) or draw.random() < 0.02
        rows.append((i, *v))
        marks.append((i, int(not bad)))
    measured = spark.createDataFrame([*rows, (None, 9.0, 0.0, 1.0)], "id bigint, a double, b double, c double")
    got = dl.learn_rules(measured, spark.createDataFrame([*marks, (None, 0)], "doc_id bigint, quality int"), max_rules=3, least_precision=0.8)
    learned = [(r[1:], y, fold_of(r[0]) == 4) for r, (_, y) in zip(rows, marks) if fold_of(r[0])]
    want = covered_rules(learned, names, 3, 0.8)
    assert len(got) == len(want) >= 2
    for rule, plain in zip(got, want):
        bounds = {}
        for side, m, cut in plain:  # a later threshold on the same side is the tighter one
            bounds[names[m], side] = cut
        assert {(c.measure, c.at_least, c.threshold) for c in rule.conditions} == {(*key, cut) for key, cut in bounds.items()}


EDGES = [(1, None), (2, ""), (3, " \n\t "), (None, "no id here"), (5, "a b c"), (5, "a b c"), (6, "x " * 20000), (None, None), (None, "no id here")]
CLASHING = "doc_id bigint, text string, lang string, id int, score double, kept string, _stats int, _x int, raw double, label string, n_tokens string, ids string"


@pytest.fixture(scope="module")
def odd(spark):
    draw = random.Random(1)
    plain = [(100 + i, " ".join(f"word{draw.randrange(3000)}" for _ in range(40))) for i in range(30)]
    plain += [(200, plain[0][1]), (201, plain[0][1]), (None, plain[1][1]), (None, "".join(plain[2][1]))]
    return spark.createDataFrame([(*r, *[None] * 10) for r in EDGES + plain], CLASHING)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_tables(spark, sf, odd, name, stage):
    """Nulls in all columns, repeated rows, rows without an id and columns of the stages' own names: rows go or stay whole."""
    out = stage(spark, odd, sf)
    assert stage(spark, odd.limit(0), sf).count() == 0
    rows = out.collect()
    if name == "pieces":
        assert len(rows) == odd.count() and all(r.round_trip for r in rows)
        return
    assert out.columns == odd.columns
    given = Counter((r.doc_id, r.text) for r in odd.collect())
    kept = Counter((r.doc_id, r.text) for r in rows)
    assert not kept - given
    if name == "near_dedup":
        assert (100, odd.where("doc_id = 100").first().text) in kept and not {200, 201} & {i for i, _ in kept}
        assert kept[2, ""] == kept[3, " \n\t "] == 1  # texts without words are linked with nothing
    if name == "decontamination":
        assert kept == given


def test_rows_without_id_are_encoded_and_counted(spark, odd):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    given = Counter((r.doc_id, r.text) for r in odd.collect())
    coded = encode_pieces(odd, model).collect()
    counted = count_tokens(odd, model)
    assert counted.columns == [c for c in odd.columns if c != "n_tokens"] + ["n_tokens"]
    assert Counter((r.doc_id, r.text) for r in counted.collect()) == given and len(coded) == sum(given.values())
    assert Counter((r.doc_id, r.n_tokens) for r in counted.collect()) == Counter((r.doc_id, len(r.ids)) for r in coded)
    assert ratios(F.col("s")).keys() and len(plain_measures("a")) == len(ratios(F.col("s")))
