"""Statistics, rules, scores, near-duplicates, leaks, shards and archives against brute force on small tables."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from paperloom.llm.decision_list import judge_documents, keep_passing
from paperloom.llm.decontamination import Finder, Myers, budget, drop_leaks, find_leaks, normal
from paperloom.llm.kernel_quality import keep_good, quality_scores
from paperloom.llm.labelled import fold
from paperloom.llm.near_duplicates import keep_first, near_duplicates
from paperloom.llm.sharding import quotas, shard_documents
from paperloom.llm.toxicity import toxicity_scores
from paperloom.llm.warc import read_records, write_archives

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = SCHEMA + ", score double, kept string, _stats int, id int"


def table(spark, rows, schema=SCHEMA):
    width = schema.count(",") + 1
    return spark.createDataFrame([(i, t, *[None] * (width - 2)) for i, t in rows], schema)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


EDGES = [(1, None), (2, ""), (3, " \n\t "), (None, "no id here"), (4, "one"), (5, "a b c"), (5, "a b c"), (6, "x " * 20000)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


def test_base_counts(spark, labels):
    docs = [*EDGES, (7, "p q r s t u v w " * 4 + "\nline one\nline one\n\n\n" + "# $ %")]
    got = {(r.doc_id, r.n_words): r for r in judge_documents(table(spark, docs, EXTRA), labels).collect()}
    for i, text in docs:
        w, seen, dup = words(text), set(), 0
        found = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {k + j for k in range(len(w) - 7) if found[tuple(w[k : k + 8])] > 1 for j in range(8)}
        for line in (text or "").split("\n"):
            dup += bool(words(line)) and line in seen
            seen.add(line)
        r = got[i, len(w)]
        symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, w)), symbols, dup, len(cover))
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w))
        assert r.kept == (not r.base_failed)
    assert judge_documents(table(spark, []), labels).count() == 0


@pytest.fixture(scope="module")
def judged(spark):
    """Clean prose, shouting and symbols, with labels."""
    draw = random.Random(3)
    vocabulary = ["".join(draw.choice("aeioulnrst") for _ in range(draw.randint(2, 8))) for _ in range(400)]
    rows, marks = [], []
    for i in range(600):
        w = [draw.choice(vocabulary) for _ in range(draw.randint(30, 120))]
        kind = draw.random()
        bad = kind < 0.3
        toxic = 0.3 <= kind < 0.5
        if kind < 0.15:
            w = [x.upper() + "!!" for x in w]
        elif bad:
            w = [x + draw.choice(["$$$", "###"]) for x in w]
        if toxic:
            w[draw.randrange(len(w))] = draw.choice(["vilefoo", "vilebar"])
            w[draw.randrange(len(w))] = "vilebaz"
        rows.append((i, " ".join(w)))
        marks.append((i, int(not bad), int(toxic)))
    return table(spark, rows, EXTRA), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")


def test_learned_rules_reject_what_is_labelled(judged):
    docs, labels = judged
    rows = judge_documents(docs, labels).join(labels, "doc_id").where(fold("doc_id") == 0).collect()
    assert len(rows) > 50
    assert sum(r.kept == bool(r.quality) for r in rows) >= 0.97 * len(rows)
    kept = keep_passing(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in judge_documents(docs, labels).where("kept").collect()}


def auc(rows, label):
    one, zero = ([r.score for r in rows if r[label] == k] for k in (1, 0))
    return np.mean([(a > b) + 0.5 * (a == b) for a in one for b in zero])


def test_quality_scores(spark, judged, labels):
    docs, marks = judged
    rows = quality_scores(docs, marks).join(marks, "doc_id").where(fold("doc_id") == 0).collect()
    assert auc(rows, "quality") > 0.98
    assert keep_good(docs, marks, 0.3).columns == docs.columns
    edge = quality_scores(table(spark, EDGES, EXTRA), marks).collect()
    assert len(edge) == len(EDGES) and all(0 <= r.score <= 1 for r in edge)
    assert len({r.score for r in quality_scores(table(spark, EDGES), labels).collect()}) == 1
    assert quality_scores(table(spark, []), marks).count() == 0


def test_toxicity_scores(spark, judged, labels):
    docs, marks = judged
    rows = toxicity_scores(docs, marks).join(marks, "doc_id").where(fold("doc_id") == 0).collect()
    assert auc(rows, "toxic") > 0.98
    edge = toxicity_scores(table(spark, EDGES, EXTRA), labels).collect()
    assert len(edge) == len(EDGES) and all(r.score == 0 for r in edge)
    assert toxicity_scores(table(spark, []), marks).count() == 0


def grouped(rows, shingle, percent):
    """Components by comparing all pairs."""
    sets = {}
    for i, text in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} - {()}
    comp = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                low, high = sorted((comp[a], comp[b]))
                comp = {i: low if c == high else c for i, c in comp.items()}
    return comp, {i: len(s) for i, s in sets.items()}


def near_rows(count=260, seed=5):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [draw.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(count):
        w = list(base)
        for _ in range(draw.choice([0, 1, 2, 3, 4, 6, 8])):  # around the threshold
            w[draw.randrange(len(w))] = draw.choice(vocabulary)
        rows.append((i, " ".join(w) if i % 3 else " ".join(draw.choices(vocabulary, k=60))))
    return rows + [(1000, None), (1001, ""), (1002, "  "), (1003, "A b"), (1004, "a B"), (1005, "a b c"), (1006, rows[0][1].upper())]


@pytest.mark.parametrize("shingle", [4, 5])
def test_near_duplicates(spark, shingle):
    rows = near_rows()
    docs = table(spark, [*rows, (1003, "A b"), (None, rows[1][1])], EXTRA)
    got = near_duplicates(docs, shingle=shingle).collect()
    comp, sizes = grouped(rows, shingle, 80)
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles) == (comp[r.doc_id], sizes[r.doc_id])
            assert r.kept == (comp[r.doc_id] == r.doc_id)
    kept = keep_first(docs, shingle=shingle)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, c in comp.items() if i == c} | {None}
    assert near_duplicates(table(spark, [])).count() == 0


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i]
        for j, c in enumerate(text):
            row.append(min(last[j] + (p != c), last[j + 1] + 1, row[j] + 1))
    return min(row)


@settings(max_examples=80, deadline=None)
@given(st.text("ab ", min_size=1, max_size=70), st.text("ab ", max_size=90))
def test_myers_equals_the_table(pattern, text):
    assert Myers(pattern).best(text)[0] == distance(pattern, text)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_finder_equals_brute_force(seed):
    draw = random.Random(seed)
    items = ["".join(draw.choice("abcd ") for _ in range(draw.randint(20, 80))) for _ in range(3)]
    text = "".join(draw.choice("abcd ") for _ in range(60))
    for item in items:
        chars = list(item)
        for _ in range(draw.randint(0, budget(len(item)) + 1)):
            at = draw.randrange(len(chars))
            chars[at : at + draw.randint(0, 1)] = draw.choice(["", "z", "a"])
        text += "".join(chars) + "".join(draw.choice("abcd ") for _ in range(20))
    items, text = [normal(i) for i in items], normal(text)
    got = {k: d for k, d, _, _ in Finder(list(enumerate(items)), 10).search(text)}
    assert got == {k: distance(i, text) for k, i in enumerate(items) if distance(i, text) <= budget(len(i))}


def test_leaks(spark):
    item = "The quick brown fox jumps over the lazy dog while nobody else is watching it."
    docs = [*EDGES, (20, "before " + item.upper() + " after"), (21, "z" + item.replace("lazy", "lzy\n ") + "!"), (22, item[:40])]
    bench = spark.createDataFrame([(1, item), (2, None), (3, " "), (None, item), (4, "x x x"), (5, item)], "item_id bigint, text string")
    frame = table(spark, docs, EXTRA)
    got = sorted((r.doc_id, r.item_id, r.distance) for r in find_leaks(frame, bench).collect())
    assert [g[:2] for g in got] == [(6, 4), (20, 1), (20, 5), (21, 1), (21, 5)] and got[0][2] == got[1][2] == 0
    longer = find_leaks(frame, bench, least_chars=6).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, longer)) == [g[:2] for g in got[1:]]
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(frame, bench, block_chars=40).collect()) == [g[:2] for g in got]
    left = drop_leaks(frame, bench)
    assert left.columns == frame.columns and left.count() == len(docs) - 3
    odd = table(spark, [(None, "so " + item), (7, "fine"), (7, item), (8, None), (9, ""), (8, None)], EXTRA)
    assert sorted((r.doc_id, r.text or "") for r in drop_leaks(odd, bench).collect()) == [(7, "fine"), (8, ""), (8, ""), (9, "")]
    assert find_leaks(frame, bench.limit(0)).count() == find_leaks(table(spark, []), bench).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_places_of_leaks(seed):
    """Start and end are the first end of least distance and the longest start that gives it."""
    draw = random.Random(seed)
    item = "".join(draw.choice("abc") for _ in range(draw.randint(1, 30)))
    text = "".join(draw.choice("abc") for _ in range(20))
    for _ in range(2):  # a second, equally good place
        text += item + "".join(draw.choice("abc") for _ in range(10))
    found = Finder([(1, item)], 10).search(text)
    assert [(f[0], f[1]) for f in found] == [(1, 0)]
    assert (found[0][2], found[0][3]) == (text.index(item), text.index(item) + len(item))


def test_quotas_keep_sizes():
    draw = np.random.default_rng(2)
    for _ in range(50):
        wanted, free = draw.integers(0, 40, (5, 5)), draw.integers(0, 60, 5)
        np.fill_diagonal(wanted, 0)
        moves, fill = quotas(wanted, free)
        net = (moves + fill).sum(axis=0) - (moves + fill).sum(axis=1)
        assert not net.any() and (moves <= wanted).all() and (fill.sum(axis=1) <= free).all() and (fill >= 0).all()


def test_shards(spark):
    draw = random.Random(1)
    rows = [*EDGES, *((100 + i, draw.choice([f"copy {i % 40}", f"text {i}"])) for i in range(900))]
    got = shard_documents(table(spark, rows, EXTRA)).collect()
    assert len(got) == len(rows)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    groups = Counter(r.copy_group for r in got)
    cut = sum(n - max(Counter(r.shard for r in got if r.copy_group == g).values()) for g, n in groups.items() if n > 1)
    linked = sum(n - 1 for n in groups.values())
    assert linked > 300 and cut < 0.25 * linked
    assert shard_documents(table(spark, [])).count() == 0


def test_archives(spark):
    rows = [(3, "u3", "<p>é</p>"), (1, None, "same"), (2, "u 2", "same"), (4, "x", None), (5, "y", ""), (None, "z", "same"), (2, "u2", "same"), (6, "long", "q" * 300000)]
    pages = spark.createDataFrame([(*r, 0, "f") for r in rows], "page_id bigint, url string, html string, offset int, file string")
    folder, index = write_archives(pages.repartition(2))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_records(folder, index, gap=10).collect()]
    first = {"same": 1, "": 4}
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        refers = first.get(html or "", i)
        later = i is not None and refers != i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if later else "response", refers if later else None))
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    one = read_records(folder, index.where("page_id = 3")).collect()
    assert [bytes(r.payload).decode() for r in one] == ["<p>é</p>"]
    folder, index = write_archives(pages.limit(0))
    assert read_records(folder, index).count() == 0


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.select("doc_id").distinct().count()
        out = stage(spark, docs, sf)
        assert out.select("doc_id").distinct().count() <= before
        if name != "pieces":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
    rows = out.collect()
    assert rows and all(r.round_trip for r in rows)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == {r.doc_id for r in rows}
    comp, _ = grouped([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    assert all(i == c for i, c in comp.items())
    bench = [normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(b in normal(r.text) for r in docs.collect() for b in bench)
