import json
import struct
import threading
import zlib
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from paperloom.functions.vectors import luma
from paperloom.operators import cache as ca
from paperloom.operators import sampling as sm
from paperloom.operators.images import to_gray
from paperloom.operators.profile import class_distribution, pixel_histogram
from paperloom.operators.ranking import first_k, position_in_group
from paperloom.sources import corpus as co
from paperloom.sources import versions as vs
from paperloom.sources import zones as zo
from paperloom.sources.results import upsert_results
from paperloom.sources.sinks import write_image_tree, write_text_cache


def hot_corpus(spark, n=3000):
    """Most rows in one class and one shard."""
    return spark.range(n).select(
        F.lit("train").alias("split"),
        F.when(F.col("id") % 10 < 8, "invoice").otherwise("letter").alias("label_name"),
        F.when(F.col("id") < n * 0.9, 0).otherwise(1).alias("shard_idx"),
        (F.col("id") * 3).alias("row_idx"),
    )


@pytest.mark.parametrize("parts", [1, 17])
def test_positions_do_not_depend_on_partitions(spark, parts):
    rows = position_in_group(hot_corpus(spark).repartition(parts), ["label_name"], "row_idx", ["shard_idx"], ranges=16).collect()
    for label in ("invoice", "letter"):
        part = sorted((r.shard_idx, r.row_idx, r.pos) for r in rows if r.label_name == label)
        assert [p[2] for p in part] == list(range(len(part)))


def test_head_and_resume(spark):
    corpus, targets = hot_corpus(spark), {"train": 1000}
    head = sm.head_per_class(corpus, targets)
    counts = {r.label_name: r["count"] for r in head.groupBy("label_name").count().collect()}
    assert counts == {"invoice": 1000, "letter": 600}
    assert {r.label_name: r.m for r in head.groupBy("label_name").agg(F.max("file_no").alias("m")).collect()} == {"invoice": 999, "letter": 599}
    taken = head.where(F.col("file_no") < 400)
    more = sm.resume_fill(corpus, taken, targets)
    assert taken.select(corpus.columns).unionByName(more.select(corpus.columns)).exceptAll(head.select(corpus.columns)).count() == 0
    assert more.agg(F.min("file_no")).first()[0] == 400 and more.count() == 800
    assert sm.resume_fill(corpus, head, targets).count() == 0
    status = {(r.label_name): (r.collected, r.status) for r in sm.shortfall(head, targets).collect()}
    assert status == {"invoice": (1000, "full"), "letter": (600, "short"), "email": (0, "short"), "scientific_report": (0, "short")}


def test_first_k(spark):
    got = first_k(hot_corpus(spark), "label_name", "row_idx", 3).orderBy("label_name", "pos").collect()
    assert [r.row_idx for r in got] == [0, 3, 6, 24, 27, 54]


def test_scan_prunes_and_pushes(spark, tmp_path):
    rows = [((bytearray(b"a"), None), i % 16, "pad") for i in range(64)] + [((None, "p.png"), 2, "pad")]
    path = str(tmp_path / "corpus")
    spark.createDataFrame(rows, "image struct<bytes:binary,path:string>, label int, other string").write.parquet(path)
    df = co.read_corpus(spark, path)
    assert df.count() == 17
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(label, [" in plan and "other" not in plan
    assert df.select(co.image_bytes(df).alias("b")).where("b is null").count() == 1


def png(levels, width):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    channels = 1 if isinstance(levels[0], int) else 3
    flat = [bytes([v]) if channels == 1 else bytes(v) for v in levels]
    lines = b"".join(b"\0" + b"".join(flat[i : i + width]) for i in range(0, len(flat), width))
    head = struct.pack(">IIBBBBB", width, len(levels) // width, 8, 0 if channels == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_image_tree(spark, tmp_path):
    for split, label, name, data in (
        ("train", "invoice", "00000.png", png([1, 2, 3, 4], 2)),
        ("train", "letter", "00001.png", png([(10, 20, 30), (255, 0, 0)], 2)),
        ("test", "other", "00000.png", png([9], 1)),
        ("test", "email", "00000.png", b"not an image"),
    ):
        folder = tmp_path / split / label
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(data)
    with pytest.raises(Exception):
        co.read_image_tree(spark, str(tmp_path)).count()
    tree = co.read_image_tree(spark, str(tmp_path), ("train", "test"))
    assert {(r.split, r.label_name, r.label, r.width) for r in tree.collect()} == {
        ("train", "invoice", 1, 2), ("train", "letter", 2, 2), ("test", "email", 0, -1),
    }
    gray = {r.label_name: r.px and list(r.px) for r in to_gray(tree).collect()}
    want = spark.range(1).select(luma(F.lit(10), F.lit(20), F.lit(30)), luma(F.lit(255), F.lit(0), F.lit(0))).first()
    assert gray == {"invoice": [1, 2, 3, 4], "letter": list(want), "email": None}
    assert co.read_image_tree(spark, str(tmp_path), ("test",), drop_invalid=True).count() == 0


def test_written_images_are_read_again(spark, tmp_path):
    kind = "split string, label_name string, file_name string, width int, height int, px array<int>, split_no int"
    rows = [
        ("train", "invoice", "a.png", 3, 2, [0, 1, 2, 253, 254, 255], 1), ("train", "letter", "b.png", 1, 1, [7], 1),
        ("test", "email", "c.png", 2, 1, None, 1), ("test", None, "d.png", 1, 1, [1], 1), ("test", "email", None, 1, 1, [1], 1),
    ]
    images = spark.createDataFrame(rows, kind)
    assert write_image_tree(images, str(tmp_path / "tree")) == 2
    assert write_image_tree(images, str(tmp_path / "tree")) == 2  # a repeated run writes the same files
    got = {(r.split, r.label_name, r.file_name, r.width, r.height): list(r.px) for r in to_gray(co.read_image_tree(spark, str(tmp_path / "tree"))).collect()}
    assert got == {("train", "invoice", "a.png", 3, 2): rows[0][5], ("train", "letter", "b.png", 1, 1): [7]}
    assert write_image_tree(images.limit(0), str(tmp_path / "none")) == 0
    assert co.read_image_tree(spark, str(tmp_path / "none")).count() == 0


def test_zones_of_unequal_classes(spark, tmp_path):
    """A label-sorted corpus whose classes differ by a factor of a hundred: footers name the shards that a scan finds."""
    sizes = {0: 1000, 2: 10, 6: 300, 7: 1, 14: 500}
    labels = [code for code, n in sizes.items() for _ in range(n)]
    rows = [(f"part{i // 100:02d}", i, code) for i, code in enumerate(labels)] + [("part19", 5000, None), ("part20", 5001, None)]
    path = str(tmp_path / "corpus")
    df = spark.createDataFrame(rows, "shard string, row int, label int")
    df.repartition("shard").sortWithinPartitions("shard", "row").write.partitionBy("shard").option("parquet.block.size", 1024).parquet(path)
    zones = zo.zone_map(spark, path, "label").withColumn("shard_idx", F.substring(F.regexp_extract("file", r"shard=part(\d+)", 1), 1, 2).cast("int")).persist()
    assert zones.agg(F.sum("n")).first()[0] == len(rows)
    want = {}
    for name, _, code in rows:
        if code is not None:
            want.setdefault(code, set()).add(int(name[4:]))
    got = {r.label16: (r.first_shard, r.last_shard) for r in zo.shard_span(zones, [*sizes, 9], []).collect()}
    exact = {code: (min(s), max(s)) for code, s in want.items()}
    assert {code: got[code] for code in exact} == exact
    assert 9 not in got or got[9][0] == got[9][1]  # only where a shard's range spans it
    for codes in ([7], [2, 14], [99], [0]):
        held = zo.read_holding(spark, path, "label", codes, zones)
        assert sorted(r.row for r in held.collect()) == [i for _, i, c in rows if c in codes]
        opened = {f.rsplit("shard=", 1)[1].split("/")[0] for f in held.inputFiles()}
        assert len(opened) <= sum(len(want.get(c, ())) for c in codes)
    zones.unpersist()


def test_versions_of_two_writers(spark, tmp_path):
    """Both writers read version 1; one publishes version 2, the other begins again from it, and no entry is lost."""
    root, schema = str(tmp_path / "table"), "model string, accuracy double"
    assert vs.read_version(spark, root) is None and vs.newest(spark, root) == 0
    first = spark.createDataFrame([("old", 0.1), ("kept", 0.2)], schema)
    assert vs.update(spark, root, lambda _: first) == 1
    both_read, runs = threading.Barrier(2), Counter()

    def write(name):
        def change(old):
            runs[name] += 1
            if runs[name] == 1:
                both_read.wait(timeout=60)
            return upsert_results(old, spark.createDataFrame([("old", 0.5), (name, 0.9)], schema))

        return vs.update(spark, root, change)

    with ThreadPoolExecutor(2) as pool:
        assert sorted(pool.map(write, ("a", "b"))) == [2, 3]
    assert sorted(runs.values()) == [1, 2]
    rows = {r.model: r.accuracy for r in vs.read_version(spark, root).collect()}
    assert rows == {"old": 0.5, "kept": 0.2, "a": 0.9, "b": 0.9}
    assert vs.read_version(spark, root, 1).count() == 2
    with pytest.raises(vs.Conflict):
        vs.commit(first, root, 1)
    assert len([f for f in (tmp_path / "table").iterdir() if f.name.startswith("data-")]) == 3  # the loser's rows are gone
    vs.drop_versions(spark, root, 9)
    assert vs.newest(spark, root) == 3 and vs.read_version(spark, root).count() == 4
    assert len([f for f in (tmp_path / "table").iterdir() if f.name.startswith("data-")]) == 1


def test_text_cache(spark, tmp_path):
    row = {"path": "a", "label": 1, "label_name": "invoice", "text": "old"}
    (tmp_path / "good.json").write_text(json.dumps([row, {**row, "text": "new"}, {**row, "path": "b", "text": None}]))
    (tmp_path / "bad.json").write_text('[{"path": "c", "la')
    cache = ca.latest_entries(co.read_text_cache(spark, str(tmp_path)))
    assert {(r.path, r.text) for r in cache.collect()} == {("a", "new"), ("b", None)}
    # the larger file is dealt first, the later name still wins
    (tmp_path / "a.json").write_text(json.dumps([{**row, "text": "first"}] + [{**row, "path": f"p{i}"} for i in range(500)]))
    cache = ca.latest_entries(co.read_text_cache(spark, str(tmp_path)))
    assert {r.text for r in cache.where("path = 'a'").collect()} == {"new"}


def test_a_long_list_is_read_by_many_tasks(spark, tmp_path):
    row = {"label": 1, "label_name": "invoice"}
    odd = ['a } b', 'quote " and \\ {', "}{", "line\nbreak", "", None, "é}", '\\"}', "[{}]"]
    rows = [{"path": f"p{i}", "text": odd[i % len(odd)], **row} for i in range(4000)]
    rows[7] = {**rows[7], "more": {"deep": [{"x": "}"}]}}
    (tmp_path / "one.json").write_text(json.dumps(rows))
    (tmp_path / "two.json").write_text(json.dumps(rows[:9], indent=2, ensure_ascii=False) + "\n")
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "cut.json").write_text(json.dumps(rows[:50])[:-30])
    (tmp_path / "empty.json").write_text("")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.text(str(tmp_path / "one.json"), lineSep="}").rdd.getNumPartitions() > 10
        got = co.read_text_cache(spark, str(tmp_path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    by_file = {}
    for r in got:
        by_file.setdefault(r.seq.file.rsplit("/", 1)[-1], []).append((r.seq.at, r.path, r.text))
    assert set(by_file) == {"one.json", "two.json"}
    for name, want in (("one.json", rows), ("two.json", rows[:9])):
        assert sorted(by_file[name]) == [(i, w["path"], w["text"]) for i, w in enumerate(want)]


def test_merge_twice_is_merge_once(spark):
    kind = "path string, label int, label_name string, text string"
    files = spark.createDataFrame([("a", 1, "invoice", ""), ("b", 1, "invoice", ""), ("c", 2, "letter", ""), ("d", 2, "letter", "")], kind)
    cache = spark.createDataFrame([("a", 0, "email", "kept"), ("b", 1, "invoice", None), ("c", 2, "letter", ""), ("gone", 1, "invoice", "x")], kind)
    missing = ca.missing(files, cache)
    assert {r.path for r in missing.collect()} == {"b", "d"}
    fresh = missing.select("path", F.concat(F.lit("new "), "path").alias("text"))
    once = ca.merge(files, cache, fresh)
    assert {(r.path, r.label, r.text) for r in once.collect()} == {("a", 0, "kept"), ("b", 1, "new b"), ("c", 2, ""), ("d", 2, "new d")}
    assert ca.missing(files, once).count() == 0
    assert ca.merge(files, once, fresh).exceptAll(once).count() == 0


def test_profiles_show_zeros(spark):
    df = spark.createDataFrame([(1, "train", 1, [5, 5, 5]), (2, "train", 1, [5, 5, 5]), (3, "test", 2, [0, 10, 255])], "doc_id int, split string, label int, px array<int>")
    dist = {(r.split, r.label): r.n for r in class_distribution(df).collect()}
    assert len(dist) == 12 and dist[("train", 1)] == 2 and dist[("validation", 3)] == 0
    hist = pixel_histogram(df, 5).collect()
    flat = {r.bin: (r.n, r.bin_left) for r in hist if r.label == 1}
    assert flat[2] == (6, 4.9) and sum(n for n, _ in flat.values()) == 6
    for label in (1, 2):
        width = 0.2 if label == 1 else 51.0
        assert sum(r.density * width for r in hist if r.label == label) == pytest.approx(1)


def test_a_text_cache_is_written_by_many_tasks(spark, tmp_path):
    rows = [(f"p{i}", i % 4, "letter", [f'a "{{{i}}}" ]', "", None, "x\n}, {"][i % 4]) for i in range(300)]
    entries = spark.createDataFrame(rows, "path string, label int, label_name string, text string").repartition(3)
    write_text_cache(entries, str(tmp_path / "cache"))
    files = list((tmp_path / "cache").glob("*.txt"))
    assert len(files) == 3 and all(isinstance(json.loads(f.read_text()), list) for f in files)
    got = co.read_text_cache(spark, str(tmp_path / "cache"))
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(rows)
    write_text_cache(entries.limit(0), str(tmp_path / "none"))
    assert co.read_text_cache(spark, str(tmp_path / "none")).count() == 0


def test_running_sums_of_a_text_cache_go_over_blocks(spark, tmp_path, monkeypatch):
    """Blocks of four pieces: quotes and braces are carried from block to block."""
    monkeypatch.setattr(co, "PIECE_BITS", 2)
    rows = [(f"p{i}", 1, "email", '"}{"}' * (i % 5) + "{" * (i % 3)) for i in range(100)]
    (tmp_path / "a.json").write_text(json.dumps([dict(zip(("path", "label", "label_name", "text"), r)) for r in rows]))
    got = sorted(co.read_text_cache(spark, str(tmp_path)).collect(), key=lambda r: r.seq)
    assert [tuple(r)[:4] for r in got] == rows
    windows = co.read_text_cache(spark, str(tmp_path))._jdf.queryExecution().analyzed().toString()
    assert "_block" in windows
