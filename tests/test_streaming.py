from pyspark.sql import functions as F

from paperloom.streaming import incremental as inc


def test_each_key_once_and_reruns_add_nothing(spark, tmp_path):
    land, table, progress = (str(tmp_path / n) for n in ("in", "table", "progress"))
    kind = "path string, text string"

    def run():
        stream = inc.arriving(spark, land, spark.createDataFrame([], kind).schema, 1)
        inc.incremental_text(stream, table, progress)
        return {(r.path, r.text) for r in spark.read.parquet(table).collect()}, spark.read.parquet(table).count()

    spark.createDataFrame([("a", " one  two "), ("b", "x"), ("a", " one  two ")], kind).repartition(3).write.parquet(land)
    assert run() == ({("a", "one two"), ("b", "x")}, 2)
    assert run()[1] == 2
    spark.createDataFrame([("a", "other"), ("c", "y")], kind).write.mode("append").parquet(land)
    assert run() == ({("a", "one two"), ("b", "x"), ("c", "y")}, 3)


def test_extract_stream_gates(spark, tmp_path):
    kind = "doc_id int, text string, label string, confidence double"
    spark.createDataFrame([(1, "Invoice #A1", "invoice", 0.5), (2, "Invoice #B2", "letter", 0.5)], kind).write.parquet(str(tmp_path / "in"))
    stream = inc.arriving(spark, str(tmp_path / "in"), spark.createDataFrame([], kind).schema)
    for _ in range(2):
        inc.append_files(inc.extract_labelled(stream), str(tmp_path / "out"), str(tmp_path / "progress"))
    assert {r.doc_id: r.invoice_number for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "A1", 2: None}


def test_other_buckets_stay_unread(spark, tmp_path):
    land, table, progress = (str(tmp_path / n) for n in ("in", "table", "progress"))
    kind = "path string, text string"
    schema = spark.createDataFrame([], kind).schema
    spark.createDataFrame([(f"p{i}", f"t {i}") for i in range(200)] + [(None, "n"), ("late", None)], kind).write.parquet(land)
    inc.incremental_text(inc.arriving(spark, land, schema), table, progress, buckets=8)
    stored = spark.read.parquet(table)
    assert stored.count() == 202 and {r.bucket for r in stored.select("bucket").distinct().collect()} == set(range(8))
    assert stored.where(inc.key_bucket("path", 8) != F.col("bucket")).count() == 0
    known = inc.known_keys(spark, table, stored.schema, [2, 5], 99, "path")
    assert known.count() == stored.where("bucket in (2, 5) and text is not null").count()
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    # a text that comes late is added, one that is known is not
    spark.createDataFrame([("late", "now"), ("p7", "changed")], kind).write.mode("append").parquet(land)
    inc.incremental_text(inc.arriving(spark, land, schema), table, progress, buckets=8)
    now = {r.path: r.text for r in inc.current_text(spark.read.parquet(table)).collect()}
    assert len(now) == 202 and now["late"] == "now" and now["p7"] == "t 7" and now[None] == "n"


def test_a_load_has_as_many_files_as_its_size_asks_for(spark, tmp_path, monkeypatch):
    from paperloom.plans import streaming as ps

    rows = spark.createDataFrame([(i, f"t  {i}") for i in range(60)], "doc_id bigint, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(ps, "shared_folder", lambda _: str(tmp_path / "run"))
    tasks = spark.read.parquet(str(tmp_path / "documents.parquet")).rdd.getNumPartitions()
    assert tasks > 1
    got = {(r.doc_id, r.text) for r in ps.st_incremental_text(spark, str(tmp_path)).collect()}
    assert got == {(i, f"t {i}") for i in range(60)}
    assert len(list((tmp_path / "run" / "in").glob("*.parquet"))) == 2 * 4 * tasks
