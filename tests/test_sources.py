"""Files in and out, dataset names, stores, scratch tables and streaming."""

from collections import Counter
from contextvars import copy_context
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from logsift.plans import jobs
from logsift.registry import Registry, preprocessors
from logsift.sources import datasets, files, scratch, stores  # noqa: F401
from logsift.streaming.scoring import score_stream


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_line_numbers_over_files_and_splits(spark, tmp_path):
    """Files of different length, cut into splits of a few hundred bytes."""
    folder = tmp_path / "logs"
    folder.mkdir()
    expected = []
    for name, n in (("b.log", 700), ("a.log", 50), ("c.log", 3)):
        lines = [f"{name} line {i} " + "x" * (i % 37) for i in range(n)]
        (folder / name).write_text("\n".join(lines) + "\n")
        expected.append((name, lines))
    expected = [line for _, lines in sorted(expected) for line in lines]
    conf = {
        "spark.sql.files.maxPartitionBytes": "900",
        "spark.sql.files.openCostInBytes": "100",
    }
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        got = files.read_log_lines(spark, str(folder))
        assert rows_of(got, "line_no") == list(enumerate(expected))
    finally:
        for key in conf:
            spark.conf.unset(key)


def test_latin_1_and_line_ends(spark, tmp_path):
    path = tmp_path / "raw.log"
    path.write_bytes("caf\xe9 one\r\ntwo\x85still two\nthree".encode("latin-1"))
    got = rows_of(files.read_log_lines(spark, str(path)), "line_no")
    assert got == [(0, "caf\xe9 one"), (1, "two\x85still two"), (2, "three")]


def test_paired_dataset(spark, tmp_path):
    (tmp_path / "groundtruth.seq").write_text("1\n2\nNA\n3\n")
    (tmp_path / "rawlog.log").write_text("id1 link 10.0.0.1 down\nid2 42\nid3 all fine\n")
    corpus = preprocessors["open_Apache"].corpus(spark, str(tmp_path))
    assert rows_of(corpus, "line_no") == [(0, "1", "link down"), (2, "NA", "all fine")]
    assert preprocessors["open_hdfs"].healthy == "NA"
    assert preprocessors["bgl"].healthy == "unlabeled"


def test_bgl_dataset(spark, tmp_path):
    path = tmp_path / "bgl.log"
    path.write_text("117 R02-M1-N0-C RAS KERNEL FATAL x   data cache parity error found\nshort\n")
    corpus = preprocessors["bgl"].corpus(spark, str(path))
    assert rows_of(corpus, "line_no") == [(0, "KERNEL", "data cache parity error found")]


def test_corpus_text_round_trip(spark, tmp_path):
    rows = [(5, "\xe9t\xe9", "b a"), (2, "A", "x y"), (9, "A", "z")]
    corpus = spark.createDataFrame(rows, "line_no bigint, label string, message string")
    text, parquet = str(tmp_path / "text"), str(tmp_path / "parquet")
    files.write_corpus_text(corpus, text)
    assert rows_of(files.read_corpus_text(spark, text), "line_no") == [
        (0, "A", "x y"),
        (1, "\xe9t\xe9", "b a"),
        (2, "A", "z"),
    ]
    files.write_corpus(corpus, parquet)
    encoded, _ = files.load_logs(spark, parquet, "A")
    assert rows_of(encoded.select("line_no", "y"), "line_no") == [(2, -1.0), (5, 1.0), (9, -1.0)]


def test_results_and_runs(spark, tmp_path):
    results = spark.createDataFrame([(0, 0.5)], "fold int, f1 double")
    stores.save_results(results, str(tmp_path / "r"))
    again = stores.load_results(spark, str(tmp_path / "r"), "fold int, f1 double")
    assert rows_of(again, "fold") == [(0, 0.5)]
    stores.save_run(spark, {"features": ["tfilf"], "k": 3}, str(tmp_path / "c"))
    assert stores.load_run(spark, str(tmp_path / "c")) == {"features": ["tfilf"], "k": 3}


class FakeContext:
    def __init__(self, master, checkpoints=None):
        self.master = master
        self.checkpoints = checkpoints

    def getCheckpointDir(self):
        return self.checkpoints

    def setCheckpointDir(self, folder):
        self.checkpoints = folder


class FakeSession:
    def __init__(self, conf, context):
        self.conf = conf
        self.sparkContext = context


def test_scratch_folder_comes_from_the_session():
    shared = FakeSession({"spark.checkpoint.dir": "hdfs://shared/x/"}, FakeContext("yarn"))
    assert scratch.scratch_dir(shared) == "hdfs://shared/x"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_dir(FakeSession({}, FakeContext("yarn")))
    local = FakeSession({}, FakeContext("local[2]"))
    assert scratch.scratch_dir(local) == scratch.scratch_dir(local)


def test_materialized_tables_lie_in_the_scratch_folder(spark):
    table = scratch.materialize(spark.range(3), "three")
    assert f"{scratch.scratch_dir(spark)}/logsift/three-" in table.inputFiles()[0]
    assert rows_of(table, "id") == [(0,), (1,), (2,)]


def tables_under(spark):
    folder = Path(scratch.scratch_dir(spark).removeprefix("file:")) / "logsift"
    return sorted(p.name.rsplit("-", 1)[0] for p in folder.glob("*")) if folder.exists() else []


def test_scopes_delete_what_is_not_kept(spark):
    before = tables_under(spark)
    with scratch.scratch_scope(spark) as outer:
        first = scratch.materialize(spark.range(2), "first")
        with scratch.scratch_scope(spark):
            scratch.materialize(spark.range(3), "second")
            third = scratch.materialize(spark.range(4), "third", keep=True)
            fourth = copy_context().run(scratch.materialize, spark.range(5), "fourth")
            assert fourth.count() == 5 and outer not in fourth.inputFiles()[0]
        assert third.count() == 4 and first.count() == 2
        assert sorted(p.name.split("-")[0] for p in Path(outer.removeprefix("file:")).glob("*")) == ["first", "third"]
        kept = scratch.materialize(spark.range(6), "kept", keep=True)
    assert kept.count() == 6 and not Path(outer.removeprefix("file:")).exists()
    assert Counter(tables_under(spark)) - Counter(before) == Counter(["kept"])
    with pytest.raises(RuntimeError), scratch.scratch_scope(spark) as folder:
        scratch.materialize(spark.range(1), "x")
        raise RuntimeError
    assert not Path(folder.removeprefix("file:")).exists()


def test_a_job_leaves_its_results_only(spark, tmp_path):
    rows = [(i, *(("ok", "service ready") if i % 3 else ("bad", f"disk failure {'a' if i % 2 else 'b'}"))) for i in range(60)]
    corpus = spark.createDataFrame(rows, "line_no bigint, label string, message string")
    before = Counter(tables_under(spark))
    path = str(tmp_path / "model")
    run = jobs.train_binary(corpus, "ok", k=2, binary_classifier="regular", path=path, numTrees=3, parallelism=2)
    left = Counter(tables_under(spark)) - before
    assert left == Counter({"classes": 1, "predictions": 2, "results": 1, "weights": 1})
    assert run.binary.count() == 60 and run.reports["binary", "confusion_matrix"].count() == 4
    assert run.models["binary"].transform(run.models["features"].transform(jobs.prepare(corpus, "ok")[0])).count() == 60


def test_paired_files_round_trip(spark, tmp_path):
    truth = spark.createDataFrame([(1, "NA"), (0, "7"), (2, "\xdf")], "line_no bigint, label string")
    raw = [(i, f"id{i} caf\xe9 up\xa0down\x85now {i}") for i in range(5)]
    raw = spark.createDataFrame(raw, "line_no bigint, raw string").repartition(3)
    files.write_paired_lines(truth, raw, str(tmp_path / "log"))
    assert b"caf\xe9 up\xa0down\x85now" in b"".join(p.read_bytes() for p in (tmp_path / "log" / "rawlog.log").glob("part-*"))
    corpus = preprocessors["open_bgl"].corpus(spark, str(tmp_path / "log"))
    assert rows_of(corpus, "line_no") == [(0, "7", "up down now"), (1, "NA", "up down now"), (2, "\xdf", "up down now")]


def test_small_stored_tables_are_broadcast_and_large_ones_are_not(spark):
    dim = scratch.materialize(spark.range(1000).withColumn("v", F.col("id") * 2), "dim")
    big = scratch.materialize(spark.range(100_000).withColumn("w", F.rand(0)), "big")
    plan = big.join(dim, "id")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
        plan = big.join(dim, "id")._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_registry_names_what_it_knows():
    registry = Registry("colour")
    registry.register("red", 1)

    @registry.register("blue")
    def blue():
        return 2

    assert registry["red"] == 1 and registry["blue"]() == 2
    with pytest.raises(KeyError, match="no colour named 'green'; known: blue, red"):
        registry["green"]


def test_stream_scores_like_batch(spark, tmp_path):
    rows = [
        (i, *(("ok", "service ready") if i % 3 else ("bad", "disk failure"))) for i in range(60)
    ]
    corpus = spark.createDataFrame(rows, "line_no bigint, label string, message string")
    model = str(tmp_path / "model")
    jobs.train_binary(corpus, "ok", k=2, binary_classifier="regular", path=model, numTrees=3)
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.log").write_text("disk failure: 12\nservice ready\n99\n")
    output = str(tmp_path / "out")
    before = set(tables_under(spark))
    for name in ("b", "c", "d"):
        query = score_stream(spark, str(inbox), model, output, str(tmp_path / "checkpoint"))
        query.awaitTermination(120)
        (inbox / f"{name}.log").write_text("disk failure\n")
    assert set(tables_under(spark)) == before  # three micro-batches have left nothing
    assert len(list((tmp_path / "out").glob("batch=*"))) == 3
    got = spark.read.parquet(output).select("message", "pred").orderBy("message").collect()
    assert [tuple(r) for r in got] == [
        ("disk failure", 1.0),
        ("disk failure", 1.0),
        ("disk failure", 1.0),
        ("service ready", -1.0),
    ]
