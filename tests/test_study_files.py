"""Run files, chunks, result files and streams of the study."""

import gzip
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import chunks, clustering, connectivity, metrics, preprocessing
from weftline.plans import study
from weftline.sources import nifti, results
from weftline.streaming import switches


def bold(spark, vertices=7, frames=9, sessions=(("a", "1"), ("a", "2"), ("b", "1"))):
    rng = np.random.default_rng(4)
    return spark.createDataFrame([(s, k, v, t, float(rng.normal())) for s, k in sessions for v in range(vertices) for t in range(frames) if (v + t) % 5], "subject string, session string, vertex long, t int, value double")


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


# -- run files -------------------------------------------------------------------


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("bids"))
    table = bold(spark)
    assert nifti.write_runs(table, folder, "fsaverage6", 7, 9, 2.5).count() == 3
    nifti.write_runs(bold(spark, 4, 3, [("a", "1")]), folder, "MNI152NLin2009cAsym", 4, 3).count()
    (open(f"{folder}/dataset_description.json", "w")).write("{}")
    return folder, table


def test_runs_come_back(spark, runs):
    folder, table = runs
    for sizes in ((3, 4), (100, 100)):
        back = chunks.to_long(nifti.read_runs(spark, folder, "fsaverage6", *sizes), ["subject", "session"], *sizes)
        assert same(back, table)
    heads = nifti.scan_runs(spark, folder)
    assert sorted((r["subject"], r["session"], r["space"], r["vertices"], r["frames"], r["repetition_time"]) for r in heads.collect()) == [
        ("a", "1", "MNI152NLin2009cAsym", 4, 3, 1.0), ("a", "1", "fsaverage6", 7, 9, 2.5), ("a", "2", "fsaverage6", 7, 9, 2.5), ("b", "1", "fsaverage6", 7, 9, 2.5)
    ]


def test_filters_skip_files(spark, runs):
    folder, _ = runs
    for path in ("sub-b/ses-1/func", "sub-a/ses-2/func"):
        for name in os.listdir(f"{folder}/{path}"):
            assert name.endswith(".nii.gz")
    reader = nifti._Reader({"path": folder})
    left = list(reader.pushFilters([nifti.EqualTo(("subject",), "a"), nifti.In(("session",), ("1", "2")), nifti.EqualTo(("space",), "fsaverage6"), nifti.EqualTo(("frames",), 9)]))
    assert [f.attribute for f in left] == [("frames",)]
    assert [(r.subject, r.session, r.space) for r in reader.partitions()] == [("a", "1", "fsaverage6"), ("a", "2", "fsaverage6")]
    found = nifti.scan_runs(spark, folder).where("subject = 'a' and space = 'fsaverage6'")
    assert found.rdd.getNumPartitions() == 2 and found.count() == 2  # a partition is a file
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "= a" not in plan and "= fsaverage6" not in plan  # the source has taken both filters


def test_the_scan_reads_no_voxel(spark, tmp_path):
    head = nifti.Header(50, 10, 2.0, np.dtype("<f4"), 352, 1.0, 0.0).pack()
    folder = tmp_path / "sub-x" / "func"
    folder.mkdir(parents=True)
    (folder / "sub-x_task-rest_space-fsaverage5_bold.nii.gz").write_bytes(gzip.compress(head))  # nothing after the header
    assert nifti.scan_runs(spark, str(tmp_path)).select("session", "vertices", "frames").collect() == [(None, 50, 10)]
    with pytest.raises(Exception, match="ends before its last frame"):
        nifti.read_runs(spark, str(tmp_path)).collect()


def test_other_number_formats_scales_and_byte_order(spark, tmp_path):
    data = np.arange(24, dtype=">i2").reshape(4, 6)  # four frames of 3 x 2 x 1 voxels
    head = bytearray(352)
    struct.pack_into(">i", head, 0, 348)
    struct.pack_into(">8h", head, 40, 4, 3, 2, 1, 4, 1, 1, 1)
    struct.pack_into(">2h", head, 70, 4, 16)
    struct.pack_into(">3f", head, 108, 352, 0.5, 1)
    head[344:348] = b"n+1\0"
    (tmp_path / "sub-1_ses-x_space-T1w_desc-preproc_bold.nii").write_bytes(bytes(head) + data.tobytes())
    back = chunks.to_long(nifti.read_runs(spark, str(tmp_path)), ["subject"])
    assert {(r["vertex"], r["t"]): r["value"] for r in back.collect()} == {(v, t): 0.5 * (6 * t + v) + 1 for v in range(6) for t in range(4)}
    (tmp_path / "sub-2_ses-x_space-T1w_bold.nii").write_bytes(b"no run at all" * 60)
    with pytest.raises(Exception, match="no NIfTI-1 file"):
        nifti.scan_runs(spark, str(tmp_path)).collect()
    assert nifti.read_runs(spark, str(tmp_path), "other").collect() == []


# -- chunks ------------------------------------------------------------------------


def test_chunks_give_the_means_of_long_tables(spark):
    table = bold(spark, 11, 10)
    keys = ["subject", "session"]
    common = spark.createDataFrame([(v, v % 4) for v in range(11)], "vertex long, roi int")
    own = table.select("subject", "vertex").distinct().withColumn("roi", (F.length("subject") + F.ascii("subject") + F.col("vertex")).cast("int") % 3)
    made = chunks.to_chunks(table, keys, 4, 3)
    assert same(chunks.to_long(made, keys, 4, 3), table)
    for atlas in (common, own):
        want = {(r["subject"], r["session"], r["roi"], r["t"]): r["value"] for r in preprocessing.extract_roi(table, atlas, keys).collect()}
        found = {(r["subject"], r["session"], r["roi"], r["t"]): r["value"] for r in chunks.extract_roi(made, chunks.atlas_blocks(atlas, keys, 4), keys, 3).collect()}
        assert found == pytest.approx(want)
    assert chunks.extract_roi(made.limit(0), chunks.atlas_blocks(common, keys, 4), keys, 3).collect() == []


def test_signals_do_not_move_for_the_join(spark, tmp_path):
    table, keys = bold(spark, 11, 10), ["subject", "session"]
    own = table.select("subject", "session", "vertex").distinct().withColumn("roi", (F.col("vertex") % 3).cast("int"))
    by = [*keys, "vb"]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        signals = chunks.save_bucketed(chunks.to_chunks(table, keys, 4, 3), "signals_here", str(tmp_path / "s"), by, 4)
        blocks = chunks.save_bucketed(chunks.atlas_blocks(own, keys, 4), "atlas_here", str(tmp_path / "a"), by, 4)
        plan = chunks.extract_roi(signals, blocks, keys, 3)._jdf.queryExecution().sparkPlan().toString()
        done = chunks.extract_roi(signals, blocks, keys, 3)
        rows = {(r["subject"], r["session"], r["roi"], r["t"]): r["value"] for r in done.collect()}
        executed = done._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
        assert "SortMergeJoin" in executed and executed.rindex("Exchange") < executed.index("SortMergeJoin"), plan  # all exchanges are above the join
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for name in ("signals_here", "atlas_here"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    assert rows == pytest.approx({(r["subject"], r["session"], r["roi"], r["t"]): r["value"] for r in preprocessing.extract_roi(table, own, keys).collect()})


# -- coupling in blocks ---------------------------------------------------------------


@pytest.mark.parametrize("direction", ["centered", "forward"])
def test_coupling_blocks_equal_the_rows(spark, direction):
    rng = np.random.default_rng(3)
    rows = [(k, r, t, 0.0 if r == 4 else float(rng.normal())) for k in "ab" for r in range(7) for t in range(40)]
    series = spark.createDataFrame(rows, "k string, roi int, t int, value double")
    want = {(r["k"], r["i"], r["j"], r["t"]): r["value"] for r in connectivity.derivative_coupling(series, ["k"], 5, direction).collect()}
    for parcels, frames in ((3, 8), (2, 5), (100, 100)):
        blocks = connectivity.coupling_blocks(series, ["k"], 5, direction, parcels, frames)
        found = {(r["k"], r["i"], r["j"], r["t"]): r["value"] for r in connectivity.blocks_to_long(blocks, ["k"], frames).collect()}
        assert found == pytest.approx(want)
    gap = connectivity.coupling_blocks(series.where("t <> 20"), ["k"], 5, direction, 3, 8)
    assert connectivity.blocks_to_long(gap, ["k"], 8).count() < len(want)
    assert connectivity.coupling_blocks(series.limit(0), ["k"], 5).collect() == []


def shuffled(spark, df):
    """Bytes that a plan writes for its exchanges."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def total():
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - before


def test_blocks_shuffle_the_series_and_not_the_pairs(spark):
    """Of series too large to be broadcast, as those of a study are."""
    rng = np.random.default_rng(5)
    series = spark.createDataFrame([(r, t, float(rng.normal())) for r in range(40) for t in range(300)], "roi int, t int, value double")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows, blocks = shuffled(spark, connectivity.derivative_coupling(series)), shuffled(spark, connectivity.coupling_blocks(series))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert 0 < 3 * blocks < rows


# -- k-means ------------------------------------------------------------------------------


def test_kmeans_is_no_worse_than_the_best_of_sequential_runs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 1.0, (40, 5)) for c in (0, 3, 6, 9)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample int, features array<double>").repartition(3)
    labels, centers, inertia = clustering.kmeans(df, n_clusters=4, n_init=12, tol=0)
    best = min(clustering._lloyd(clustering._Samples(len(x), 5, x), 4, np.random.default_rng(s), 300)[1] for s in range(12))
    assert inertia <= best * (1 + 1e-9)
    by = {r["sample"]: r["label"] for r in labels.collect()}
    c = np.array([r["center"] for r in centers.orderBy("label").collect()])
    assert np.sum((x - c[[by[i] for i in range(len(x))]]) ** 2) == pytest.approx(inertia)
    assert list(np.argsort(np.linalg.norm(c, axis=1))) == [0, 1, 2, 3]
    # the same as sparse vectors
    sparse = df.select("sample", F.struct(F.sequence(F.lit(0), F.lit(4)).alias("indices"), F.col("features").alias("values")).alias("features"))
    assert clustering.kmeans(sparse, n_clusters=4, n_init=12, width=5, tol=0)[2] == pytest.approx(inertia)
    monkeypatch.setattr(clustering, "DRIVER_SUMS", 0)  # sums added up in tasks
    assert clustering.kmeans(df, n_clusters=4, n_init=12, tol=0)[2] == pytest.approx(inertia)


def test_kmeans_passes_are_iterations(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 2) * 50, float(i % 7)]) for i in range(60)], "sample int, features array<double>")
    passes, sums = [], clustering._sums
    monkeypatch.setattr(clustering, "_sums", lambda data, centers, tasks: passes.append(len(centers)) or sums(data, centers, tasks))
    clustering.kmeans(df, n_clusters=2, n_init=20)
    assert passes[0] == 20 and len(passes) < 20 and passes == sorted(passes, reverse=True)


def test_kmeans_edges(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, None), (3, [0.0])], "sample int, features array<double>")
    labels, centers, inertia = clustering.kmeans(df, n_clusters=3, n_init=2)
    assert sorted(r["sample"] for r in labels.collect()) == [1, 3] and inertia == 0 and centers.count() == 3
    labels, centers, inertia = clustering.kmeans(df.limit(0), n_clusters=3, n_init=2)
    assert labels.collect() == [] and centers.collect() == [] and inertia == 0
    empty = spark.createDataFrame([(1, ([], [])), (2, ([1, 3], [2.0, 1.0])), (3, ([1], [2.0]))], "sample int, features struct<indices: array<int>, values: array<double>>")
    labels, _, _ = clustering.kmeans(empty, n_clusters=2, n_init=4, width=4)
    assert {r["sample"]: r["label"] for r in labels.collect()} == {1: 0, 2: 1, 3: 1}


# -- result files -----------------------------------------------------------------------------


def test_result_files_come_back(spark, tmp_path):
    table = spark.createDataFrame([(1, "é, \"x\"", 2.5), (2, None, None), (3, "", -1.0)], "k long, name string, x double").repartition(2)
    for form in results.FORMS:
        results.write_results(table, str(tmp_path / form), form)
        results.write_results(table, str(tmp_path / form), form)  # in place of the first
        assert all(f.startswith("part-") for f in os.listdir(tmp_path / form))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "csv"), header=True, schema="k long, name string, x double", escape='"').collect())) == [(1, "é, \"x\"", 2.5), (2, None, None), (3, None, -1.0)]
    assert sorted(map(tuple, spark.read.schema(table.schema).json(str(tmp_path / "json")).collect())) == sorted(map(tuple, table.collect()))
    back = results.read_mat(spark, str(tmp_path / "mat"), "k long, name string, x double").collect()
    assert [(r["k"], r["name"], r["x"] if r["x"] == r["x"] else None) for r in sorted(back)] == [(1, "é, \"x\"", 2.5), (2, "", None), (3, "", -1.0)]


def test_an_aborted_write_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "out")
    results.write_results(spark.range(5), path, "csv")
    before = sorted(os.listdir(path))
    bad = spark.range(40).repartition(4).select(F.when(F.col("id") == 33, F.raise_error(F.lit("broken row"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken row"):
        results.write_results(bad, path, "csv")
    assert sorted(os.listdir(path)) == before
    with pytest.raises(Exception, match="form must be"):
        results.write_results(spark.range(5), path, "xml")


def test_a_run_from_files_equals_one_from_a_table(spark, tmp_path):
    rng = np.random.default_rng(12)
    table = spark.createDataFrame([(s, k, v, t, float(10 + rng.normal())) for s in "ab" for k in "12" for v in range(9) for t in range(16)], "subject string, session string, vertex long, t int, value double")
    nifti.write_runs(table, str(tmp_path / "bids"), "fsaverage6", 9, 16).count()
    atlas = spark.createDataFrame([(v, v % 5) for v in range(9)], "vertex long, roi int")
    behaviour = spark.createDataFrame([("a", 1.0), ("b", 2.5)], "subject string, caq double")
    motion = spark.createDataFrame([("b", "2")], "subject string, session string")
    few = study.Settings(window=4, runs=2, reps=2, n_init=2)
    one = study.run(table, atlas, behaviour, "caq", str(tmp_path / "one"), few, motion=motion)
    two = study.run_files(spark, str(tmp_path / "bids"), "fsaverage6", atlas, behaviour, "caq", str(tmp_path / "two"), study.Settings(window=4, runs=2, reps=2, n_init=2, blocks=True), motion=motion)
    assert same(one, two) and one.count() == 3
    assert results.read_mat(spark, str(tmp_path / "two" / "sessions_mat"), "subject string, session string").count() == 3


# -- streams --------------------------------------------------------------------------------------


def arrivals(spark, folder, parts):
    for k, part in enumerate(parts):
        df = spark.createDataFrame(part, "key long, seconds long, n long, state int").select("key", F.timestamp_seconds("seconds").alias("ts"), "n", "state")
        df.coalesce(1).write.mode("append").parquet(str(folder))
        for name in os.listdir(folder):  # files are taken by age
            if name.startswith("part-"):
                os.utime(f"{folder}/{name}", (1_700_000_000 + k, 1_700_000_000 + k)) if os.path.getmtime(f"{folder}/{name}") > 1_700_001_000 else None


SCHEMA = "key long, ts timestamp, n long, state int"


def test_arrival_in_any_order_counts_the_same(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(k, int(t) // 2, n, int(rng.integers(1, 3))) for k in range(4) for n, t in enumerate(sorted(rng.integers(0, 4000, 50)))]
    shuffled = [rows[i] for i in rng.permutation(len(rows))]
    arrivals(spark, tmp_path / "in", [shuffled[i::5] for i in range(5)])
    found = switches.count_files(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "work"), "2 hours", 2)
    batch = metrics.switch_count(spark.createDataFrame(rows, "key long, t long, n long, state int"), ["key"], ["t", "n"])
    assert sorted(map(tuple, found.collect())) == [(r["key"], r["switch_count"], 0) for r in batch.orderBy("key").collect()]


def test_rows_behind_the_watermark_are_settled_and_later_ones_are_late(spark, tmp_path):
    parts = [[(1, 100, 1, 1), (1, 300, 2, 2)], [(1, 5000, 3, 2)], [(1, 6000, 4, 1)], [(1, 7000, 6, 1)], [(1, 200, 5, 2)]]
    arrivals(spark, tmp_path / "in", parts)
    found = switches.count_files(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "work"), "10 seconds", 1)
    # the last row is over an hour behind; its switches would be none anyway, and settled ones don't change
    assert [tuple(r)[:2] for r in found.collect()] == [(1, 2)]
    close = [[(1, 100, 1, 1), (1, 300, 2, 1)], [(1, 200, 3, 2)]]
    arrivals(spark, tmp_path / "in2", close)
    found = switches.count_files(spark, str(tmp_path / "in2"), SCHEMA, str(tmp_path / "work2"), "1 hour", 1)
    assert [tuple(r) for r in found.collect()] == [(1, 2, 0)]  # put back between the two
