"""Golden and property tests of the network operators on tables small enough to work by hand."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.functions import statistics
from weftline.operators import clustering, community, connectivity, control, metrics, preprocessing
from weftline.plans import study
from weftline.sources import results, tables


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_roi_mean_leaves_out_background(spark):
    bold = spark.createDataFrame([(0, 1, 0, 1.0), (0, 2, 0, 3.0), (0, 3, 0, 9.0)], "session int, vertex int, t int, value double")
    atlas = spark.createDataFrame([(1, 5), (2, 5), (3, 0)], "vertex int, roi int")
    assert rows(preprocessing.extract_roi(bold, atlas, ["session"]), "session", "roi", "t", "value") == [(0, 5, 0, 2.0)]
    with pytest.raises(ValueError):
        preprocessing.extract_roi(bold, atlas, ["session"], "mesh")


def test_networks_are_numbered_in_order(spark):
    series = spark.createDataFrame([(r, 0, float(r)) for r in (1, 2, 3, 4)], "roi int, t int, value double")
    regions = spark.createDataFrame([(1, "ContA"), (2, "VisCent"), (3, "DefaultB"), (4, "DefaultA")], "roi int, network string")
    assert rows(preprocessing.select_networks(series, regions), "roi", "value") == [(0, 3.0), (1, 4.0), (2, 1.0)]
    assert rows(preprocessing.select_networks(series, regions, dmn=[2], ecn=[1]), "roi", "value") == [(0, 2.0), (1, 1.0)]


def test_constant_series_has_no_tsnr(spark):
    series = spark.createDataFrame([(r, t, float(v)) for r, vs in enumerate([[1, 1, 1], [1, 2, 3], [1, 2, 4]]) for t, v in enumerate(vs)], "roi int, t int, value double")
    found = {r["roi"]: (r["tsnr"], r["keep"]) for r in preprocessing.tsnr(series).collect()}
    assert found[0] == (None, False) and found[1][0] == pytest.approx(2.0)


@pytest.mark.parametrize("direction,first", [("forward", 1), ("centered", 3)])
def test_coupling_of_equal_series_is_their_mean_square(spark, direction, first):
    rng = np.random.default_rng(1)
    v = rng.normal(size=20)
    series = spark.createDataFrame([(r, t, float(x)) for r in (0, 1) for t, x in enumerate(v)], "roi int, t int, value double")
    w = 4
    out = connectivity.derivative_coupling(series, window=w, direction=direction).where("i = 0 and j = 1").orderBy("t").collect()
    z = np.diff(v) / np.diff(v).std(ddof=1)
    want = [np.mean(z[k : k + w] ** 2) for k in range(len(z) - w + 1)]
    assert len(out) == len(v) - w and out[0]["t"] == first
    assert [r["value"] for r in out] == pytest.approx(want)
    padded = connectivity.derivative_coupling(series, window=w, direction=direction, trim=False).where("i = 0 and j = 1")
    assert padded.count() == len(v) and padded.where("value = 0").count() == w
    assert connectivity.derivative_coupling(series, window=w, declared_length=True).where("i = 0 and j = 1").count() == len(v) - w - 1


def test_coupling_ignores_scale(spark):
    rng = np.random.default_rng(2)
    a = spark.createDataFrame([(r, t, float(x)) for r in range(3) for t, x in enumerate(rng.normal(size=15))], "roi int, t int, value double")
    one = {(r["i"], r["j"], r["t"]): r["value"] for r in connectivity.derivative_coupling(a, window=3).collect()}
    two = {(r["i"], r["j"], r["t"]): r["value"] for r in connectivity.derivative_coupling(a.withColumn("value", F.col("value") * 7), window=3).collect()}
    assert one == pytest.approx(two)


def test_participation(spark):
    w = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0), (1, 0, 1.0), (2, 0, 1.0), (3, 0, -1.0), (0, 3, -1.0)], "i int, j int, wt double")
    m = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 1)], "node int, c int")
    found = {r["node"]: (r["p_pos"], r["p_neg"]) for r in metrics.participation(w, m).collect()}
    assert found[0] == (0.5, 0.0) and found[3] == (0.0, 0.0)


def test_module_z_of_equal_degrees_is_zero(spark):
    w = spark.createDataFrame([(a, b, 1.0) for a in range(3) for b in range(3) if a != b], "i int, j int, wt double")
    m = spark.createDataFrame([(k, 1) for k in range(3)], "node int, c int")
    assert rows(metrics.module_z(w, m), "node", "z") == [(0, 0.0), (1, 0.0), (2, 0.0)]


def test_agreement(spark):
    parts = spark.createDataFrame([(1, 0, 1), (2, 0, 1), (3, 0, 2), (1, 1, 1), (2, 1, 2), (3, 1, 2)], "node int, p int, c int")
    found = {(r["i"], r["j"]): r["value"] for r in community.agreement(parts).collect()}
    assert found == {(1, 1): 1.0, (2, 2): 1.0, (3, 3): 1.0, (1, 2): 0.5, (2, 3): 0.5}


def test_cartography_cells(spark):
    nodes = spark.createDataFrame([(0, 0, 0.5, 0.0), (0, 1, 1.0, 9.0)], "t int, node int, bt double, wt double")
    profile = metrics.cartography(nodes)
    assert rows(profile, "yb", "xb", "n") == [(0, 100, 1), (50, 50, 1)]
    dense = metrics.densify(metrics.profile_vectors(nodes.union(nodes.limit(1).withColumn("t", F.lit(3)))))
    values = {r["t"]: r["values"] for r in dense.collect()}
    assert sorted(values) == [0, 3] and all(len(v) == 101 * 101 for v in values.values())
    assert [k for k, n in enumerate(values[0]) if n] == [100, 50 * 101 + 50] and sum(values[0]) == 2 and values[3][50 * 101 + 50] == 1 == sum(values[3])
    plan = dense._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_switches(spark):
    states = spark.createDataFrame([(0, t, s) for t, s in enumerate([1, 1, 2, 2, 1])], "k int, t int, state int")
    assert [r["flag"] for r in metrics.switches(states, ["k"]).orderBy("t").collect()] == [2, 3, 4, 3]
    assert rows(metrics.switch_count(states, ["k"]), "k", "switch_count") == [(0, 2)]


def planted(n=12, seed=0):
    rng = np.random.default_rng(seed)
    c = np.arange(n) % 3
    w = np.where(c[:, None] == c[None, :], 1.0, -0.4) + rng.normal(scale=0.05, size=(n, n))
    w = (w + w.T) / 2
    np.fill_diagonal(w, 0)
    return c, w


@pytest.mark.parametrize("qtype", metrics.QTYPES)
def test_louvain_finds_planted_modules(spark, qtype):
    c, w = planted()
    upper = spark.createDataFrame([(0, i, j, float(w[i, j])) for i in range(len(w)) for j in range(i + 1, len(w))], "t int, i int, j int, wt double")
    found = community.louvain(upper, ["t"], qtype, seed=3)
    labels = {r["node"]: r["c"] for r in found.collect()}
    if qtype != "neg":  # negative links alone don't hold modules together
        assert all((labels[a] == labels[b]) == (c[a] == c[b]) for a in labels for b in labels)
    q = metrics.modularity(connectivity.mirror(upper), found.select("t", "node", "c"), ["t"], qtype).first()["q"]
    assert q == pytest.approx(found.first()["q"], abs=1e-9)
    assert rows(found, "node", "c", "q") == rows(community.louvain(upper, ["t"], qtype, seed=3), "node", "c", "q")


def test_consensus_of_clear_agreement(spark):
    agreed = spark.createDataFrame([(0, i, j, 1.0 if i // 3 == j // 3 else 0.0) for i in range(6) for j in range(i, 6)], "k int, i int, j int, value double")
    found = {r["node"]: r["c"] for r in community.consensus(agreed, ["k"], reps=5, seed=1).collect()}
    assert len(set(found.values())) == 2 and found[0] == found[1] == found[2] != found[3]
    empty = community.consensus(agreed.withColumn("value", F.lit(0.0)), ["k"], reps=5, seed=1)
    assert len({r["c"] for r in empty.collect()}) == 6


def test_kmeans_by_key_separates_and_counts_from_one(spark):
    cells = spark.createDataFrame([("a", s, f, float((s % 2) * 10 + f)) for s in range(8) for f in range(3)], "k string, sample int, feature int, value double")
    found = {r["t"]: r["state"] for r in clustering.kmeans_by_key(cells, ["k"], n_init=5).collect()}
    assert found == {s: s % 2 + 1 for s in range(8)}


def test_stack_restores_axes(spark):
    table = spark.createDataFrame([(1, 2, 3.0)], "subject int, t int, value double")
    same, keys = control.for_each(table, ["subject", "t"])
    assert control.stack(same, keys).columns == table.columns
    assert control.stack(same, keys, "append").columns == ["t", "value", "subject"]
    with pytest.raises(ValueError):
        control.for_each(table, ["subject"], 2)


def test_icc_of_equal_sessions_is_one(spark):
    scores = spark.createDataFrame([(s, k, float(s)) for s in range(5) for k in range(3)] + [(9, 0, 4.0)], "subject int, session int, value double")
    found = statistics.icc21(scores).first()
    assert (found["n"], found["k"], found["icc"]) == (5, 3, pytest.approx(1.0))


def test_p_values_against_published_pairs(spark):
    # r and p to three places at n = 39, known pairs
    for r, p in [(-0.184, 0.262), (0.155, 0.347), (0.211, 0.198), (0.072, 0.663)]:
        t2 = r * r * 37 / (1 - r * r)
        assert statistics._beta_tail(18.5, 0.5, 37 / (37 + t2)) == pytest.approx(p, abs=2e-3)
    table = spark.createDataFrame(pd.DataFrame({"x": [1.0, 2.0, 3.0, 4.0], "y": [1.0, 3.0, 2.0, 4.0]}))
    found = statistics.pearson(table, "x", "y").first()
    assert found["r"] == pytest.approx(0.8) and found["p"] == pytest.approx(0.2, abs=1e-9)


def test_grades(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (0.7,), (0.9,), (None,)], "icc double")
    assert [r[0] for r in df.select(statistics.icc_grade(F.col("icc"))).collect()] == ["poor", "fair", "good", "excellent", None]
    assert df.select(statistics.fisher_z(F.col("icc"))).first()[0] == pytest.approx(math.atanh(0.1))


def test_study_runs_for_each_session(spark):
    rng = np.random.default_rng(5)
    series = spark.createDataFrame([(s, k, r, t, float(rng.normal())) for s in range(2) for k in range(2) for r in range(6) for t in range(12)], "subject int, session int, roi int, t int, value double")
    found = study.switching(series, settings=study.Settings(window=4, runs=2, reps=2, n_init=2))
    assert found.count() == 4
    behaviour = spark.createDataFrame([(0, 1.0), (1, 2.0)], "subject int, score double")
    assert study.reliability(found, behaviour, "score").count() == 1
    with pytest.raises(ValueError):
        study.Settings(window=2)


@pytest.mark.parametrize(("level", "tsnr"), [("roi", True), ("vertex", False)])
def test_a_run_writes_its_files(spark, tmp_path, level, tsnr):
    rng = np.random.default_rng(9)
    cells = [(s, k, v, t, float(10 + rng.normal())) for s in "abc" for k in ("1", "2") for v in range(8) for t in range(17)]
    bold = spark.createDataFrame(cells, "subject string, session string, vertex int, t int, value double")
    atlas = spark.createDataFrame([(v, v % 5) for v in range(8)], "vertex int, roi int")
    regions = spark.createDataFrame([(1, "DefaultA"), (2, "ContB"), (3, "DefaultB"), (4, "ContA")], "roi int, network string")
    behaviour = spark.createDataFrame([("a", 1.0), ("b", 2.5), ("c", 2.0)], "subject string, caq double")
    motion = spark.createDataFrame([("c", "2")], "subject string, session string")
    few = study.Settings(window=4, runs=2, reps=2, n_init=2)
    found = study.run(bold, atlas, behaviour, "caq", str(tmp_path), few, regions, level, motion, tsnr)
    assert {(r["subject"], r["session"]) for r in found.collect()} == {(s, k) for s in "abc" for k in "12"} - {("c", "2")}
    text = "subject string, session string, switch_count long"
    assert rows(spark.read.csv(f"{tmp_path}/sessions_csv", header=True, schema=text), "subject", "session", "switch_count") == rows(found, "subject", "session", "switch_count")
    assert rows(results.read_mat(spark, f"{tmp_path}/sessions_mat", text), "switch_count") == rows(found, "switch_count")
    assert spark.read.csv(f"{tmp_path}/subjects_csv", header=True).count() == 3
    whole = spark.read.json(f"{tmp_path}/statistics_json").first()
    assert whole["n"] == 5 and whole["mean"] == pytest.approx(found.agg(F.avg("switch_count")).first()[0]) and {"icc", "grade", "r", "p"} <= set(whole.asDict())


def test_the_study_has_its_own_settings():
    own = study.Settings()
    assert (own.runs, own.reps, own.n_init, own.tau, own.window, own.drop, own.threshold_sd) == (500, 500, 100, 0.1, 14, 5, 2.0)


def test_sources_round_trip(spark, tmp_path):
    table = spark.createDataFrame([("s1", "a", 3), ("s1", "b", 4)], "subject string, session string, switch_count int")
    for form in ("csv", "json", "parquet"):
        tables.write_sessions(table, str(tmp_path / form), form)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    (tmp_path / "x.txt").write_text("# flagged\ns1 a\n\ns2,b\n")
    assert rows(tables.read_exclusions(spark, str(tmp_path / "x.txt")), "subject", "session") == [("s1", "a"), ("s2", "b")]
    (tmp_path / "m.csv").write_text("Kong_Index,Kong_ROI_Name,Schaefer2018_Best_Match,Dice\n0,Background,Background,1.0\n1,17networks_LH_DefaultA_PFCd_1,17Networks_LH_DefaultB_PFCd_1,1.0\n")
    assert rows(tables.read_mapping(spark, str(tmp_path / "m.csv")).where("roi = 1"), "network", "target_network") == [("DefaultA", "DefaultB")]


def test_variants_equal_four_separate_filters(spark):
    keys = ["definition", "subject", "session"]
    sessions = spark.createDataFrame([(d, s, k, 10 * s + k) for d in "ab" for s in range(4) for k in range(3)], "definition string, subject int, session int, switch_count int")
    motion = spark.createDataFrame([(0, 0), (1, 2), (1, 2)], "subject int, session int")
    features = spark.createDataFrame([("a", s, k, (s + k) % 2 == 0) for s in range(4) for k in range(3)], "definition string, subject int, session int, keep boolean")
    found = rows(study.variants(sessions, motion, features, keys), "motion", "tsnr", *keys)
    moved, good = {(0, 0), (1, 2)}, {("a", s, k) for s in range(4) for k in range(3) if (s + k) % 2 == 0}
    want = [(m, t, d, s, k) for m in (False, True) for t in (False, True) for d in "ab" for s in range(4) for k in range(3) if not (m and (s, k) in moved) and (not t or (d, s, k) in good)]
    assert sorted(found) == sorted(want)


def test_definitions_take_atlases_of_all_and_of_each_session(spark):
    bold = spark.createDataFrame([(k, v, 0, float(v + 10 * k)) for k in range(2) for v in range(4)], "session int, vertex int, t int, value double")
    common = spark.createDataFrame([(v, 1 + v % 2) for v in range(4)], "vertex int, roi int")
    own = spark.createDataFrame([(k, v, 1 + (v + k) % 2) for k in range(2) for v in range(4)], "session int, vertex int, roi int")
    found = sorted(rows(study.definitions({"x": (bold, common), "y": (bold, own)}, ["session"]), "definition", "session", "roi", "value"))
    assert found == [("x", 0, 1, 1.0), ("x", 0, 2, 2.0), ("x", 1, 1, 11.0), ("x", 1, 2, 12.0), ("y", 0, 1, 1.0), ("y", 0, 2, 2.0), ("y", 1, 1, 12.0), ("y", 1, 2, 11.0)]
