"""Results that don't depend on how rows are dealt, and steps whose tasks don't grow with the input."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline import queries
from weftline.llm import ngram_join
from weftline.operators import community, large_graphs
from weftline.sources import tables
from weftline.streaming import switches


@pytest.mark.parametrize("name", ["cartography_dense", "cartography_sparse"])
def test_profiles_add_up_in_the_order_of_events(spark, tmp_path, name):
    rng, n = np.random.default_rng(3), 8000
    cell = rng.permutation(np.arange(n) % 1000)  # of eight events, whose mean lies at a bin's edge in one of eight cells
    events = pd.DataFrame({"event_id": np.arange(n), "ts": pd.to_datetime("2024-01-01") + pd.to_timedelta(cell % 5, "h"), "user_id": cell // 5, "event_type": "view", "value": (2 * rng.integers(0, 2000, n) + 1) / 20, "props": "{}"})
    events.loc[events.user_id == 7, "value"] = None
    db = duckdb.connect(config={"threads": 1})
    db.register("events", events)
    want = db.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    want = sorted(want.fetchall())
    for k, order in enumerate((events, events[::-1], events.sample(frac=1, random_state=1))):
        made = spark.createDataFrame(order.astype({"value": object}).where(order.notna(), None), "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
        made.coalesce(3).write.parquet(str(tmp_path / str(k) / "events.parquet"))
        assert sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path / str(k))).select(*names).collect())) == want


def test_pairs_of_agreement_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 1000)
    parts = spark.range(600).selectExpr("id div 100 as block", "id as node", "0 as p", "id % 2 as c").coalesce(1)
    agreed = community.agreement(parts, keys=["block"])
    assert agreed.count() == 12 * 50 * 51 // 2
    assert agreed.rdd.getNumPartitions() == 16  # 15,300 pairs


def test_edges_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    edges = spark.range(40).selectExpr("id as i").crossJoin(spark.range(40).selectExpr("id as j")).where("i <> j and i div 10 = j div 10").withColumn("wt", F.when(F.col("i") < F.col("j"), 1.0).otherwise(2.0)).coalesce(1)
    written, keep = [], large_graphs.kept
    monkeypatch.setattr(large_graphs, "kept", lambda df, *old: written.append((sorted(df.columns), df.rdd.getNumPartitions())) or keep(df, *old))
    found = large_graphs.louvain(edges)
    assert {(r["node"], r["c"]) for r in found.collect()} == {(n, n // 10 * 10) for n in range(40)}
    assert [n for columns, n in written if columns == ["i", "j", "wt"]][1] == 4  # 360 links, as they were given and then both ways
    both = {(r["i"], r["j"]): r["wt"] for r in large_graphs.symmetric(edges).collect()}
    assert len(both) == 360 and set(both.values()) == {1.0}  # the first triangle's


def test_sets_of_candidates_out_of_reach_do_not_travel(spark):
    rng, threshold = np.random.default_rng(4), 75
    base = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 5, 60, 64, 65, 300, 5000)]
    rows, pairs = [], []
    for s in base:
        for share in (1.0, 0.9, 0.86, 0.85, 0.7, 0.5):
            kept = s[: max(1, round(share * len(s)))]
            other = np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, len(s) - len(kept)).astype(np.uint64)]))
            both = len(np.intersect1d(s, other))
            at = len(rows)
            rows += [(at + i, len(x), bytearray(ngram_join.to_planes(x)), bytearray(ngram_join.sketch(x))) for i, x in enumerate((s, other))]
            pairs.append((2 * at, 2 * at + 1, at, at + 1, 100 * both >= threshold * (len(s) + len(other) - both), share))
    sets = spark.createDataFrame(rows, "row long, n long, tokens binary, sketch binary")
    made = spark.createDataFrame([p[:4] for p in pairs], "u long, v long, r1 long, r2 long")
    found = {tuple(r) for r in ngram_join._within_reach(sets, made, threshold).collect()}
    assert {p[:4] for p in pairs if p[4]} <= found  # no link is lost
    assert not any(p[:4] in found for p in pairs if p[5] <= 0.7 and rows[p[2]][1] >= 60)
    assert sum(len(r[3]) for r in rows) * 30 < sum(len(r[2]) for r in rows if r[1] > 64) * 1.1


@pytest.mark.parametrize("bits", [27, 11])
def test_texts_that_stay_do_not_travel(spark, tmp_path, monkeypatch, bits):
    """However many the filter of lost ids takes for lost ones by chance."""
    monkeypatch.setattr(ngram_join, "FILTER_BITS", bits)
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 40)) + " " + rng.bytes(20_000).hex() for _ in range(300)]
    rows = [(k, texts[k % 300], k) for k in range(600)] + [(7, texts[7], -7), (7, "another text of the seventh " * 3, -8), (None, texts[9], 9), (None, "no id and alone here too", 10)]
    spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(4).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    before = _shuffled(spark)
    kept = sorted(((r["doc_id"], r["n"]) for r in ngram_join.keep_first(docs).collect()), key=str)
    assert kept == sorted([*((k, k) for k in range(300)), (7, -7), (7, -8), (None, 10)], key=str)
    assert _shuffled(spark) - before < 2_000_000  # of 24 MB of texts


def _shuffled(spark):
    """Bytes that all stages so far have written for exchanges."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


@pytest.mark.parametrize("kernel", [community.consensus, community.louvain])
def test_matrices_are_dealt_to_tasks_by_their_rows(spark, monkeypatch, kernel):
    """Not to as many as there are shuffle partitions, or fewer."""
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    rows = spark.range(1000).selectExpr("id div 10 as block", "id div 2 as i", "id div 2 + id % 2 as j", "1.0D as value", "1.0D as wt").coalesce(1)
    found = kernel(rows, keys=["block"], reps=2, seed=1)
    assert found.rdd.getNumPartitions() == 10
    assert found.select("block").distinct().count() == 100


def test_a_batch_reads_and_writes_the_state_of_a_key_once():
    calls, held = [], {}

    class Value:
        def get(self):
            calls.append("get")
            return held.get("v")

        def update(self, v):
            calls.append("update")
            held["v"] = v

    class Handle:
        def getValueState(self, *_):
            return Value()

        def getMapState(self, *_):
            raise AssertionError("a row at a time")

        def registerTimer(self, at):
            held["timer"] = at

    class Timers:
        now = 0

        def getCurrentWatermarkInMs(self):
            return self.now

    timers, run = Timers(), switches._Switches(None)
    run.init(Handle())
    step = lambda rows: next(run.handleInputRows(("k",), iter([pd.DataFrame(rows, columns=["micros", "n", "state"])]), timers)).iloc[0].tolist()
    assert step([(9000, 1, 2), (5000, 1, 1), (5000, 2, 2)]) == ["k", 1, 3, 0] and held["timer"] == 6
    assert calls == ["get", "update"]
    timers.now = 6
    assert step([(7000, 1, 1), (1000, 1, 1)]) == ["k", 3, 2, 0]
    assert step([(4000, 1, 2), (5000, 2, 1), (9000, 1, 1)]) == ["k", 2, 2, 2]  # two late ones, and one in the place of a row
    timers.now = 9
    assert next(run.handleExpiredTimer(("k",), timers, None)).iloc[0].tolist() == ["k", 2, 0, 2]
