"""K-means: many starts in one job over all samples, or per key in one task each."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.sources.tables import kept

#: Samples from which starts are drawn, and the bytes that they may have on the driver.
SEEDS, SEED_BYTES = 2000, 64 << 20
#: Bytes of all tasks' sums that the driver adds up itself; beyond that they are added up in tasks first.
DRIVER_SUMS = 32 << 20
#: Features of one row of sums, and values of samples that a task works on at once.
FEATURES, SLICE = 4096, 1 << 20


class _Samples:
    """Some samples as dense rows ``x``, or as the values ``x`` of what isn't 0 with its row and place."""

    def __init__(self, n: int, width: int, x: np.ndarray, row: np.ndarray | None = None, at: np.ndarray | None = None):
        self.n, self.width, self.x, self.row, self.at = n, width, x, row, at
        self.square = (x**2).sum(1) if at is None else np.bincount(row, x**2, n)
        self.opens = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if at is not None and len(row) else np.empty(0, np.int64)

    @classmethod
    def of(cls, column: pa.Array, width: int) -> _Samples:
        if not pa.types.is_struct(column.type):
            return cls(len(column), width, column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1))
        lists, values = (pa.compute.struct_field(column, k) for k in (0, 1))
        size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
        return cls(len(column), width, values.flatten().to_numpy(zero_copy_only=False).astype(float), np.repeat(np.arange(len(column)), size), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))

    def one(self, i: int) -> np.ndarray:
        """One sample as a dense row."""
        if self.at is None:
            return self.x[i]
        out, mine = np.zeros(self.width), slice(*np.searchsorted(self.row, [i, i + 1]))
        out[self.at[mine]] = self.x[mine]
        return out

    def distances(self, centers: np.ndarray) -> np.ndarray:
        """Squared distances (samples, centers)."""
        if self.at is None:
            dot = self.x @ centers.T
        else:
            dot = np.zeros((self.n, len(centers)))
            if len(self.opens):
                dot[self.row[self.opens]] = np.add.reduceat(self.x[:, None] * centers.T[self.at], self.opens, axis=0)
        return np.maximum(self.square[:, None] - 2 * dot + (centers**2).sum(1)[None], 0.0)

    def sums(self, label: np.ndarray, k: int) -> np.ndarray:
        """The sum of the samples of each label."""
        if self.at is None:
            return np.eye(k)[label].T @ self.x
        return np.bincount(label[self.row] * self.width + self.at, self.x, k * self.width).reshape(k, self.width)


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, SLICE // max(1, width))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _starts(data: DataFrame, width: int, k: int, n_init: int, seed: int) -> tuple[np.ndarray, float]:
    """(starts, k, width) centers and the features' mean variance: far points of a bounded sample are likelier starts; the sample is drawn by hash."""
    most = max(k, min(SEEDS, SEED_BYTES // (8 * max(1, width))))
    some = data.orderBy(F.xxhash64(F.col("sample").cast("string"), F.lit(seed)), "sample").limit(most).select("features").toArrow()
    x = _Samples.of(some.column("features").combine_chunks(), width)
    mean = x.sums(np.zeros(x.n, np.int64), 1)[0] / x.n
    return np.stack([_far_points(x, k, np.random.default_rng(seed + s)) for s in range(n_init)]), float(x.distances(mean[None]).mean() / max(1, width))


def _far_points(x: _Samples, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the samples, far ones likelier."""
    centers = [x.one(rng.integers(x.n))]
    far = x.distances(centers[0][None])[:, 0]
    while len(centers) < k:
        centers.append(x.one(rng.choice(x.n, p=far / far.sum()) if far.sum() else rng.integers(x.n)))
        far = np.minimum(far, x.distances(centers[-1][None])[:, 0])
    return np.stack(centers)


def _sums(data: DataFrame, centers: np.ndarray, tasks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, sums, inertias) of every start's clusters, in one pass over the samples."""
    starts, k, width = centers.shape
    shared = data.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = shared.value
        counts, sums, inertia = np.zeros((starts, k)), np.zeros((starts, k, width)), np.zeros(starts)
        seen = False
        for batch in _pieces(batches, width):
            x, seen = _Samples.of(batch.column("features"), width), True
            far = x.distances(centers.reshape(-1, width)).reshape(x.n, starts, k)
            label = far.argmin(2)
            inertia += far.min(2).sum(0)
            for s in range(starts):
                counts[s] += np.bincount(label[:, s], minlength=k)
                sums[s] += x.sums(label[:, s], k)
        for s in range(starts if seen else 0):
            for c in range(k):
                for block, at in enumerate(range(0, max(1, width), FEATURES)):
                    part = sums[s, c, at : at + FEATURES]
                    yield pa.RecordBatch.from_pylist([{"start": s, "center": c, "block": block, "n": counts[s, c], "inertia": inertia[s], "sums": part.tobytes()}], _PARTIAL)

    kind = "start int, center int, block int, n double, inertia double, sums binary"
    partial = data.select("features").mapInArrow(run, kind)
    counts, sums, inertia = np.zeros((starts, k)), np.zeros((starts, k, width)), np.zeros(starts)
    if 8 * starts * k * width * tasks <= DRIVER_SUMS:
        for r in partial.toArrow().to_pylist():
            at = r["block"] * FEATURES
            counts[r["start"], r["center"]] += r["n"] if not at else 0
            inertia[r["start"]] += r["inertia"] if not at and not r["center"] else 0
            sums[r["start"], r["center"], at : at + FEATURES] += np.frombuffer(r["sums"])
        return counts, sums, inertia

    def add(table: pa.Table) -> pa.Table:
        """The partial sums of all tasks, one row a task."""
        parts = np.sum([np.frombuffer(x.as_buffer()) for x in table.column("sums")], axis=0)
        row = {c: table.column(c)[0].as_py() for c in ("start", "center", "block")}
        return pa.Table.from_pylist([row | {"n": pa.compute.sum(table.column("n")).as_py(), "inertia": pa.compute.sum(table.column("inertia")).as_py(), "sums": parts.tobytes()}], _PARTIAL)

    for r in partial.groupBy("start", "center", "block").applyInArrow(add, kind).toArrow().to_pylist():
        at = r["block"] * FEATURES
        counts[r["start"], r["center"]], inertia[r["start"]] = r["n"], r["inertia"]
        sums[r["start"], r["center"], at : at + FEATURES] = np.frombuffer(r["sums"])
    return counts, sums, inertia


_PARTIAL = pa.schema([("start", pa.int32()), ("center", pa.int32()), ("block", pa.int32()), ("n", pa.float64()), ("inertia", pa.float64()), ("sums", pa.binary())])


def kmeans(samples: DataFrame, sample_col: str = "sample", vector_col: str = "features", n_clusters: int = 2, n_init: int = 100, max_iter: int = 300, random_state: int = 0, width: int | None = None, tol: float = 1e-4) -> tuple[DataFrame, DataFrame, float]:
    """Labels (sample, label), centers (label, center) and inertia of the best of ``n_init`` runs over all samples (sample, vector).

    A vector is an array, or (indices, values) of what isn't 0, then of ``width`` features. All
    runs go on side by side: an iteration is one pass over the samples with all
    centers of the runs that haven't settled (n_init x n_clusters x features numbers, broadcast and
    returned as sums). A run has settled when its centers move by no more than ``tol`` of the features' mean variance (squared distance),
    or not at all. Starts are drawn from at most ``SEEDS`` samples. Labels count from
    0 in the order of the centers' norms. An empty cluster keeps its center; samples without a vector are left out; no
    samples give no labels and no centers.
    """
    vector = F.col(vector_col)
    sparse = isinstance(samples.schema[vector_col].dataType, T.StructType)
    typed = F.struct(vector["indices"].cast("array<int>").alias("indices"), vector["values"].cast("array<double>").alias("values")) if sparse else vector.cast("array<double>")
    data = kept(samples.where(vector.isNotNull()).select(F.col(sample_col).alias("sample"), typed.alias("features")))
    spark, kind = samples.sparkSession, samples.schema[sample_col].dataType
    if not sparse:
        width = data.agg(F.max(F.size("features"))).first()[0]
    elif width is None:
        raise ValueError("sparse vectors need their width")
    if not data.head(1):
        return data.select("sample", F.lit(0).alias("label")).limit(0), spark.createDataFrame([], "label int, center array<double>"), 0.0
    centers, spread = _starts(data, width, n_clusters, n_init, random_state)
    inertia, live, tasks = np.full(n_init, np.inf), np.arange(n_init), data.rdd.getNumPartitions()
    for k in range(max_iter):
        counts, sums, inertia[live] = _sums(data, centers[live], tasks)
        moved = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1)[:, :, None], centers[live])
        still = np.isclose(moved, centers[live], rtol=1e-12, atol=1e-12).all(axis=(1, 2)) | (((moved - centers[live]) ** 2).sum(axis=(1, 2)) <= tol * spread)
        if k == max_iter - 1 or still.all():
            break  # the inertias are those of the centers as they are
        centers[live[~still]] = moved[~still]
        live = live[~still]
    best = int(np.argmin(inertia))
    chosen = centers[best][np.argsort(np.linalg.norm(centers[best], axis=1), kind="stable")]
    shared = spark.sparkContext.broadcast(chosen)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, width):
            near = _Samples.of(batch.column("features"), width).distances(shared.value).argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("sample"), pa.array(near.astype(np.int32))], names=["sample", "label"])

    labels = data.mapInArrow(label, T.StructType([T.StructField("sample", kind), T.StructField("label", T.IntegerType())]))
    table = spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(chosen)], "label int, center array<double>")
    return labels, table, float(inertia[best])


def _lloyd(x: _Samples, k: int, rng: np.random.Generator, max_iter: int) -> tuple[np.ndarray, float]:
    centers, labels = _far_points(x, k, rng), None
    for _ in range(max_iter):
        far = x.distances(centers)
        now = far.argmin(1)
        if labels is not None and (now == labels).all():
            break
        labels = now
        count = np.bincount(labels, minlength=k)[:, None]
        centers = np.where(count > 0, x.sums(labels, k) / np.maximum(count, 1), centers)
    order = np.argsort(np.argsort(np.linalg.norm(centers, axis=1), kind="stable"))
    return order[labels], float(far.min(1).sum())


def kmeans_by_key(cells: DataFrame, keys: Sequence[str], n_clusters: int = 2, n_init: int = 100, max_iter: int = 300, seed: int = 0) -> DataFrame:
    """(keys, t, state, inertia): states from 1 of each key's samples (keys, sample, feature, value), absent features 0; a task holds the cells that are there, and centers."""
    keys = list(keys)
    schema = T.StructType([*(cells.schema[k] for k in keys), T.StructField("t", T.LongType()), T.StructField("state", T.IntegerType()), T.StructField("inertia", T.DoubleType())])

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        t, at = np.unique(rows["sample"], return_inverse=True)
        f, to = np.unique(rows["feature"], return_inverse=True)
        by = np.lexsort((to, at))
        x = _Samples(len(t), len(f), rows["value"].to_numpy(float)[by], at[by], to[by])
        rng = np.random.default_rng(seed)
        labels, inertia = min((_lloyd(x, min(n_clusters, len(t)), rng, max_iter) for _ in range(n_init)), key=lambda r: r[1])
        return pd.DataFrame({**dict(zip(keys, key)), "t": t, "state": labels + 1, "inertia": inertia})[schema.names]

    return cells.groupBy(*keys).applyInPandas(one, schema)
