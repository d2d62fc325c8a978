"""Communities: agreement of partitions in SQL, Louvain and consensus per matrix in one small kernel."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.sources.tables import kept, tasks_for


def agreement(partitions: DataFrame, weights: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, i, j, value): the weighted share of partitions (keys, node, p, c) in which two nodes have one label, i <= j.

    Without ``weights`` (p, wt) all count alike; the diagonal is 1. Pairs are counted first, to be dealt to so
    many tasks that the memory of one doesn't grow with the input.
    """
    if weights is None:
        share = partitions.select(*keys, "p").distinct().withColumn("wt", F.lit(1.0))
        on = [*keys, "p"]
    else:
        share, on = weights, [*(k for k in keys if k in weights.columns), "p"]
    total = share.groupBy(*[k for k in on if k != "p"]).agg(F.sum("wt").alias("total"))
    names = [k for k in on if k != "p"]
    share = share.join(total, names) if names else share.crossJoin(F.broadcast(total))  # one row
    size = partitions.groupBy(*keys, "p", "c").agg(F.count("*").cast("double").alias("n"))
    tasks, same = tasks_for(size.agg(F.sum(F.col("n") * (F.col("n") + 1) / 2)).first()[0]), [*keys, "p", "c"]
    # a join by hash, as sorting would hold all rows of a task
    named = partitions.join(share.select(*on, (F.col("wt") / F.col("total")).alias("w")).hint("shuffle_hash"), on)
    a = named.select(*keys, "p", "c", F.col("node").alias("i"), "w").repartition(tasks, *same)
    b = named.select(*keys, "p", "c", F.col("node").alias("j")).repartition(tasks, *same)
    pairs = a.join(b.hint("merge"), same).where("i <= j").select(*keys, "i", "j", "w")
    return pairs.repartition(tasks, *keys, "i", "j").groupBy(*keys, "i", "j").agg(F.sum("w").alias("value"))


def scales(pos: float, neg: float, qtype: str) -> tuple[float, float]:
    inv = lambda x: 1 / x if x else 0.0
    return {"sta": (inv(pos), inv(pos + neg)), "pos": (inv(pos), 0.0), "smp": (inv(pos), inv(neg)), "gja": (inv(pos + neg), inv(pos + neg)), "neg": (0.0, inv(neg))}[qtype]


def louvain_labels(w: np.ndarray, rng: np.random.Generator, qtype: str = "sta") -> tuple[np.ndarray, float]:
    """Labels from 0 in order of first appearance, and Q, of one symmetric signed matrix."""
    n = len(w)
    pos, neg = np.maximum(w, 0), np.maximum(-w, 0)
    s0, s1 = pos.sum(), neg.sum()
    d0, d1 = scales(s0, s1, qtype)
    b = np.zeros_like(w, dtype=float)  # the modularity matrix; Q is its sum within modules
    if s0:
        b += d0 * (pos - np.outer(pos.sum(1), pos.sum(1)) / s0)
    if s1:
        b -= d1 * (neg - np.outer(neg.sum(1), neg.sum(1)) / s1)
    labels, level = np.arange(n), b
    while True:
        m = len(level)
        own = np.arange(m)
        gain = level.copy()  # gain[i, c]: the links of i into module c
        moved = True
        while moved:
            moved = False
            for i in rng.permutation(m):
                here = own[i]
                score = gain[i].copy()
                score[here] -= level[i, i]
                best = int(np.argmax(score))
                if score[best] - score[here] > 1e-10:
                    gain[:, here] -= level[:, i]
                    gain[:, best] += level[:, i]
                    own[i], moved = best, True
        _, own = np.unique(own, return_inverse=True)
        if own.max() + 1 == m:
            break
        labels = own[labels]
        join = np.eye(own.max() + 1)[own]
        level = join.T @ level @ join
    _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
    labels = np.argsort(np.argsort(first))[inverse]
    same = labels[:, None] == labels[None, :]
    return labels, float(b[same].sum())


def _share(partitions: Iterable[np.ndarray], n: int | None = None) -> np.ndarray:
    """The share of partitions in which two nodes have one label, added up one partition at a time."""
    out, seen = None if n is None else np.zeros((n, n)), 0
    for c in partitions:
        out = np.zeros((len(c), len(c))) if out is None else out
        out += c[:, None] == c[None, :]
        seen += 1
    return out / max(seen, 1)


def consensus_labels(d: np.ndarray, rng: np.random.Generator, tau: float, reps: int, rounds: int = 20) -> np.ndarray:
    """Labels (nodes, partitions) after iterated thresholding and clustering of an agreement matrix; one column if it settles."""
    for _ in range(rounds):
        d = np.where(d >= tau, d, 0.0)
        np.fill_diagonal(d, 0.0)
        if not d.any():
            return np.arange(len(d))[:, None]
        found = np.unique(np.stack([louvain_labels(d, rng, "pos")[0] for _ in range(reps)], axis=1), axis=1)
        if found.shape[1] == 1:
            break
        d = _share(found.T)
    return found


def _matrix(rows: pd.DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    nodes = np.unique(np.concatenate([rows["i"].to_numpy(), rows["j"].to_numpy()]))
    out = np.zeros((len(nodes), len(nodes)))
    a, b = np.searchsorted(nodes, rows["i"]), np.searchsorted(nodes, rows["j"])
    out[a, b] = out[b, a] = rows[value].to_numpy()
    return nodes, out


def _seed(key: tuple, seed: int | None) -> np.random.Generator:
    if seed is None:
        return np.random.default_rng()
    import xxhash

    return np.random.default_rng(xxhash.xxh3_64_intdigest(repr((*map(str, key), seed))))


def _schema(df: DataFrame, keys: Sequence[str], *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*(df.schema[k] for k in keys), *(T.StructField(n, k) for n, k in more)])


def _by_graph(rows: DataFrame, keys: list[str]) -> GroupedData:
    """Rows by graph, which are counted to be dealt to so many tasks that none sorts more of them as the input grows."""
    if not keys:
        return rows.groupBy()
    held = kept(rows)
    tasks = max(tasks_for(held.count()), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return held.repartition(tasks, *keys).groupBy(*keys)


def louvain(weights: DataFrame, keys: Sequence[str] = (), qtype: str = "sta", seed: int | None = None, reps: int = 1) -> DataFrame:
    """(keys, p, node, c, q): labels from 1 and modularity of each repetition p, one matrix (i <= j or both triangles) per key at a time.

    With a seed the result depends on key, repetition and seed alone.
    """
    keys = list(keys)
    schema = _schema(weights, keys, ("p", T.IntegerType()), ("node", T.LongType()), ("c", T.IntegerType()), ("q", T.DoubleType()))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes, w = _matrix(rows.sort_values(["i", "j"]), "wt")
        out = []
        for p in range(reps):
            labels, q = louvain_labels(w, _seed((*key, p), seed), qtype)
            out.append(pd.DataFrame({**dict(zip(keys, key)), "p": p, "node": nodes, "c": labels + 1, "q": q}))
        return pd.concat(out)[schema.names]

    return _by_graph(weights, keys).applyInPandas(one, schema)


def consensus(agreed: DataFrame, keys: Sequence[str] = (), tau: float = 0.1, reps: int = 500, seed: int | None = None) -> DataFrame:
    """(keys, node, p, c): the unique partitions left after consensus clustering of agreement (keys, i, j, value); labels from 1."""
    keys = list(keys)
    schema = _schema(agreed, keys, ("node", T.LongType()), ("p", T.IntegerType()), ("c", T.IntegerType()))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes, d = _matrix(rows.sort_values(["i", "j"]), "value")
        found = consensus_labels(d, _seed(key, seed), tau, reps)
        parts = [pd.DataFrame({**dict(zip(keys, key)), "node": nodes, "p": p, "c": c + 1}) for p, c in enumerate(found.T)]
        return pd.concat(parts)[schema.names]

    return _by_graph(agreed, keys).applyInPandas(one, schema)


def window_communities(weights: DataFrame, keys: Sequence[str], tau: float = 0.1, runs: int = 500, reps: int = 500, qtype: str = "sta", seed: int | None = None) -> DataFrame:
    """(keys, node, c): Louvain ``runs`` times, agreement of the runs, consensus; all in one task per matrix, as runs x nodes rows needn't leave it."""
    keys = list(keys)
    schema = _schema(weights, keys, ("node", T.LongType()), ("c", T.IntegerType()))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes, w = _matrix(rows.sort_values(["i", "j"]), "wt")
        rng = _seed(key, seed)
        d = _share((louvain_labels(w, rng, qtype)[0] for _ in range(runs)), len(w))
        labels = consensus_labels(d, rng, tau, reps)[:, 0]
        return pd.DataFrame({**dict(zip(keys, key)), "node": nodes, "c": labels + 1})[schema.names]

    return _by_graph(weights, keys).applyInPandas(one, schema)
