"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut_lineage


def _local_forest(batches):
    """Links of a slice of rows as stars around their smallest node; fewer links, same components."""
    for batch in batches:
        u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
        up: dict[int, int] = {}

        def root(x: int) -> int:
            r = x
            while up.get(r, r) != r:
                r = up[r]
            while up.get(x, x) != r:
                up[x], x = r, up.get(x, x)
            return r

        for a, b in zip(u, v):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
                up.setdefault(min(a, b), min(a, b))
        pairs = [(root(x), x) for x in up]
        pairs = np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


#: Links that a task has at least, so few links make few tasks.
TASK_LINKS = 250_000


def _star(links: DataFrame, large: bool, tasks: int) -> DataFrame:
    """One star step: the neighbours of each node are linked to the smallest of them all."""
    if large:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u").coalesce(tasks)
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v")
    else:
        out = joined.select(F.col("m").alias("u"), "v").union(least.select(F.col("m").alias("u"), F.col("u").alias("v")))
    return out.where("u <> v").distinct().coalesce(tasks)


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component) of every node of the links (u, v); a component is named by its smallest node.

    Links may repeat and go either way; a link to itself makes a node alone.
    Nodes without links aren't listed. No links give no rows.
    """
    nodes = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    edges = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v")
    edges = cut_lineage(edges.distinct().mapInArrow(_local_forest, "u long, v long"))
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = state(edges)
    most = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(most_rounds):
        if not now[0]:
            break
        tasks = min(most, 8 + now[0] // TASK_LINKS)
        edges = cut_lineage(_star(_star(edges, True, tasks), False, tasks))
        was, now = now, state(edges)
        if was == now:
            break
    else:
        raise RuntimeError("the components did not settle")
    return nodes.join(edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
