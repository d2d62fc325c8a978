"""Communities of graphs of any size: Louvain by rounds over edge tables, and consensus by a loop over it.

A graph is an edge table (keys, i, j, wt) with either or both triangles; many graphs, told apart by
keys, are worked on at once. A round moves nodes side by side: the links of each node to the
modules next to it are one aggregation over the edges, and modules' totals come by a join, so the
modularity matrix is never made. Moves that depend on each other would undo each other's
gain, so a round moves only one of ``PARITIES`` hashed shares of the nodes, another one
each time. When no share moves, modules become the nodes of the next level. What a round
leaves is written to the shared folder, and what the round before left is removed, so no plan grows with the rounds.
Graphs of at most ``GRAPH_LINKS`` links, told apart by keys, are dealt to tasks whole, and go through the same rounds there:
the result is the same, but links are exchanged once and not in every round.
Keys and nodes have no nulls.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators import community
from weftline.operators.metrics import QTYPES, modularity
from weftline.sources.tables import kept, tasks_for

PARITIES = 3
#: Links of a graph that a task takes whole (some 20 MB).
GRAPH_LINKS = 200_000


def symmetric(edges: DataFrame, keys: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
    """Both triangles without the diagonal, each pair once; a pair that is listed twice counts once, by its first triangle if they differ. Made in so many tasks, where given."""
    pairs = edges.where("i <> j").select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "wt", (F.col("i") > F.col("j")).alias("_up"))
    first = F.coalesce(F.min(F.when(~F.col("_up"), F.col("wt"))), F.min(F.when(F.col("_up"), F.col("wt"))))  # no structs, which aggregates sort for
    dealt = pairs.repartition(tasks, *keys, "i", "j") if tasks else pairs
    one = dealt.groupBy(*keys, "i", "j").agg(first.alias("wt"))
    both = F.explode(F.array(F.struct("i", "j", "wt"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "wt"))).alias("_e")
    return one.select(*keys, both).select(*keys, "_e.i", "_e.j", "_e.wt")


def _scale(qtype: str, s0: Column, s1: Column) -> tuple[Column, Column]:
    inv = lambda c: F.coalesce(F.try_divide(F.lit(1.0), c), F.lit(0.0))
    zero = F.lit(0.0)
    return {"sta": (inv(s0), inv(s0 + s1)), "pos": (inv(s0), zero), "smp": (inv(s0), inv(s1)), "gja": (inv(s0 + s1), inv(s0 + s1)), "neg": (zero, inv(s1))}[qtype]


def _with_scale(strength: DataFrame, keys: list[str], qtype: str) -> DataFrame:
    """(keys, s0, s1, d0, d1): a graph's total weights of both signs, and what they are divided by."""
    whole = strength.groupBy(*keys).agg(F.sum("kp").alias("s0"), F.sum("kn").alias("s1"))
    d0, d1 = _scale(qtype, F.col("s0"), F.col("s1"))
    return whole.select(*keys, "s0", "s1", d0.alias("d0"), d1.alias("d1"))


def _join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b, keys) if keys else a.crossJoin(F.broadcast(b))  # without keys b is one row


def _round(links: DataFrame, nodes: DataFrame, keys: list[str], chance: list[str], sweep: int, share: int) -> DataFrame:
    """The nodes after those of one share have moved to the module next to them with the greatest gain.

    Links (keys, i, j, wt, kp, kn) have the strengths of i, nodes (keys, node, c, kp, kn, s0, s1, d0, d1) the figures of
    their graph, so a round joins links with the modules of their ends, modules with their totals, and nodes with their moves.
    """
    luck = [F.xxhash64(*chance)] if chance else []
    dealt = lambda c: F.pmod(F.xxhash64(c, *luck, F.lit(sweep).cast("long")), F.lit(PARITIES)) == share
    tie = F.xxhash64("_to", *luck, F.lit(sweep).cast("long")) if chance else -F.col("_to")
    whole = ("s0", "s1", "d0", "d1")
    module = nodes.groupBy(*keys, F.col("c").alias("_to")).agg(F.sum("kp").alias("_mp"), F.sum("kn").alias("_mn"), *(F.first(c).alias(c) for c in whole))
    own = [*keys, "node", "_to", "kp", "kn"]
    beside = links.where(dealt("i")).withColumnRenamed("i", "node").join(nodes.select(*keys, F.col("node").alias("j"), F.col("c").alias("_to")), [*keys, "j"])
    beside = beside.select(*own, F.greatest("wt", F.lit(0.0)).alias("_p"), F.greatest(-F.col("wt"), F.lit(0.0)).alias("_n"), F.lit(False).alias("_here"))
    # a node may stay where it has no links
    stay = nodes.where(dealt("node")).withColumnRenamed("c", "_to").select(*own, F.lit(0.0).alias("_p"), F.lit(0.0).alias("_n"), F.lit(True).alias("_here"))
    to = beside.unionByName(stay).groupBy(*keys, "node", "_to").agg(F.sum("_p").alias("_p"), F.sum("_n").alias("_n"), F.first("kp").alias("kp"), F.first("kn").alias("kn"), F.bool_or("_here").alias("_here"))
    full = to.join(module, [*keys, "_to"])
    inv = lambda c: F.coalesce(F.try_divide(F.lit(1.0), F.col(c)), F.lit(0.0))
    rest = lambda total, k: F.col(total) - F.when(F.col("_here"), F.col(k)).otherwise(0.0)
    gain = F.col("d0") * (F.col("_p") - F.col("kp") * rest("_mp", "kp") * inv("s0")) - F.col("d1") * (F.col("_n") - F.col("kn") * rest("_mn", "kn") * inv("s1"))
    # sums of other orders differ in their last digits, which mustn't decide ties
    even = F.round(gain / F.greatest("d0", "d1"), 9)
    found = full.select(*keys, "node", "_to", even.alias("_gain"), "_here", tie.alias("_tie"))
    best = found.groupBy(*keys, "node").agg(F.max_by("_to", F.struct("_gain", "_tie")).alias("_best"), F.max("_gain").alias("_most"), F.max(F.when(F.col("_here"), F.col("_gain"))).alias("_now"))
    moved = best.where("_most > _now").select(*keys, "node", "_best")
    return nodes.drop("moved").join(moved, [*keys, "node"], "left").select(*keys, "node", F.coalesce("_best", "c").alias("c"), "kp", "kn", *whole, F.col("_best").isNotNull().alias("moved"))


def _strength(links: DataFrame, keys: list[str]) -> DataFrame:
    return links.groupBy(*keys, F.col("i").alias("node")).agg(F.sum(F.greatest("wt", F.lit(0.0))).alias("kp"), F.sum(F.greatest(-F.col("wt"), F.lit(0.0))).alias("kn"))


def xxhash64(*columns: np.ndarray | int) -> np.ndarray:
    """Spark's hash of long columns, so that a graph has the same turns and ties in a task as in joins."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = np.full(1, 42, np.uint64)
    for c in columns:
        x = np.atleast_1d(np.asarray(c, np.int64)).view(np.uint64)
        h = turn((h + p5 + np.uint64(8)) ^ (turn(x * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


def rounds_of_one(i: np.ndarray, j: np.ndarray, wt: np.ndarray, luck: Sequence[int], qtype: str, most_sweeps: int, most_levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and modules of one graph by the rounds of ``_round``, all links in arrays."""
    off = i != j
    name, at = np.unique(np.concatenate([i[off], j[off]]), return_inverse=True)
    n, (a, b) = len(name), at.reshape(2, -1)
    cell = np.minimum(a, b) * n + np.maximum(a, b)
    by = np.lexsort((wt[off], a > b, cell))  # a pair's first triangle, as in ``symmetric``
    cell, w = cell[by], wt[off][by]
    first = np.diff(cell, prepend=-1) != 0
    (a, b), w = np.divmod(cell[first], max(n, 1)), np.tile(w[first], 2)
    src, dst, pos, neg = np.concatenate([a, b]), np.concatenate([b, a]), np.maximum(w, 0), np.maximum(-w, 0)
    nodes, named, kp, kn = name, np.arange(n), np.bincount(src, pos, n), np.bincount(src, neg, n)
    s0, s1 = kp.sum(), kn.sum()
    d0, d1 = community.scales(s0, s1, qtype)
    scale = max(d0, d1) or 1.0
    inv0, inv1 = 1 / s0 if s0 else 0.0, 1 / s1 if s1 else 0.0
    for _ in range(most_levels):
        m = len(name)
        c, moves = np.arange(m), 0
        for sweep in range(most_sweeps):
            turn, luckier, now = np.mod(xxhash64(name, *luck, sweep), PARITIES), xxhash64(name, *luck, sweep) if luck else -name, 0
            for share in range(PARITIES):
                mine = np.flatnonzero(turn == share)
                out = np.flatnonzero(turn[src] == share)
                cell, of = np.unique(np.concatenate([mine * m + c[mine], src[out] * m + c[dst[out]]]), return_inverse=True)
                node, to = np.divmod(cell, max(m, 1))
                here = np.zeros(len(cell), bool)
                here[of[: len(mine)]] = True
                p, q = (np.bincount(of[len(mine) :], x[out], len(cell)) for x in (pos, neg))
                mp, mn = (np.bincount(c, k, m)[to] - np.where(here, k[node], 0.0) for k in (kp, kn))
                gain = np.round((d0 * (p - kp[node] * mp * inv0) - d1 * (q - kn[node] * mn * inv1)) / scale, 9)
                by = np.lexsort((luckier[to], gain, node))
                best = by[np.diff(node[by], append=-1) != 0]
                moved = best[gain[best] > gain[here]]  # one cell a node in either, in the order of nodes
                c[node[moved]] = to[moved]
                now += len(moved)
            moves += now
            if not now:
                break
        if not moves:
            break
        low = np.full(m, m)
        np.minimum.at(low, c, np.arange(m))  # names ascend, so the first node of a module is its name
        left, new = np.unique(low[c], return_inverse=True)
        name, named, kp, kn = name[left], new[named], np.bincount(new, kp), np.bincount(new, kn)
        src, dst = new[src], new[dst]
        out = src != dst
        src, dst, pos, neg = src[out], dst[out], pos[out], neg[out]
    return nodes, name[named]


def _in_tasks(links: DataFrame, keys: list[str], qtype: str, chance: list[str], most_sweeps: int, most_levels: int, tasks: int) -> DataFrame:
    """(keys, node, c) of graphs that each go to one task, which has many."""

    def one(rows: pa.Table) -> pa.Table:
        i, j, wt = (rows.column(x).to_numpy() for x in ("i", "j", "wt"))
        node, c = rounds_of_one(i, j, wt, [rows.column("_luck")[0].as_py()] if chance else [], qtype, most_sweeps, most_levels)
        key = rows.select(keys).take(pa.array(np.zeros(len(node), np.int64)))
        return key.append_column("node", pa.array(node, pa.int64())).append_column("c", pa.array(c, pa.int64()))

    schema = T.StructType([*(links.schema[k] for k in keys), T.StructField("node", T.LongType()), T.StructField("c", T.LongType())])
    return links.select(*keys, "i", "j", "wt", *([F.xxhash64(*chance).alias("_luck")] if chance else [])).repartition(tasks, *keys).groupBy(*keys).applyInArrow(one, schema)


def louvain(edges: DataFrame, keys: Sequence[str] = (), qtype: str = "sta", chance: Sequence[str] = (), most_sweeps: int = 20, most_levels: int = 12) -> DataFrame:
    """(keys, node, c) of every node with a link: modules of signed graphs, named by their smallest node.

    Takes edges as ``symmetric`` does; null weights and weights of 0 are no links, self-links are left
    out. Nodes are whole numbers; gains are compared to nine digits of their scale. The result depends on the
    graph alone, and on the values of the keys in ``chance``, which decide ties and whose turn it is, but not on how
    rows are dealt. ``most_sweeps`` bounds the sweeps of a level, where moves would go on in circles.
    """
    if qtype not in QTYPES:
        raise ValueError(f"qtype must be one of {QTYPES}")
    keys, chance = list(keys), list(chance)
    raw = kept(edges.where("wt <> 0").select(*keys, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("wt").cast("double").alias("wt")))
    rows = raw.count()  # counted, so that no task has more of them as the input grows
    whole, large = None, raw
    if keys:
        size = kept(raw.groupBy(*keys).agg(F.count("*").alias("_n")))
        most = size.agg(F.max("_n")).first()[0] or 0
        of = lambda some: raw if (most <= GRAPH_LINKS) else raw.join(size.where(some).select(*keys), keys, "left_semi")
        tasks = max(tasks_for(rows), int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        whole = kept(_in_tasks(of(F.col("_n") <= GRAPH_LINKS), keys, qtype, chance, most_sweeps, most_levels, tasks))
        if most <= GRAPH_LINKS:
            return whole
        large = kept(of(F.col("_n") > GRAPH_LINKS), raw)
    links = kept(symmetric(large, keys, tasks_for(rows)), large)
    strength = kept(_strength(links, keys))
    totals = kept(_with_scale(strength, keys, qtype))
    named = kept(strength.select(*keys, "node", F.col("node").alias("c")))  # of the first level's nodes
    for _ in range(most_levels):
        nodes, moves = kept(_join(strength.select(*keys, "node", F.col("node").alias("c"), "kp", "kn"), totals, keys)), 0
        weighted = kept(links.join(strength.withColumnRenamed("node", "i"), [*keys, "i"]))
        for sweep in range(most_sweeps):
            now = 0
            for share in range(PARITIES):
                seen = Observation()
                nodes = kept(_round(weighted, nodes, keys, chance, sweep, share).observe(seen, F.count_if("moved").alias("moves")), nodes)
                now += seen.get["moves"]
            moves += now
            if not now:
                break
        if not moves:
            break
        # modules are named by their smallest node, which then stands for them
        names = nodes.groupBy(*keys, "c").agg(F.min("node").alias("name"))
        to = kept(nodes.select(*keys, "node", "c").join(names, [*keys, "c"]).select(*keys, "node", "name"))
        named = kept(named.join(to.select(*keys, F.col("node").alias("c"), "name"), [*keys, "c"]).select(*keys, "node", F.col("name").alias("c")), named)
        a, b = to.select(*keys, F.col("node").alias("i"), F.col("name").alias("a")), to.select(*keys, F.col("node").alias("j"), F.col("name").alias("b"))
        # links inside a module are in no gain of a later level; the strengths have them
        between = links.join(a, [*keys, "i"]).join(b, [*keys, "j"]).where("a <> b").groupBy(*keys, F.col("a").alias("i"), F.col("b").alias("j"), (F.col("wt") > 0).alias("up"))
        links = kept(between.agg(F.sum("wt").alias("wt")).drop("up"), links)
        strength = kept(strength.join(to, [*keys, "node"]).groupBy(*keys, F.col("name").alias("node")).agg(F.sum("kp").alias("kp"), F.sum("kn").alias("kn")), strength)
    return named if whole is None else named.unionByName(whole)


def best_louvain(edges: DataFrame, keys: Sequence[str] = (), qtype: str = "sta", runs: int = 5) -> DataFrame:
    """(keys, node, c, q): of several runs, all graphs of one job, the modules with the greatest modularity q."""
    keys = list(keys)
    each = kept(symmetric(edges.where("wt <> 0"), keys).withColumn("_run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))))
    found = louvain(each, [*keys, "_run"], qtype, ["_run"])
    q = modularity(each, found, [*keys, "_run"], qtype)
    best = q.groupBy(*keys).agg(F.max_by("_run", F.struct("q", -F.col("_run"))).alias("_run"), F.max("q").alias("q")).where("_run is not null")
    joined = found.join(best, [*keys, "_run"])
    return joined.select(*keys, "node", "c", "q")


def numbered(labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node, c) with labels from 1 in the order of modules' names; modules are numbered, not nodes."""
    order = labels.select(*keys, "c").distinct().withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy("c")))
    return labels.join(order, [*keys, "c"]).select(*keys, "node", F.col("n").cast("int").alias("c"))


def consensus(agreed: DataFrame, keys: Sequence[str] = (), tau: float = 0.1, reps: int = 500, rounds: int = 20) -> DataFrame:
    """(keys, node, p, c): the partitions left after consensus clustering of agreement (keys, i, j, value), labels from 1.

    The agreement is a list of the pairs from ``tau`` on. Each round clusters every graph ``reps`` times, as
    so many graphs at once, and tells by a fingerprint of the partitions which keys have settled on one;
    only the others go on, with the agreement of their partitions. A key that hasn't settled after ``rounds`` has
    its different partitions, numbered by p from 0. Nodes without a pair are modules of their own.
    """
    keys = list(keys)
    agreed = kept(agreed.select(*keys, "i", "j", "value"))  # read twice
    nodes = kept(agreed.select(*keys, F.explode(F.array(F.col("i").cast("long"), F.col("j").cast("long"))).alias("node")).distinct())
    pairs, done = kept(agreed.where((F.col("value") >= tau) & (F.col("value") > 0) & (F.col("i") != F.col("j"))).select(*keys, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("value").alias("wt"))), []
    bare = nodes.join(pairs.select(*keys).distinct(), keys, "left_anti") if keys else nodes.limit(0) if pairs.head(1) else nodes
    done.append(kept(bare.select(*keys, "node", F.lit(0).alias("p"), F.col("node").alias("c"))))
    for k in range(rounds):
        if not pairs.head(1):
            break
        many = pairs.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
        found = louvain(many, [*keys, "_rep"], "pos", ["_rep"]).withColumnRenamed("_rep", "p")
        prints = found.groupBy(*keys, "p").agg(F.bit_xor(F.xxhash64("node", "c")).alias("x"), F.sum(F.pmod(F.xxhash64("c", "node"), F.lit(1 << 40))).alias("y"))
        kinds = kept(prints.groupBy(*keys, "x", "y").agg(F.min("p").alias("p")))  # one repetition of each kind of partition
        several = kinds.groupBy(*keys).agg(F.count("*").alias("n"))
        ends = several.where("n = 1") if k < rounds - 1 else several
        last = kinds.join(ends.select(*keys), keys, "left_semi") if keys else kinds.where(F.lit(True)) if ends.head(1) else kinds.limit(0)
        live = nodes.join(pairs.select(*keys).distinct(), keys, "left_semi") if keys else nodes
        out = _join(live, last.select(*keys, "p"), keys) if keys else live.crossJoin(F.broadcast(last.select("p")))  # at most ``reps`` rows
        done.append(kept(out.join(found, [*keys, "p", "node"], "left").select(*keys, "node", "p", F.coalesce("c", "node").alias("c"))))
        on = several.where("n > 1").select(*keys)
        if k == rounds - 1 or not on.head(1):
            break
        again = found.join(on, keys, "left_semi") if keys else found
        a, b = again.withColumnRenamed("node", "i"), again.withColumnRenamed("node", "j")
        share = a.join(b, [*keys, "p", "c"]).where("i < j").groupBy(*keys, "i", "j").agg((F.count("*") / reps).alias("wt"))
        pairs = kept(share.where(F.col("wt") >= tau), pairs)
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    order = every.select(*keys, "p").distinct().withColumn("_p", F.row_number().over(W.partitionBy(*keys).orderBy("p")) - 1)
    labels = numbered(every, [*keys, "p"])
    return labels.join(order, [*keys, "p"]).select(*keys, "node", F.col("_p").cast("int").alias("p"), "c")


def window_communities(weights: DataFrame, keys: Sequence[str], tau: float = 0.1, runs: int = 500, reps: int = 500, qtype: str = "sta") -> DataFrame:
    """(keys, node, c): as ``community.window_communities``, for matrices beyond one worker: all runs of all matrices are graphs of one job, and so are the repetitions of each round of consensus. A matrix that doesn't settle has its first partition."""
    keys = list(keys)
    many = weights.withColumn("_run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    found = louvain(many, [*keys, "_run"], qtype, ["_run"]).withColumnRenamed("_run", "p")
    agreed = kept(community.agreement(found, keys=keys))
    return consensus(agreed, keys, tau, reps).where("p = 0").select(*keys, "node", "c")
