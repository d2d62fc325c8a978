"""Node metrics on signed weight matrices (keys, i, j, wt) with modules (keys, node, c)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

QTYPES = ("sta", "pos", "smp", "gja", "neg")


def participation(weights: DataFrame, modules: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node, p_pos, p_neg): 1 - sum over modules of the squared share of a node's links there; 0 without links of the sign."""
    of = modules.select(*keys, F.col("node").alias("j"), "c")
    per = (
        weights.join(of, [*keys, "j"])
        .groupBy(*keys, F.col("i").alias("node"), "c")
        .agg(F.sum(F.when(F.col("wt") > 0, F.col("wt")).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("wt") < 0, -F.col("wt")).otherwise(0.0)).alias("neg"))
    )
    share = lambda c: F.coalesce(1 - F.try_divide(F.sum(F.col(c) * F.col(c)), F.nullif(F.sum(c) * F.sum(c), F.lit(0.0))), F.lit(0.0))
    return per.groupBy(*keys, "node").agg(share("pos").alias("p_pos"), share("neg").alias("p_neg"))


def module_z(weights: DataFrame, modules: DataFrame, keys: Sequence[str] = (), flag: int = 0, ddof: int = 1) -> DataFrame:
    """(keys, node, z): the within-module degree, standardised in its module; 0 where all are equal.

    flag 0 or 1 takes row sums, 2 column sums, 3 both.
    """
    if flag not in (0, 1, 2, 3):
        raise ValueError("flag must be 0, 1, 2 or 3")
    flip = weights.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "wt")
    links = weights.select(*keys, "i", "j", "wt") if flag < 2 else flip if flag == 2 else weights.select(*keys, "i", "j", "wt").union(flip)
    mine = modules.select(*keys, F.col("node").alias("i"), F.col("c"))
    other = modules.select(*keys, F.col("node").alias("j"), F.col("c").alias("cj"))
    inside = links.join(other, [*keys, "j"]).groupBy(*keys, "i", "cj").agg(F.sum("wt").alias("k"))
    degree = mine.join(inside.withColumnRenamed("cj", "c"), [*keys, "i", "c"], "left").select(*keys, F.col("i").alias("node"), "c", F.coalesce("k", F.lit(0.0)).alias("k"))
    over = W.partitionBy(*keys, "c")
    sd = F.stddev_samp("k").over(over) if ddof else F.stddev_pop("k").over(over)
    z = F.coalesce(F.try_divide(F.col("k") - F.avg("k").over(over), F.nullif(sd, F.lit(0.0))), F.lit(0.0))
    return degree.select(*keys, "node", z.alias("z"))


def modularity(weights: DataFrame, modules: DataFrame, keys: Sequence[str] = (), qtype: str = "sta") -> DataFrame:
    """(keys, q) of given modules on an undirected signed matrix with both triangles."""
    if qtype not in QTYPES:
        raise ValueError(f"qtype must be one of {QTYPES}")
    pos, neg = F.greatest(F.col("wt"), F.lit(0.0)), F.greatest(-F.col("wt"), F.lit(0.0))
    a = modules.select(*keys, F.col("node").alias("i"), F.col("c").alias("ci"))
    b = modules.select(*keys, F.col("node").alias("j"), F.col("c").alias("cj"))
    links = weights.join(a, [*keys, "i"]).join(b, [*keys, "j"])
    per = links.groupBy(*keys, "ci", F.col("cj")).agg(F.sum(pos).alias("p"), F.sum(neg).alias("n"))
    # sums over pairs of one module need its own links and its nodes' total strength
    strength = per.groupBy(*keys, "ci").agg(F.sum("p").alias("kp"), F.sum("n").alias("kn"), F.sum(F.when(F.col("ci") == F.col("cj"), F.col("p")).otherwise(0.0)).alias("wp"), F.sum(F.when(F.col("ci") == F.col("cj"), F.col("n")).otherwise(0.0)).alias("wn"))
    whole = strength.groupBy(*keys).agg(F.sum("kp").alias("s0"), F.sum("kn").alias("s1"), F.sum("wp").alias("wp"), F.sum("wn").alias("wn"), F.sum(F.col("kp") * F.col("kp")).alias("kkp"), F.sum(F.col("kn") * F.col("kn")).alias("kkn"))
    inv = lambda c: F.coalesce(F.try_divide(F.lit(1.0), c), F.lit(0.0))
    s0, s1 = F.col("s0"), F.col("s1")
    d0 = {"sta": inv(s0), "pos": inv(s0), "smp": inv(s0), "gja": inv(s0 + s1), "neg": F.lit(0.0)}[qtype]
    d1 = {"sta": inv(s0 + s1), "pos": F.lit(0.0), "smp": inv(s1), "gja": inv(s0 + s1), "neg": inv(s1)}[qtype]
    return whole.select(*keys, (d0 * (F.col("wp") - F.col("kkp") * inv(s0)) - d1 * (F.col("wn") - F.col("kkn") * inv(s1))).alias("q"))


def cartography(nodes: DataFrame, keys: Sequence[str] = (), bins: int = 101) -> DataFrame:
    """(keys, t, yb, xb, n): nodes (keys, t, node, bt, wt) counted by participation (0 to 1) and by z (5 down to -5); values outside go to the border."""
    top = bins - 1
    clamp = lambda x: F.least(F.greatest(F.round(x).cast("int"), F.lit(0)), F.lit(top))
    xb, yb = clamp(F.col("bt") * top), clamp((5 - F.col("wt")) * (top / 10))
    return nodes.groupBy(*keys, "t", yb.alias("yb"), xb.alias("xb")).agg(F.count("*").alias("n"))


def profile_vectors(nodes: DataFrame, keys: Sequence[str] = (), bins: int = 101) -> DataFrame:
    """(keys, t, cells, counts): each time's profile as the sorted numbers (``yb * bins + xb``) and counts of its filled cells.

    Counts per cell add up in every task before the exchange; what meets for a time is a row per filled cell, ``bins`` squared at most.
    """
    per = cartography(nodes, keys, bins).groupBy(*keys, "t").agg(F.sort_array(F.collect_list(F.struct((F.col("yb") * bins + F.col("xb")).alias("cell"), "n"))).alias("_f"))
    return per.select(*keys, "t", F.col("_f.cell").alias("cells"), F.col("_f.n").alias("counts"))


def densify(profile: DataFrame, keys: Sequence[str] = (), bins: int = 101) -> DataFrame:
    """(keys, t, values): the counts of all cells of ``profile_vectors`` as one array, row by row; a projection, without a join."""
    ends = F.concat(F.slice("cells", F.lit(2), F.size("cells")), F.array(F.lit(bins * bins)))
    zeros = lambda n: F.array_repeat(F.lit(0).cast("bigint"), n)
    runs = F.zip_with(F.arrays_zip(F.col("cells").alias("c"), F.col("counts").alias("n")), ends, lambda a, end: F.concat(F.array(a["n"].cast("bigint")), zeros(end - a["c"] - 1)))
    return profile.select(*keys, "t", F.concat(zeros(F.element_at("cells", 1)), F.flatten(runs)).alias("values"))


def flatten_profile(profile: DataFrame, keys: Sequence[str] = (), bins: int = 101) -> DataFrame:
    """(keys, sample, feature, value): each time a sample, each cell a feature."""
    return profile.select(*keys, F.col("t").alias("sample"), (F.col("yb") * bins + F.col("xb")).alias("feature"), F.col("n").cast("double").alias("value"))


def switches(states: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("t",)) -> DataFrame:
    """(keys, order, flag, switched) of states (keys, t, state): flag is the sum with the state before, 3 where states 1 and 2 meet."""
    over = W.partitionBy(*keys).orderBy(*order)
    before = F.lag("state").over(over)
    return states.select(*keys, *order, (F.col("state") + before).alias("flag"), (F.col("state") != before).alias("switched")).where("flag is not null")


def switch_count(states: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("t",)) -> DataFrame:
    """(keys, switch_count); a key with a single state counts 0."""
    over = W.partitionBy(*keys).orderBy(*order)
    moved = F.col("state") != F.lag("state").over(over)
    return states.select(*keys, moved.alias("m")).groupBy(*keys).agg(F.count(F.when(F.col("m"), 1)).alias("switch_count"))
