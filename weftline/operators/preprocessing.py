"""From vertices to clean series of the networks of interest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BACKGROUND = 0


def drop_frames(series: DataFrame, first: int = 5, t_col: str = "t") -> DataFrame:
    """Drop the first frames of every series and count time from zero again."""
    return series.where(F.col(t_col) >= first).withColumn(t_col, F.col(t_col) - first)


def extract_roi(bold: DataFrame, atlas: DataFrame, keys: Sequence[str] = (), level: str = "roi") -> DataFrame:
    """Mean signal per parcel and time point, from ``bold`` (keys, vertex, t, value) and ``atlas`` (vertex, roi).

    An atlas that has some of the keys is joined on them too, so each subject
    can have its own. Label 0 is background and left out. With level
    ``vertex`` the values stay as they are, labelled.
    """
    on = ["vertex", *(k for k in keys if k in atlas.columns)]
    labels = atlas.where(F.col("roi") != BACKGROUND).select(*on, "roi")
    # Catalyst broadcasts the labels where their estimated size is under its threshold
    joined = bold.join(labels, on)
    if level == "vertex":
        return joined.select(*keys, "roi", "vertex", "t", "value")
    if level != "roi":
        raise ValueError(f"level must be roi or vertex, not {level!r}")
    return joined.groupBy(*keys, "roi", "t").agg(F.avg("value").alias("value"))


def select_networks(series: DataFrame, regions: DataFrame, dmn: Sequence[int] | str = "auto", ecn: Sequence[int] | str = "auto") -> DataFrame:
    """The parcels of the default-mode and executive networks, numbered from zero in that order.

    ``regions`` (roi, network) names the network of each parcel. "auto" takes
    the networks whose names begin with Default, then those with Cont.
    """
    name = F.col("network")
    by = [(name.startswith("Default") if isinstance(dmn, str) else F.col("roi").isin(list(dmn))), (name.startswith("Cont") if isinstance(ecn, str) else F.col("roi").isin(list(ecn)))]
    part = F.when(by[0], 0).when(by[1], 1)
    # parcels of an atlas are a few hundred; one window over them is no bottleneck
    chosen = regions.withColumn("part", part).where("part is not null").select("roi", (F.row_number().over(W.orderBy("part", "roi")) - 1).cast("int").alias("new"))
    return series.join(chosen, "roi").withColumn("roi", F.col("new")).drop("new")


def relabel(series: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rename parcels by ``mapping`` (roi, target); parcels without a target go."""
    return series.join(mapping.select("roi", "target"), "roi").withColumn("roi", F.col("target")).drop("target")


def tsnr(series: DataFrame, keys: Sequence[str] = (), threshold_sd: float = 2.0, feature: str = "roi") -> DataFrame:
    """(keys, feature, tsnr, keep): mean over sd in time, and whether it is within ``threshold_sd`` sds of the mean of all features of the key.

    A constant series has no tsnr and isn't kept.
    """
    each = series.groupBy(*keys, feature).agg(F.try_divide(F.avg("value"), F.stddev_samp("value")).alias("tsnr"))
    # moments per key by partial aggregation: a key with many features is no single task
    spread = each.groupBy(*keys).agg(F.avg("tsnr").alias("_m"), F.stddev_samp("tsnr").alias("_s"))
    each = each.join(spread, list(keys)) if keys else each.crossJoin(F.broadcast(spread))
    keep = F.coalesce(F.abs(F.col("tsnr") - F.col("_m")) <= threshold_sd * F.col("_s"), F.lit(False))
    return each.select(*keys, feature, "tsnr", keep.alias("keep"))


def tsnr_filter(series: DataFrame, keys: Sequence[str] = (), threshold_sd: float = 2.0, feature: str = "roi") -> DataFrame:
    """The series whose tsnr is kept."""
    return series.join(tsnr(series, keys, threshold_sd, feature).where("keep").select(*keys, feature), [*keys, feature], "left_semi")


def exclude(series: DataFrame, excluded: DataFrame, keys: Sequence[str] = ("subject", "session")) -> DataFrame:
    """Leave out the listed sessions."""
    return series.join(excluded.select(*keys).distinct(), list(keys), "left_anti")
