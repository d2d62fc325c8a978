"""The switching study from signals to reliability; only the sizes of small tables are read while a plan is made."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import statistics
from weftline.operators import chunks, clustering, community, connectivity, large_graphs, metrics, preprocessing
from weftline.sources import nifti, results, tables


@dataclass(frozen=True)
class Settings:
    """Parameters of a run, with the study's own values."""

    drop: int = 5
    window: int = 14
    direction: str = "centered"
    threshold_sd: float = 2.0
    runs: int = 500
    tau: float = 0.1
    reps: int = 500
    n_clusters: int = 2
    n_init: int = 100
    qtype: str = "sta"
    seed: int = 0
    large: bool = False  # communities by rounds over edge tables
    blocks: bool = False  # coupling in blocks, for series whose frames have no gaps

    def __post_init__(self):
        if not (3 <= self.window <= 50 and 0.5 <= self.threshold_sd <= 5 and 0 <= self.tau <= 1 and 2 <= self.n_clusters <= 10 and self.qtype in metrics.QTYPES):
            raise ValueError("a setting is out of its range")


def profiles(series: DataFrame, keys: Sequence[str], settings: Settings = Settings()) -> DataFrame:
    """(keys, sample, feature, value): the profile of each window, from parcel series (keys, roi, t, value).

    Coupling, communities per window, participation and module z, and their
    joint counts. Every step groups by the keys, so sessions run side by side
    and nothing is gathered. Communities are found in one task per window, or, with
    ``settings.large``, by rounds over the edge table of all windows, for nodes by the ten thousands.
    """
    keys = list(keys)
    at = [*keys, "t"]
    if settings.blocks:
        coupled = connectivity.blocks_to_long(connectivity.coupling_blocks(series, keys, settings.window, settings.direction), keys)
    else:
        coupled = connectivity.derivative_coupling(series, keys, settings.window, settings.direction)
    upper = coupled.withColumnRenamed("value", "wt").where("i < j")
    if settings.large:
        upper = tables.kept(upper)
        labels = large_graphs.window_communities(upper, at, settings.tau, settings.runs, settings.reps, settings.qtype)
    else:
        labels = community.window_communities(upper, at, settings.tau, settings.runs, settings.reps, settings.qtype, settings.seed)
    full = connectivity.mirror(upper)
    bt = metrics.participation(full, labels, at)
    wt = metrics.module_z(full, labels, at)
    nodes = bt.join(wt, [*at, "node"]).select(*at, "node", F.col("p_pos").alias("bt"), F.col("z").alias("wt"))
    return metrics.flatten_profile(metrics.cartography(nodes, keys), keys)


def states(series: DataFrame, keys: Sequence[str], settings: Settings = Settings()) -> DataFrame:
    """(keys, t, state, inertia) from parcel series: the clusters of each key's profiles."""
    return clustering.kmeans_by_key(profiles(series, keys, settings), list(keys), settings.n_clusters, settings.n_init, seed=settings.seed)


def switching(series: DataFrame, keys: Sequence[str] = ("subject", "session"), settings: Settings = Settings()) -> DataFrame:
    """(keys, switch_count) of parcel series."""
    return metrics.switch_count(states(series, keys, settings), keys)


def definitions(tables: Mapping[str, tuple[DataFrame, DataFrame]], keys: Sequence[str] = ("subject", "session")) -> DataFrame:
    """(definition, keys, roi, t, value): parcel series under each definition of parcels, by name.

    A definition is a signal table (keys, vertex, t, value) of its space and an
    atlas (vertex, roi) of it, which may have the keys too where subjects have
    atlases of their own. The definition is a key of all later steps, so the
    whole grid is one plan.
    """
    keys = list(keys)
    parts = [preprocessing.extract_roi(bold, atlas, keys).select(F.lit(name).alias("definition"), *keys, "roi", "t", "value") for name, (bold, atlas) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def variants(sessions: DataFrame, motion: DataFrame, features: DataFrame, keys: Sequence[str] = ("subject", "session")) -> DataFrame:
    """(motion, tsnr, keys, ...) of session rows under the four choices of leaving out moving sessions and sessions without a kept feature.

    Both flags are joined once; then each row goes to the variants that keep
    it. With a definition among the keys this is the grid of all pipelines.
    """
    keys = list(keys)
    moved = motion.select(*(k for k in keys if k in motion.columns)).distinct().withColumn("_moved", F.lit(True))
    good = features.where("keep").select(*(k for k in keys if k in features.columns)).distinct().withColumn("_good", F.lit(True))
    flagged = sessions.join(moved, [k for k in keys if k in moved.columns], "left").join(good, [k for k in keys if k in good.columns], "left")
    choices = F.array(*(F.when(keep, F.struct(F.lit(m).alias("motion"), F.lit(s).alias("tsnr"))) for m, s, keep in (
        (False, False, F.lit(True)), (False, True, F.col("_good").isNotNull()), (True, False, F.col("_moved").isNull()), (True, True, F.col("_moved").isNull() & F.col("_good").isNotNull())
    )))
    return flagged.withColumn("_to", F.explode(F.filter(choices, lambda c: c.isNotNull()))).select("_to.motion", "_to.tsnr", *(sessions[c] for c in sessions.columns))


def subject_means(counts: DataFrame, by: Sequence[str] = (), subject: str = "subject", value: str = "switch_count") -> DataFrame:
    """(by, subject, mean_count): the mean over a subject's sessions."""
    return counts.groupBy(*by, subject).agg(F.avg(value).alias("mean_count"))


def group_spread(counts: DataFrame, by: Sequence[str] = (), value: str = "switch_count") -> DataFrame:
    """(by, n, mean, sd) over all sessions of a group."""
    return statistics.describe(counts, value, by)


def reliability(counts: DataFrame, behaviour: DataFrame, score: str, by: Sequence[str] = (), value: str = "switch_count") -> DataFrame:
    """(by, n, mean, sd, icc, grade, r, p) of switch counts (by, subject, session, value) and a behavioural score per subject."""
    by = list(by)
    numbers = counts.withColumn(value, F.col(value).cast("double"))
    spread = group_spread(numbers, by, value)
    icc = statistics.icc21(numbers, by, value=value).select(*by, "icc", statistics.icc_grade(F.col("icc")).alias("grade"))
    means = subject_means(numbers, by, value=value)
    r = statistics.pearson(means.join(behaviour.select("subject", score), "subject"), "mean_count", score, by).select(*by, "r", "p")
    if by:
        return spread.join(icc, by, "left").join(r, by, "left")
    return spread.crossJoin(F.broadcast(icc)).crossJoin(F.broadcast(r))


def write_run(counts: DataFrame, folder: str, behaviour: DataFrame | None = None, score: str = "score", by: Sequence[str] = ()) -> None:
    """The files of a run: switch counts (by, subject, session, switch_count) as ``sessions_csv`` and ``sessions_mat``, subjects' means as
    ``subjects_csv`` and the statistics as ``statistics_json``, with reliability and correlation if there is a score. Each is written by the tasks that have its rows."""
    counts = tables.kept(counts)
    results.write_results(counts, f"{folder}/sessions_csv", "csv")
    results.write_results(counts, f"{folder}/sessions_mat", "mat")
    results.write_results(subject_means(counts, by), f"{folder}/subjects_csv", "csv")
    results.write_results(group_spread(counts, by) if behaviour is None else reliability(counts, behaviour, score, by), f"{folder}/statistics_json", "json")


def run(bold: DataFrame, atlas: DataFrame, behaviour: DataFrame, score: str, folder: str, settings: Settings = Settings(), regions: DataFrame | None = None, level: str = "roi", motion: DataFrame | None = None, tsnr: bool = False, keys: Sequence[str] = ("subject", "session")) -> DataFrame:
    """One of the study's runs from signals (keys, vertex, t, value) to its files; returns the session table (keys, switch_count).

    ``atlas`` (vertex, roi) may have the subject or both keys where each has its own, as in the run for
    individuals. ``regions`` (roi, network) restricts it to the two networks, numbered in order. With level
    ``vertex`` labelled vertices are the nodes instead of parcels. ``motion`` lists sessions to leave out, ``tsnr``
    leaves out nodes beyond ``settings.threshold_sd``. The settings' defaults are those of the study: 500 partitions,
    500 repetitions of consensus at 0.1, 100 starts of the clustering.
    """
    keys = list(keys)
    kept_sessions = preprocessing.exclude(bold, motion, keys) if motion is not None else bold
    series = preprocessing.extract_roi(preprocessing.drop_frames(kept_sessions, settings.drop), atlas, keys, level)
    if regions is not None:
        series = preprocessing.select_networks(series, regions) if level == "roi" else series.join(regions.where(F.col("network").startswith("Default") | F.col("network").startswith("Cont")).select("roi"), "roi", "left_semi")
    if level == "vertex":
        series = series.drop("roi").withColumnRenamed("vertex", "roi")
    return _finish(series, behaviour, score, folder, settings, tsnr, keys)


def run_files(spark: SparkSession, path: str, space: str, atlas: DataFrame, behaviour: DataFrame, score: str, folder: str, settings: Settings = Settings(), regions: DataFrame | None = None, motion: DataFrame | None = None, tsnr: bool = False) -> DataFrame:
    """``run`` at the level of parcels, straight from the run files of a BIDS directory.

    Files of other spaces aren't opened. Signals stay chunks until they are parcels' means, so no
    table has a row for each vertex and frame.
    """
    keys = ["subject", "session"]
    signals = nifti.read_runs(spark, path, space)
    if motion is not None:
        signals = preprocessing.exclude(signals, motion, keys)
    series = preprocessing.drop_frames(chunks.extract_roi(signals, chunks.atlas_blocks(atlas, keys), keys), settings.drop)
    if regions is not None:
        series = preprocessing.select_networks(series, regions)
    return _finish(series, behaviour, score, folder, settings, tsnr, keys)


def _finish(series: DataFrame, behaviour: DataFrame, score: str, folder: str, settings: Settings, tsnr: bool, keys: list[str]) -> DataFrame:
    """From nodes' series to the files of a run."""
    if tsnr:
        series = preprocessing.tsnr_filter(series, keys, settings.threshold_sd)
    counts = tables.kept(switching(tables.kept(series), keys, settings))
    write_run(counts, folder, behaviour, score)
    return counts
