"""Queries of the network operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import statistics
from weftline.operators import chunks, clustering, community, connectivity, control, large_graphs, metrics, preprocessing
from weftline.plans import study
from weftline.sources import nifti, results, tables
from weftline.streaming import switches as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in cols})


# -- SQL of the adapters ----------------------------------------------------

HOURS = """
    hours AS (SELECT event_id, user_id, event_type, value, ts, CAST(date_diff('hour', TIMESTAMP '2024-01-01', ts) AS INTEGER) AS t,
        CAST((date_diff('hour', TIMESTAMP '2024-01-01', ts) // 24) % 6 AS INTEGER) AS session FROM events)"""
SERIES = f"""{HOURS},
    mean AS (SELECT event_type, t, avg(value) AS value FROM hours GROUP BY ALL),
    types AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS roi FROM (SELECT DISTINCT event_type FROM mean)),
    grid AS (SELECT event_type, roi, CAST(u.t AS INTEGER) AS t FROM types, unnest(range(0, (SELECT max(t) + 1 FROM mean))) AS u(t)),
    series AS (SELECT roi, grid.t, coalesce(value, 0.0) AS value FROM grid LEFT JOIN mean USING (event_type, t))"""
BOLD = f"""{HOURS},
    bold AS (SELECT session, user_id AS vertex, t, avg(value) AS value FROM hours GROUP BY ALL),
    atlas AS (SELECT DISTINCT user_id AS vertex, CAST(user_id % 12 AS INTEGER) AS roi FROM hours),
    roi AS (SELECT session, roi, t, avg(value) AS value FROM bold JOIN atlas USING (vertex) WHERE roi <> 0 GROUP BY ALL)"""


def coupling_sql(frame: str, window: int = 14) -> str:
    return f"""{SERIES},
    d AS (SELECT *, value - lag(value) OVER (PARTITION BY roi ORDER BY t) AS d FROM series),
    z AS (SELECT roi, t, d / nullif(stddev_samp(d) OVER (PARTITION BY roi), 0) AS z FROM d),
    p AS (SELECT a.roi AS i, b.roi AS j, a.t, a.z * b.z AS p FROM z a JOIN z b USING (t) WHERE a.roi <= b.roi),
    m AS (SELECT i, j, t, count(p) OVER w = {window} AS whole, avg(p) OVER w AS value FROM p WINDOW w AS (PARTITION BY i, j ORDER BY t ROWS BETWEEN {frame}))"""


FORWARD, CENTERED = "CURRENT ROW AND 13 FOLLOWING", "7 PRECEDING AND 6 FOLLOWING"
WEIGHTS = f"""{coupling_sql(FORWARD)},
    up AS (SELECT i, j, t, round(value, 9) AS wt FROM m WHERE whole AND i < j),
    weights AS (SELECT i, j, t, wt FROM up UNION ALL SELECT j, i, t, wt FROM up),
    modules AS (SELECT t, CAST(node AS INTEGER) AS node, CAST(node % 2 + 1 AS INTEGER) AS c FROM (SELECT DISTINCT t FROM up), unnest(range(0, 5)) AS u(node))"""


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both triangles of all coupling slices."""
    up = connectivity.derivative_coupling(tables.event_series(spark, sf_dir), window=14, direction="forward").where("i < j")
    return connectivity.mirror(up.withColumn("wt", F.round("value", 9)).drop("value"))


def _modules(weights: DataFrame) -> DataFrame:
    return weights.select("t").distinct().select("t", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("node")).withColumn("c", (F.col("node") % 2 + 1).cast("int"))


# -- sources and preprocessing ----------------------------------------------


@query(f"WITH {BOLD} SELECT axis, size FROM (SELECT count(DISTINCT session) AS session, count(DISTINCT vertex) AS vertex, count(DISTINCT t) AS t FROM bold) UNPIVOT (size FOR axis IN (session, vertex, t))")
def read_scan_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.extents(tables.event_bold(spark, sf_dir), ["session", "vertex", "t"])


@query(f"""WITH {HOURS}, bold AS (SELECT user_id % 7 AS subject, session, user_id AS vertex, t, avg(value) AS value FROM hours GROUP BY ALL),
    kept AS (SELECT * FROM bold ANTI JOIN (SELECT DISTINCT user_id % 7 AS subject, session FROM hours WHERE event_type = 'error' AND value > 90 AND user_id % 7 < 2) USING (subject, session))
    SELECT axis, size FROM (SELECT count(DISTINCT subject) AS subject, count(DISTINCT session) AS session, count(DISTINCT vertex) AS vertex, count(DISTINCT t) AS t FROM kept) UNPIVOT (size FOR axis IN (subject, session, vertex, t))""")
def read_bold_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals and a list of excluded sessions, written as the study's files and read by its readers."""
    folder = tables.scratch_folder(spark)
    hours = tables.hours(spark, sf_dir).withColumn("subject", (F.col("user_id") % 7).cast("int"))
    bold = hours.groupBy("subject", "session", F.col("user_id").cast("int").alias("vertex"), "t").agg(F.avg("value").alias("value"))
    bold.write.partitionBy("subject", "session").parquet(f"{folder}/bold")
    moved = hours.where("event_type = 'error' and value > 90 and subject < 2").select("subject", "session").distinct()
    moved.select(F.concat_ws(" ", "subject", "session").alias("value")).write.text(f"{folder}/excluded")
    excluded = tables.read_exclusions(spark, f"{folder}/excluded").select(F.col("subject").cast("int").alias("subject"), F.col("session").cast("int").alias("session"))
    return tables.scan_extents(preprocessing.exclude(tables.read_bold(spark, f"{folder}/bold"), excluded))


@query("SELECT CAST(p_partkey AS INTEGER) AS roi, '17networks_LH_' || p_brand || '_' || p_size AS name, '17Networks_RH_' || p_type || '_1' AS target_name, round(p_retailprice / 3000, 6) AS dice, p_brand AS network, p_type AS target_network FROM part")
def read_mapping_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the file of an atlas mapping, read with the networks that the names tell."""
    folder = tables.scratch_folder(spark)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    join = lambda *x: F.concat_ws("_", *x)
    rows = part.select(F.col("p_partkey").cast("int").alias("Kong_Index"), join(F.lit("17networks_LH"), "p_brand", "p_size").alias("Kong_ROI_Name"), join(F.lit("17Networks_RH"), "p_type", F.lit("1")).alias("Schaefer2018_Best_Match"), (F.col("p_retailprice") / 3000).alias("Dice"))
    rows.write.csv(folder, header=True)
    return _round(tables.read_mapping(spark, folder), "dice")


@query("SELECT c_mktsegment AS segment, count(*) AS n, round(avg(c_nationkey), 6) AS mean, round(stddev_samp(c_nationkey), 6) AS sd FROM customer GROUP BY c_mktsegment")
def read_behaviour_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the study's table of behaviour, read from its file and described by group."""
    folder = tables.scratch_folder(spark)
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    score = lambda name: F.col("c_nationkey").cast("int").alias(name)
    c.select(F.col("c_custkey").cast("string").alias("subject"), *(score(n) for n in ("N", "E", "O", "A", "C", "caq", "cbq", "raven"))).write.csv(folder, header=True)
    read = tables.read_behaviour(spark, folder).join(c.select(F.col("c_custkey").cast("string").alias("subject"), F.col("c_mktsegment").alias("segment")), "subject")
    return _round(statistics.describe(read, "caq", ["segment"]), "mean", "sd")


def _roi(spark: SparkSession, sf_dir: str, level: str = "roi") -> DataFrame:
    return preprocessing.extract_roi(tables.event_bold(spark, sf_dir), tables.event_atlas(spark, sf_dir), ["session"], level)


@query(f"WITH {BOLD} SELECT session, roi, t, round(value, 6) AS value FROM roi")
def roi_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_roi(spark, sf_dir), "value")


@query(f"WITH {BOLD} SELECT session, roi, vertex, t, round(value, 6) AS value FROM bold JOIN atlas USING (vertex) WHERE roi <> 0")
def roi_vertex_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_roi(spark, sf_dir, "vertex"), "value")


@query(f"""WITH {BOLD}, own AS (SELECT s.session, vertex, CAST((vertex + s.session) % 12 AS INTEGER) AS roi FROM (SELECT DISTINCT session FROM bold) s, atlas)
    SELECT session, roi, t, round(avg(value), 6) AS value FROM bold JOIN own USING (session, vertex) WHERE roi <> 0 GROUP BY session, roi, t""")
def roi_individual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An atlas of its own for each session."""
    bold = tables.event_bold(spark, sf_dir)
    atlas = bold.select("session", "vertex").distinct().withColumn("roi", ((F.col("vertex") + F.col("session")) % 12).cast("int"))
    return _round(preprocessing.extract_roi(bold, atlas, ["session"]), "value")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.to_chunks(tables.event_bold(spark, sf_dir), ["session"], 64, 128)


@query(f"WITH {BOLD} SELECT session, roi, t, round(value, 6) AS value FROM roi")
def roi_mean_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parcels' means from signals laid out as chunks; only sums per parcel are exchanged."""
    blocks = chunks.atlas_blocks(tables.event_atlas(spark, sf_dir), ["session"], 64)
    return _round(chunks.extract_roi(_chunks(spark, sf_dir), blocks, ["session"], 128), "value")


@query(f"""WITH {BOLD}, own AS (SELECT s.session, vertex, CAST((vertex + s.session) % 12 AS INTEGER) AS roi FROM (SELECT DISTINCT session FROM bold) s, atlas)
    SELECT session, roi, t, round(avg(value), 6) AS value FROM bold JOIN own USING (session, vertex) WHERE roi <> 0 GROUP BY session, roi, t""")
def roi_individual_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An atlas of its own for each session; signals and atlases are bucketed alike, so neither moves for the join."""
    atlas = tables.event_bold(spark, sf_dir).select("session", "vertex").distinct().withColumn("roi", ((F.col("vertex") + F.col("session")) % 12).cast("int"))
    folder = tables.scratch_folder(spark)
    name = folder.rpartition("-")[2]
    by = ["session", "vb"]
    signals = chunks.save_bucketed(_chunks(spark, sf_dir), f"signals_{name}", f"{folder}/signals", by, 8)
    blocks = chunks.save_bucketed(chunks.atlas_blocks(atlas, ["session"], 64), f"atlas_{name}", f"{folder}/atlas", by, 8)
    return _round(chunks.extract_roi(signals, blocks, ["session"], 128), "value")


#: Users of each of seven subjects are the vertices of its runs, numbered from 0; a run has the hours of its session.
RUNS = f"""{HOURS}, runs AS (SELECT CAST(user_id % 7 AS VARCHAR) AS subject, CAST(session AS VARCHAR) AS session, user_id // 7 AS vertex, t, avg(value) AS value FROM hours GROUP BY ALL)"""


def _bids(spark: SparkSession, sf_dir: str) -> str:
    """A BIDS directory of the events, written by Spark."""
    hours = tables.hours(spark, sf_dir)
    bold = hours.groupBy((F.col("user_id") % 7).cast("string").alias("subject"), F.col("session").cast("string").alias("session"), F.expr("user_id div 7").alias("vertex"), "t").agg(F.avg("value").alias("value"))
    folder = tables.scratch_folder(spark)
    width, length = bold.agg(F.max("vertex") + 1, F.max("t") + 1).first()
    nifti.write_runs(bold, folder, "fsaverage6", width, length).write.format("noop").mode("overwrite").save()
    return folder


@query(f"WITH {RUNS} SELECT DISTINCT subject, session, 'fsaverage6' AS space, (SELECT max(vertex) + 1 FROM runs) AS vertices, (SELECT CAST(max(t) + 1 AS INTEGER) FROM runs) AS frames, 1.0::DOUBLE AS repetition_time FROM runs")
def bids_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimensions of all runs of a BIDS directory, from the files' headers."""
    return nifti.scan_runs(spark, _bids(spark, sf_dir)).drop("path")


@query(f"WITH {RUNS} SELECT subject, session, CAST(vertex % 5 + 1 AS INTEGER) AS roi, t, round(avg(value), 6) AS value FROM runs GROUP BY ALL")
def bids_roi_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels' means straight from the run files of a BIDS directory."""
    folder = _bids(spark, sf_dir)
    width = nifti.scan_runs(spark, folder).agg(F.max("vertices")).first()[0]
    atlas = spark.range(width).select(F.col("id").alias("vertex"), (F.col("id") % 5 + 1).cast("int").alias("roi"))
    keys = ["subject", "session"]
    return _round(chunks.extract_roi(nifti.read_runs(spark, folder, "fsaverage6", 64, 128), chunks.atlas_blocks(atlas, keys, 64), keys, 128), "value")


REGIONS = "regions AS (SELECT CAST(r AS INTEGER) AS roi, CASE WHEN r % 3 = 0 THEN 'DefaultA' WHEN r % 3 = 1 THEN 'ContB' ELSE 'VisCent' END AS network FROM unnest(range(1, 12)) AS u(r))"


@query(f"""WITH {BOLD}, {REGIONS}, chosen AS (SELECT roi, CAST(row_number() OVER (ORDER BY CASE WHEN network LIKE 'Default%' THEN 0 ELSE 1 END, roi) - 1 AS INTEGER) AS new FROM regions WHERE network NOT LIKE 'Vis%')
    SELECT session, new AS roi, t, round(value, 6) AS value FROM roi JOIN chosen USING (roi)""")
def network_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = spark.range(1, 12).select(F.col("id").cast("int").alias("roi"), F.when(F.col("id") % 3 == 0, "DefaultA").when(F.col("id") % 3 == 1, "ContB").otherwise("VisCent").alias("network"))
    return _round(preprocessing.select_networks(_roi(spark, sf_dir), regions).select("session", "roi", "t", "value"), "value")


@query(f"WITH {BOLD} SELECT session, CAST(100 - roi AS INTEGER) AS roi, t, round(value, 6) AS value FROM roi")
def atlas_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.range(1, 12).select(F.col("id").cast("int").alias("roi"), (100 - F.col("id")).cast("int").alias("target"))
    return _round(preprocessing.relabel(_roi(spark, sf_dir), mapping).select("session", "roi", "t", "value"), "value")


@query(f"WITH {SERIES} SELECT roi, CAST(t - 5 AS INTEGER) AS t, round(value, 6) AS value FROM series WHERE t >= 5")
def drop_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(preprocessing.drop_frames(tables.event_series(spark, sf_dir)).select("roi", "t", "value"), "value")


TSNR = """each AS (SELECT session, roi, avg(value) / nullif(stddev_samp(value), 0) AS tsnr FROM roi GROUP BY ALL),
    kept AS (SELECT *, coalesce(abs(tsnr - avg(tsnr) OVER w) <= 1.5 * stddev_samp(tsnr) OVER w, false) AS keep FROM each WINDOW w AS (PARTITION BY session))"""


@query(f"WITH {BOLD}, {TSNR} SELECT session, roi, round(tsnr, 6) AS tsnr, keep FROM kept")
def tsnr_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(preprocessing.tsnr(_roi(spark, sf_dir), ["session"], 1.5), "tsnr")


@query(f"WITH {BOLD}, {TSNR} SELECT session, roi, t, round(value, 6) AS value FROM roi SEMI JOIN (SELECT * FROM kept WHERE keep) USING (session, roi)")
def tsnr_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(preprocessing.tsnr_filter(_roi(spark, sf_dir), ["session"], 1.5).select("session", "roi", "t", "value"), "value")


MOTION = "motion AS (SELECT DISTINCT user_id AS subject, session FROM hours WHERE event_type = 'error' AND value > 90)"


def _motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.hours(spark, sf_dir).where("event_type = 'error' and value > 90").select(F.col("user_id").alias("subject"), "session").distinct()


COUNTS = """moved AS (SELECT user_id AS subject, session, state <> lag(state) OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS m FROM (SELECT *, CASE WHEN value > 50 THEN 2 ELSE 1 END AS state FROM hours)),
    counts AS (SELECT subject, session, count(*) FILTER (WHERE m) AS switch_count FROM moved GROUP BY ALL)"""


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = tables.event_states(spark, sf_dir).withColumnRenamed("user_id", "subject")
    return metrics.switch_count(states, ["subject", "session"], ["ts", "event_id"])


@query(f"WITH {HOURS}, {MOTION}, {COUNTS} SELECT subject, session, switch_count FROM counts ANTI JOIN motion USING (subject, session)")
def motion_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preprocessing.exclude(_counts(spark, sf_dir), _motion(spark, sf_dir))


# -- coupling -----------------------------------------------------------------


def _coupled(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return _round(connectivity.derivative_coupling(tables.event_series(spark, sf_dir), window=14, **options), "value")


@query(f"WITH {coupling_sql(CENTERED)} SELECT i, j, t, round(value, 6) AS value FROM m WHERE whole")
def mtd_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coupled(spark, sf_dir)


@query(f"WITH {coupling_sql(FORWARD)} SELECT i, j, t, round(value, 6) AS value FROM m WHERE whole")
def mtd_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coupled(spark, sf_dir, direction="forward")


@query(f"WITH {coupling_sql(CENTERED)} SELECT i, j, t, CASE WHEN whole THEN round(value, 6) ELSE 0.0 END AS value FROM m")
def mtd_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coupled(spark, sf_dir, trim=False)


@query(f"WITH {coupling_sql(CENTERED)} SELECT i, j, t, round(value, 6) AS value FROM m WHERE whole AND t < (SELECT max(t) FROM m WHERE whole)")
def mtd_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coupled(spark, sf_dir, declared_length=True)


def _blocked(spark: SparkSession, sf_dir: str, direction: str) -> DataFrame:
    blocks = connectivity.coupling_blocks(tables.event_series(spark, sf_dir), window=14, direction=direction, parcels=2, frames=100)
    return _round(connectivity.blocks_to_long(blocks, frames=100), "value")


@query(f"WITH {coupling_sql(CENTERED)} SELECT i, j, t, round(value, 6) AS value FROM m WHERE whole")
def mtd_blocks_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocked(spark, sf_dir, "centered")


@query(f"WITH {coupling_sql(FORWARD)} SELECT i, j, t, round(value, 6) AS value FROM m WHERE whole")
def mtd_blocks_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocked(spark, sf_dir, "forward")


# -- communities and metrics ----------------------------------------------------

#: All parts, a hundred to a matrix.
CI = """parts AS (SELECT p_partkey // 100 AS block, p_partkey AS node, 0 AS p, p_brand AS c FROM part UNION ALL SELECT p_partkey // 100, p_partkey, 1, p_type FROM part
    UNION ALL SELECT p_partkey // 100, p_partkey, 2, CAST(p_size % 4 AS VARCHAR) FROM part)"""


def _partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.expr("p_partkey div 100").alias("block"), F.col("p_partkey").alias("node"), F.posexplode(F.array("p_brand", "p_type", (F.col("p_size") % 4).cast("string"))).alias("p", "c"))


def _agreement_sql(weights: str) -> str:
    return f"""WITH {CI}, wts AS (SELECT * FROM (VALUES {weights}) AS v(p, wt))
    SELECT block, a.node AS i, b.node AS j, round(sum(wt / (SELECT sum(wt) FROM wts)), 6) AS value
    FROM parts a JOIN parts b USING (block, p, c) JOIN wts USING (p) WHERE a.node <= b.node GROUP BY ALL"""


@query(_agreement_sql("(0, 1.0::DOUBLE), (1, 1.0), (2, 1.0)"))
def agreement_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(community.agreement(_partitions(spark, sf_dir), keys=["block"]), "value")


@query(_agreement_sql("(0, 0.5::DOUBLE), (1, 0.2), (2, 0.9)"))
def agreement_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = spark.createDataFrame([(0, 0.5), (1, 0.2), (2, 0.9)], "p int, wt double")
    return _round(community.agreement(_partitions(spark, sf_dir), weights, ["block"]), "value")


PARTICIPATION = f"""WITH {WEIGHTS}, k AS (SELECT weights.t, i, c, sum(greatest(wt, 0)) AS pos, sum(greatest(-wt, 0)) AS neg FROM weights JOIN modules ON weights.t = modules.t AND j = node GROUP BY ALL)
    SELECT t, i AS node, round(coalesce(1 - sum(pos * pos) / nullif(sum(pos) * sum(pos), 0), 0), 6) AS p_pos, round(coalesce(1 - sum(neg * neg) / nullif(sum(neg) * sum(neg), 0), 0), 6) AS p_neg FROM k GROUP BY ALL"""


@query(PARTICIPATION)
def participation_pos_neg(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _weights(spark, sf_dir)
    return _round(metrics.participation(w, _modules(w), ["t"]), "p_pos", "p_neg")


#: A directed matrix, so that the flags differ: users of one session, site (forty users) and type, weighted by their difference.
DIRECTED = f"""{HOURS}, u AS (SELECT session, user_id // 40 AS site, event_type, user_id, sum(value) AS v FROM hours GROUP BY ALL),
    weights AS (SELECT a.session, a.site, a.user_id AS i, b.user_id AS j, sum(a.v - 0.5 * b.v) AS wt FROM u a JOIN u b USING (session, site, event_type) WHERE a.user_id <> b.user_id GROUP BY ALL),
    modules AS (SELECT DISTINCT session, site, user_id AS node, CAST(user_id % 5 AS INTEGER) AS c FROM u)"""


def _z_sql(links: str) -> str:
    return f"""WITH {DIRECTED}, links AS ({links}),
    own AS (SELECT l.session, l.i, sum(wt) AS k FROM links l JOIN modules a ON a.session = l.session AND a.node = l.i JOIN modules b ON b.session = l.session AND b.node = l.j WHERE a.c = b.c GROUP BY ALL),
    d AS (SELECT m.session, m.site, node, c, coalesce(k, 0) AS k FROM modules m LEFT JOIN own ON own.session = m.session AND own.i = node)
    SELECT session, site, node, round(coalesce((k - avg(k) OVER w) / nullif(stddev_samp(k) OVER w, 0), 0), 6) AS z FROM d WINDOW w AS (PARTITION BY session, site, c)"""


def _module_z(flag: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        u = tables.hours(spark, sf_dir).groupBy("session", F.expr("user_id div 40").alias("site"), "event_type", "user_id").agg(F.sum("value").alias("v"))
        at = ["session", "site", "event_type"]
        a, b = u.select(*at, F.col("user_id").alias("i"), F.col("v").alias("a")), u.select(*at, F.col("user_id").alias("j"), F.col("v").alias("b"))
        w = a.join(b, at).where("i <> j").groupBy("session", "site", "i", "j").agg(F.sum(F.col("a") - 0.5 * F.col("b")).alias("wt"))
        modules = u.select("session", "site", F.col("user_id").alias("node")).distinct().withColumn("c", (F.col("node") % 5).cast("int"))
        return _round(metrics.module_z(w, modules, ["session", "site"], flag), "z")

    return run


for _flag, _name, _links in (
    (0, "und", "SELECT session, i, j, wt FROM weights"),
    (1, "out", "SELECT session, i, j, wt FROM weights"),
    (2, "in", "SELECT session, j AS i, i AS j, wt FROM weights"),
    (3, "both", "SELECT session, i, j, wt FROM weights UNION ALL SELECT session, j, i, wt FROM weights"),
):
    query(_z_sql(_links), f"module_z_{_name}")(_module_z(_flag))


def _q_sql(d0: str, d1: str) -> str:
    return f"""WITH {WEIGHTS}, l AS (SELECT w.t, a.c AS ci, b.c AS cj, sum(greatest(wt, 0)) AS p, sum(greatest(-wt, 0)) AS n FROM weights w JOIN modules a ON a.t = w.t AND a.node = i JOIN modules b ON b.t = w.t AND b.node = j GROUP BY ALL),
    s AS (SELECT t, ci, sum(p) AS kp, sum(n) AS kn, sum(CASE WHEN ci = cj THEN p ELSE 0 END) AS wp, sum(CASE WHEN ci = cj THEN n ELSE 0 END) AS wn FROM l GROUP BY ALL),
    g AS (SELECT t, sum(kp) AS s0, sum(kn) AS s1, sum(wp) AS wp, sum(wn) AS wn, sum(kp * kp) AS kkp, sum(kn * kn) AS kkn FROM s GROUP BY ALL)
    SELECT t, round(coalesce({d0}, 0) * (wp - coalesce(kkp / nullif(s0, 0), 0)) - coalesce({d1}, 0) * (wn - coalesce(kkn / nullif(s1, 0), 0)), 6) + 0.0 AS q FROM g"""


def _modularity(qtype: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = _weights(spark, sf_dir)
        return _round(metrics.modularity(w, _modules(w), ["t"], qtype), "q")

    return run


_S0, _S1, _ALL = "1 / nullif(s0, 0)", "1 / nullif(s1, 0)", "1 / nullif(s0 + s1, 0)"
for _q, _d0, _d1 in (("sta", _S0, _ALL), ("pos", _S0, "0"), ("smp", _S0, _S1), ("gja", _ALL, _ALL), ("neg", "0", _S1)):
    query(_q_sql(_d0, _d1), f"modularity_q_{_q}")(_modularity(_q))


@query(f"""WITH {WEIGHTS}, l AS (SELECT w.t, a.c AS ci, b.c AS cj, sum(abs(wt)) AS x FROM weights w JOIN modules a ON a.t = w.t AND a.node = i JOIN modules b ON b.t = w.t AND b.node = j GROUP BY ALL),
    s AS (SELECT t, ci, sum(x) AS k, sum(CASE WHEN ci = cj THEN x ELSE 0 END) AS own FROM l GROUP BY ALL)
    SELECT t, round(sum(own) / sum(k) - sum(k * k) / (sum(k) * sum(k)), 6) + 0.0 AS q FROM s GROUP BY t""")
def modularity_unsigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newman's modularity of weights without signs, which the signed one gives where none is negative."""
    w = _weights(spark, sf_dir).withColumn("wt", F.abs("wt"))
    return _round(metrics.modularity(w, _modules(w), ["t"]), "q")


#: Participation-like and z-like values of users per hour.
NODES = f"{HOURS}, nodes AS (SELECT t, user_id AS node, (avg(value) % 100) / 100 AS bt, (avg(value) % 13) - 6 AS wt FROM hours GROUP BY ALL)"
BINS = "least(greatest(CAST(round((5 - wt) * 10) AS INTEGER), 0), 100) AS yb, least(greatest(CAST(round(bt * 100) AS INTEGER), 0), 100) AS xb"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means add up in the order of events, as the last digit of a sum decides bins at a half and mustn't depend on how rows are dealt."""
    events = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("event_id", "value")))).alias("_e")
    per = tables.hours(spark, sf_dir).groupBy("t", F.col("user_id").alias("node")).agg(events)
    mean = F.try_divide(F.aggregate("_e.value", F.lit(0.0), lambda total, x: total + x), F.size("_e"))
    return per.select("t", "node", mean.alias("_m")).select("t", "node", (F.col("_m") % 100 / 100).alias("bt"), (F.col("_m") % 13 - 6).alias("wt"))


@query(f"WITH {NODES} SELECT t, {BINS}, count(*) AS n FROM nodes GROUP BY ALL")
def cartography_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cartography(_nodes(spark, sf_dir))


@query(f"""WITH {NODES}, p AS (SELECT t, {BINS}, count(*) AS n FROM nodes GROUP BY ALL)
    SELECT t, 10201::BIGINT AS cells, count(*) AS filled, CAST(sum(n) AS BIGINT) AS nodes, CAST(sum(n * (101 * yb + xb)) AS BIGINT) AS places, CAST(max(n) AS BIGINT) AS most FROM p GROUP BY t""")
def cartography_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole 101 x 101 profiles of all hours, each told by its sums."""
    dense = metrics.densify(metrics.profile_vectors(_nodes(spark, sf_dir)))
    cell, n = F.col("cell"), F.col("n")
    return dense.select("t", F.posexplode("values").alias("cell", "n")).groupBy("t").agg(F.count("*").alias("cells"), F.count(F.when(n > 0, 1)).alias("filled"), F.sum("n").alias("nodes"), F.sum(n * cell).alias("places"), F.max("n").alias("most"))


# -- switching and statistics ----------------------------------------------------


@query(f"WITH {HOURS}, m AS (SELECT user_id, state <> lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS m FROM (SELECT *, CASE WHEN value > 50 THEN 2 ELSE 1 END AS state FROM hours)) SELECT user_id, count(*) FILTER (WHERE m) AS switch_count FROM m GROUP BY ALL")
def switch_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.switch_count(tables.event_states(spark, sf_dir), ["user_id"], ["ts", "event_id"])


@query(f"WITH {HOURS}, f AS (SELECT user_id, event_id, state + lag(state) OVER w AS flag, state <> lag(state) OVER w AS switched FROM (SELECT *, CASE WHEN value > 50 THEN 2 ELSE 1 END AS state FROM hours) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT * FROM f WHERE flag IS NOT NULL")
def switch_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.switches(tables.event_states(spark, sf_dir), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "flag", "switched")


@query(f"WITH {HOURS}, m AS (SELECT user_id, state <> lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS m FROM (SELECT *, CASE WHEN value > 50 THEN 2 ELSE 1 END AS state FROM hours)) SELECT user_id, count(*) FILTER (WHERE m) AS switch_count, 0::BIGINT AS late FROM m GROUP BY ALL")
def switch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as files in an order of arrival that isn't theirs, counted by a stream in the order of event time."""
    folder = tables.scratch_folder(spark)
    states = tables.event_states(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("n"), "state")
    states.repartition(8, F.xxhash64("n")).write.parquet(f"{folder}/arrived")
    counts = streams.count_files(spark, f"{folder}/arrived", "key long, ts timestamp, n long, state int", folder, "60 days", 3)
    return counts.withColumnRenamed("key", "user_id")


@query(f"WITH {HOURS}, {COUNTS} SELECT subject, session, switch_count, switch_count AS from_mat, round(avg(switch_count) OVER (PARTITION BY subject), 6) AS mean_count FROM counts")
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session table as CSV and MATLAB files, subjects' means as CSV and the group's figures as JSON, read back and put side by side."""
    folder, keys = tables.scratch_folder(spark), ["subject", "session"]
    study.write_run(_counts(spark, sf_dir), folder)
    sessions = spark.read.csv(f"{folder}/sessions_csv", header=True, schema="subject long, session int, switch_count long")
    mat = results.read_mat(spark, f"{folder}/sessions_mat", "subject long, session int, switch_count long").withColumnRenamed("switch_count", "from_mat")
    means = spark.read.csv(f"{folder}/subjects_csv", header=True, schema="subject long, mean_count double")
    return _round(sessions.join(mat, keys).join(means, "subject"), "mean_count")


KEPT = """each AS (SELECT user_id AS subject, session, avg(value) / nullif(stddev_samp(value), 0) AS tsnr FROM hours GROUP BY ALL),
    kept AS (SELECT subject, session, coalesce(abs(tsnr - avg(tsnr) OVER w) <= 1.0 * stddev_samp(tsnr) OVER w, false) AS keep FROM each WINDOW w AS (PARTITION BY session))"""
GRID = f"""{HOURS}, {MOTION}, {COUNTS}, {KEPT}, grid AS (
    SELECT false AS motion, false AS tsnr, * FROM counts
    UNION ALL SELECT false, true, * FROM counts SEMI JOIN (SELECT * FROM kept WHERE keep) USING (subject, session)
    UNION ALL SELECT true, false, * FROM counts ANTI JOIN motion USING (subject, session)
    UNION ALL SELECT true, true, * FROM (SELECT * FROM counts ANTI JOIN motion USING (subject, session)) SEMI JOIN (SELECT * FROM kept WHERE keep) USING (subject, session))"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = preprocessing.tsnr(tables.hours(spark, sf_dir).withColumnRenamed("user_id", "subject"), ["session"], 1.0, "subject")
    return study.variants(_counts(spark, sf_dir), _motion(spark, sf_dir), features)


@query(f"WITH {GRID} SELECT motion, tsnr, subject, session, switch_count FROM grid")
def variant_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir)


@query(f"WITH {HOURS}, {COUNTS} SELECT subject, round(avg(switch_count), 6) AS mean_count FROM counts GROUP BY ALL")
def subject_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(study.subject_means(_counts(spark, sf_dir)), "mean_count")


@query(f"WITH {GRID} SELECT motion, tsnr, count(*) AS n, round(avg(switch_count), 6) AS mean, round(stddev_samp(switch_count), 6) AS sd FROM grid GROUP BY motion, tsnr")
def group_mean_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(study.group_spread(_grid(spark, sf_dir), ["motion", "tsnr"]), "mean", "sd")


ICC = """f AS (SELECT *, count(*) OVER (PARTITION BY motion, tsnr, subject) AS have FROM grid),
    c AS (SELECT motion, tsnr, subject, session, CAST(switch_count AS DOUBLE) AS x FROM f JOIN (SELECT motion, tsnr, count(DISTINCT session) AS k FROM grid GROUP BY ALL) USING (motion, tsnr) WHERE have = k),
    d AS (SELECT *, avg(x) OVER (PARTITION BY motion, tsnr, subject) AS s, avg(x) OVER (PARTITION BY motion, tsnr, session) AS m, avg(x) OVER (PARTITION BY motion, tsnr) AS g FROM c),
    e AS (SELECT motion, tsnr, count(DISTINCT subject) AS n, count(DISTINCT session) AS k, sum((s - g) ** 2) AS r, sum((m - g) ** 2) AS q, sum((x - s - m + g) ** 2) AS e FROM d GROUP BY ALL),
    h AS (SELECT motion, tsnr, n, k, r / nullif(n - 1, 0) AS msr, q / nullif(k - 1, 0) AS msc, e / nullif((n - 1) * (k - 1), 0) AS mse FROM e),
    icc AS (SELECT motion, tsnr, n, k, (msr - mse) / nullif(msr + (k - 1) * mse + k * (msc - mse) / n, 0) AS icc FROM h)"""


def _icc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.icc21(_grid(spark, sf_dir).withColumn("value", F.col("switch_count").cast("double")), ["motion", "tsnr"])


@query(f"WITH {GRID}, {ICC} SELECT motion, tsnr, n, k, round(icc, 6) AS icc FROM icc")
def icc21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_icc(spark, sf_dir), "icc")


@query(f"WITH {GRID}, {ICC} SELECT motion, tsnr, CASE WHEN icc < 0.4 THEN 'poor' WHEN icc < 0.6 THEN 'fair' WHEN icc < 0.75 THEN 'good' WHEN icc IS NOT NULL THEN 'excellent' END AS grade FROM icc")
def icc_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _icc(spark, sf_dir).select("motion", "tsnr", statistics.icc_grade(F.col("icc")).alias("grade"))


PAIRS = "pairs AS (SELECT motion, tsnr, avg(switch_count) AS x, any_value(c_acctbal) AS y FROM grid JOIN customer ON c_custkey = subject GROUP BY motion, tsnr, subject)"


def _pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = _grid(spark, sf_dir).groupBy("motion", "tsnr", "subject").agg(F.avg("switch_count").alias("x"))
    scores = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("subject"), F.col("c_acctbal").alias("y"))
    return statistics.pearson(means.join(scores, "subject"), "x", "y", ["motion", "tsnr"])


@query(f"WITH {GRID}, {PAIRS} SELECT motion, tsnr, count(*) AS n, round(corr(x, y), 6) AS r FROM pairs GROUP BY ALL")
def pearson_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_pearson(spark, sf_dir).drop("p"), "r")


#: Two-sided p at n - 2 degrees of freedom as the finite sums of Student's distribution, in r and cos^2 = 1 - r^2.
P_SQL = f"""WITH {GRID}, {PAIRS}, c AS (SELECT motion, tsnr, count(*) AS n, corr(x, y) AS r FROM pairs GROUP BY ALL),
    terms AS (SELECT motion, tsnr, n, r, n % 2 = 0 AS even, unnest(range(0, greatest(n - 2, 2) // 2)) AS k FROM c),
    sums AS (SELECT motion, tsnr, n, r, even, CASE
        WHEN even THEN sum(exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1) + k * ln(1 - r * r))) * abs(r)
        ELSE 2 / pi() * (asin(abs(r)) + abs(r) * sqrt(1 - r * r) * coalesce(sum(CASE WHEN k < (n - 3) // 2 THEN exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5) + k * ln(1 - r * r)) END), 0)) END AS inside
        FROM terms GROUP BY motion, tsnr, n, r, even)
    SELECT motion, tsnr, n, round(r, 6) AS r, round(1 - inside, 6) AS p FROM sums"""


@query(P_SQL)
def pearson_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_pearson(spark, sf_dir), "r", "p")


@query(f"WITH {GRID}, {PAIRS} SELECT motion, tsnr, round(atanh(corr(x, y)), 6) AS z FROM pairs GROUP BY ALL")
def fisher_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_pearson(spark, sf_dir).select("motion", "tsnr", statistics.fisher_z(F.col("r")).alias("z")), "z")


# -- control --------------------------------------------------------------------


@query(f"WITH {BOLD} SELECT session, roi, t, round(value, 6) AS value FROM roi")
def for_stack_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, keys = control.for_each(_roi(spark, sf_dir), ["session", "roi", "t"])
    return _round(control.stack(table, keys), "value")


@query(f"WITH {BOLD} SELECT roi, t, round(value, 6) AS value, session FROM roi")
def stack_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, keys = control.for_each(_roi(spark, sf_dir), ["session", "roi", "t"])
    return _round(control.stack(table, keys, "append"), "value")


@query(f"WITH {BOLD} SELECT session, roi, count(*) AS length, round(arg_min(value, t), 6) AS first_value, round(arg_max(value, t), 6) AS last_value FROM roi GROUP BY ALL")
def dense_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = control.dense_rows(_roi(spark, sf_dir), ["session", "roi"], "t")
    return rows.select("session", "roi", F.size("values").cast("long").alias("length"), F.round(F.element_at("values", 1), 6).alias("first_value"), F.round(F.element_at("values", -1), 6).alias("last_value"))


# -- kernels: the query is a check that has SQL -----------------------------------


LOUVAIN = f"WITH {WEIGHTS} SELECT DISTINCT t, true AS q_agrees, true AS labels_from_one FROM up"


@query(LOUVAIN)
def louvain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernel's Q equals the relational one for its labels, and isn't under that of one module."""
    return _louvain_check(_weights(spark, sf_dir))


#: Customers in groups of forty, all linked within a group and repelled by their like of the next.
_GROUPS = "SELECT c_custkey AS node, CAST(min(c_custkey) OVER (PARTITION BY c_custkey // 40) AS BIGINT) AS c FROM customer"


def _group_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("i"), F.expr("c_custkey div 40").alias("g"))
    tasks = tables.tasks_for(nodes.count() * 20)  # twenty pairs to a node
    left, right = nodes.repartition(tasks, "g"), nodes.withColumnRenamed("i", "j").repartition(tasks, "g")
    inside = left.join(right.hint("merge"), "g").where("i < j").select("g", "i", "j", F.lit(1.0).alias("wt"))
    apart = nodes.join(nodes.select(F.col("i").alias("j")), F.col("j") == F.col("i") + 40).select("g", "i", "j", F.lit(-0.5).alias("wt"))
    return inside.unionByName(apart)


@query(_GROUPS)
def louvain_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as one graph, whose modules the rounds over the edge table find."""
    return large_graphs.louvain(_group_edges(spark, sf_dir).drop("g"))


@query("SELECT c_custkey // 200 AS part, c_custkey AS node, CAST(dense_rank() OVER (PARTITION BY c_custkey // 200 ORDER BY c_custkey // 40) AS INTEGER) AS c FROM customer")
def louvain_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernel on five groups at a time."""
    edges = _group_edges(spark, sf_dir).withColumn("part", F.expr("g div 5")).where("i div 200 = j div 200")
    return community.louvain(edges.select("part", "i", "j", "wt"), ["part"], seed=7).select("part", "node", "c")


def _louvain_check(w: DataFrame) -> DataFrame:
    found = community.louvain(w, ["t"], seed=7)
    q = metrics.modularity(w, found.select("t", "node", "c"), ["t"])
    one = metrics.modularity(w, found.select("t", "node", F.lit(1).alias("c")), ["t"]).withColumnRenamed("q", "q1")
    own = found.groupBy("t").agg(F.max("q").alias("kernel"), F.min("c").alias("low"), F.max("c").alias("high"), F.count_distinct("c").alias("n"))
    return own.join(q, "t").join(one, "t").select("t", ((F.abs(F.col("q") - F.col("kernel")) < 1e-6) & (F.col("kernel") >= F.col("q1") - 1e-9)).alias("q_agrees"), ((F.col("low") == 1) & (F.col("high") == F.col("n"))).alias("labels_from_one"))


def _agreed(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    group = (F.col("p_size") % 4).cast("string")
    parts = part.select(F.expr("p_partkey div 100").alias("block"), F.col("p_partkey").alias("node"), F.posexplode(F.array(group, group, "p_brand")).alias("p", "c"))
    return community.agreement(parts, keys=["block"])


@query("""SELECT block, node, CAST(dense_rank() OVER (PARTITION BY block ORDER BY first) AS INTEGER) AS c
    FROM (SELECT p_partkey // 100 AS block, p_partkey AS node, min(p_partkey) OVER (PARTITION BY p_partkey // 100, p_size % 4) AS first FROM part)""")
def consensus_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels where two of three partitions agree on four groups and the third is the brand: consensus finds the groups, numbered by their first node."""
    return community.consensus(_agreed(spark, sf_dir), ["block"], tau=0.5, reps=20, seed=7).where("p = 0").select("block", "node", "c")


@query("""SELECT block, node, CAST(dense_rank() OVER (PARTITION BY block ORDER BY first) AS INTEGER) AS c
    FROM (SELECT p_partkey // 100 AS block, p_partkey AS node, min(p_partkey) OVER (PARTITION BY p_partkey // 100, p_size % 4) AS first FROM part)""")
def consensus_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of ``consensus_planted``, found by the loop over pair lists of all matrices at once."""
    return large_graphs.consensus(_agreed(spark, sf_dir), ["block"], tau=0.5, reps=3).where("p = 0").select("block", "node", "c")


@query(f"WITH {CI} SELECT block, count(DISTINCT node) AS nodes, 1::INTEGER AS first_label, true AS dense FROM parts GROUP BY block")
def consensus_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part has one label of its matrix, from 1 on without gaps."""
    found = community.consensus(community.agreement(_partitions(spark, sf_dir), keys=["block"]), ["block"], reps=20, seed=7).where("p = 0")
    return found.groupBy("block").agg(F.count_distinct("node").alias("nodes"), F.min("c").alias("first_label"), ((F.count_distinct("c") == F.max("c")) & (F.count("*") == F.count_distinct("node"))).alias("dense"))


@query("SELECT count(*) AS vectors, 10::BIGINT AS labels, true AS inertia_agrees FROM embeddings")
def kmeans_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector has a label, all labels are used, and the inertia is the sum of squared distances to the centers."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("sample"), F.col("embedding").cast("array<double>").alias("features"))
    labels, centers, inertia = clustering.kmeans(e, n_clusters=10, n_init=3)
    off = F.aggregate(F.zip_with("features", "center", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    both = labels.join(e, "sample").join(F.broadcast(centers), "label")
    return both.agg(F.count("*").alias("vectors"), F.count_distinct("label").alias("labels"), (F.abs(F.sum(off) - F.lit(inertia)) <= 1e-6 * F.lit(inertia)).alias("inertia_agrees"))


@query("SELECT c_custkey AS sample, CAST(c_nationkey % 5 AS INTEGER) AS label FROM customer")
def kmeans_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers around five points far apart, told by their balance within: the labels follow from the points' norms."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    group = F.col("c_nationkey") % 5
    vector = F.array((1000.0 * (group + 1)).cast("double"), F.when(group % 2 == 0, 300.0).otherwise(0.0), F.col("c_acctbal") / 1000)
    return clustering.kmeans(c.select(F.col("c_custkey").alias("sample"), vector.alias("features")), n_clusters=5, n_init=10)[0]


#: Hours with an even and with an odd number of events are two states.
_STATES = f"""{HOURS}, hourly AS (SELECT session, t, CAST(count(*) % 2 + 1 AS INTEGER) AS state FROM hours GROUP BY ALL),
    moves AS (SELECT session, t, state, state <> lag(state) OVER (PARTITION BY session ORDER BY t) AS m FROM hourly)"""


@query(f"WITH {_STATES} SELECT session, count(*) AS windows, count(*) FILTER (WHERE state = 2) AS second, count(*) FILTER (WHERE m) AS switch_count FROM moves GROUP BY session")
def states_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States per session from profiles of two kinds, and their switches."""
    hourly = tables.hours(spark, sf_dir).groupBy("session", "t").agg((F.count("*") % 2).alias("odd"), F.avg("value").alias("v"))
    cells = hourly.select("session", F.col("t").alias("sample"), (F.col("odd") * 7 + 3).alias("feature"), (100.0 * (F.col("odd") + 1) + F.col("v") / 100).alias("value"))
    found = clustering.kmeans_by_key(cells, ["session"], n_init=10)
    size = found.groupBy("session").agg(F.count("*").alias("windows"), F.count(F.when(F.col("state") == 2, 1)).alias("second"))
    return size.join(metrics.switch_count(found, ["session"]), "session")


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = tables.hours(spark, sf_dir).groupBy("session", "event_type", (F.col("t") % 24 + 24 * F.floor(F.col("t") / 144)).cast("int").alias("t")).agg(F.avg("value").alias("value"))
    return hourly.select("session", F.pmod(F.xxhash64("event_type"), F.lit(1 << 20)).cast("int").alias("roi"), "t", "value")


@query()
def study_switching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole study on hourly series per session, with few repetitions."""
    return study.switching(_hourly(spark, sf_dir), ["session"], study.Settings(runs=3, reps=3, n_init=3))


DEFINITIONS = f"""{BOLD}, verts AS (SELECT DISTINCT session, vertex FROM bold),
    labels AS (SELECT 'surface' AS definition, session, vertex, CAST(vertex % 12 AS INTEGER) AS roi FROM verts UNION ALL SELECT 'volume', session, vertex, CAST(vertex % 10 AS INTEGER) FROM verts
        UNION ALL SELECT 'own labels', session, vertex, CAST((vertex + session) % 12 AS INTEGER) FROM verts UNION ALL SELECT 'own labels, matched', session, vertex, CAST((vertex + 2 * session) % 12 AS INTEGER) FROM verts),
    parcels AS (SELECT definition, session, roi, t, avg(value) AS value FROM bold JOIN labels USING (session, vertex) WHERE roi <> 0 GROUP BY ALL)"""


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcel series under four definitions: two atlases of all, two of each session's own."""
    bold = tables.event_bold(spark, sf_dir)
    atlas = tables.event_atlas(spark, sf_dir)
    own = bold.select("session", "vertex").distinct()
    named = lambda df, roi: df.withColumn("roi", roi.cast("int"))
    return study.definitions(
        {
            "surface": (bold, atlas),
            "volume": (bold, named(atlas, F.col("vertex") % 10)),
            "own labels": (bold, named(own, (F.col("vertex") + F.col("session")) % 12)),
            "own labels, matched": (bold, named(own, (F.col("vertex") + 2 * F.col("session")) % 12)),
        },
        ["session"],
    )


@query(f"WITH {DEFINITIONS} SELECT definition, session, roi, t, round(value, 6) AS value FROM parcels")
def definition_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_definitions(spark, sf_dir), "value")


#: Switches of each parcel and session under all sixteen pipelines.
PIPELINES = f"""{DEFINITIONS},
    moves AS (SELECT definition, roi AS subject, session, state <> lag(state) OVER (PARTITION BY definition, session, roi ORDER BY t) AS m FROM (SELECT *, CASE WHEN value > 50 THEN 2 ELSE 1 END AS state FROM parcels)),
    counted AS (SELECT definition, subject, session, count(*) FILTER (WHERE m) AS switch_count FROM moves GROUP BY ALL),
    motion AS (SELECT DISTINCT user_id % 12 AS subject, session FROM hours WHERE event_type = 'error' AND value > 90 AND user_id % 12 < 4),
    each AS (SELECT definition, session, roi AS subject, avg(value) / nullif(stddev_samp(value), 0) AS tsnr FROM parcels GROUP BY ALL),
    good AS (SELECT definition, session, subject FROM (SELECT *, coalesce(abs(tsnr - avg(tsnr) OVER w) <= 1.0 * stddev_samp(tsnr) OVER w, false) AS keep FROM each WINDOW w AS (PARTITION BY definition, session)) WHERE keep),
    flags AS (SELECT c.*, m.subject IS NOT NULL AS moved, g.subject IS NOT NULL AS fine FROM counted c LEFT JOIN motion m USING (subject, session) LEFT JOIN good g USING (definition, subject, session)),
    grid AS (SELECT f.*, v.motion, v.tsnr FROM flags f, (VALUES (false, false), (false, true), (true, false), (true, true)) AS v(motion, tsnr) WHERE NOT (v.motion AND moved) AND (NOT v.tsnr OR fine))"""
PIPELINE = ["definition", "motion", "tsnr"]


def _pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parcels = _definitions(spark, sf_dir).withColumnRenamed("roi", "subject")
    keys = ["definition", "subject", "session"]
    counted = metrics.switch_count(parcels.withColumn("state", F.when(F.col("value") > 50, 2).otherwise(1)), keys)
    motion = tables.hours(spark, sf_dir).where("event_type = 'error' and value > 90 and user_id % 12 < 4").select((F.col("user_id") % 12).cast("int").alias("subject"), "session").distinct()
    features = preprocessing.tsnr(parcels, ["definition", "session"], 1.0, "subject")
    return study.variants(counted, motion, features, keys)


@query(f"WITH {PIPELINES} SELECT definition, motion, tsnr, count(*) AS n, round(avg(switch_count), 6) AS mean, round(stddev_samp(switch_count), 6) AS sd FROM grid GROUP BY ALL")
def pipeline_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sixteen pipelines, four definitions by four variants, in one plan: switches of each parcel and session."""
    return _round(study.group_spread(_pipelines(spark, sf_dir), PIPELINE), "mean", "sd")


ICC_BY = ICC.replace("motion, tsnr", "definition, motion, tsnr")


@query(f"""WITH {PIPELINES}, {ICC_BY},
    spread AS (SELECT definition, motion, tsnr, count(*) AS n, avg(switch_count) AS mean, stddev_samp(switch_count) AS sd FROM grid GROUP BY ALL),
    pairs AS (SELECT definition, motion, tsnr, avg(switch_count) AS x, any_value(c_acctbal) AS y FROM grid JOIN customer ON c_custkey = subject GROUP BY definition, motion, tsnr, subject),
    related AS (SELECT definition, motion, tsnr, count(*) AS m, corr(x, y) AS r FROM pairs GROUP BY ALL),
    terms AS (SELECT definition, motion, tsnr, m, r, m % 2 = 0 AS even, unnest(range(0, greatest(m - 2, 2) // 2)) AS k FROM related),
    sums AS (SELECT definition, motion, tsnr, r, CASE
        WHEN even THEN sum(exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1) + k * ln(1 - r * r))) * abs(r)
        ELSE 2 / pi() * (asin(abs(r)) + abs(r) * sqrt(1 - r * r) * coalesce(sum(CASE WHEN k < (m - 3) // 2 THEN exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5) + k * ln(1 - r * r)) END), 0)) END AS inside
        FROM terms GROUP BY definition, motion, tsnr, m, r, even)
    SELECT definition, motion, tsnr, s.n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(icc, 6) AS icc,
        CASE WHEN icc < 0.4 THEN 'poor' WHEN icc < 0.6 THEN 'fair' WHEN icc < 0.75 THEN 'good' WHEN icc IS NOT NULL THEN 'excellent' END AS grade, round(r, 6) AS r, round(1 - inside, 6) AS p
    FROM spread s LEFT JOIN icc USING (definition, motion, tsnr) LEFT JOIN sums USING (definition, motion, tsnr)""")
def pipeline_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The study's table of results: mean, sd, reliability with its grade, and the correlation with a score, of each of the sixteen pipelines."""
    scores = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("subject"), F.col("c_acctbal").alias("score"))
    return _round(study.reliability(_pipelines(spark, sf_dir), scores, "score", PIPELINE), "mean", "sd", "icc", "r", "p")


@query(f"""WITH {HOURS}, h AS (SELECT DISTINCT session, event_type, t % 24 + 24 * (t // 144) AS t FROM hours),
    meets AS (SELECT a.session, a.event_type AS x, b.event_type AS y, a.t FROM h a JOIN h b ON a.session = b.session AND a.t = b.t AND a.event_type < b.event_type),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY session, event_type ORDER BY t) AS n FROM h),
    pairs AS (SELECT session, t, count(*) FILTER (WHERE fa > 1 AND fb > 1) OVER (PARTITION BY session, x, y ORDER BY t ROWS BETWEEN 7 PRECEDING AND 6 FOLLOWING) AS have
        FROM (SELECT b.*, ra.n AS fa, rb.n AS fb FROM meets b JOIN ranked ra ON ra.session = b.session AND ra.event_type = x AND ra.t = b.t JOIN ranked rb ON rb.session = b.session AND rb.event_type = y AND rb.t = b.t))
    SELECT session, count(DISTINCT t) AS windows, true AS states_in_range, true AS inertia_agrees, true AS counts_agree FROM pairs WHERE have = 14 GROUP BY session""")
def states_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The study's states per session against relational sums: their number, the inertia of the labelled profiles, and the switches of the labels."""
    few = study.Settings(runs=3, reps=3, n_init=3)
    cells = study.profiles(_hourly(spark, sf_dir), ["session"], few)
    found = clustering.kmeans_by_key(cells, ["session"], few.n_clusters, few.n_init, seed=few.seed)
    size = found.groupBy("session", "state").agg(F.count("*").alias("size"))
    named = cells.join(found.select("session", F.col("t").alias("sample"), "state"), ["session", "sample"])
    sums = named.groupBy("session", "state", "feature").agg(F.sum(F.col("value") * F.col("value")).alias("square"), F.sum("value").alias("sum")).join(size, ["session", "state"])
    within = sums.groupBy("session").agg(F.sum(F.col("square") - F.col("sum") * F.col("sum") / F.col("size")).alias("within"))
    seen = found.groupBy("session").agg(F.count("*").alias("windows"), F.max("inertia").alias("inertia"), F.min("state").alias("low"), F.max("state").alias("high"))
    lists = found.groupBy("session").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "state"))), lambda x: x["state"]).alias("s"))
    moves = lists.select("session", F.size(F.filter(F.zip_with(F.slice("s", 2, 1 << 30), F.slice("s", F.lit(1), F.size("s") - 1), lambda a, b: a != b), lambda x: x)).cast("long").alias("moves"))
    counts = metrics.switch_count(found, ["session"]).join(moves, "session").select("session", (F.col("switch_count") == F.col("moves")).alias("counts_agree"))
    each = within.join(seen, "session").join(counts, "session")
    ok = {"states_in_range": (F.col("low") == 1) & (F.col("high") <= 2), "inertia_agrees": F.abs(F.col("within") - F.col("inertia")) <= 1e-6 * (1 + F.col("inertia")), "counts_agree": F.col("counts_agree")}
    return each.select("session", "windows", *(c.alias(n) for n, c in ok.items()))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All coupling slices, their node metrics under fixed communities, and the profile of each."""
    w = _weights(spark, sf_dir)
    modules = _modules(w)
    nodes = metrics.participation(w, modules, ["t"]).join(metrics.module_z(w, modules, ["t"]), ["t", "node"])
    return metrics.cartography(nodes.select("t", "node", F.col("p_pos").alias("bt"), F.col("z").alias("wt")))
