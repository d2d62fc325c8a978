"""Reading and writing the study's tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.control import extents

# The layouts of the study's files and the names of its spaces.
BOLD = "subject int, session int, vertex int, t int, value double"
MAPPING = "Kong_Index int, Kong_ROI_Name string, Schaefer2018_Best_Match string, Dice double"
BEHAVIOUR = "subject string, N int, E int, O int, A int, C int, caq int, cbq int, raven int"
SPACES = ("fsaverage6", "fsaverage5", "MNI152NLin2009cAsym")


def read_bold(spark: SparkSession, path: str, space: str = "fsaverage6") -> DataFrame:
    """The signal table of one space, partitioned by subject and session on disk, so a filter on them skips files."""
    if space not in SPACES:
        raise ValueError(f"space must be one of {SPACES}")
    return spark.read.schema(BOLD).parquet(path)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, removed when the driver ends: under ``spark.checkpoint.dir``, or for a local session the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = f"{(named or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/study-{uuid.uuid4().hex}"
    place, files = _hadoop(spark, folder)
    files.deleteOnExit(place)
    return folder


def _hadoop(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def kept(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """The frame as a table in the shared folder, so what follows doesn't compute it again and a loop's plan doesn't grow; the table of an earlier round is removed."""
    spark = df.sparkSession
    folder = scratch_folder(spark)
    df.write.parquet(folder)
    out = spark.read.parquet(folder)
    out.kept_in = folder
    if instead_of is not None:
        place, files = _hadoop(spark, instead_of.kept_in)
        files.delete(place, True)
    return out


#: Rows of a step that one task should have, where a step makes more rows than it reads.
TASK_ROWS = 500_000


def tasks_for(rows: int | None) -> int:
    """So many tasks that each has about ``TASK_ROWS`` rows. Spark sizes tasks by what a step reads, and joins of small tables in as many as have files."""
    return max(1, -(-int(rows or 0) // TASK_ROWS))


def scan_extents(bold: DataFrame) -> DataFrame:
    """(axis, size) of a signal table."""
    return extents(bold, ["subject", "session", "vertex", "t"])


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """The parcel mapping between two atlases, with the network of each parcel from its name."""
    raw = spark.read.schema(MAPPING).csv(path, header=True)
    network = lambda c: F.element_at(F.split(c, "_"), 3)
    return raw.select(
        F.col("Kong_Index").alias("roi"), F.col("Kong_ROI_Name").alias("name"), F.col("Schaefer2018_Best_Match").alias("target_name"), F.col("Dice").alias("dice"),
        F.when(F.col("Kong_ROI_Name") != "Background", network("Kong_ROI_Name")).alias("network"), F.when(F.col("Schaefer2018_Best_Match") != "Background", network("Schaefer2018_Best_Match")).alias("target_network"),
    )


def read_behaviour(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BEHAVIOUR).csv(path, header=True)


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Sessions to leave out, one "subject session" or "subject,session" a line."""
    parts = F.split(F.trim("value"), r"[\s,]+")
    lines = spark.read.text(path).where(F.trim("value").rlike(r"^[^#\s]"))
    return lines.select(F.element_at(parts, 1).alias("subject"), F.try_element_at(parts, F.lit(2)).alias("session"))


def write_sessions(table: DataFrame, path: str, form: str = "csv", keys: Sequence[str] = ("subject", "session")) -> None:
    """One folder per session, written by the tasks that have its rows."""
    writer = table.write.mode("overwrite").partitionBy(*keys)
    if form == "csv":
        writer.option("header", True).csv(path)
    elif form in ("json", "parquet"):
        getattr(writer, form)(path)
    else:
        raise ValueError(f"unknown form {form!r}")


def write_statistics(table: DataFrame, path: str) -> None:
    """A small result as JSON."""
    table.write.mode("overwrite").json(path)


# -- the driver's tables in the study's roles ------------------------------


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with subject, session (day % 6), vertex (user) and t (hour from the start of 2024)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("int")
    return events.select("event_id", "user_id", "event_type", "value", "ts", t.alias("t")).withColumn("session", (F.floor(F.col("t") / 24) % 6).cast("int"))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(roi, t, value): the hourly mean of each event type, 0.0 where it has none; types are numbered by name."""
    mean = hours(spark, sf_dir).groupBy("event_type", "t").agg(F.avg("value").alias("value"))
    types = mean.select("event_type").distinct()
    earlier = types.withColumnRenamed("event_type", "other")
    # the types are the event log's fixed vocabulary, a handful
    numbered = types.join(F.broadcast(earlier), F.col("other") < F.col("event_type"), "left").groupBy("event_type").agg(F.count("other").cast("int").alias("roi"))
    grid = numbered.crossJoin(F.broadcast(mean.agg(F.max("t").alias("last")))).select("event_type", "roi", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("t"))
    return grid.join(mean, ["event_type", "t"], "left").select("roi", "t", F.coalesce("value", F.lit(0.0)).alias("value"))


def event_bold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, vertex, t, value): hourly mean per user."""
    return hours(spark, sf_dir).groupBy("session", F.col("user_id").alias("vertex"), "t").agg(F.avg("value").alias("value"))


def event_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vertex, roi): user modulo 12, where 0 is background."""
    return hours(spark, sf_dir).select(F.col("user_id").alias("vertex")).distinct().withColumn("roi", (F.col("vertex") % 12).cast("int"))


def event_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, ts, event_id, state): 2 for values over 50, else 1."""
    return hours(spark, sf_dir).select("user_id", "session", "ts", "event_id", F.when(F.col("value") > 50, 2).otherwise(1).alias("state"))
