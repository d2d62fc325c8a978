"""Reliability and correlation statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def icc21(scores: DataFrame, by: Sequence[str] = (), subject: str = "subject", session: str = "session", value: str = "value") -> DataFrame:
    """(by, n, k, icc): two-way random, single-measure reliability over subjects with all sessions.

    Subjects are summed up once, as their mean and their scores' distances to it, then
    sessions over the subjects with as many scores, and of these sums those of the subjects with all sessions count; no
    rows are joined back. Every sum adds up in the tasks first. A group without such subjects has no row.
    """
    by = list(by)
    known = scores.where(F.col(value).isNotNull())
    each = known.groupBy(*by, subject).agg(F.avg(value).alias("_s"), F.collect_list(F.struct(F.col(session).alias("j"), F.col(value).cast("double").alias("x"))).alias("_x"))  # a subject's sessions are few
    long = each.select(*by, "_s", F.size("_x").alias("_m"), F.explode("_x").alias("_x")).withColumn("_d", F.col("_x.x") - F.col("_s"))
    per = long.groupBy(*by, "_m", F.col("_x.j").alias("_j")).agg(F.count("*").alias("n"), F.avg("_d").alias("d"), F.sum(F.col("_d") * F.col("_d")).alias("q"), F.var_pop("_s").alias("v"))
    # of each number of scores a row per session: their number is the largest
    whole = per.groupBy(*by).agg(F.count_distinct("_j").alias("k"), F.collect_list(F.struct(F.col("_m").alias("m"), "n", "d", "q", "v")).alias("_r"))
    full = whole.select(*by, "k", F.filter("_r", lambda r: r["m"] == F.col("k")).alias("_r")).where(F.size("_r") > 0)
    total = lambda f: F.aggregate("_r", F.lit(0.0), lambda s, r: s + f(r))
    sums = full.select(*by, F.element_at("_r", 1)["n"].alias("n"), "k", F.element_at("_r", 1)["v"].alias("v"), total(lambda r: r["d"] * r["d"]).alias("cols"), total(lambda r: r["q"]).alias("within"))
    n, k = F.col("n"), F.col("k")
    cols = n * F.col("cols")
    msr, msc = F.try_divide(k * n * F.col("v"), n - 1), F.try_divide(cols, k - 1)
    mse = F.try_divide(F.col("within") - cols, (n - 1) * (k - 1))
    icc = F.try_divide(msr - mse, msr + (k - 1) * mse + k * (msc - mse) / n)
    return sums.select(*by, n.alias("n"), k.alias("k"), icc.alias("icc"))


def icc_grade(icc: Column) -> Column:
    """Bands at .40, .60 and .75."""
    return F.when(icc < 0.40, "poor").when(icc < 0.60, "fair").when(icc < 0.75, "good").when(icc.isNotNull(), "excellent")


def fisher_z(r: Column) -> Column:
    return F.atanh(r)


def _beta_tail(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value


@F.pandas_udf(T.DoubleType())
def _p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    def one(r: float, n: float) -> float | None:
        if r != r or n < 3:
            return None
        if abs(r) >= 1:
            return 0.0
        t2 = r * r * (n - 2) / (1 - r * r)
        return _beta_tail((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))

    return pd.Series([one(a, b) for a, b in zip(r, n)], dtype="float64")


def pearson(table: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, r, p) over complete pairs, p two-sided; both null under two pairs."""
    have = table.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = have.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))
    out = out.withColumn("r", F.when((F.col("n") >= 2) & ~F.isnan("r"), F.col("r")))
    return out.withColumn("p", _p_value("r", F.col("n").cast("double")))


def describe(table: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, mean, sd)."""
    return table.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
