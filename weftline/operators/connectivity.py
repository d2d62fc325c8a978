"""Time-resolved coupling by multiplication of temporal derivatives."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type


def derivative_coupling(series: DataFrame, keys: Sequence[str] = (), window: int = 14, direction: str = "centered", trim: bool = True, declared_length: bool = False) -> DataFrame:
    """(keys, i, j, t, value) for i <= j from series (keys, roi, t, value).

    Derivatives are differences in time, scaled by their sample sd; their
    products are averaged over ``window`` frames, centered or forward. Trimmed
    output has full windows alone, T - window per pair (one less with
    ``declared_length``); otherwise the other times hold 0.0. A constant
    series has no scale, and its pairs no full window.
    """
    if window < 2 or direction not in ("centered", "forward"):
        raise ValueError("window must be at least 2, direction centered or forward")
    own = W.partitionBy(*keys, "roi")
    d = series.withColumn("d", F.col("value") - F.lag("value").over(own.orderBy("t")))
    z = d.select(*keys, "roi", "t", F.try_divide(F.col("d"), F.nullif(F.stddev_samp("d").over(own), F.lit(0.0))).alias("z"))
    left = z.select(*keys, F.col("roi").alias("i"), "t", F.col("z").alias("zi"))
    right = z.select(*keys, F.col("roi").alias("j"), "t", F.col("z").alias("zj"))
    # equal join on time; only the upper triangle is made
    pairs = left.join(right, [*keys, "t"]).where("i <= j").withColumn("p", F.col("zi") * F.col("zj"))
    half = window // 2
    frame = (0, window - 1) if direction == "forward" else (-half, window - 1 - half)
    order = W.partitionBy(*keys, "i", "j").orderBy("t")
    over = order.rowsBetween(*frame)
    full = F.count("p").over(over) == window
    out = pairs.select(*keys, "i", "j", "t", full.alias("full"), F.avg("p").over(over).alias("value"))
    if not trim:
        return out.select(*keys, "i", "j", "t", F.when(F.col("full"), F.col("value")).otherwise(0.0).alias("value"))
    out = out.where("full").drop("full")
    if declared_length:
        last = F.max("t").over(W.partitionBy(*keys, "i", "j"))
        out = out.withColumn("_last", last).where("t < _last").drop("_last")
    return out


def coupling_blocks(series: DataFrame, keys: Sequence[str] = (), window: int = 14, direction: str = "centered", parcels: int = 128, frames: int = 256) -> DataFrame:
    """(keys, i, j, tb, values) for i <= j: a pair's coupling over a block of frames as one array, null where no full window is.

    Scaled derivatives are dealt to blocks of parcels by blocks of frames, each with
    the window - 1 frames around it that its windows reach into; so what is shuffled is the series, once for each block of
    partners, and not its pairs. Within a pair of blocks windows are differences of running sums. Frames
    are whole numbers from 0; a frame that a parcel lacks is a missing value, and no window over it is
    full. Values are those of ``derivative_coupling``; ``blocks_to_long`` gives its rows.
    """
    if window < 2 or direction not in ("centered", "forward"):
        raise ValueError("window must be at least 2, direction centered or forward")
    keys = list(keys)
    own = W.partitionBy(*keys, "roi")
    before = F.lag(F.struct("t", "value")).over(own.orderBy("t"))
    d = series.select(*keys, "roi", "t", F.when(before["t"] == F.col("t") - 1, F.col("value") - before["value"]).alias("d"))
    z = d.select(*keys, "roi", "t", F.try_divide(F.col("d"), F.nullif(F.stddev_samp("d").over(own), F.lit(0.0))).alias("z")).where("z is not null")
    left = 0 if direction == "forward" else window // 2  # frames of a window before its own
    right = window - 1 - left
    # a frame goes to its own block and to the neighbours whose windows reach it
    tb = F.explode(F.array_distinct(F.filter(F.array(*(F.expr(f"cast((t + {x}) div {frames} as int)") for x in (-right, 0, left))), lambda b: b >= 0)))
    if window > frames:
        raise ValueError("a block needs as many frames as a window")
    rb = F.expr(f"cast(roi div {parcels} as int)")
    placed = z.select(*keys, "roi", "t", "z", rb.alias("rb")).select("*", tb.alias("tb"))
    # a block of parcels meets every other one, the first of the two by number
    last = series.agg(F.max(rb)).first()[0]
    others = F.explode(F.sequence(F.lit(0), F.lit(last if last is not None else 0)))
    pairs = placed.withColumn("ob", others).select(*keys, "tb", F.least("rb", "ob").alias("a"), F.greatest("rb", "ob").alias("b"), "roi", "t", "z")
    kinds = [to_arrow_type(series.schema[k].dataType) for k in keys]
    roi_kind = series.schema["roi"].dataType
    out = T.StructType([*(series.schema[k] for k in keys), T.StructField("i", roi_kind), T.StructField("j", roi_kind), T.StructField("tb", T.IntegerType()), T.StructField("values", T.ArrayType(T.DoubleType()))])

    def one(key: tuple, table: pa.Table) -> pa.Table:
        *k, t_block, a, b = (x.as_py() for x in key)
        rois, row = np.unique(table.column("roi").to_numpy(), return_inverse=True)
        x = np.full((len(rois), frames + window - 1), np.nan)
        at = table.column("t").to_numpy() - t_block * frames + left
        inside = (at >= 0) & (at < x.shape[1])
        x[row[inside], at[inside]] = table.column("z").to_numpy()[inside]
        lists, pairs_i, pairs_j = [], [], []
        first, second = np.flatnonzero(rois // parcels == a), np.flatnonzero(rois // parcels == b)
        for i in first.tolist():
            with_ = second[rois[second] >= rois[i]]
            if not len(with_):
                continue
            p = x[i] * x[with_]
            have = ~np.isnan(p)
            total = np.cumsum(np.pad(np.where(have, p, 0.0), ((0, 0), (1, 0))), axis=1)
            count = np.cumsum(np.pad(have.astype(np.int32), ((0, 0), (1, 0))), axis=1)
            full = count[:, window:] - count[:, :-window] == window
            mean = np.where(full, (total[:, window:] - total[:, :-window]) / window, np.nan)
            lists.append(mean)
            pairs_i.append(np.full(len(with_), rois[i]))
            pairs_j.append(rois[with_])
        if not lists:
            return out_schema.empty_table()
        values = np.concatenate(lists)
        flat = pa.array(values.ravel(), mask=np.isnan(values.ravel()))
        n = len(values)
        columns = [*(pa.array([v] * n, kind) for v, kind in zip(k, kinds)), pa.array(np.concatenate(pairs_i), out_schema.field("i").type), pa.array(np.concatenate(pairs_j), out_schema.field("j").type), pa.array([t_block] * n, pa.int32())]
        return pa.Table.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * frames, pa.int32()), flat)], schema=out_schema)

    out_schema = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in out])
    return pairs.groupBy(*keys, "tb", "a", "b").applyInArrow(one, out)


def blocks_to_long(blocks: DataFrame, keys: Sequence[str] = (), frames: int = 256) -> DataFrame:
    """(keys, i, j, t, value) of full windows."""
    each = blocks.select(*keys, "i", "j", "tb", F.posexplode("values").alias("at", "value")).where("value is not null")
    return each.select(*keys, "i", "j", (F.col("tb") * frames + F.col("at")).cast("int").alias("t"), "value")


def mirror(upper: DataFrame) -> DataFrame:
    """The full symmetric matrix of an upper triangle (i, j)."""
    swapped = [F.col("j").alias("i") if c == "i" else F.col("i").alias("j") if c == "j" else F.col(c) for c in upper.columns]
    return upper.unionByName(upper.where("i <> j").select(*swapped))
