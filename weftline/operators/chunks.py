"""Signals as chunks: a block of vertices by a block of frames in one array.

A chunk (keys, vb, tb, frames, values) holds ``values[v * frames + t]`` of the vertices
from ``vb * vertices`` and the frames from ``tb * block`` on; NaN is a missing
value. A row for each chunk instead of one for each vertex and frame makes signals a few
thousand times fewer rows, and a mean per parcel a product with the block of
the atlas that belongs to the chunk. Only sums per parcel leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

VERTICES, FRAMES = 1024, 256
BACKGROUND = 0
#: Values of parcel sums that a task holds before it passes them on.
HELD = 4_000_000


def to_chunks(bold: DataFrame, keys: Sequence[str] = (), vertices: int = VERTICES, frames: int = FRAMES) -> DataFrame:
    """Chunks of a long table (keys, vertex, t, value); vertices and times count from 0, of equal cells one value is taken. This is the one exchange of the signals, made when they are laid out."""
    keys = list(keys)
    cells = bold.where(F.col("value").isNotNull()).select(*keys, F.expr(f"cast(vertex div {vertices} as int)").alias("vb"), F.expr(f"cast(t div {frames} as int)").alias("tb"), ((F.col("vertex") % vertices) * frames + F.col("t") % frames).cast("int").alias("at"), F.col("value").cast("double").alias("value"))
    kinds = [to_arrow_type(bold.schema[k].dataType) for k in keys]

    def one(key: tuple, table: pa.Table) -> pa.Table:
        values = np.full(vertices * frames, np.nan)
        values[table.column("at").to_numpy()] = table.column("value").to_numpy()
        own = [pa.array([k.as_py()], kind) for k, kind in zip(key, [*kinds, pa.int32(), pa.int32()])]
        array = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))
        return pa.Table.from_arrays([*own, pa.array([frames], pa.int32()), array], names=[*keys, "vb", "tb", "frames", "values"])

    schema = T.StructType([*(bold.schema[k] for k in keys), *(T.StructField(c, T.IntegerType()) for c in ("vb", "tb", "frames")), T.StructField("values", T.ArrayType(T.DoubleType()))])
    return cells.groupBy(*keys, "vb", "tb").applyInArrow(one, schema)


def to_long(chunks: DataFrame, keys: Sequence[str] = (), vertices: int = VERTICES, frames: int = FRAMES) -> DataFrame:
    """(keys, vertex, t, value) of chunks, without missing values."""
    each = chunks.select(*keys, "vb", "tb", "frames", F.posexplode("values").alias("at", "value")).where(~F.isnan("value"))
    vertex, t = F.expr("at div frames") + F.col("vb") * vertices, F.col("at") % F.col("frames") + F.col("tb") * frames
    return each.select(*keys, vertex.cast("long").alias("vertex"), t.cast("int").alias("t"), "value")


def atlas_blocks(atlas: DataFrame, keys: Sequence[str] = (), vertices: int = VERTICES) -> DataFrame:
    """(keys, vb, at, roi): the labelled vertices of each block as two arrays, from (keys, vertex, roi) without background."""
    pair = F.sort_array(F.collect_list(F.struct("roi", (F.col("vertex") % vertices).cast("int").alias("at"))))
    own = [k for k in keys if k in atlas.columns]
    blocks = atlas.where(F.col("roi") != BACKGROUND).groupBy(*own, F.expr(f"cast(vertex div {vertices} as int)").alias("vb")).agg(pair.alias("p"))
    return blocks.select(*own, "vb", F.col("p.at").alias("at"), F.col("p.roi").cast("array<int>").alias("roi"))


def save_bucketed(table: DataFrame, name: str, path: str, by: Sequence[str], buckets: int) -> DataFrame:
    """The table under a name, bucketed and sorted by some columns; two tables of the same buckets are joined on them without an exchange."""
    table.write.bucketBy(buckets, *by).sortBy(*by).option("path", path).mode("overwrite").saveAsTable(name)
    return table.sparkSession.table(name)


def extract_roi(chunks: DataFrame, blocks: DataFrame, keys: Sequence[str] = (), frames: int = FRAMES) -> DataFrame:
    """(keys, roi, t, value): the mean of each parcel's vertices at each frame, of chunks and ``atlas_blocks``.

    Blocks that have some of the keys are joined on them too. A mean leaves missing
    values out; a parcel without any at a frame has no row. Signals stay where they are where the blocks
    are broadcast or both sides are bucketed alike.
    """
    keys = list(keys)
    on = [*(k for k in keys if k in blocks.columns), "vb"]
    joined = chunks.join(blocks, on).select(*keys, "tb", "frames", "values", "at", "roi")
    out = T.StructType([*(chunks.schema[k] for k in keys), T.StructField("tb", T.IntegerType()), T.StructField("roi", T.IntegerType()), T.StructField("sums", T.ArrayType(T.DoubleType())), T.StructField("counts", T.ArrayType(T.LongType()))])
    kinds = [to_arrow_type(f.dataType) for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*((*key, *sums) for key, sums in held.items())))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=out.names)

        for batch in batches:
            own = list(zip(*(batch.column(k).to_pylist() for k in [*keys, "tb"])))
            for i, key in enumerate(own):
                n = batch.column("frames")[i].as_py()
                x = batch.column("values")[i].values.to_numpy().reshape(-1, n)
                at, roi = (batch.column(c)[i].values.to_numpy() for c in ("at", "roi"))
                at, roi = at[at < len(x)], roi[at < len(x)]
                if not len(at):
                    continue
                rows = x[at]
                have = ~np.isnan(rows)
                starts = np.flatnonzero(np.concatenate([[True], roi[1:] != roi[:-1]]))
                sums = np.add.reduceat(np.where(have, rows, 0.0), starts, axis=0)
                counts = np.add.reduceat(have.astype(np.int64), starts, axis=0)
                for k, r in enumerate(roi[starts].tolist()):
                    seen = held.get((*key, r))
                    if seen is None:
                        held[(*key, r)] = (sums[k], counts[k])
                        size += 2 * n
                    else:
                        held[(*key, r)] = (seen[0] + sums[k], seen[1] + counts[k])
            if size > HELD:
                yield flush()
                size = 0
        if held:
            yield flush()

    def added(column: str, kind: str):
        """Arrays of a parcel and block added element by element; there is one from each task at most."""
        zero = F.array_repeat(F.lit(0).cast(kind), F.size(F.element_at(F.col(column), 1)))
        return F.aggregate(column, zero, lambda a, b: F.zip_with(a, b, lambda x, y: x + y))

    partial = joined.mapInArrow(run, out)
    whole = partial.groupBy(*keys, "roi", "tb").agg(F.collect_list("sums").alias("sums"), F.collect_list("counts").alias("counts"))
    means = F.zip_with(added("sums", "double"), added("counts", "bigint"), lambda s, n: F.when(n > 0, s / n))
    each = whole.select(*keys, "roi", "tb", F.posexplode(means).alias("j", "value")).where("value is not null")
    return each.select(*keys, "roi", (F.col("tb") * frames + F.col("j")).cast("int").alias("t"), "value")
