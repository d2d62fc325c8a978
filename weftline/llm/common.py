"""Shared helpers of the corpus operators.

Conventions that hold for every operator here:

* a null text counts as an empty text;
* operators that change or annotate rows replace columns of the names they add and
  pass all others through untouched; those that report on rows (quality figures,
  near duplicates, repeated passages, token counts, leaks, rankings, manifests, mixtures) return their
  own columns alone, whatever further ones the input has;
* repeated rows are kept as they are, each with its own result;
* an empty table gives an empty table of the same schema.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of text that a Python step holds at once, besides a single longer text.
SLICE_BYTES = 1 << 20
ROW_GROUP_BYTES = 8 << 20

_SPACES = re.compile(r"[\x09-\x0d]")


def split_words(text: str | None) -> list[str]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    if not text:
        return []
    if _SPACES.search(text):
        text = _SPACES.sub(" ", text)
    return [w for w in text.split(" ") if w]


def fresh_name(df: DataFrame, name: str) -> str:
    """The name, with underscores until no column has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values; seeds give unrelated orders."""
    x = x ^ np.uint64((seed * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def window_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` word hashes, by doubling, so that long windows cost their logarithm."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    done, part, span, rest = None, mix(words, seed + 1), 1, width
    at = 0
    while rest:
        if rest & 1:
            piece = part[at : at + n]
            done = piece.copy() if done is None else mix(done * _MIX + piece, seed + 2)
            at += span
        rest >>= 1
        if rest:
            part = mix(part[: len(part) - span] * _MIX + part[span:], seed + 3)
            span *= 2
    return done


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``column`` holds about ``most`` bytes in each, or list elements if it holds lists."""
    for batch in batches:
        values = batch.column(column)
        length = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
        sizes = pc.fill_null(length(values), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def with_columns(df: DataFrame, column: str, fields: Sequence[T.StructField], make: Callable[[], Callable[[pa.Array], list]], most: int = SLICE_BYTES) -> DataFrame:
    """Add ``fields`` to each row, computed from the values of ``column`` a slice of rows at a time.

    ``make`` builds, once per task, the function from an Arrow array of values to
    one Arrow array (or list) per field.
    """
    names = [f.name for f in fields]
    kept = [f for f in df.schema.fields if f.name.lower() not in {n.lower() for n in names}]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    cols = [f.name for f in kept] + names
    read = column if column in [f.name for f in kept] else fresh_name(df, "_source")
    source = df if read == column else df.withColumn(read, df[column])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in slices(batches, read, most):
            step = step or make()
            made = step(batch.column(read))
            made = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, k) for x, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *made], names=cols)

    return source.mapInArrow(run, T.StructType([*kept, *fields]))


class Utf8:
    """The bytes of a slice of a text column, one text after another, with the bounds of each; a null text is empty."""

    def __init__(self, column: pa.Array, lower: bool = False):
        if column.null_count:
            column = pc.fill_null(column, "")
        wide = pa.types.is_large_string(column.type)
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        first, self.n = int(bounds[0]), int(bounds[-1] - bounds[0])
        self.bounds = bounds - first
        #: Zeros after the last byte let eight bytes be read from any place.
        self.raw = np.zeros((self.n + 23) // 8 * 8, np.uint8)
        if self.n:
            own = np.frombuffer(data, np.uint8, self.n, first)
            self.raw[: self.n] = _LOWER[own] if lower else own

    def opens(self) -> np.ndarray:
        """Where texts that aren't empty start."""
        return self.bounds[:-1][np.diff(self.bounds) > 0]

    def words(self, between: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Where the words ``[^\\x20\\x09-\\x0D]+`` begin and end, or those of other bytes than a table of 256 flags sets."""
        inside = ~(_BLANK if between is None else between)[self.raw[: self.n]]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        opens = self.opens()
        begin[opens] = inside[opens]
        closes = opens[1:] - 1
        end[closes] = inside[closes]
        return np.flatnonzero(begin), np.flatnonzero(end) + 1

    def per_text(self, places: np.ndarray) -> np.ndarray:
        """How many of these ascending places each text has."""
        return np.diff(np.searchsorted(places, self.bounds))

    def _eight(self, at: np.ndarray) -> np.ndarray:
        """The eight bytes from each place on as a number."""
        whole = self.raw.view(np.uint64)
        cell, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        return (whole[cell] >> shift) | ((whole[cell + 1] << (np.uint64(63) - shift)) << np.uint64(1))

    def hashes(self, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of the bytes of each span, eight at a time."""
        size = end - begin
        out = mix((self._eight(begin) & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * _MIX, seed)
        far = np.flatnonzero(size > 256)
        for i in far.tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.raw[begin[i] : end[i]].tobytes(), seed)
        left, at = np.flatnonzero((size > 8) & (size <= 256)), 8
        while len(left):
            rest = size[left] - at
            out[left] = mix(out[left] * _MIX + (self._eight(begin[left] + at) & _FIRST[np.minimum(rest, 8)]), seed + 1)
            left, at = left[rest > 8], at + 8
        return out

    def strings(self, begin: np.ndarray, end: np.ndarray) -> list[str]:
        raw = self.raw.tobytes()
        return [raw[a:b].decode() for a, b in zip(begin.tolist(), end.tolist())]


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks of the first k of eight bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class SpanMemo:
    """Memo from byte spans to short integer sequences, kept flat under the spans' 64-bit hashes.

    ``compute`` maps a list of (string, flag) of unseen spans to (values,
    lengths). When more than ``bound`` spans or ``most_values`` values are
    held, the memo starts anew with the next call; strings are never held.
    """

    def __init__(self, compute: Callable[[list[tuple[str, bool]]], tuple[np.ndarray, np.ndarray]], bound: int = 400_000, most_values: int = 4_000_000, dtype=np.int32):
        self.compute, self.bound, self.most_values, self.dtype = compute, bound, most_values, dtype
        self.clear()

    def clear(self) -> None:
        self.count, self.used = 0, 0
        self.values = np.empty(1 << 16, self.dtype)
        self.starts, self.lengths, self.keys = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.uint64)
        self._table(16)

    def _table(self, bits: int) -> None:
        self.bits, self.slot_key, self.slot_number = bits, np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self._place(self.keys[: self.count], np.arange(self.count))

    def _place(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(keys):
            free = self.slot_key[slot] == 0
            self.slot_key[slot[free]] = keys[free]
            won = self.slot_key[slot] == keys
            self.slot_number[slot[won]] = numbers[won]
            keys, numbers, slot = keys[~won], numbers[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        number, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(open_):
            held = self.slot_key[slot]
            hit = held == keys[open_]
            number[open_[hit]] = self.slot_number[slot[hit]]
            on = ~hit & (held != 0)
            open_, slot = open_[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return number

    def numbers(self, text: Utf8, begin: np.ndarray, end: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """The number of each span; spans with the same bytes and flag have the same one."""
        if self.count > self.bound or self.used > self.most_values:
            self.clear()
        keys = np.maximum(text.hashes(begin, end, 31) ^ (flags * np.uint64(0xA0761D6478BD642F)), np.uint64(1))
        number = self._find(keys)
        lost = np.flatnonzero(number < 0)
        if len(lost):
            fresh, first, of = np.unique(keys[lost], return_index=True, return_inverse=True)
            at = lost[first]
            values, lengths = self.compute(list(zip(text.strings(begin[at], end[at]), flags[at].tolist())))
            self._hold(fresh, values, lengths)
            number[lost] = self.count - len(fresh) + of
        return number

    def _hold(self, keys: np.ndarray, values: np.ndarray, lengths: np.ndarray) -> None:
        first, n = self.count, len(keys)
        self.values = _room(self.values, self.used, self.used + len(values))
        self.starts, self.lengths, self.keys = (_room(x, first, first + n) for x in (self.starts, self.lengths, self.keys))
        self.values[self.used : self.used + len(values)] = values
        self.lengths[first : first + n], self.keys[first : first + n] = lengths, keys
        self.starts[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.used += len(values)
        self.count += n
        if 2 * self.count > 1 << self.bits:
            self._table(int(4 * self.count).bit_length())
        else:
            self._place(keys, np.arange(first, first + n))

    def expand(self, text: Utf8, begin: np.ndarray, end: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of all spans, in turn, and how many each text has."""
        at = self.numbers(text, begin, end, flags)
        lengths = self.lengths[at]
        values = self.values[spans(self.starts[at], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        cuts = np.searchsorted(begin, text.bounds)
        return values, np.diff(total[cuts])


def _room(array: np.ndarray, used: int, want: int) -> np.ndarray:
    """The array, or a larger one with its first values."""
    if want <= len(array):
        return array
    out = np.empty(max(want, 2 * len(array)), array.dtype)
    out[:used] = array[:used]
    return out


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every span, one span after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame that several steps read to the shared checkpoint folder.

    Spark removes checkpoints itself where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """The frame as a Parquet table in the shared folder, for rows too wide for several passes; steps read only the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    # rows are wide, so small row groups keep writers and readers small
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).option("compression", compression).parquet(path)
    remove_at_exit(df.sparkSession, path)
    return df.sparkSession.read.parquet(path)


def _hadoop(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Remove an intermediate folder when the driver ends; until then lost tasks may read it again."""
    place, files = _hadoop(spark, path)
    files.deleteOnExit(place)


def remove(spark: SparkSession, path: str) -> None:
    place, files = _hadoop(spark, path)
    files.delete(place, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where that is unset, a local session, as in tests, takes one under the
    warehouse; on a cluster it is an error, as that folder may be one machine's.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
