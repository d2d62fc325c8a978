"""Flat word arrays of many documents, and exchanges of packed rows.

Windows of words are far more numerous than documents. They travel as packed
arrays, many to a row, dealt by a shard number that content decides; so a
shuffle carries about the bytes of the hashes alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import Utf8, spans, window_hashes
from weftline.llm.ordering import before, bucketed

#: Documents without an id get one from here on, by their text; so they come after all others (ids are below it).
NO_ID_FROM = 1 << 62


def ident(id_col: str, text_col: str) -> Column:
    """The id as a long; a null one is replaced by a number that depends on the text.

    Ids are whole numbers under ``NO_ID_FROM``; a larger one, or one that makes no long, is an error.
    """
    own = F.col(id_col).cast("long")
    own = F.when(own >= NO_ID_FROM, F.raise_error(F.lit("ids must be under 2 ** 62")).cast("long")).otherwise(own)
    return F.coalesce(own, F.lit(NO_ID_FROM) + F.xxhash64(F.col(text_col)).bitwiseAND(F.lit(NO_ID_FROM - 1)))


def real_id(c: str, bits: int = 0) -> Column:
    """The id as it was before ``keyed`` put bits below it, null where one was made up."""
    return F.when(F.col(c) < NO_ID_FROM, F.shiftright(c, bits) if bits else F.col(c))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """(id, text) rows whose ids name one text each, the bits that were put below the ids for that, and the bytes of all texts.

    Where all rows of an id have one text, ids are as they are and the bits are 0.
    Else an id's texts are numbered in these bits, so ids shifted right by
    them still tell what is smaller; there, ids must leave room for them. Null ids are made up as by ``ident``. Ids
    that aren't whole numbers are a TypeError.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers, not {docs.schema[id_col].dataType.simpleString()}")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    per = hashed.groupBy("id").agg(F.min("hash").alias("low"), F.max("hash").alias("high"), F.sum(F.octet_length("text")).alias("size"))
    several = F.col("id").isNotNull() & (F.col("low") != F.col("high"))
    size, clash = per.agg(F.sum("size"), F.bool_or(several)).first()
    if not clash:
        return rows.select(ident("id", "text").alias("id"), "text"), 0, size or 0
    texts = hashed.join(per.where(several).select("id"), "id", "left_semi").select("id", "hash").distinct()
    numbers = before(bucketed(texts, ["id", "hash"]), ["id"], ["hash"], F.lit(1), "nth")
    bits = int(numbers.agg(F.max("nth")).first()[0]).bit_length()
    room = NO_ID_FROM >> bits
    own = F.when(F.col("id") >= room, F.raise_error(F.lit(f"ids must be under {room} where one has several texts")).cast("long")).otherwise(F.shiftleft("id", bits) + F.coalesce("nth", F.lit(0)))
    made = F.lit(NO_ID_FROM) + F.col("hash").bitwiseAND(F.lit(NO_ID_FROM - (1 << bits)))
    return hashed.join(numbers, ["id", "hash"], "left").select(F.coalesce(own, made).alias("id"), "text"), bits, size or 0


class FlatWords:
    """Word hashes of a slice of documents in one array; row holds the document of each word, at its place there."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.text = Utf8(column, lower)
        self.begin, self.end = self.text.words()
        self.words = self.text.hashes(self.begin, self.end)
        self.sizes = self.text.per_text(self.begin)
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.at = np.arange(len(self.words)) - self.starts[self.row]

    def joined(self, keep: np.ndarray) -> pa.Array:
        """For each document the words that are kept, joined by one space."""
        begin, size = self.begin[keep], self.end[keep] - self.begin[keep] + 1
        out = self.text.raw[spans(begin, size)]
        after = np.cumsum(size)
        out[after - 1] = 32
        per = np.bincount(self.row[keep], minlength=len(self.sizes))
        ends = np.concatenate([[0], after])[np.cumsum(per)]
        full = np.ones(len(out), bool)
        full[ends[per > 0] - 1] = False
        offsets = np.concatenate([[0], ends - np.cumsum(per > 0)])
        return pa.Array.from_buffers(pa.large_string(), len(per), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out[full]))]).cast(pa.string())

    def windows(self, width: int) -> np.ndarray:
        """Flat positions at which a window of this width starts and ends in one document."""
        n = len(self.words) - width + 1
        if n <= 0:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.row[:n] == self.row[width - 1 :])

    def least(self, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """For each position, the least hash among the grams of the window of ``width`` there, and the leftmost place of it."""
        value = window_hashes(self.words, gram)
        place = np.arange(len(value))
        span, want = 1, width - gram + 1
        if len(value) < want:
            return np.empty(0, np.uint64), np.empty(0, np.int64)

        def both(shift: int) -> None:
            nonlocal value, place
            left = value[:-shift] <= value[shift:]
            value, place = np.where(left, value[:-shift], value[shift:]), np.where(left, place[:-shift], place[shift:])

        while 2 * span <= want:
            both(span)
            span *= 2
        if want > span:
            both(want - span)
        return value, place


def ids_of(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def runs(docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted, distinct (document, first, last) runs of consecutive starts."""
    if not len(docs):
        return docs, starts, starts
    by = np.lexsort((starts, docs))
    docs, starts = docs[by], starts[by]
    fresh = np.ones(len(docs), bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (starts[1:] != starts[:-1])
    docs, starts = docs[fresh], starts[fresh]
    opens = np.ones(len(docs), bool)
    opens[1:] = (docs[1:] != docs[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(opens)
    last = np.append(first[1:], len(docs)) - 1
    return docs[first], starts[first], starts[last]


def run_rows(docs: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """One row (doc, runs) per document; runs holds (first, last) pairs as int32."""
    cuts = np.flatnonzero(np.diff(docs)) + 1
    heads = np.concatenate([[0], cuts]) if len(docs) else cuts
    pairs = np.stack([first, last], axis=1).astype(np.int32)
    blobs = [p.tobytes() for p in np.split(pairs, cuts)] if len(docs) else []
    return pa.RecordBatch.from_arrays([pa.array(docs[heads], pa.int64()), pa.array(blobs, pa.binary())], names=["doc", "runs"])


RUN_ROWS = "doc long, runs binary"


def merge_runs(blobs: Iterable[bytes]) -> np.ndarray:
    """Merged, sorted (first, last) pairs of a document's run blobs."""
    pairs = np.frombuffer(b"".join(blobs), np.int32).reshape(-1, 2)
    if len(pairs) < 2:
        return pairs
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    opens = np.ones(len(pairs), bool)
    opens[1:] = pairs[1:, 0] > reach[:-1] + 1
    heads = np.flatnonzero(opens)
    return np.stack([pairs[heads, 0], reach[np.append(heads[1:], len(pairs)) - 1]], axis=1)


def covered(blobs: Iterable[bytes], width: int, n: int) -> np.ndarray:
    """Mask of the words that lie in a window of ``width`` starting in one of the runs."""
    edges = np.zeros(n + 1, np.int64)
    for first, last in merge_runs(blobs):
        edges[first] += 1
        edges[min(last + width, n)] -= 1
    return np.cumsum(edges[:n]) > 0


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches that are set; end is exclusive."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in edge.reshape(-1, 2)]


def shard_count(df: DataFrame) -> int:
    """Shards of an exchange: several per shuffle partition, to even them out."""
    return 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def frequent(counts: DataFrame, shards: int) -> np.ndarray:
    """Of rows (key, n), one a key, the sorted keys that hold a quarter of an even shard or more; so four a shard at most."""
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return np.empty(0, np.uint64)
    found = counts.where(F.col("n") * 4 * shards >= total).select("key").toArrow().column("key")
    return np.sort(found.to_numpy().view(np.uint64))


def among(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that are among sorted ones."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def slots(df: DataFrame) -> np.ndarray:
    """For each shuffle partition a number that repartition() deals to it, so one shard per partition is even."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    reach = 64 * n + 1024
    dealt = spark.range(reach).select(F.col("id").cast("int").alias("id"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("part"))
    first = {r["part"]: r["id"] for r in dealt.groupBy("part").agg(F.min("id").alias("id")).collect()}
    return np.array([first.get(k, reach + k) for k in range(n)], np.int32)


def packed(shard: np.ndarray, shards: int, arrays: list[np.ndarray], kind: int = 0, named: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (shard, kind, a, b, c, ...) with the arrays' bytes, one row per shard that has any; shards can have other names."""
    by = np.argsort(shard, kind="stable")
    bounds = np.searchsorted(shard[by], np.arange(shards + 1))
    arrays = [a[by] for a in arrays]
    have = np.flatnonzero(np.diff(bounds))
    for lo in range(0, len(have), 256):
        part = have[lo : lo + 256]
        columns = [pa.array([a[bounds[s] : bounds[s + 1]].tobytes() for s in part.tolist()], pa.binary()) for a in arrays]
        yield pa.RecordBatch.from_arrays([pa.array(part if named is None else named[part], pa.int32()), pa.array(np.full(len(part), kind), pa.int32()), *columns], names=["shard", "kind", *"abcde"[: len(arrays)]])


def packed_schema(arrays: int) -> str:
    return "shard int, kind int, " + ", ".join(f"{c} binary" for c in "abcde"[:arrays])


def by_shard(df: DataFrame, work: Callable[[dict[int, list[list[bytes]]]], Iterator[pa.RecordBatch]], schema: str, arrays: int) -> DataFrame:
    """Bring the rows of each shard together and hand them to ``work`` shard by shard, as {kind: [blobs of a, of b, ...]}."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = list("abcde"[:arrays])

    def run(batches):
        shard, held = None, {}
        for batch in batches:
            rows = zip(batch.column("shard").to_pylist(), batch.column("kind").to_pylist(), *(batch.column(c).to_pylist() for c in names))
            for s, kind, *blobs in rows:
                if s != shard:
                    if held:
                        yield from work(held)
                    shard, held = s, {}
                for out, blob in zip(held.setdefault(kind, [[] for _ in names]), blobs):
                    out.append(blob)
        if held:
            yield from work(held)

    return df.repartition(n, F.col("shard")).sortWithinPartitions("shard").mapInArrow(run, schema)
