"""Removal of repeated word windows, behind a count-min prefilter.

A window of ``WIDTH`` words has an anchor: of the runs of ``GRAM`` words in it,
the one with the least hash. Equal windows have equal anchors, so the number of
documents with an anchor is never less than the number with a window.

1. Every task counts its anchors, once per document, in a count-min sketch;
   the partition sketches are merged cell by cell.
2. Windows whose anchor is estimated in fewer than two documents can't repeat.
   The others are grouped exactly. Each task first settles what it can itself:
   of equal windows only those of the smallest id go on, so that a window that
   a third of all documents hold reaches its shard once per task. An anchor
   whose cell has more than its share of a shard, as in a passage in many
   surroundings, is split: its windows are dealt by their own hash.
3. The starts of repeated windows return to their documents.

The merged sketch is two bit arrays of ``2 ** bits`` cells. ``bits`` follows the
size of the corpus up to ``MOST_BITS``, which bounds the broadcast at 128 MB.
Beyond that the estimates are higher and the exact pass gets more windows; none
is ever lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import mix, slices, window_hashes, written
from weftline.llm.passages import RUN_ROWS, FlatWords, among, by_shard, covered, frequent, ids_of, keyed, packed, packed_schema, real_id, run_rows, runs, shard_count, spans_of

WIDTH, GRAM = 50, 25
DEPTH, MOST_BITS, SLICES = 2, 29, 256
HELD = 1_500_000
#: An anchor whose cell counts fewer is never split; results are the same.
LEAST_SPLIT = 1000


def _cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(anchors, 100 + row) >> np.uint64(64 - bits)).astype(np.int64)


def _anchors(flat: FlatWords, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all windows, and their anchors."""
    starts = flat.windows(width)
    least, _ = flat.least(width, gram)
    return starts, least[starts] if len(starts) else np.empty(0, np.uint64)


def _once_per_document(row: np.ndarray, anchors: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cells of the distinct anchors of each document, for each row of the sketch."""
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (anchors[1:] != anchors[:-1])
    row, anchors = row[fresh], anchors[fresh]
    by = np.lexsort((anchors, row))
    row, anchors = row[by], anchors[by]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (anchors[1:] != anchors[:-1])
    return [_cells(anchors[fresh], r, bits) for r in range(DEPTH)]


def sketch(docs: DataFrame, bits: int, width: int = WIDTH, gram: int = GRAM, text_col: str = "text") -> tuple[list[np.ndarray], np.ndarray]:
    """Per row of the sketch, a packed bit for each cell: whether two documents or more fell there; and the frequent cells of the first row."""
    per_slice, shards = (1 << bits) // SLICES, shard_count(docs)

    def partition(batches):
        held, n = [[] for _ in range(DEPTH)], 0

        def flush():
            for r in range(DEPTH):
                if held[r]:
                    cells, count = np.unique(np.concatenate(held[r]), return_counts=True)
                    yield from packed((cells // per_slice).astype(np.int64) + r * SLICES, DEPTH * SLICES, [(cells % per_slice).astype(np.uint32), np.minimum(count, 255).astype(np.uint8)])
                held[r].clear()

        for batch in slices(batches, text_col):
            flat = FlatWords(batch.column(text_col))
            starts, anchors = _anchors(flat, width, gram)
            for r, cells in enumerate(_once_per_document(flat.row[starts], anchors, bits)):
                held[r].append(cells)
                n += len(cells)
            if n > DEPTH * HELD:
                yield from flush()
                n = 0
        yield from flush()

    def merge(batches):
        shard, cells = None, None

        def done():
            # those that are frequent overall are so within their slice, which holds four a shard of such at most
            many = np.flatnonzero((cells >= LEAST_SPLIT) & (cells * 4 * shards >= cells.sum())) if shard < SLICES else np.empty(0, np.int64)
            packed_bits = [np.packbits(cells >= 2, bitorder="little").tobytes()] + [None] * len(many)
            keys, counts = [None] + (shard * per_slice + many).tolist(), [None] + cells[many].tolist()
            return pa.RecordBatch.from_arrays([pa.array([shard] * len(keys), pa.int32()), pa.array(packed_bits, pa.binary()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["shard", "bits", "key", "n"])

        for batch in batches:
            for s, at, count in zip(batch.column("shard").to_pylist(), batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                if s != shard:
                    if cells is not None:
                        yield done()
                    shard, cells = s, np.zeros(per_slice, np.int64)
                cells[np.frombuffer(at, np.uint32)] += np.frombuffer(count, np.uint8)  # a row has each cell once
        if cells is not None:
            yield done()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = docs.select(text_col).mapInArrow(partition, packed_schema(2))
    counted = written(parts.repartition(n, F.col("shard")).sortWithinPartitions("shard").mapInArrow(merge, "shard int, bits binary, key long, n long"))
    merged = counted.where("key is null").select("shard", "bits").toArrow()
    rows = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(DEPTH)]
    for s, data in zip(merged.column("shard").to_pylist(), merged.column("bits").to_pylist()):
        r, k = divmod(s, SLICES)
        rows[r][k * per_slice // 8 : (k + 1) * per_slice // 8] = np.frombuffer(data, np.uint8)
    return rows, frequent(counted.where("key is not null").select("key", "n"), shards)


def repeated_starts(docs: DataFrame, width: int, gram: int, low: int, size: int) -> DataFrame:
    """(doc, runs): the starts of windows that also start in a document with a smaller id, of rows as ``keyed`` gives them with ``low`` bits and ``size`` bytes."""
    id_col, text_col = "id", "text"
    anchors = size / 6 * 2 / (width - gram + 2)
    bits = min(MOST_BITS, max(16, math.ceil(math.log2(8 * anchors + 1))))
    shards, context = shard_count(docs), docs.sparkSession.sparkContext
    shared = context.broadcast(sketch(docs, bits, width, gram, text_col))

    def settle(h1, h2, docs_, starts):
        """Of equal windows, which have a smaller document here, and which go on."""
        by = np.lexsort((docs_, h2, h1))
        h1, h2, d = h1[by], h2[by], docs_[by]
        opens = np.ones(len(by), bool)
        opens[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        heads = np.flatnonzero(opens)
        smallest = np.repeat(d[heads], np.diff(np.append(heads, len(d))))
        later = d >> low > smallest >> low
        return by[later], by[~later]

    def partition(batches):
        (rows, split), held, n = shared.value, [], 0

        def flush():
            if not held:
                return
            h1, h2, dealt, doc, start = (np.concatenate(x) for x in zip(*held))
            held.clear()
            later, on = settle(h1, h2, doc, start)
            d, first, last = runs(doc[later], start[later])
            yield from packed((mix(d.astype(np.uint64)) % np.uint64(shards)).astype(np.int64), shards, [d, first.astype(np.int32), last.astype(np.int32), np.zeros(len(d), np.uint8)], kind=0)
            shard = (mix(dealt[on], 9) % np.uint64(shards)).astype(np.int64)
            yield from packed(shard, shards, [h1[on], h2[on], doc[on], start[on]], kind=1)

        for batch in slices(batches, text_col):
            flat, ids = FlatWords(batch.column(text_col)), ids_of(batch.column(id_col))
            starts, anchors = _anchors(flat, width, gram)
            often = np.ones(len(starts), bool)
            places = [_cells(anchors, r, bits) for r in range(DEPTH)]
            for r, cell in enumerate(places):
                often &= (rows[r][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
            if not often.any():
                continue
            starts = starts[often]
            one, two = window_hashes(flat.words, width, 11), window_hashes(flat.words, width, 23)
            dealt = np.where(among(split, places[0][often].astype(np.uint64)), one[starts], anchors[often])
            held.append((one[starts], two[starts].astype(np.uint32), dealt, ids[flat.row[starts]], flat.at[starts].astype(np.int32)))
            n += len(starts)
            if n > HELD:
                yield from flush()
                n = 0
        yield from flush()

    def merge(held):
        if 0 in held:
            d, first, last = (np.frombuffer(b"".join(x), k) for x, k in zip(held[0], (np.int64, np.int32, np.int32)))
            by = np.lexsort((first, d))
            yield run_rows(d[by], first[by], last[by])
        if 1 in held:
            h1, h2, doc, start = (np.frombuffer(b"".join(x), k) for x, k in zip(held[1], (np.uint64, np.uint32, np.int64, np.int32)))
            later, _ = settle(h1, h2, doc, start)
            if len(later):
                yield run_rows(*runs(doc[later], start[later]))

    parts = docs.mapInArrow(partition, packed_schema(4))
    return by_shard(parts, merge, RUN_ROWS, 4)


def dedup_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, spans and kept_text of every document.

    A word goes if a window of ``width`` words that covers it also starts in a
    document with a smaller id; windows are judged on the input. Texts shorter
    than a window keep all their words, a null text has none. Equal rows get the same
    result each; rows with one id and different texts are texts of that id, each with
    a result of its own, and take nothing from each other. Documents without an
    id come after all others, in an order of their texts. Ids are whole numbers, others are a TypeError. An empty
    table gives no rows. Other columns aren't returned, whatever their names.
    """
    rows, low, size = keyed(docs, id_col, text_col)
    found = repeated_starts(rows, width, gram, low, size).groupBy("doc").agg(F.collect_list("runs").alias("runs"))
    joined = rows.join(found, F.col("id") == F.col("doc"), "left").select(real_id("id", low).alias(id_col), F.col("text"), "runs")
    text_col = "text"

    def finish(batches):
        for batch in slices(batches, text_col):
            flat = FlatWords(batch.column(text_col))
            gone, spans = np.zeros(len(flat.words), bool), []
            for start, n, blobs in zip(flat.starts.tolist(), flat.sizes.tolist(), batch.column("runs").to_pylist()):
                if blobs:
                    gone[start : start + n] = covered(blobs, width, n)
                spans.append([{"start": a, "end": b} for a, b in spans_of(gone[start : start + n])] if blobs else [])
            removed = np.bincount(flat.row[gone], minlength=len(flat.sizes))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(flat.sizes), pa.array(removed), pa.array(spans, kind), flat.joined(~gone)], names=[id_col, "n_words", "n_removed", "spans", "kept_text"])

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [T.StructField(id_col, T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span), T.StructField("kept_text", T.StringType())]
    return joined.mapInArrow(finish, T.StructType(fields))
