"""Repeated passages by sparse suffix arrays.

Of each window of ``WIDTH`` words, the run of ``GRAM`` words with the least hash
marks a position that depends on the words alone; so a passage of ``WIDTH``
words or more holds the same marked position wherever it stands. Only suffixes
at marked positions are kept.

1. Marked positions are grouped by their gram; grams of a single document end
   here.
2. The suffixes left, cut to ``WIDTH`` words with the ``WIDTH - GRAM`` words
   before them, are sorted within their gram; neighbours are compared for
   their longest common prefix.
3. Each match is extended to the left: for every number of words taken from the
   left, suffixes whose common prefix makes up a whole window, and whose left
   words are equal, hold the same window. The smallest id keeps it.

Each task first settles suffixes with the same surroundings among its own
documents and sends on one of them, so copies don't pile up in one shard. Grams
that two documents of a task hold are known to be repeated, and one row tells
the others. A gram that makes up more than its share of a shard is split: its
suffixes go by the windows that it marks, of which each task again settles its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import Utf8, mix, slices, spans, window_hashes, written
from weftline.llm.passages import RUN_ROWS, FlatWords, among, by_shard, covered, frequent, ids_of, keyed, merge_runs, packed, packed_schema, real_id, run_rows, runs, shard_count, spans_of

WIDTH, GRAM = 50, 16
#: Bytes of a word's hash that travel: two different words agree once in 10 ** 12.
WORD_BYTES = 5
HELD = 100_000
#: A gram with fewer marks than this is never split; results are the same.
LEAST_SPLIT = 1000


def _marks(flat: FlatWords, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Flat positions of the marked suffixes, and the hashes of their grams."""
    starts = flat.windows(width)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    value, place = flat.least(width, gram)
    marked, first = np.unique(place[starts], return_index=True)
    return marked, value[starts][first]


def _settled(keys: np.ndarray, doc: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of which a smaller document holds the key too, and the others."""
    by = np.lexsort((doc, keys))
    keys, d = keys[by], doc[by]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    later = d >> low > np.repeat(d[heads], np.diff(np.append(heads, len(d)))) >> low
    return by[later], by[~later]


def repeated_marks(docs: DataFrame, width: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, runs): marked positions whose gram is marked in another document too; and rows (gram, n) of grams with many marks."""
    shards = shard_count(docs)

    def partition(batches):
        held, n = [], 0

        def flush():
            if not held:
                return
            grams, doc, at = (np.concatenate(x) for x in zip(*held))
            held.clear()
            by = np.lexsort((doc, grams))
            grams, doc, at = grams[by], doc[by], at[by]
            heads = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            size = np.diff(np.append(heads, len(grams)))
            several = doc[heads] != doc[heads + size - 1]
            known = np.repeat(several, size)
            d, first, last = runs(doc[known], at[known])
            yield from packed((mix(d.astype(np.uint64)) % np.uint64(shards)).astype(np.int64), shards, [d, first, last, np.zeros(len(d), np.uint8)], kind=0)
            # of a gram of several documents here, one row with the number of its marks goes on
            count = np.ones(len(grams), np.int32)
            count[heads[several]] = size[several]
            on = ~known
            on[heads] = True
            yield from packed((grams[on] % np.uint64(shards)).astype(np.int64), shards, [grams[on], doc[on], at[on], count[on]], kind=1)

        for batch in slices(batches, text_col):
            flat, ids = FlatWords(batch.column(text_col)), ids_of(batch.column(id_col))
            marks, grams = _marks(flat, width, gram)
            if not len(marks):
                continue
            held.append((grams, ids[flat.row[marks]], flat.at[marks].astype(np.int32)))
            n += len(marks)
            if n > 10 * HELD:
                yield from flush()
                n = 0
        yield from flush()

    def rows(docs_, blobs, grams, counts):
        columns = (pa.array(docs_, pa.int64()), pa.array(blobs, pa.binary()), pa.array(grams, pa.int64()), pa.array(counts, pa.int64()))
        size = max(map(len, columns))
        return pa.RecordBatch.from_arrays([c if len(c) == size else pa.nulls(size, c.type) for c in columns], names=["doc", "runs", "gram", "n"])

    def merge(held):
        if 0 in held:
            d, first, last = (np.frombuffer(b"".join(x), k) for x, k in zip(held[0], (np.int64, np.int32, np.int32)))
            by = np.lexsort((first, d))
            found = run_rows(d[by], first[by], last[by])
            yield rows(found.column("doc"), found.column("runs"), [], [])
        if 1 in held:
            grams, doc, at, count = (np.frombuffer(b"".join(x), k) for x, k in zip(held[1], (np.uint64, np.int64, np.int32, np.int32)))
            by = np.lexsort((doc, grams))
            grams, doc, at, count = grams[by], doc[by], at[by], count[by].astype(np.int64)
            heads = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            size = np.diff(np.append(heads, len(grams)))
            several = (doc[heads] != doc[heads + size - 1]) | (np.maximum.reduceat(count, heads) > 1)
            left = np.repeat(several, size) & (count == 1)  # those counted together have their runs
            if left.any():
                found = run_rows(*runs(doc[left], at[left]))
                yield rows(found.column("doc"), found.column("runs"), [], [])
            total = np.add.reduceat(count, heads)
            many = several & (total >= LEAST_SPLIT)
            if many.any():
                yield rows([], [], grams[heads[many]].view(np.int64), total[many])

    parts = docs.mapInArrow(partition, packed_schema(4))
    return written(by_shard(parts, merge, RUN_ROWS + ", gram long, n long", 4))


def _surroundings(words: np.ndarray, at: np.ndarray, left: int, right: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words before (nearest first) and from each position, as bytes, with how many there are of each; missing ones are zero."""
    n = len(words)
    raw = np.zeros((n + 1, WORD_BYTES), np.uint8)
    raw[:n] = words.view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES]
    after = at[:, None] + np.arange(right)
    before = at[:, None] - 1 - np.arange(left)
    n_right, n_left = np.minimum(n - at, right), np.minimum(at, left)
    return raw[np.where(before >= 0, before, n)], n_left.astype(np.uint8), raw[np.minimum(after, n)], n_right.astype(np.uint8)


def _same_windows(gram, before, n_left, after, n_right, doc, width, gram_words, low):
    """(row, words taken from the left) of each window that a smaller document holds too."""
    m = len(doc)
    key = np.concatenate([gram.astype(">u8").view(np.uint8).reshape(m, 8), after.reshape(m, -1)], axis=1)
    order = np.argsort(np.ascontiguousarray(key).view(f"S{key.shape[1]}").ravel(), kind="stable")
    gram, before, n_left, after, n_right, doc = gram[order], before[order], n_left[order], after[order], n_right[order], doc[order]
    same = (after[1:] == after[:-1]).all(axis=2)
    prefix = np.where(same.all(axis=1), after.shape[1], np.argmin(same, axis=1))
    prefix[gram[1:] != gram[:-1]] = 0
    wide = np.zeros((m, before.shape[1], 8), np.uint8)
    wide[:, :, :WORD_BYTES] = before
    left_words = wide.view(np.uint64)[:, :, 0]
    left = np.zeros(m, np.uint64)
    rows, taken = [], []
    for k in range(width - gram_words + 1):
        if k:
            left = mix(left * np.uint64(0x9E3779B97F4A7C15) + left_words[:, k - 1], 5)
        run = np.concatenate([[0], np.cumsum(prefix < width - k)])
        whole = np.flatnonzero((n_left >= k) & (n_right >= width - k))
        if len(whole) < 2:
            continue
        run, own, d = run[whole], left[whole], doc[whole]
        by = np.lexsort((d, own, run))
        opens = np.ones(len(by), bool)
        opens[1:] = (run[by][1:] != run[by][:-1]) | (own[by][1:] != own[by][:-1])
        heads = np.flatnonzero(opens)
        smallest = np.repeat(d[by][heads], np.diff(np.append(heads, len(by))))
        later = by[d[by] >> low > smallest >> low]
        rows.append(order[whole[later]])
        taken.append(np.full(len(later), k))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(taken)


def repeated_starts(docs: DataFrame, width: int, gram: int, low: int) -> DataFrame:
    """(doc, runs): the starts of windows of ``width`` words that a document with a smaller id holds too, of rows as ``keyed`` gives them with ``low`` bits."""
    id_col, text_col = "id", "text"
    shards, side = shard_count(docs), width - gram
    found = repeated_marks(docs, width, gram, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(frequent(found.where("gram is not null").select(F.col("gram").alias("key"), "n"), shards))
    marks = found.where("doc is not null").groupBy("doc").agg(F.collect_list("runs").alias("runs"))
    joined = docs.join(marks, docs[id_col] == marks["doc"]).select("doc", text_col, "runs")

    def unpack(held):
        kinds = (np.uint64, np.int64, np.int32, np.uint8)
        grams, doc, at, raw = (np.frombuffer(b"".join(x), k) for x, k in zip(held, kinds))
        m = len(doc)
        raw = raw.reshape(m, -1)
        cut = 2 + side * WORD_BYTES
        return grams, doc, at, raw[:, 2:cut].reshape(m, side, WORD_BYTES), raw[:, 0], raw[:, cut:].reshape(m, width, WORD_BYTES), raw[:, 1]

    def settled(doc, at, rows, taken) -> list:
        return list(runs(doc[rows], (at[rows] - taken).astype(np.int32)))

    def partition(batches):
        split, held, windows, n = shared.value, [], [], 0

        def flush():
            if windows:
                keys, doc, start = (np.concatenate(x) for x in zip(*windows))
                windows.clear()
                copies, on = _settled(keys, doc, low)
                d, first, last = runs(doc[copies], start[copies])
                yield from packed((mix(d.astype(np.uint64)) % np.uint64(shards)).astype(np.int64), shards, [d, first, last, np.zeros(len(d), np.uint8)], kind=0)
                yield from packed((keys[on] % np.uint64(shards)).astype(np.int64), shards, [keys[on], doc[on], start[on], np.zeros(len(on), np.uint8)], kind=2)
            if not held:
                return
            grams, doc, at, raw = (np.concatenate(x) for x in zip(*held))
            held.clear()
            # of rows with the same surroundings, one with the smallest id goes on
            own = np.ascontiguousarray(np.concatenate([grams.view(np.uint8).reshape(-1, 8), raw], axis=1)).view(f"V{raw.shape[1] + 8}").ravel()
            _, group = np.unique(own, return_inverse=True)
            by = np.lexsort((doc, group))
            opens = np.ones(len(by), bool)
            opens[1:] = group[by][1:] != group[by][:-1]
            heads = np.flatnonzero(opens)
            least = np.repeat(doc[by][heads], np.diff(np.append(heads, len(by))))
            later = doc[by] >> low > least >> low
            copies, on = by[later], by[~later]
            if len(copies):
                n_left, n_right = raw[copies, 0].astype(np.int64), raw[copies, 1].astype(np.int64)
                fewest = np.maximum(0, width - n_right)  # of the words that whole windows take from the left
                count = np.maximum(0, np.minimum(n_left, side) - fewest + 1)
                rows = np.repeat(copies, count)
                d, first, last = settled(doc, at, rows, spans(fewest, count))
                yield from packed((mix(d.astype(np.uint64)) % np.uint64(shards)).astype(np.int64), shards, [d, first, last, np.zeros(len(d), np.uint8)], kind=0)
            yield from packed((grams[on] % np.uint64(shards)).astype(np.int64), shards, [grams[on], doc[on], at[on], raw[on]], kind=1)

        for batch in slices(batches, text_col, 1 << 20):
            flat = FlatWords(batch.column(text_col))
            grams = window_hashes(flat.words, gram)
            if len(split):
                starts, (mark, _) = flat.windows(width), flat.least(width, gram)
                starts = starts[among(split, mark[starts])] if len(starts) else starts
                if len(starts):
                    windows.append((window_hashes(flat.words, width)[starts], ids_of(batch.column("doc"))[flat.row[starts]], flat.at[starts].astype(np.int32)))
                    n += len(starts) // 10
            for i, (doc, blobs) in enumerate(zip(batch.column("doc").to_pylist(), batch.column("runs").to_pylist())):
                lo, size = int(flat.starts[i]), int(flat.sizes[i])
                pairs = merge_runs(blobs)
                at = np.concatenate([np.arange(a, b + 1) for a, b in pairs.tolist()])
                at = at[~among(split, grams[lo + at])]
                if not len(at):
                    continue
                before, n_left, after, n_right = _surroundings(flat.words[lo : lo + size], at, side, width)
                raw = np.concatenate([n_left[:, None], n_right[:, None], before.reshape(len(at), -1), after.reshape(len(at), -1)], axis=1)
                held.append((grams[lo + at], np.full(len(at), doc), at.astype(np.int32), raw))
                n += len(at)
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
            grams, doc, at, before, n_left, after, n_right = unpack(held[1])
            rows, taken = _same_windows(grams, before, n_left, after, n_right, doc, width, gram, low)
            if len(rows):
                yield run_rows(*runs(doc[rows], (at[rows] - taken).astype(np.int32)))
        if 2 in held:
            keys, doc, start = (np.frombuffer(b"".join(x), k) for x, k in zip(held[2], (np.uint64, np.int64, np.int32)))
            copies, _ = _settled(keys, doc, low)
            if len(copies):
                yield run_rows(*runs(doc[copies], start[copies]))

    return by_shard(joined.mapInArrow(partition, packed_schema(4)), merge, RUN_ROWS, 4)


def repeated_passages(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_repeated and spans (start, end in words) of every document.

    A word is repeated if a window of ``width`` words that covers it also stands
    in a document with a smaller id; so the first copy of a passage is free.
    Texts shorter than a window have no spans, a null text has no words. Equal
    rows get the same result each; rows with one id and different texts are texts of
    that id, each with a result of its own, and repeat nothing of each other. Documents
    without an id come after all others, in an order of their texts. Ids are whole numbers, others are a TypeError. An
    empty table gives no rows. Other columns aren't returned, whatever their names.
    """
    rows, low, _ = keyed(docs, id_col, text_col)
    found = repeated_starts(rows, width, gram, low).groupBy("doc").agg(F.collect_list("runs").alias("runs"))

    def sizes(batches):
        for batch in slices(batches, "text"):
            text = Utf8(batch.column("text"))
            n = pa.array(text.per_text(text.words()[0]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), n], names=["id", "n_words"])

    joined = rows.mapInArrow(sizes, "id long, n_words long").join(found, F.col("id") == F.col("doc"), "left").select(real_id("id", low).alias(id_col), "n_words", "runs")

    def finish(batches):
        for batch in batches:
            repeated, found_spans = [], []
            for n, blobs in zip(batch.column("n_words").to_pylist(), batch.column("runs").to_pylist()):
                mask = covered(blobs, width, n) if blobs else np.zeros(0, bool)
                repeated.append(int(mask.sum()))
                found_spans.append([{"start": a, "end": b} for a, b in spans_of(mask)])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("n_words"), pa.array(repeated, pa.int64()), pa.array(found_spans, kind)], names=[id_col, "n_words", "n_repeated", "spans"])

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return joined.mapInArrow(finish, T.StructType([T.StructField(id_col, T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_repeated", T.LongType()), T.StructField("spans", span)]))
