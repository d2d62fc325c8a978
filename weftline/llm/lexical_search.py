"""Ranked lexical search: MaxScore over the shards of an inverted index.

A shard is an inverted index of some megabytes of documents: for each term its
documents and frequencies. Shards are made where the documents are read, without
a shuffle, and written once; any set of queries can then be run against them.

Scores need the corpus's numbers of documents and terms and each query term's
document frequency, which are sums over shards. Then each shard is searched by
MaxScore. A query's terms are ordered by the highest score that each adds to any
document there. Those that together stay under the k-th best score known are
non-essential: a document with no other term can't qualify. So only documents of the
essential lists are looked at, and the non-essential postings are probed, highest bound
first, only for documents that can still reach the k-th best score. That
score is carried on from shard to shard within a task. Each task gives k documents a
query at most, and of those the best k are taken.

A document's length enters as m = 100 - 75 + (75 * n * N) div L; a term adds
w * ((1000000000 * tf) div (1000 * tf + 8 * m)) with the weight
w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from weftline.llm.common import Utf8, slices, spans, written

#: Bytes of text in a shard, besides a single longer document.
SHARD_BYTES = 8 << 20
#: Terms of the queries that are broadcast at once (some 40 bytes each); more queries are run in blocks.
BLOCK_TERMS = 1 << 19

#: Bytes between terms: ASCII other than letters and digits.
_BETWEEN = np.ones(256, bool)
_BETWEEN[128:] = False
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False

_SHARD = "ids binary, n binary, keys binary, ends binary, posts binary, tfs binary, n_docs long, n_terms long"
#: Stands for a null id, so that it comes after all others.
_NO_ID = np.iinfo(np.int64).max


def _postings(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text, sorted term hashes, where each one's postings end, (text, tf) of the postings)."""
    text = Utf8(column, lower=True)
    begin, end = text.words(_BETWEEN)
    n = text.per_text(begin)
    keys = text.hashes(begin, end)
    order = np.argsort(keys, kind="stable")  # texts stay in order within a term
    keys, row = keys[order], np.repeat(np.arange(len(n)), n)[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    heads = fresh.copy()
    heads[1:] |= row[1:] != row[:-1]
    at = np.flatnonzero(heads)
    tf = np.diff(np.append(at, len(keys)))
    opens = np.flatnonzero(fresh[at])
    return n, keys[at][opens], np.append(opens[1:], len(at)) if len(at) else opens, np.stack([row[at], tf])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index of whole texts, a row per shard, written to the shared folder.

    Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased, told
    apart by 64-bit hashes. Texts without terms, null or empty ones, are in no
    shard and don't count as documents. Each row is a document of its own, rows with
    equal or null ids too; ids are whole numbers, others an error. An empty table
    gives no shards. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SHARD_BYTES):
            n, keys, ends, (row, tf) = _postings(batch.column("text"))
            have = np.flatnonzero(n)
            if not len(have):
                continue
            ids = batch.column("id").fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.cumsum(n > 0) - 1
            blobs = (ids[have], n[have].astype(np.int64), keys, ends.astype(np.int64), place[row].astype(np.int32), tf.astype(np.int32))
            yield pa.RecordBatch.from_pylist([dict(zip("ids n keys ends posts tfs".split(), (x.tobytes() for x in blobs))) | {"n_docs": len(have), "n_terms": int(n.sum())}], schema=_shard_schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(run, _SHARD), "zstd")


_shard_schema = pa.schema([pa.field(c, pa.binary()) for c in "ids n keys ends posts tfs".split()] + [pa.field("n_docs", pa.int64()), pa.field("n_terms", pa.int64())])


def _queries(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, keys, times): the terms of each item and how often it has them; equal rows count once, several texts of one item are one query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n, keys, ends, (row, tf) = _postings(batch.column("text"))
            term = np.repeat(keys, np.diff(np.concatenate([[0], ends])))
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(row)), pa.array(term.view(np.int64)), pa.array(tf.astype(np.int64))], names=["item", "key", "times"])

    kind = items.schema[id_col].dataType
    own = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).distinct()
    terms = own.mapInArrow(run, T.StructType([T.StructField("item", kind), T.StructField("key", T.LongType()), T.StructField("times", T.LongType())]))
    each = terms.groupBy("item", "key").agg(F.sum("times").alias("times"))
    both = F.sort_array(F.collect_list(F.struct("key", "times")))
    return each.groupBy("item").agg(both.alias("b")).select("item", F.col("b.key").alias("keys"), F.col("b.times").alias("times"))


class _Block:
    """Some queries with the terms of all of them: query q has terms[cuts[q]:cuts[q + 1]], numbers in the sorted vocabulary."""

    def __init__(self, rows: list, kind: pa.DataType):
        self.items = pa.array([r["item"] for r in rows], kind)
        keys = np.concatenate([np.array(r["keys"], np.int64) for r in rows]).view(np.uint64)
        self.times = np.concatenate([np.array(r["times"], np.int64) for r in rows])
        self.cuts = np.cumsum([0, *(len(r["keys"]) for r in rows)])
        self.vocabulary, self.terms = np.unique(keys, return_inverse=True)
        self.weights = np.zeros(len(self.vocabulary), np.int64)

    def places(self, keys: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The block's terms that a shard has, where their postings start there, and how many there are."""
        if not len(keys):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(keys, self.vocabulary), len(keys) - 1)
        have = np.flatnonzero(keys[at] == self.vocabulary)
        at = at[have]
        starts = np.where(at > 0, ends[at - 1], 0)
        return have, starts, ends[at] - starts


def _blocks(queries: DataFrame) -> Iterator[_Block]:
    kind, held, n = to_arrow_type(queries.schema["item"].dataType), [], 0
    for row in queries.toLocalIterator():
        if held and n + len(row["keys"]) > BLOCK_TERMS:
            yield _Block(held, kind)
            held, n = [], 0
        held.append(row)
        n += len(row["keys"])
    if held:
        yield _Block(held, kind)


def _document_frequencies(index: DataFrame, block: _Block) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(block.vocabulary), np.int64)
        for batch in batches:
            for keys, ends in zip(batch.column("keys"), batch.column("ends")):
                have, _, n = block.places(np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(ends.as_buffer(), np.int64))
                df[have] += n
        have = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(df[have])], names=["term", "df"])

    found = index.select("keys", "ends").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(len(block.vocabulary), np.int64)
    out[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return out


class _Best:
    """The k best (score, id) of each query so far, best first; ids ascend within a score."""

    def __init__(self, queries: int, k: int):
        self.k, self.held = k, [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in range(queries)]

    def floor(self, q: int) -> int:
        """The score that a document needs; one is the least score above 0."""
        scores = self.held[q][0]
        return int(scores[-1]) if len(scores) == self.k else 1

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.held[q][0], scores]), np.concatenate([self.held[q][1], ids])
        best = np.lexsort((ids, -scores))[: self.k]
        self.held[q] = scores[best], ids[best]


def _kth(values: np.ndarray, k: int) -> int:
    """The k-th largest value, 0 if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0


def lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents with n terms each, exact also where 75 * n * N leaves 64 bits."""
    if 75 * int(n.max(initial=0)) * n_docs < 2**63:
        return 25 + (75 * n * n_docs) // n_terms
    return np.array([25 + 75 * x * n_docs // n_terms for x in n.tolist()], np.int64)


def _search_shard(block: _Block, best: _Best, ids: np.ndarray, m: np.ndarray, keys: np.ndarray, ends: np.ndarray, posts: np.ndarray, tfs: np.ndarray) -> None:
    """Add what one shard has to the best of all queries of a block."""
    have, starts, sizes = block.places(keys, ends)
    if not len(have):
        return
    flat = spans(starts, sizes)
    doc, tf = posts[flat], tfs[flat].astype(np.int64)
    score = np.repeat(block.weights[have], sizes) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    cut = np.concatenate([[0], np.cumsum(sizes)])
    bound = np.maximum.reduceat(score, cut[:-1])
    local = np.full(len(block.vocabulary), -1, np.int64)
    local[have] = np.arange(len(have))
    kth: dict[int, int] = {}
    for q in range(len(block.items)):
        mine = slice(block.cuts[q], block.cuts[q + 1])
        terms, times = local[block.terms[mine]], block.times[mine]
        terms, times = terms[terms >= 0], times[terms >= 0]
        if not len(terms):
            continue
        floor = best.floor(q)
        for t, x in zip(terms.tolist(), times.tolist()):
            if bound[t] * x >= floor:  # k documents have this score from one term alone
                if t not in kth:
                    kth[t] = _kth(score[cut[t] : cut[t + 1]], best.k)
                floor = max(floor, kth[t] * x)
        most = bound[terms] * times
        by = np.argsort(most, kind="stable")
        reach = np.cumsum(most[by])  # what the terms up to here add at most
        split = int(np.searchsorted(reach, floor, "left"))
        if split == len(by):
            continue
        total = np.zeros(len(ids), np.int64)
        for j in by[split:].tolist():
            t = terms[j]
            total[doc[cut[t] : cut[t + 1]]] += times[j] * score[cut[t] : cut[t + 1]]
        able = np.flatnonzero(total)
        floor = max(floor, _kth(total[able], best.k))
        for j in range(split - 1, -1, -1):
            able = able[total[able] + reach[j] >= floor]
            if not len(able):
                break
            t, x = terms[by[j]], times[by[j]]
            docs = doc[cut[t] : cut[t + 1]]
            at = np.minimum(np.searchsorted(docs, able), len(docs) - 1)
            total[able] += np.where(docs[at] == able, x * score[cut[t] + at], 0)
        able = able[total[able] >= floor]
        best.add(q, total[able], ids[able])


def search(index: DataFrame, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", result_id: str = "doc_id") -> DataFrame:
    """(item, rank, document, score): of every item the k documents of an index with the highest scores above 0, or all if fewer.

    Equal scores are ranked by ascending id, documents without an id after the
    others; rows that share an id have a rank each. Items with a null or empty text,
    or with no term that a document has, have no rows. Equal item rows count once;
    an item id (null too) with several texts has the terms of all. No documents, or no items, give no
    rows. All results are exact; shards, tasks and blocks change none.
    """
    kind = items.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField(result_id, T.LongType()), T.StructField("score", T.LongType())])
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    found = None
    for block in _blocks(written(_queries(items, id_col, text_col))) if n_docs else ():
        df = _document_frequencies(index, block)
        block.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        shared = index.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            best = _Best(len(block.items), k)
            for batch in batches:
                for row in zip(*(batch.column(c) for c in ("ids", "n", "keys", "ends", "posts", "tfs"))):
                    ids, n, keys, ends, posts, tfs = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, (np.int64, np.int64, np.uint64, np.int64, np.int32, np.int32)))
                    _search_shard(block, best, ids, lengths(n, n_docs, n_terms), keys, ends, posts, tfs)
            of = np.repeat(np.arange(len(best.held)), [len(s) for s, _ in best.held])
            scores, ids = (np.concatenate([h[j] for h in best.held]) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([block.items.take(pa.array(of)), pa.array(ids, mask=ids == _NO_ID), pa.array(scores)], names=schema.names)

        part = index.drop("n_docs", "n_terms").mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = index.sparkSession.createDataFrame([], schema)
    best = W.partitionBy(id_col).orderBy(F.desc("score"), F.asc_nulls_last(result_id))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(id_col, "rank", result_id, "score")
