"""Token counts of whole documents without their ids.

Pre-tokens of the whole corpus are counted once per distinct string. A
pre-token that makes up at least one in ``HOT_SHARE`` of the corpus is hot; by
that definition there are at most ``HOT_SHARE`` of them, and their counts are
broadcast as two flat arrays. All other pre-tokens reach their documents by a
join, in which no key can hold more than that share of the rows.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import SpanMemo, Utf8, cut_lineage, slices

#: Upper bound of the broadcast pre-tokens (12 bytes each).
HOT_SHARE = 1 << 21
# The split pattern of this family of byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Below this code point the two libraries agree on letters, numbers and spaces; above, the tokenizer splits itself.
PLAIN_BELOW = "ɐ"
SLICE = 2 << 20
#: First bytes of characters beyond ASCII among which there is white space.
_SPACE_LEADS = np.zeros(256, bool)
_SPACE_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class Splitter:
    """Pre-tokens of one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        specials = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.pattern = regex.compile(PATTERN)
        self.exotic = regex.compile(f"[{PLAIN_BELOW}-\U0010ffff]")

    def pre_tokens(self, text: str) -> list[str]:
        if self.exotic.search(text):
            return [text[a:b] for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def parts(self, text: Utf8) -> tuple[np.ndarray, np.ndarray]:
        """Where independent parts begin and end.

        No pre-token crosses a single space or line feed between two characters
        that aren't white space, but it may begin with that space; so parts
        begin there.
        """
        raw, n = text.raw, text.n
        starts = np.zeros(n, bool)
        opens = text.opens()
        starts[opens] = True
        at = np.flatnonzero((raw[:n] == 32) | (raw[:n] == 10))
        at = at[(at > 0) & (at < n - 1)]
        before, after = raw[at - 1], raw[at + 1]
        inside = (before > 32) & (before != 127) & (after > 32) & (after != 127) & ~starts[at] & ~starts[at + 1]
        # beyond ASCII, leads of characters that may be white space, and what such characters end in
        inside &= ~_SPACE_LEADS[after] & ~((before >= 128) & (_SPACE_LEADS[raw[at - 2]] | _SPACE_LEADS[raw[at - 3]]))
        starts[at[inside]] = True
        begin = np.flatnonzero(starts)
        return begin, np.append(begin[1:], n)[: len(begin)]

    def count(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.lib.encode_batch_fast(pieces, add_special_tokens=False)]


@lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


class _PartNumbers:
    """Parts of texts to numbers of pre-tokens; texts with special tokens are cut at those first."""

    def __init__(self, split: Splitter):
        self.split, self.memo = split, SpanMemo(self._learn)
        self.piece_number: dict[str, int] = {}

    def _learn(self, parts: list) -> tuple[np.ndarray, np.ndarray]:
        number, values, lengths = self.piece_number, [], []
        for p, _ in parts:
            pieces = self.split.pre_tokens(p)
            lengths.append(len(pieces))
            values += [number.setdefault(x, len(number)) for x in pieces]
        return np.array(values, np.int32), np.array(lengths, np.int64)

    def forget(self) -> None:
        self.piece_number = {}
        self.memo.clear()

    def expand(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers of all pre-tokens, how many each text has, and the special tokens in each."""
        special = self.split.special
        if special is None or not len(column) or not pc.any(pc.match_substring_regex(column, special.pattern)).as_py():
            values, sizes = self._plain(column)
            return values, sizes, np.zeros(len(column), np.int64)
        cut = [special.split(t) if t else [""] for t in column.to_pylist()]
        per = np.array([len(c) for c in cut], np.int64)
        values, sizes = self._plain(pa.array([s for c in cut for s in c], pa.string()))
        return values, np.add.reduceat(sizes, np.cumsum(per) - per), per - 1

    def _plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        text = Utf8(column)
        begin, end = self.split.parts(text)
        return self.memo.expand(text, begin, end, np.zeros(len(begin), np.uint64))


def piece_frequencies(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(piece, freq) over the whole corpus; each task adds up what it has seen before the shuffle."""

    def run(batches):
        numbers = _PartNumbers(splitter(tokenizer))
        total = np.zeros(0, np.int64)

        def flush():
            nonlocal total
            names = list(numbers.piece_number)
            for lo in range(0, len(names), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(names[lo : lo + 50_000], pa.string()), pa.array(total[lo : lo + 50_000])], names=["piece", "freq"])
            total = np.zeros(0, np.int64)
            numbers.forget()

        for batch in slices(batches, text_col, SLICE):
            if len(numbers.piece_number) > 400_000:
                yield from flush()
            values, _, _ = numbers.expand(batch.column(text_col))
            seen = np.bincount(values, minlength=len(numbers.piece_number))
            seen[: len(total)] += total
            total = seen
        yield from flush()

    parts = docs.select(text_col).mapInArrow(run, "piece string, freq long")
    return parts.groupBy("piece").agg(F.sum("freq").alias("freq"))


def count_pieces(pieces: DataFrame, tokenizer: str) -> DataFrame:
    """Piece_hash, mark (more bits of the hash), freq and n, the tokens, of each distinct pre-token."""

    def run(batches):
        split = splitter(tokenizer)
        for batch in batches:
            names = batch.column("piece").to_pylist()
            hashes, marks = _hashes(names)
            n = pa.array(split.count(names), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(marks), batch.column("freq"), n], names=["piece_hash", "mark", "freq", "n"])

    return pieces.mapInArrow(run, "piece_hash long, mark short, freq long, n int")


def _hashes(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64 bits and 15 more of each pre-token, so that among 10 ** 10 of them two alike have odds of 10 ** -4."""
    whole = [xxhash.xxh3_128_intdigest(x.encode()) for x in pieces]
    return np.array([h & (2**64 - 1) for h in whole], np.uint64).view(np.int64), np.array([h >> 64 & 0x7FFF for h in whole], np.int16)


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and n_tokens of every row.

    Added tokens of the tokenizer count as one where they stand in a text, as
    the library does by default. A null or empty text has no tokens; rows that
    repeat an id and a text get one result each.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("fp", F.xxhash64("text"))
    pieces = cut_lineage(count_pieces(piece_frequencies(docs, tokenizer), tokenizer))
    total = pieces.agg(F.sum("freq")).first()[0] or 0
    floor = total / HOT_SHARE
    hot = pieces.where(F.col("freq") >= floor).select("piece_hash", "n").toArrow() if total else None
    keys = hot.column("piece_hash").to_numpy() if hot else np.empty(0, np.int64)
    by = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[by], hot.column("n").to_numpy()[by] if hot else np.empty(0, np.int32)))

    def run(batches):
        numbers, (hot_keys, hot_n) = _PartNumbers(splitter(tokenizer)), shared.value
        owner, hashes, marks, tokens = None, np.zeros(0, np.int64), np.zeros(0, np.int16), np.zeros(0, np.int64)
        for batch in slices(batches, "text", SLICE):
            if len(numbers.piece_number) > 600_000:
                numbers.forget()
            values, sizes, specials = numbers.expand(batch.column("text"))
            if numbers.piece_number is not owner:
                owner, hashes, marks, tokens = numbers.piece_number, hashes[:0], marks[:0], tokens[:0]
            names = list(islice(numbers.piece_number, len(hashes), None))
            fresh, own_marks = _hashes(names)
            at = np.minimum(np.searchsorted(hot_keys, fresh), max(len(hot_keys) - 1, 0))
            known = hot_keys[at] == fresh if len(hot_keys) else np.zeros(len(fresh), bool)
            hashes, marks = np.concatenate([hashes, fresh]), np.concatenate([marks, own_marks])
            tokens = np.concatenate([tokens, np.where(known, hot_n[at], 0) if len(hot_keys) else np.zeros(len(fresh), np.int64)])
            row = np.repeat(np.arange(batch.num_rows), sizes)
            sums = np.bincount(row, tokens[values], minlength=batch.num_rows).astype(np.int64) + specials
            cold = tokens[values] == 0
            pair, freq = np.unique((row[cold] << 32) | values[cold], return_counts=True)
            at_row, piece = pair >> 32, pair & 0xFFFFFFFF
            rows = np.concatenate([np.arange(batch.num_rows), at_row])
            ids, fps = batch.column("id").take(pa.array(rows)), batch.column("fp").take(pa.array(rows))
            own = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    fps,
                    pa.array(np.concatenate([np.full(own, -1, np.int16), marks[piece]])),
                    pa.array(np.concatenate([batch.column("fp").to_numpy(), hashes[piece]])),
                    pa.array(np.concatenate([sums, freq])),
                    pa.array(np.concatenate([pc.binary_length(batch.column("text")).to_numpy().astype(np.int64), np.zeros(len(pair), np.int64)])),
                ],
                names=["id", "fp", "mark", "piece_hash", "tokens", "n_bytes"],
            )

    long = T.LongType()
    fields = [("id", docs.schema["id"].dataType), ("fp", long), ("mark", T.ShortType()), ("piece_hash", long), ("tokens", long), ("n_bytes", long)]
    parts = docs.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in fields]))
    # A document's own row carries the sum of its hot pre-tokens. Its mark matches no pre-token, and its key spreads it.
    cold = pieces.where(F.col("freq") < floor).select("piece_hash", "mark", "n")
    whole = F.col("mark") < 0
    each = F.when(whole, F.lit(1)).otherwise(F.coalesce("n", F.raise_error(F.lit("a pre-token was not counted")).cast("int")))
    per_doc = (
        parts.join(cold, ["piece_hash", "mark"], "left")
        .groupBy("id", "fp")
        .agg(F.sum(F.col("tokens") * each).alias("tokens"), F.max("n_bytes").alias("n_bytes"), F.count(F.when(whole, 1)).cast("int").alias("rows"))
    )
    return per_doc.select(F.col("id").alias(id_col), "n_bytes", F.expr("tokens div rows").alias("n_tokens"), F.explode(F.array_repeat(F.lit(0), F.col("rows"))).alias("_copy")).drop("_copy")
