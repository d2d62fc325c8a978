"""SentencePiece BPE encoding and decoding as vectorised merge rounds.

All words of a slice of documents lie in one flat symbol array. Each round
looks up the rank of every adjacent pair, takes the minimum per word, merges
the leftmost non-overlapping pairs of that rank in all words at once and
compacts the array; a word leaves when it has no pair with a rank.

Merging several pairs of one rank at once equals the library's one-by-one order
only if no longer piece built on the merged one ranks before it. That is known
per piece from the vocabulary; for the other pieces a round merges only the
leftmost pair of a word. Words that need more than ``ROUNDS`` rounds are ended
by an exact queue, so that long runs stay cheap.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftline.llm.common import SpanMemo, Utf8, fresh_name, slices, spans, with_columns

SPACE = "▁"
ROUNDS = 48
#: Bytes of text, and ids, that a step holds at once, besides a single longer text.
TEXT_SLICE, ID_SLICE = 1 << 20, 1 << 18
_NONE = np.int32(2**31 - 1)


class PieceCodec:
    """Tables of one model, and the memo of encoded segments of one worker."""

    def __init__(self, model: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(self.size)]
        normal = {p: i for i, p in enumerate(names) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))}
        score = {p: lib.get_score(i) for p, i in normal.items()}
        self.unknown, self.control = lib.unk_id(), np.array([lib.is_control(i) for i in range(self.size)])
        self.byte_id = np.zeros(256, np.int32)
        self.byte_of = np.full(self.size, -1, np.int32)
        for i, p in enumerate(names):
            if lib.is_byte(i):
                self.byte_id[int(p[3:5], 16)], self.byte_of[i] = i, int(p[3:5], 16)
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        rank = {p: order[s] for p, s in score.items()}
        self.names, self.is_byte = names, self.byte_of >= 0

        self.symbol = np.arange(0x110000, dtype=np.int32) + self.size
        for p, i in normal.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        keys, merged, best = [], [], {}
        for q, i in normal.items():
            for k in range(1, len(q)):
                a, b = q[:k], q[k:]
                if a in normal and b in normal:
                    keys.append(normal[a] * self.size + normal[b])
                    merged.append(i)
                    for x in (normal[a], normal[b]):
                        best[x] = min(best.get(x, _NONE), rank[q])
        by = np.argsort(keys) if keys else np.empty(0, np.int64)
        self.keys = np.array(keys, np.int64)[by]
        self.merged = np.array(merged, np.int32)[by]
        self.piece_rank = np.full(self.size, _NONE, np.int32)
        for p, i in normal.items():
            self.piece_rank[i] = rank[p]
        self.ranks = self.piece_rank[self.merged]
        self._index_pairs()
        self.safe = np.array([best.get(i, _NONE) > self.piece_rank[i] for i in range(self.size)])
        # A line feed stands alone in models that have no piece with one; words then end there too.
        self.splits_lines = not any("\n" in p for p in normal)

        text = [b"" if self.control[i] else " ⁇ ".encode() if i == self.unknown else bytes([self.byte_of[i]]) if self.is_byte[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.out_len = np.array([len(t) for t in text], np.int64)
        self.out_at = np.cumsum(self.out_len) - self.out_len
        self.out = np.frombuffer(b"".join(text), np.uint8)
        self.leads = np.array([p.startswith(SPACE) and not self.control[i] for i, p in enumerate(names)])
        self.memo = SpanMemo(self._encode_segments)

    # -- encoding ---------------------------------------------------------

    def segments(self, text: Utf8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where independent segments begin and end, and which of them open a text.

        Pieces never hold a space after another character, so a segment begins
        at the first of each run of spaces, at line feeds, and where a text
        does; there the library adds a space.
        """
        raw = text.raw[: text.n]
        space = raw == 32
        starts = space.copy()
        starts[1:] &= ~space[:-1]
        if self.splits_lines:
            starts |= raw == 10
        opens = text.opens()
        starts[opens] = True
        begin = np.flatnonzero(starts)
        first = np.zeros(text.n, np.uint64)
        first[opens] = 1
        return begin, np.append(begin[1:], text.n)[: len(begin)], first[begin]

    def _index_pairs(self) -> None:
        """An open-addressed table of the pairs, at most a quarter full."""
        self.bits = max(4, int(len(self.keys)).bit_length() + 2)
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_pair = np.zeros(1 << self.bits, np.int32)
        for i, (k, s) in enumerate(zip(self.keys.tolist(), self._slot(self.keys).tolist())):
            while self.slot_key[s] >= 0:
                s = (s + 1) & ((1 << self.bits) - 1)
            self.slot_key[s], self.slot_pair[s] = k, i

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair; the rank is _NONE where there is none."""
        rank, piece = np.full(len(left), _NONE, np.int32), np.zeros(len(left), np.int32)
        open_ = np.flatnonzero((left < self.size) & (right < self.size))
        key = left[open_].astype(np.int64) * self.size + right[open_]
        slot = self._slot(key)
        while len(open_):
            found = self.slot_key[slot]
            hit = found == key
            pair = self.slot_pair[slot[hit]]
            rank[open_[hit]], piece[open_[hit]] = self.ranks[pair], self.merged[pair]
            on = ~hit & (found >= 0)
            open_, key, slot = open_[on], key[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return rank, piece

    def _encode_segments(self, segments: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
        plain = [(SPACE + s if opens else s).replace(" ", SPACE) for s, opens in segments]
        sizes = np.fromiter(map(len, plain), np.int64, len(plain))
        symbols = self.symbol[np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(plain)), sizes)
        done_symbols, done_words = [], []
        for _ in range(ROUNDS):
            if not len(symbols):
                break
            last = np.ones(len(word), bool)
            last[:-1] = word[1:] != word[:-1]
            rank = np.full(len(symbols), _NONE, np.int32)
            piece = np.zeros(len(symbols), np.int32)
            rank[:-1], piece[:-1] = self._pair_ranks(symbols[:-1], symbols[1:])
            rank[last] = _NONE
            ends = np.flatnonzero(last)
            starts = np.concatenate([[0], ends[:-1] + 1])
            least = np.repeat(np.minimum.reduceat(rank, starts), ends - starts + 1)
            over = least == _NONE
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
            at = np.flatnonzero((rank == least) & ~over)
            if not len(at):
                symbols = symbols[:0]
                break
            first = np.ones(len(at), bool)
            first[1:] = word[at[1:]] != word[at[:-1]]
            opens = np.ones(len(at), bool)
            opens[1:] = at[1:] != at[:-1] + 1
            index = np.arange(len(at))
            in_run = index - np.maximum.accumulate(np.where(opens, index, 0))
            at = at[first | (self.safe[piece[at]] & (in_run % 2 == 0))]
            symbols = symbols.copy()
            symbols[at] = piece[at]
            keep = ~over
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        if len(symbols):
            rest = self._finish(symbols, word)
            done_symbols.append(rest[0])
            done_words.append(rest[1])
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        by = np.argsort(word, kind="stable")
        return self._to_ids(symbols[by], word[by], len(plain))

    def _finish(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge what is left pair by pair, best and leftmost first."""
        pair = dict(zip(self.keys.tolist(), self.merged.tolist()))
        out, words = [], []
        cuts = np.flatnonzero(np.diff(word)) + 1
        for part, w in zip(np.split(symbols, cuts), word[np.concatenate([[0], cuts])]):
            s = part.tolist()
            n = len(s)
            left, right = list(range(-1, n - 1)), [*range(1, n), -1]
            queue: list = []

            def offer(i: int, j: int) -> None:
                if i >= 0 and j >= 0 and s[i] < self.size and s[j] < self.size and (m := pair.get(s[i] * self.size + s[j])) is not None:
                    heapq.heappush(queue, (int(self.piece_rank[m]), i, j, s[i], s[j], m))

            for i in range(n - 1):
                offer(i, i + 1)
            while queue:
                _, i, j, a, b, m = heapq.heappop(queue)
                if s[i] != a or s[j] != b or right[i] != j:
                    continue
                s[i], s[j] = m, -1
                right[i] = right[j]
                if right[j] >= 0:
                    left[right[j]] = i
                offer(left[i], i)
                offer(i, right[i])
            s = [x for x in s if x >= 0]
            out.append(np.array(s, np.int64))
            words.append(np.full(len(s), w))
        return np.concatenate(out), np.concatenate(words)

    def _to_ids(self, symbols: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece become the bytes of their character."""
        odd = symbols >= self.size
        if odd.any():
            data = [self.byte_id[list(chr(c).encode("utf-8", "surrogatepass"))] for c in (symbols[odd] - self.size).tolist()]
            reps = np.ones(len(symbols), np.int64)
            reps[odd] = [len(d) for d in data]
            flat = np.repeat(symbols, reps)
            flat[np.repeat(odd, reps)] = np.concatenate(data)
            symbols, word = flat, np.repeat(word, reps)
        return symbols.astype(np.int32), np.bincount(word, minlength=n)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each has; null texts have none."""
        if len(column) and pc.any(pc.match_substring(column, SPACE)).as_py():
            column = pc.replace_substring(column, SPACE, " ")
        text = Utf8(column)
        return self.memo.expand(text, *self.segments(text))

    # -- decoding ---------------------------------------------------------

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        lengths = self.out_len[ids]
        flat = self.out[spans(self.out_at[ids], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(counts)
        texts = []
        for lo, hi in zip((ends - counts).tolist(), ends.tolist()):
            raw = flat[total[lo] : total[hi]].tobytes()
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                text = self._decode_loose(ids[lo:hi])
            if text and text[0] == " ":
                own = ids[lo:hi]
                own = own[~self.control[own]][:1]
                if len(own) and self.leads[own[0]]:
                    text = text[1:]
            texts.append(text)
        return texts

    def _decode_loose(self, ids: np.ndarray) -> str:
        """Runs of byte pieces that aren't UTF-8: each wrong byte becomes one replacement character."""
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + n].decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids.tolist():
            if self.is_byte[i]:
                run.append(int(self.byte_of[i]))
            else:
                flush()
                if not self.control[i]:
                    out.append(" ⁇ " if i == self.unknown else self.names[i].replace(SPACE, " "))
        flush()
        return "".join(out)


@lru_cache(maxsize=2)
def codec(model: str) -> PieceCodec:
    """One codec per worker and model."""
    return PieceCodec(model)


def encode(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add the piece ids of each whole text as an array of int; a null or empty text has none."""

    def make():
        table = codec(model)
        return lambda column: [_lists(*table.encode(column))]

    return with_columns(docs, text_col, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], make, TEXT_SLICE)


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))


def round_trip(docs: DataFrame, model: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Add the ids of each whole text and the text that they decode to, as ``decode(encode(docs))`` does, by one worker a task.

    A null or empty text has no ids and decodes to an empty one.
    """

    def make():
        table = codec(model)

        def step(column: pa.Array) -> list:
            ids, counts = table.encode(column)
            return [_lists(ids, counts), pa.array(table.decode(ids, counts), pa.string())]

        return step

    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(decoded_col, T.StringType())]
    return with_columns(docs, text_col, fields, make, TEXT_SLICE)


def decode(docs: DataFrame, model: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add the text of each id array; null ids, and none, give an empty text, an id outside the vocabulary an error."""
    fields = [f for f in docs.schema.fields if f.name.lower() != text_col.lower()]
    names = [f.name for f in fields]
    source = ids_col if ids_col in names else fresh_name(docs, "_source")
    if source not in names:
        docs = docs.withColumn(source, docs[ids_col])

    def run(batches):
        table = codec(model)
        for part in slices(batches, source, ID_SLICE):
            lists = part.column(source)
            counts = np.array([len(x) if x is not None else 0 for x in lists], np.int64) if lists.null_count else np.diff(lists.offsets.to_numpy())
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            made = pa.array(table.decode(ids, counts), pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), made], names=[*names, text_col])

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(text_col, T.StringType())]))
