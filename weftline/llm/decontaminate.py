"""Benchmark decontamination by the q-gram lemma.

Texts are folded (lower case, runs of anything but letters and digits as one
space) and compared as UTF-8. An item of m bytes that stands in a document with
at most k edits shares at least m - q + 1 - q * k of its q-grams with it, all of
them on diagonals at most k apart. So shared q-grams are counted per document,
item and diagonal band; bands are twice as wide as their step, which is over k,
and every match lies whole in one of them. Bands that reach the bound are
verified by alignment within the band.

A part of an item counts too: of an item, or of each overlapping piece of a
longer one, shared q-grams in one band that cover ``PART`` bytes and half of it.
Items too short for q-grams are looked for as whole words.

The benchmark is the stated query set. It is broadcast in blocks of bounded
size, each against all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import slices

Q = 12
#: Edits allowed, as a part of an item's bytes.
EDITS = 0.05
#: Items that fold to fewer bytes must stand in the document as they are, as whole words.
LEAST = 24
#: Longer items are looked for in overlapping pieces of this many bytes, so a part of them is found too.
PIECE = 512
#: So are parts, in smaller pieces; and the bytes of a part that count.
SMALL, PART = 128, 64
BLOCK_BYTES = 4 << 20
FILTER_BITS = 22
#: Pairs of equal q-grams looked at together; texts with more are looked at in stretches, which overlap by more than any match is long.
PAIRS, STRETCH, OVERLAP = 500_000, 4096, 640

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def fold(text: str | None) -> np.ndarray:
    if not text:
        return np.empty(0, np.uint8)
    raw = np.frombuffer((text if text.isascii() else text.lower()).encode().translate(_FOLD), np.uint8)
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    keep[0] = raw[0] != 32
    raw = raw[keep]
    return raw[:-1] if len(raw) and raw[-1] == 32 else raw


def grams(raw: np.ndarray) -> np.ndarray:
    """A 64-bit value for each run of Q = 12 bytes."""
    if len(raw) < Q:
        return np.empty(0, np.uint64)
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, 8)).view(np.uint64).ravel()
    x = eight[: len(raw) - Q + 1] * np.uint64(0x9E3779B97F4A7C15) ^ (eight[4:] >> np.uint64(32))
    return x * np.uint64(0xD6E8FEB86659FD93)


class Items:
    """The items of one block, with their q-grams sorted."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        self.ids, self.raw, part = [], [], []
        #: Short items by their first word: (whole item, id).
        self.short: dict[bytes, list[tuple[bytes, int]]] = {}
        for i, t in zip(ids, texts):
            raw = fold(t)
            if len(raw) < LEAST:
                if len(raw):
                    word = raw.tobytes()
                    self.short.setdefault(word.split(b" ")[0], []).append((word, i))
                continue
            for width in (PIECE, SMALL):
                if width == SMALL and len(raw) <= SMALL:
                    continue
                starts = range(0, max(1, len(raw) - width // 2), width // 2) if len(raw) > width else (0,)
                for s in starts:
                    # a rest too short for a piece of its own belongs to the last, so every second piece makes up the item
                    piece = raw[s:] if len(raw) - s - width < LEAST else raw[s : s + width]
                    if len(piece) >= LEAST:
                        self.ids.append(i)
                        self.raw.append(piece)
                        part.append(width == SMALL)
        self.part = np.array(part, bool)
        size = np.array([len(r) for r in self.raw], np.int64)
        self.k = np.floor(EDITS * size).astype(np.int64)
        self.least = np.maximum(1, size - Q + 1 - Q * self.k)
        # bytes that a part must cover, and the fewest q-grams that cover them; larger pieces have smaller ones for that
        self.cover = np.where((size >= PART) & (size <= SMALL), np.maximum(PART, size // 2), 1 << 30)
        self.few = np.minimum(self.least, -(-self.cover // Q))
        keys = [grams(r) for r in self.raw]
        self.key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        self.item = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
        self.at = np.concatenate([np.arange(len(x)) for x in keys]) if keys else np.empty(0, np.int64)
        by = np.argsort(self.key, kind="stable")
        self.key, self.item, self.at = self.key[by], self.item[by], self.at[by]
        opens = np.ones(len(by), bool)
        opens[1:] = self.key[1:] != self.key[:-1]
        #: Each q-gram's number, and with it the items that hold it in order.
        self.rank = np.cumsum(opens) - 1
        self.place = self.rank * max(1, len(self.raw)) + self.item
        self.size = size
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def regions(self, raw: np.ndarray) -> list[tuple[int, int, int, bool, int, int, int]]:
        """(item, least diagonal, largest diagonal, reaches the bound, bytes covered, first and last place in the item) of the bands that reach the bound or cover a part."""
        own = grams(raw)
        where = np.flatnonzero(self.filter[(own >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(where):
            return []
        found = own[where]
        lo, hi = np.searchsorted(self.key, found, "left"), np.searchsorted(self.key, found, "right")
        n = hi - lo
        where, lo, n = where[n > 0], lo[n > 0], n[n > 0]
        if not len(where):
            return []
        if int(n.sum()) <= PAIRS:
            return self._bands(where, lo, n)
        out = []
        for start in range(0, len(own), STRETCH):
            first, last = np.searchsorted(where, (start, start + STRETCH + OVERLAP))
            here, rank, held = where[first:last], self.rank[lo[first:last]], n[first:last]
            parts = -(-int(held.sum()) // PAIRS)
            for edges in zip(*(np.linspace(0, len(self.raw), parts + 1).astype(np.int64)[k : k + parts] for k in (0, 1))):
                low, high = (np.searchsorted(self.place, rank * len(self.raw) + i) for i in edges)
                some = high > low
                if some.any():
                    out += self._bands(here[some], low[some], (high - low)[some])
        return out

    def _bands(self, where: np.ndarray, lo: np.ndarray, n: np.ndarray) -> list[tuple[int, int, int, bool, int, int, int]]:
        """The regions among the places of a text whose q-gram has n entries from lo on."""
        entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        item, at, diagonal = self.item[entry], self.at[entry], np.repeat(where, n) - self.at[entry]
        # enough shared grams of an item at all, before bands are looked at
        often = np.bincount(item, minlength=len(self.least)) >= self.few
        keep = often[item]
        item, at, diagonal = item[keep], at[keep], diagonal[keep]
        if not len(item):
            return []
        step = self.k[item] + 1
        band = np.concatenate([diagonal // step, diagonal // step - 1])
        item, at, diagonal = np.tile(item, 2), np.tile(at, 2), np.tile(diagonal, 2)
        by = np.lexsort((at, band, item))
        item, at, band, diagonal = item[by], at[by], band[by], diagonal[by]
        opens = np.ones(len(by), bool)
        opens[1:] = (item[1:] != item[:-1]) | (band[1:] != band[:-1])
        fresh = opens.copy()
        fresh[1:] |= at[1:] != at[:-1]
        heads = np.flatnonzero(opens)
        count = np.add.reduceat(fresh.astype(np.int64), heads)
        last = np.append(heads[1:], len(at)) - 1
        gap = np.full(len(at), Q)
        gap[:-1] = np.minimum(at[1:] - at[:-1], Q)
        gap[last] = Q
        covered = np.add.reduceat(gap, heads)
        whole = count >= self.least[item[heads]]
        good = whole | (covered >= self.cover[item[heads]])
        low, high = np.minimum.reduceat(diagonal, heads), np.maximum.reduceat(diagonal, heads)
        return list(zip(*(x[good].tolist() for x in (item[heads], low, high, whole, covered, at[heads], at[last]))))

    def words(self, raw: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, 0) of the first place of each short item."""
        if not self.short:
            return []
        text, found, at = raw.tobytes(), {}, 0
        for word in text.split(b" "):
            for item, i in self.short.get(word, ()):
                end = at + len(item)
                if i not in found and text.startswith(item, at) and text[end : end + 1] in (b"", b" "):
                    found[i] = (i, at, end, 0)
            at += len(word) + 1
        return list(found.values())

    def holds_any(self, raw: np.ndarray) -> bool:
        """Whether the text holds an item, or a part that counts."""
        if self.words(raw):
            return True
        for item, low, high, whole, covered, _, _ in self.regions(raw):
            if covered >= self.cover[item]:
                return True
            k, start = int(self.k[item]), max(0, low - int(self.k[item]))
            if whole and align(self.raw[item], raw[start : min(len(raw), high + int(self.size[item]) + k)], low - start - k, high - start + k, k):
                return True
        return False

    def matches(self, raw: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, edits) of the best match of each item, in folded bytes.

        A match of an item, or of a large piece, goes before one of a part. The edits of a part are the bytes of its piece that no shared q-gram covers.
        """
        best: dict[int, tuple[bool, int, int, int]] = {}
        for item, low, high, whole, covered, first, last in self.regions(raw):
            if best.get(self.ids[item], (True, 1))[:2] == (False, 0):
                continue  # there is no better match than one without edits
            k, m = int(self.k[item]), int(self.size[item])
            start = max(0, low - k)
            end = min(len(raw), high + m + k)
            found = align(self.raw[item], raw[start:end], low - start - k, high - start + k, k) if whole else None
            if found:
                match = (bool(self.part[item]), found[2], start + found[0], start + found[1])
            elif covered >= self.cover[item]:
                match = (True, m - covered, max(0, low + first), min(len(raw), high + last + Q))
            else:
                continue
            if self.ids[item] not in best or match[:2] < best[self.ids[item]][:2]:
                best[self.ids[item]] = match
        return sorted([*((i, x[2], x[3], x[1]) for i, x in best.items()), *self.words(raw)])


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best match of the item inside the text with at most ``most`` edits, over diagonals low to high.

    Row by row; column j - i + low of a row is the cell of text position j.
    """
    exact = text.tobytes().find(item.tobytes())
    if exact >= 0:
        return exact, exact + len(item), 0
    width, big = high - low + 1, 1 << 20
    columns = np.arange(width)
    place = columns + low
    cost = np.where((place >= 0) & (place <= len(text)), 0, big)
    origin = np.clip(place, 0, len(text))
    padded = np.concatenate([text.astype(np.int64), np.full(1, -1)])
    for i in range(1, len(item) + 1):
        place = columns + low + i
        inside = (place >= 0) & (place <= len(text))
        other = padded[np.clip(place - 1, -1, len(text) - 1)]
        change = cost + ((other != item[i - 1]) | (place < 1))
        drop = np.append(cost[1:], big) + 1
        came = np.append(origin[1:], 0)
        take = drop < change
        now, since = np.where(take, drop, change), np.where(take, came, origin)
        now = np.where(inside, now, big)
        # insertions: the running minimum of cost minus column, taken from the left
        lead = now - columns
        least = np.minimum.accumulate(lead)
        source = np.maximum.accumulate(np.where(lead == least, columns, 0))
        cost, origin = np.minimum(least + columns, big), since[source]
        if cost.min() > most:
            return None
    at = int(np.argmin(cost))
    if cost[at] > most:
        return None
    return int(origin[at]), int(at + low + len(item)), int(cost[at])


def _blocks(benchmark: DataFrame, id_col: str | None, text_col: str):
    """Broadcasts of (ids, texts), each of about BLOCK_BYTES of text."""
    ident = F.col(id_col).cast("long") if id_col else F.lit(0)
    items = benchmark.select(ident.alias("item"), F.col(text_col).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for b in range(blocks):
        part = (items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) if blocks > 1 else items).toArrow()
        yield benchmark.sparkSession.sparkContext.broadcast((part.column("item").to_pylist(), part.column("text").to_pylist()))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, start, end, edits) of every benchmark item that stands in a document; a name that the id has gets an underscore.

    Places are in the folded text; an item counts once per document, at its best
    match. Null and empty texts hold and are nothing; repeated items are found
    each under their own id, repeated documents each as a row of its own.
    """
    longs = [f"{c}_" if c == id_col.lower() else c for c in ("item_id", "start", "end", "edits")]
    schema, out = T.StructType([docs.schema[id_col], *(T.StructField(n, T.LongType()) for n in longs)]), None
    for shared in _blocks(benchmark, item_col, item_text_col):

        def run(batches, shared=shared):
            block = Items(*shared.value)
            for batch in slices(batches, text_col):
                rows, found = [], []
                for r, text in enumerate(batch.column(text_col).to_pylist()):
                    for m in block.matches(fold(text)):
                        rows.append(r)
                        found.append(m)
                columns = list(zip(*found)) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], names=[id_col, *longs])

        one = docs.select(id_col, text_col).mapInArrow(run, schema)
        out = one if out is None else out.union(one)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with their own columns.

    Null and empty texts hold none and stay; null and empty items are in no
    text; a repeated document stays or goes with all its rows.
    """
    out = docs
    for shared in _blocks(benchmark, None, item_text_col):

        def run(batches, shared=shared):
            block = Items(*shared.value)
            for batch in slices(batches, text_col):
                yield batch.filter(pa.array([not block.holds_any(fold(t)) for t in batch.column(text_col).to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
