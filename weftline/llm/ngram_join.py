"""Near duplicates by a Jaccard join on word shingles, under several global token orders.

A document is the set of its distinct shingles. Texts are cut into shingles
once; every later step reads the stored sets. Equal sets form one class and are
joined once. Two sets can reach the threshold only if they share a token among
the first n - ceil(t * n) + 1 of each, under any order of all tokens. The
prefixes are indexed under ``orders`` unrelated orders; a pair of classes is a
candidate only if it shares prefix tokens under each of them, and enough of
them that the rest can still make up the overlap it needs. Sketches of the sets, a
fortieth of their size, bound what candidates can share; those that can reach the threshold are
verified on their whole sets.

Tokens that many documents hold come last in every order, so shared passages seldom
reach a prefix, and buckets stay small. Those frequent within some task's documents are known
from the first pass. A token that is spread more thinly shows as a bucket of over ``BUCKET`` entries: no pairs are
made there, the token joins the frequent ones, in a filter of bounded size, and prefixes are made anew, until no such
bucket is left. So no bucket is compared pair by pair beyond that size, however rows are dealt. Documents made up mostly of such tokens
are members of large families. Among those no pairs are enumerated at first:
in each bucket all are compared with its hub, the member that has the fewest
tokens of its own, as the text that the others were copied from has. What is
linked becomes components, and then only pairs of different components are
compared, where the places of the shared token in both prefixes leave room for
the overlap they need. Both steps, too, keep only pairs that meet under every
order. So a family of m near copies costs about m comparisons, and no link
between components is lost. Buckets of families are joined by Spark, which
splits those that are large, and hubs are found by partial aggregation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import cut_lineage, fresh_name, mix, slices, window_hashes, written
from weftline.llm.components import components
from weftline.llm.passages import FlatWords, by_shard, ident, ids_of, packed, packed_schema, real_id, slots

GRAM, THRESHOLD, ORDERS = 5, 75, 2
#: Bound of the broadcast list of frequent tokens (8 bytes each).
MOST_HOT = 1 << 20
#: Tokens of a task looked at together for frequent ones, and the documents among them that make one frequent.
LOOK, OFTEN = 2_000_000, 3
#: Entries of a token's bucket that are compared pair by pair; a token with more is a frequent one.
BUCKET = 2000
#: Rounds of looking for such tokens. What then is left is compared all the same.
ROUNDS = 8
#: Bits of the broadcast filter of classes in candidate pairs and, at most, of lost ids (16 MB), and at most of that of frequent tokens (128 MB, which 16 million fill to an eighth).
FILTER_BITS, MOST_FILTER_BITS = 27, 30
#: Pairs that a task holds before it sends them on.
HELD_PAIRS = 4_000_000
#: Distinct sets a task remembers, to store each once.
HELD_SETS = 200_000
#: Bytes of a class key (part of its fingerprint: two classes have one key in 10 ** 17 pairs), and of a token beside its shard.
KEY_BYTES, TOKEN_BYTES = 7, 4
KEY = (1 << 8 * KEY_BYTES) - 1
#: Step between size classes; sets of one bucket are compared if their classes allow it.
LENGTHS = 1.1
#: Prefix tokens a task holds before it sends them on.
HELD_TOKENS = 1_000_000
#: The kind of packed rows with tokens of large buckets.
LARGE = 100
#: A count of shared tokens that stands for as many or more.
MANY = (1 << 16) - 1


def shingle_sets(column: pa.Array, gram: int = GRAM) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle, an empty one has none."""
    flat = FlatWords(column, lower=True)
    grams = window_hashes(flat.words, gram)
    out = []
    for start, n in zip(flat.starts.tolist(), flat.sizes.tolist()):
        if n >= gram:
            own = np.sort(grams[start : start + n - gram + 1])
            fresh = own[1:] != own[:-1]
            out.append(own if fresh.all() else own[np.concatenate([[True], fresh])])
        else:
            out.append(window_hashes(flat.words[start : start + n], n, 1000 + n) if n else grams[:0])
    return out


def to_planes(tokens: np.ndarray) -> bytes:
    """Sorted tokens as bytes, all first ones before all second ones and so on, as the leading ones, in order, then compress."""
    return np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(tokens.tobytes())
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(h >> 64), signed(h & (2**64 - 1))


def prefix_length(n, threshold: int):
    return n - -(-threshold * n // 100) + 1


def _narrow(x: np.ndarray, width: int) -> np.ndarray:
    """The lowest bytes of each number."""
    return np.ascontiguousarray(x.astype(np.uint64)).view(np.uint8).reshape(-1, 8)[:, :width]


def _widen(raw: bytes, width: int) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8).reshape(-1, width)
    out = np.zeros((len(data), 8), np.uint8)
    out[:, :width] = data
    return out.view(np.uint64).ravel()


def _length_class(n: int) -> int:
    return min(127, int(np.log(n) / np.log(LENGTHS)))


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of how many tokens fall in each of 64 cells or more, one to two for a token: two sets differ in as many tokens at least as their sketches in cells."""
    cells = 1 << max(6, int(len(tokens) - 1).bit_length())
    return np.packbits(np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1, bitorder="little").tobytes()


def cells_apart(a: bytes, b: bytes) -> int:
    """In how many cells two sketches differ, the larger one folded to the size of the other."""
    few, many = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(few ^ np.bitwise_xor.reduce(many.reshape(-1, len(few)), axis=0)).sum())


PROFILE = "kind int, a long, n long, c long, d long, row long, tokens binary, sketch binary"


def _profiles(docs: DataFrame, gram: int) -> DataFrame:
    """Of kind 0 the id (a), set size and fingerprint (c, d) of each document, with the set itself and its sketch where it is the task's first; of kind 1 a token (a) and how many of a task's distinct sets hold it (n)."""

    def run(batches):
        held, n, seen, row = [], 0, set(), TaskContext.get().partitionId() << 33
        names = ["kind", "a", "n", "c", "d", "row", "tokens", "sketch"]

        def frequent():
            tokens = np.concatenate(held)
            held.clear()
            tokens.sort()
            # in sorted order a token that stands OFTEN times equals the one so many places on
            found = np.unique(tokens[OFTEN - 1 :][tokens[OFTEN - 1 :] == tokens[: len(tokens) - OFTEN + 1]])
            count = np.searchsorted(tokens, found, "right") - np.searchsorted(tokens, found)
            none = lambda kind: pa.nulls(len(found), kind)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(found), np.int32)), pa.array(found.view(np.int64)), pa.array(count), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.binary()), none(pa.binary())], names=names)

        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), gram)
            prints = [fingerprint(s) for s in sets]
            stored, rows, sketches = [], [], []
            if len(seen) > HELD_SETS:
                seen.clear()
            for s, p in zip(sets, prints):
                if p in seen or not len(s):
                    stored.append(None)
                    rows.append(None)
                    sketches.append(None)
                    continue
                seen.add(p)
                held.append(s)
                n += len(s)
                stored.append(to_planes(s))
                sketches.append(sketch(s))
                rows.append(row)
                row += 1
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            p = np.array(prints, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), pa.array(ids_of(batch.column("id"))), pa.array(sizes), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(rows, pa.int64()), pa.array(stored, pa.binary()), pa.array(sketches, pa.binary())], names=names)
            if n > LOOK:
                yield frequent()
                n = 0
        if held:
            yield frequent()

    return docs.mapInArrow(run, PROFILE)


def _spread(place: list[np.ndarray], bits: np.ndarray | None) -> np.ndarray:
    """Which tokens, given by their place in each order, the filter of frequent ones has under any order; a few others too, but the same ones everywhere."""
    often = np.zeros(len(place[0]), bool)
    for o, x in enumerate(place if bits is not None else ()):
        often |= _in_filter((x >> np.uint64(32)) | np.uint64(o << 32), bits)
    return often


def _met(sets: DataFrame, hot, spread, threshold: int, orders: int, bucket_bound: int) -> DataFrame:
    """Packed rows of pairs (kind o), of family members (kind -1 - o) and of tokens with too large a bucket (kind 100)."""
    names, seeds = slots(sets), range(orders)
    shards = len(names)

    def partition(batches):
        known, filter_bits, held, n = hot.value, spread.value if spread else None, [], 0

        def flush():
            """Per shard the tokens, and for each document there (many tokens make several entries) its key, facts and tokens per order."""
            if not held:
                return
            tokens, keys, facts, sizes = (np.concatenate(x) for x in zip(*held))
            held.clear()
            doc = np.repeat(np.arange(len(keys)), sizes)
            order = (np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // (sizes[doc] // orders)
            shard = (tokens % np.uint64(shards)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            shard, doc, order, short = shard[by], doc[by], order[by], (tokens[by] >> np.uint64(32)).astype(np.uint32)
            opens, index = np.ones(len(by), bool), np.arange(len(by))
            opens[1:] = (shard[1:] != shard[:-1]) | (doc[1:] != doc[:-1])
            opens |= (index - np.maximum.accumulate(np.where(opens, index, 0))) % 255 == 0
            heads = np.flatnonzero(opens)
            entry = np.empty((len(heads), 1 + orders), np.uint8)
            entry[:, 0] = facts[doc[heads]]
            for o in seeds:
                entry[:, 1 + o] = np.add.reduceat((order == o).astype(np.int64), heads)
            own = _narrow(keys[doc[heads]], KEY_BYTES)
            at, cut = np.searchsorted(shard, np.arange(shards + 1)), np.searchsorted(shard[heads], np.arange(shards + 1))
            have = np.flatnonzero(np.diff(at)).tolist()
            blobs = [[x[c[s] : c[s + 1]].tobytes() for s in have] for x, c in ((short, at), (own, cut), (entry, cut))]
            for lo in range(0, len(have), 256):
                part = slice(lo, lo + 256)
                yield pa.RecordBatch.from_arrays([pa.array(names[have[part]], pa.int32()), pa.array(np.zeros(len(have[part]), np.int32)), *(pa.array(x[part], pa.binary()) for x in blobs)], names=["shard", "kind", "a", "b", "c"])

        for batch in slices(batches, "tokens"):
            blobs = batch.column("tokens").to_pylist()
            flat = np.concatenate([from_planes(b) for b in blobs])
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                often = known[at] == flat
            else:
                often = np.zeros(len(flat), bool)
            place = [mix(flat, 50 + o) for o in seeds]
            often |= _spread(place, filter_bits)
            last = often.astype(np.uint64) << np.uint64(63)
            rank = [last | (x >> np.uint64(1)) for x in place]
            total = np.concatenate([[0], np.cumsum(often)])
            members, lo = [], 0
            for key, blob in zip(batch.column("k").to_pylist(), blobs):
                size = len(blob) // 8
                hi = lo + size
                p, rare = prefix_length(size, threshold), size - int(total[hi] - total[lo])
                family = rare < p
                own = []
                for o in seeds:
                    first = lo + (np.argsort(rank[o][lo:hi])[:p] if family else np.argpartition(rank[o][lo:hi], p - 1)[:p])
                    own.append(place[o][first])
                held.append((np.concatenate(own), np.array([key], np.uint64), np.array([2 * _length_class(size) + family], np.uint8), np.array([orders * p])))
                n += orders * p
                if family:
                    members += [(names[key % shards], -1 - o, np.array([key, size, rare], np.uint64).tobytes(), own[o].tobytes(), b"") for o in seeds]
                lo = hi
            if members:
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*members), kinds)], names=["shard", "kind", "a", "b", "c"])
            if n > HELD_TOKENS:
                yield from flush()
                n = 0
        yield from flush()

    steps = int(np.ceil(np.log(100 / threshold) / np.log(LENGTHS))) + 1

    def meet(held):
        """Pairs of each bucket of a token; family members go on to a round of their own."""
        for o in seeds:
            for facts, tokens, _ in zip(*held.get(-1 - o, ((), (), ()))):
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([-1 - o], pa.int32()), pa.array([facts], pa.binary()), pa.array([tokens], pa.binary()), pa.array([b""], pa.binary())], names=["shard", "kind", "a", "b", "c"])
        if 0 not in held:
            return
        every, own = np.frombuffer(b"".join(held[0][0]), np.uint32), _widen(b"".join(held[0][1]), KEY_BYTES)
        entry = np.frombuffer(b"".join(held[0][2]), np.uint8).reshape(-1, 1 + orders).astype(np.int64)
        ends = np.cumsum(entry[:, 1:], axis=1)
        doc = np.repeat(np.arange(len(own)), ends[:, -1])
        inside = np.arange(len(every)) - np.repeat(np.cumsum(ends[:, -1]) - ends[:, -1], ends[:, -1])
        order = (inside[:, None] >= ends[doc]).sum(axis=1)
        for o in seeds:
            here = order == o
            tokens, keys, facts = every[here], own[doc[here]], entry[doc[here], 0]
            if not len(tokens):
                continue
            by = np.argsort(tokens)
            again = tokens[by][1:] == tokens[by][:-1]
            by = by[np.concatenate([again, [False]]) | np.concatenate([[False], again])]
            tokens, keys, facts = tokens[by], keys[by], facts[by]
            sizes, family = facts >> 1, facts & 1 == 1
            by = np.lexsort((keys, sizes, tokens))
            tokens, keys, sizes, family = tokens[by], keys[by], sizes[by], family[by]
            fresh = np.ones(len(by), bool)
            fresh[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])
            tokens, keys, sizes, family = tokens[fresh], keys[fresh], sizes[fresh], family[fresh]
            opens = np.ones(len(tokens), bool)
            opens[1:] = tokens[1:] != tokens[:-1]
            bucket = np.cumsum(opens) - 1
            if not len(tokens):
                continue
            size, members = np.bincount(bucket), np.bincount(bucket, family)
            large = (size > bucket_bound) & (members < size)
            if large.any():
                ids = (tokens[opens][large].astype(np.uint64) | np.uint64(o << 32)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([LARGE], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary())], names=["shard", "kind", "a", "b", "c"])
            ends = np.append(np.flatnonzero(opens)[1:], len(tokens))[bucket]
            one, two, n = [], [], 0

            def flush(o=o):
                a, b = np.concatenate(one), np.concatenate(two)
                one.clear()
                two.clear()
                a, b = np.minimum(a, b), np.maximum(a, b)
                by = np.lexsort((b, a))
                a, b = a[by], b[by]
                heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
                count = np.minimum(np.diff(np.append(heads, len(a))), MANY).astype(np.uint16)
                a, b = a[heads], b[heads]
                yield from packed((mix(a * np.uint64(3) + b) % np.uint64(shards)).astype(np.int64), shards, [_narrow(a, KEY_BYTES), _narrow(b, KEY_BYTES), count], kind=o, named=names)

            step, left = 1, np.flatnonzero(~large[bucket])
            while len(left):
                left = left[left + step < ends[left]]
                right = left + step
                near = sizes[right] - sizes[left] <= steps
                left, right = left[near], right[near]  # sizes ascend in a bucket, so those farther off differ more
                plain = ~(family[left] & family[right])
                if plain.any():
                    one.append(keys[left[plain]])
                    two.append(keys[right[plain]])
                    n += len(one[-1])
                if n > HELD_PAIRS:
                    yield from flush()
                    n = 0
                step += 1
            if one:
                yield from flush()

    return cut_lineage(by_shard(sets.select("k", "tokens").mapInArrow(partition, packed_schema(3)), meet, packed_schema(3), 3))


def _candidates(sets: DataFrame, hot, threshold: int, orders: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (k1, k2, n0, n1, ...) of class keys with the prefix tokens they share per order, and the family members (k, n, rare, o, tokens) with their prefix under each order."""
    seeds, spread, found = range(orders), None, None
    for k in range(ROUNDS + 1):
        met = _met(sets, hot, spread, threshold, orders, BUCKET if k < ROUNDS else 1 << 62)
        large = met.where(F.col("kind") == LARGE)
        if large.isEmpty():
            break
        ids = large.select("a").mapInArrow(_long_rows, "row long")
        found = cut_lineage((ids if found is None else ids.union(found)).distinct())
        bits = min(MOST_FILTER_BITS, max(16, int(16 * found.count()).bit_length()))
        spread = sets.sparkSession.sparkContext.broadcast(_row_filter(found, bits))

    def intersect(held):
        """Add up the shared prefix tokens per order, and keep the pairs that every order has."""
        found = None
        for o in seeds:
            if o not in held:
                return
            a, b, count = _widen(b"".join(held[o][0]), KEY_BYTES), _widen(b"".join(held[o][1]), KEY_BYTES), np.frombuffer(b"".join(held[o][2]), np.uint16)
            by = np.lexsort((b, a))
            a, b, count = a[by], b[by], np.where(count[by] < MANY, count[by].astype(np.int64), np.int64(1 << 40))
            heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            here = (a[heads], b[heads], np.add.reduceat(count, heads)[:, None])
            if found is not None:
                # of two sorted lists of different pairs, those that stand twice in both together
                a, b = (np.concatenate([found[i], here[i]]) for i in (0, 1))
                by = np.lexsort((b, a))
                again = np.flatnonzero((a[by][1:] == a[by][:-1]) & (b[by][1:] == b[by][:-1]))
                one, two = by[again], by[again + 1] - len(found[0])  # the sort is stable
                here = (found[0][one], found[1][one], np.concatenate([found[2][one], here[2][two]], axis=1))
            found = here
        if len(found[0]):
            yield pa.RecordBatch.from_arrays([pa.array(found[0].view(np.int64)), pa.array(found[1].view(np.int64)), *(pa.array(np.ascontiguousarray(found[2][:, o])) for o in seeds)], names=["k1", "k2", *(f"n{o}" for o in seeds)])

    def members(batches):
        for batch in batches:
            facts = np.frombuffer(b"".join(batch.column("a").to_pylist()), np.int64).reshape(-1, 3)
            blobs = batch.column("b").to_pylist()
            ends = np.cumsum([len(b) // 8 for b in blobs], dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.frombuffer(b"".join(blobs), np.int64)))
            order = pa.array(-1 - batch.column("kind").to_numpy(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.array(facts[:, i]) for i in range(3)), order, lists], names=["k", "n", "rare", "o", "tokens"])

    pairs = by_shard(met.where(F.col("kind").between(0, orders - 1)), intersect, "k1 long, k2 long, " + ", ".join(f"n{o} long" for o in seeds), 3)
    return pairs, met.where("kind < 0").select("kind", "a", "b").mapInArrow(members, "k long, n long, rare long, o int, tokens array<long>")


def _long_rows(batches):
    """Packed numbers as rows."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column("a").to_pylist()), np.int64))], names=["row"])


def _in_filter(x: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which numbers may be among those that a filter was made of."""
    shift, keep = np.uint64(64 - (8 * len(bits)).bit_length() + 1), np.ones(len(x), bool)
    for r in range(2):
        at = (mix(x, 70 + r) >> shift).astype(np.int64)
        keep &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return keep


def _row_filter(rows: DataFrame, width: int = FILTER_BITS) -> np.ndarray:
    """A bit array of ``2 ** width`` bits, with two for each number ``row``."""
    parts = 256
    per = (1 << width) // parts

    def run(batches):
        for batch in batches:
            x = batch.column("row").to_numpy().astype(np.uint64)
            at = np.unique(np.concatenate([mix(x, 70 + r) >> np.uint64(64 - width) for r in range(2)])).astype(np.int64)
            yield from packed(at // per, parts, [(at % per).astype(np.uint32)])

    def numbered(batches):
        shard = None
        for batch in batches:
            for s, a in zip(batch.column("shard").to_pylist(), batch.column("a").to_pylist()):
                if s != shard:
                    if shard is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["shard", "bits"])
                    shard, bits = s, np.zeros(per, np.uint8)
                bits[np.frombuffer(a, np.uint32)] = 1
        if shard is not None:
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["shard", "bits"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = rows.mapInArrow(run, packed_schema(1)).repartition(n, F.col("shard")).sortWithinPartitions("shard").mapInArrow(numbered, "shard int, bits binary").toArrow()
    out = np.zeros((1 << width) // 8, np.uint8)
    for s, bits in zip(made.column("shard").to_pylist(), made.column("bits").to_pylist()):
        out[s * per // 8 : (s + 1) * per // 8] = np.frombuffer(bits, np.uint8)
    return out


def _held(rows: DataFrame, n: int):
    """A function of a column that tells which numbers may be among ``n`` rows (row), or fewer: all that are, and while a filter of bounded size has room, few others."""
    bits = min(FILTER_BITS, max(16, int(64 * n).bit_length()))
    shared = rows.sparkSession.sparkContext.broadcast(_row_filter(rows, bits))

    @F.arrow_udf(T.BooleanType())
    def held(numbers: pa.Array) -> pa.Array:
        return pa.array(_in_filter(numbers.to_numpy(zero_copy_only=False).astype(np.uint64), shared.value))

    return held


def _wanted(sets: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """(row, columns) of the sets that pairs (r1, r2) name, and a few others; Python sees the rows' numbers alone."""
    held = _held(pairs.select(F.explode(F.array("r1", "r2")).alias("row")), 2 * pairs.count())
    return sets.select("row", *columns).where(held("row"))


def _both(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (r1, r2) with the columns of both rows, numbered; both joins read one exchange of the rows."""
    side = lambda i: held.select(*(F.col(c).alias({"row": "r"}.get(c, c) + str(i)) for c in held.columns))
    return pairs.join(side(2), "r2").join(side(1), "r1")


def _within_reach(sets: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose sketches leave room for the overlap they need: all that reach the threshold, and few others, so that not every candidate's set travels."""

    def run(batches):
        for batch in batches:
            total = batch.column("n1").to_numpy() + batch.column("n2").to_numpy()
            apart = np.fromiter(map(cells_apart, batch.column("sketch1").to_pylist(), batch.column("sketch2").to_pylist()), np.int64, batch.num_rows)
            yield batch.select(["u", "v", "r1", "r2"]).filter(pa.array((100 + threshold) * (total - apart) >= 2 * threshold * total))

    met = _both(pairs, _wanted(sets, pairs, ["n", "sketch"])).select("u", "v", "r1", "r2", "n1", "n2", "sketch1", "sketch2")
    return cut_lineage(met.mapInArrow(run, "u long, v long, r1 long, r2 long"))


def _verified(sets: DataFrame, classes: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """The links (u, v) between the ids of classes whose whole sets reach the threshold, of pairs (k1, k2) of class keys."""
    first = classes.select(F.col("k").alias("k1"), F.col("id").alias("u"), F.col("holder").alias("r1"))
    second = classes.select(F.col("k").alias("k2"), F.col("id").alias("v"), F.col("holder").alias("r2"))
    pairs = cut_lineage(pairs.distinct().join(first, "k1").join(second, "k2").where("u <> v").select("u", "v", "r1", "r2"))
    near = _within_reach(sets, pairs, threshold)

    def compare(batches):
        for batch in slices(batches, "tokens1"):
            keep = []
            for a, b in zip(batch.column("tokens1").to_pylist(), batch.column("tokens2").to_pylist()):
                few, many = sorted((from_planes(a), from_planes(b)), key=len)
                both = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
                keep.append(100 * both >= threshold * (len(few) + len(many) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    met = _both(near, _wanted(sets, near, ["tokens"]))
    return met.select("u", "v", "tokens1", "tokens2").mapInArrow(compare, "u long, v long").distinct()


def _by_every_order(pairs: DataFrame, orders: int) -> DataFrame:
    """The pairs (k1, k2) among rows (o, k1, k2) that all orders have."""
    return pairs.groupBy("k1", "k2").agg(F.bit_or(F.expr("shiftleft(1, o)")).alias("seen")).where(F.col("seen") == (1 << orders) - 1).select("k1", "k2")


def _hub_pairs(members: DataFrame, orders: int) -> DataFrame:
    """Pairs (k1, k2) of each member with the hubs of its buckets, if they meet under every order."""
    # the fewest own tokens come first; the rest of a rank tells the hub by 48 bits of its key
    ranked = members.withColumn("rank", F.shiftleft(F.least("rare", F.lit((1 << 15) - 1)), 48).bitwiseOR(F.xxhash64("k").bitwiseAND(F.lit((1 << 48) - 1))))
    rows = ranked.select("k", "o", "rank", F.explode("tokens").alias("token"))
    hubs = rows.groupBy("o", "token").agg(F.min("rank").alias("hub"), F.count("*").alias("size")).where("size > 1").select("o", "token", "hub")
    named = ranked.select(F.col("k").alias("k2"), F.col("rank").alias("hub")).distinct()
    found = rows.join(hubs, ["o", "token"]).where("rank <> hub").select("o", "k", "hub").distinct()
    return _by_every_order(found.join(named, "hub").select("o", F.col("k").alias("k1"), "k2"), orders)


def _across(members: DataFrame, threshold: int, orders: int) -> DataFrame:
    """Pairs (k1, k2) of members (with their component) of different components that share a token under every order with room for their overlap."""
    rows = members.select("k", "n", "o", "component", F.posexplode("tokens").alias("place", "token"))
    per = rows.groupBy("o", "token", "component").agg(F.count("*").alias("size"))
    several = per.groupBy("o", "token").agg(F.max(F.struct("size", "component")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    several = cut_lineage(several.select("o", "token", F.col("most.component").alias("big")))
    # no pairs are made within the largest component of a bucket
    here = rows.join(several, ["o", "token"])
    one = here.where("component <> big").select("o", "token", F.col("k").alias("k1"), F.col("n").alias("n1"), F.col("place").alias("p1"), F.col("component").alias("c1"))
    two = here.select("o", "token", F.col("k").alias("k2"), F.col("n").alias("n2"), F.col("place").alias("p2"), F.col("component").alias("c2"), "big")
    room = F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2")) * (100 + threshold) >= threshold * (F.col("n1") + F.col("n2"))
    met = one.join(two, ["o", "token"]).where((F.col("c1") != F.col("c2")) & ((F.col("c2") == F.col("big")) | (F.col("k1") < F.col("k2"))) & room)
    return _by_every_order(met.select("o", F.least("k1", "k2").alias("k1"), F.greatest("k1", "k2").alias("k2")).distinct(), orders)


def grouped(profiles: DataFrame, classes: DataFrame, threshold: int, orders: int) -> DataFrame:
    """(node, component) of the smallest ids of the classes that are linked with others."""
    spark = profiles.sparkSession
    tokens = profiles.where("kind = 1").groupBy(F.col("a").alias("token")).agg(F.sum("n").alias("n"))
    total = tokens.agg(F.sum("n")).first()[0] or 0
    often = tokens.where(F.col("n") * MOST_HOT >= total).select("token").toArrow().column("token").to_numpy() if total else np.empty(0, np.int64)
    hot = spark.sparkContext.broadcast(np.sort(often.view(np.uint64)))
    sets = profiles.where("kind = 0 and row is not null").select("row", F.col("c").bitwiseAND(F.lit(KEY)).alias("k"), "n", "tokens", "sketch")

    pairs, members = _candidates(sets, hot, threshold, orders)
    first = classes.select(F.col("k").alias("k1"), F.col("id").alias("u"), F.col("n").alias("nu"))
    second = classes.select(F.col("k").alias("k2"), F.col("id").alias("v"), F.col("n").alias("nv"))
    need = F.ceil(threshold * (F.col("nu") + F.col("nv")) / (100 + threshold))
    rest = lambda n: F.col(n) - _prefix_length_sql(n, threshold)
    enough = F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * threshold
    for o in range(orders):
        enough &= F.col(f"n{o}") + F.greatest(rest("nu"), rest("nv")) >= need
    plain = pairs.join(first, "k1").join(second, "k2").where(enough).select("k1", "k2")

    members = cut_lineage(members.dropDuplicates(["k", "o"]))
    families = not members.isEmpty()
    near = cut_lineage(_verified(sets, classes, plain.union(_hub_pairs(members, orders)) if families else plain, threshold))
    found = components(near)
    if not families:
        return found
    found = cut_lineage(found)
    at = classes.select("k", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select("k", F.coalesce("component", "id").alias("component"))
    others = cut_lineage(_across(members.join(at, "k"), threshold, orders))
    if others.isEmpty():
        return found
    # the components so far are stars, and join the new links as such
    more = cut_lineage(_verified(sets, classes, others, threshold))
    return components(more.union(found.select(F.col("component").alias("u"), F.col("node").alias("v"))))


def _prefix_length_sql(n: str, threshold: int) -> Column:
    return F.col(n) - F.ceil(threshold * F.col(n) / 100) + 1


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, threshold: int = THRESHOLD, orders: int = ORDERS) -> DataFrame:
    """id, n_shingles and component_id of every document.

    The component is the smallest id reachable over links. Texts without words,
    null ones too, are linked with nothing. Equal rows have one component; rows with one id and
    different texts have the figures of their own texts, and whatever is linked with one of them is in the component of that id.
    Documents without an id come after all others, and a component of such documents alone has a null id. Ids are whole
    numbers, others are a TypeError. An empty table gives no rows. Other columns aren't returned, whatever their names.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers, not {docs.schema[id_col].dataType.simpleString()}")
    rows = docs.select(ident(id_col, text_col).alias("id"), F.col(text_col).alias("text"))
    out = _grouped(rows, gram, threshold, orders)
    return out.select(real_id("id").alias(id_col), F.col("n").alias("n_shingles"), real_id("component").alias("component_id"))


def _grouped(rows: DataFrame, gram: int = GRAM, threshold: int = THRESHOLD, orders: int = ORDERS) -> DataFrame:
    """(id, n, component) of rows (id, text)."""
    profiles = written(_profiles(rows, gram), "zstd")
    own = profiles.where("kind = 0").select(F.col("a").alias("id"), "n", "c", "d", "row")
    classes = cut_lineage(own.where("n > 0").groupBy("n", "c", "d").agg(F.min("id").alias("id"), F.min("row").alias("holder")).withColumn("k", F.col("c").bitwiseAND(F.lit(KEY))))
    parts = grouped(profiles, classes, threshold, orders).withColumnRenamed("node", "id")
    named = classes.join(parts, "id", "left").select("n", "c", "d", F.coalesce("component", "id").alias("component"))
    return own.join(named, ["n", "c", "d"], "left").select("id", "n", F.coalesce("component", "id").alias("component"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents whose id names their component, so one of each group, with all their columns; rows that repeat an id and a text stay together.

    Nulls are as in ``near_duplicates``: a document without words, or without an id and alone in its group, stays.
    """
    own, kept = fresh_name(docs, "_id"), fresh_name(docs, "_kept")
    docs = docs.withColumn(own, ident(id_col, text_col))
    found = _grouped(docs.select(F.col(own).alias("id"), F.col(text_col).alias("text")), **options)
    found = cut_lineage(found.groupBy(F.col("id").alias("row")).agg(F.bool_or(F.col("id") == F.col("component")).alias("stays")))
    # texts don't travel: what the filter of lost ids doesn't have stays, and of the rest the few that it has by chance are joined
    gone = found.where("not stays").select("row")
    lost = _held(gone, gone.count())
    spared = cut_lineage(found.where("stays").select("row").where(lost("row")))
    again = _held(spared, spared.count())
    rest = docs.where(lost(own)).where(again(own)).join(spared.select(F.col("row").alias(kept)), F.col(own) == F.col(kept), "left_semi")
    return docs.where(~lost(own)).union(rest).drop(own)
