"""Ranked search, Merkle manifests and source mixtures against plain Python, with nulls, ties, repeated rows and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from weftline.llm import lexical_search, merkle, mixture, ordering

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = [f"{a}{b}" for a in "Ka lo mi se ru".split() for b in "n t ra é 7 X".split()]


def text_of(rng, n):
    return rng.choice([" ", "-", "\n"]).join(rng.choices(WORDS, [1 / (k + 1) for k in range(len(WORDS))], k=n))


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, source): ties, copies, a repeated row, one id with two texts, null ids, null and empty texts, a hot source."""
    rng = random.Random(11)
    texts = [text_of(rng, rng.choice([1, 3, 8, 20, 60])) for _ in range(160)] + [text_of(rng, 4000), None, "", " \n", "--", "a\x00b_c\x7fd", "é🙂 x"]
    texts += [texts[0]] * 12
    out = [(i, t, "hot" if i % 3 == 0 else [None, "", "s1", "é", "z", "only blank"][i % 6]) for i, t in enumerate(texts, 1)]
    out = [(i, "  " if s == "only blank" else t, s) for i, t, s in out]
    return out + [out[4], (7, "other text Kan", "hot"), (None, "Kan lot", "hot"), (None, None, None), (10**12, "one\ntwo", "alone")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame([(i, t, s, "en", None if i is None else i % 5) for i, t, s in rows], "doc_id long, text string, source string, lang string, n_chars long").repartition(3)
    return df.withColumns({c: F.lit("own") for c in ("id", "g", "size", "score", "rank", "item", "key", "idx", "kid", "kids", "path", "digest", "_bucket", "_tie", "row", "block", "target")})


# -- 11 ----------------------------------------------------------------------


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(rows, items, k):
    have = [(i, collections.Counter(terms(t)), len(terms(t))) for i, t, _ in rows if terms(t)]
    n_docs, n_terms = len(have), sum(n for *_, n in have)
    df = collections.Counter(t for _, c, _ in have for t in c)
    out = {}
    for item in {i for i, _ in items}:
        asked = collections.Counter(t for i, text in set(items) if i == item for t in terms(text))
        found = []
        for i, c, n in have:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, x in asked.items() if t in c)
            found.append((-score, math.inf if i is None else i))
        out[item] = [(None if i == math.inf else i, -s) for s, i in sorted(found)[:k] if s]
    return {item: best for item, best in out.items() if best}


@pytest.mark.parametrize(("shard", "block"), [(1 << 20, 1 << 19), (3000, 40), (1, 1)])
def test_search_equals_brute_force(spark, docs, rows, shard, block, monkeypatch):
    monkeypatch.setattr(lexical_search, "SHARD_BYTES", shard)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
    rng = random.Random(3)
    items = [(k, text_of(rng, rng.choice([1, 2, 6, 25]))) for k in range(25)] + [(100, None), (101, ""), (102, "nowhere"), (None, "Kan kan"), (3, "one more text of mit"), (103, rows[0][1]), (103, rows[0][1])]
    table = spark.createDataFrame(items, "item_id long, text string").withColumns({"score": F.lit("own"), "doc_id": F.lit(1)})
    index = lexical_search.build_index(docs)
    for k in (1, 10):
        got = collections.defaultdict(dict)
        for r in lexical_search.search(index, table, k).collect():
            got[r["item_id"]][r["rank"]] = (r["doc_id"], r["score"])
        want = plain_search(rows, items, k)
        assert {i: [best[j] for j in sorted(best)] for i, best in got.items()} == want
        assert all(sorted(best) == list(range(1, len(best) + 1)) for best in got.values())
    assert 3 in want and None in want and 100 not in want


def test_non_essential_postings_are_probed_for_few_documents(monkeypatch):
    """The frequent term's list is never added up as a whole once the rare one has filled the best."""
    import numpy as np
    import pyarrow as pa

    texts = ["rare common"] * 20 + ["common"] * 2000
    n, keys, ends, (row, tf) = lexical_search._postings(pa.array(texts))
    (_, asked, _, (_, times)) = lexical_search._postings(pa.array(["rare common"]))
    block = lexical_search._Block([{"item": 1, "keys": asked.view(np.int64), "times": times}], pa.int64())
    block.weights = np.array([5000 if ends[np.searchsorted(keys, v)] - (ends[np.searchsorted(keys, v) - 1] if v != keys[0] else 0) == 20 else 1 for v in block.vocabulary], np.int64)
    best, looked = lexical_search._Best(1, 10), []
    zeros = np.zeros
    monkeypatch.setattr(lexical_search.np, "zeros", lambda *a, **b: looked.append(zeros(*a, **b)) or looked[-1])
    lexical_search._search_shard(block, best, np.arange(len(texts)), lexical_search.lengths(n, len(texts), int(n.sum())), keys, ends, row.astype(np.int32), tf.astype(np.int32))
    assert np.count_nonzero(looked[-1]) == 20  # documents whose score was ever looked at
    assert best.held[0][1].tolist() == list(range(10))


def test_lengths_are_exact_beyond_64_bits():
    import numpy as np

    n = np.array([1, 10**9], np.int64)
    assert lexical_search.lengths(n, 10**11, 10**13).tolist() == [25 + 75 * x * 10**11 // 10**13 for x in n.tolist()]


def test_empty_tables_have_no_ranks(spark, docs):
    none = spark.createDataFrame([], "item_id string, text string")
    some = spark.createDataFrame([("a", "Kan")], "item_id string, text string")
    index = lexical_search.build_index(docs)
    assert lexical_search.search(index, none).collect() == []
    empty = lexical_search.search(lexical_search.build_index(docs.limit(0)), some)
    assert empty.collect() == [] and empty.columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical_search.search(index, some).count() == 10


# -- 12 ------------------------------------------------------------------------


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_tree(nodes, fanout=3):
    """(root, the siblings left and right of each node, level by level)."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(place):
            run = at // fanout * fanout
            paths[k].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + fanout])))
            place[k] = at // fanout
        nodes = [sha("".join(nodes[j : j + fanout])) for j in range(0, len(nodes), fanout)]
    return nodes[0], paths


def plain_manifest(rows):
    def leaf(r, text):
        i, _, s = r
        values = [i, s, "en", None if i is None else i % 5, text]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    by = collections.defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = plain_tree([x[2] for x in by[s]])
    root, above = plain_tree([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, above):
        for (_, _, own, r), path in zip(by[s], trees[s][1]):
            path = path + up
            broken = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            acc = leaf(r, r[1].replace("\n", "") if broken and r[1] is not None else r[1])
            for left, right in path:
                acc = sha(left + acc + right)
            out.append((r[0], own, trees[s][0], root, sha("".join(a + b for a, b in path)), acc, acc == root))
    return out


def manifest(docs, **more):
    broken = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    return merkle.manifest(docs, tampered={"text": broken}, **more)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest_equals_plain_python(docs, rows):
    got = [tuple(r[c] for c in COLUMNS) for r in manifest(docs).collect()]
    assert sorted(got, key=repr) == sorted(plain_manifest(rows), key=repr)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("keep", ["source = 'alone'", "source = 'hot'", "doc_id = 9", "source in ('alone', 's1')"])
def test_manifests_of_few_sources_and_single_rows(docs, rows, keep):
    part = docs.where(keep)
    ids = collections.Counter((r["doc_id"], r["text"], r["source"]) for r in part.collect())
    want = plain_manifest([r for r, n in ids.items() for _ in range(n)])
    assert sorted((tuple(r[c] for c in COLUMNS) for r in manifest(part).collect()), key=repr) == sorted(want, key=repr)


def test_manifest_without_rows_and_without_tampering(docs):
    none = manifest(docs.limit(0))
    assert none.collect() == [] and none.columns == ["doc_id", "leaf", "subroot", "root", "path", "proof_sha256", "folded_root", "verified"]
    assert merkle.manifest(docs, fanout=16).where("not verified").count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(docs, fanout=1)


def test_numbers_of_a_large_group_need_no_single_task(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 5000).alias("v"), F.lit(None).cast("int").alias("extra"))
    numbered = ordering.before(ordering.bucketed(df, ["g", "v"]), ["g"], ["v"], F.lit(1), "n")
    assert numbered.where("n <> v").count() == 0 and numbered.count() == 5000
    assert ordering.bucketed(df, ["g", "v"]).select("_bucket").distinct().count() > 1


# -- 13 ------------------------------------------------------------------------


def plain_targets(sizes, weights=(3, 1, 2), percent=150, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full, budget = set(), Fraction(percent * sum(sizes.values()), 100)
    while True:
        rest = [s for s in order if s not in full]
        left = budget - sum(most * sizes[s] for s in full)
        unit = left / sum(w[s] for s in rest) if rest else 0
        above = {s for s in rest if w[s] * unit > most * sizes[s]}
        if not above:
            return {s: Fraction(most * sizes[s]) if s in full else w[s] * unit for s in order}
        full |= above


def check_mixture(mixed, rows, block, most=2):
    documents = mixed.documents.collect()
    sizes = collections.Counter()
    for i, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = plain_targets(sizes)
    assert collections.Counter((r["doc_id"], r["size"]) for r in documents) == collections.Counter((i, len(WORD.findall(t or ""))) for i, t, _ in rows)
    assert all(0 <= r["taken"] <= most * r["size"] for r in documents)
    goal = {(sizes[s], float(t)) for s, t in want.items()}
    assert {(r["source_size"], r["target"]) for r in documents} == goal
    taken = collections.Counter()
    for r in documents:
        taken[r["source_size"], r["target"]] += r["taken"]
    assert all(abs(n - t * sum(1 for s in want if (sizes[s], float(want[s])) == (size, t))) <= 2 for (size, t), n in taken.items())

    # the schedule: a slot each, every block of a pass once, and the words that the documents say
    slots = sorted(mixed.slots.collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in slots] == list(range(len(slots)))
    assert len({(r["g"], r["epoch"], r["block"]) for r in slots}) == len(slots)
    assert sum(r["length"] for r in slots) == sum(taken.values())
    held = collections.Counter()
    for p in mixed.pieces.collect():
        held[p["g"], p["block"]] += p["words"]
    assert all(n <= block for n in held.values()) and all(r["length"] <= held[r["g"], r["block"]] for r in slots)
    return slots


@pytest.mark.parametrize("block", [5, 64, 1024])
def test_mixture_meets_targets(docs, rows, block):
    check_mixture(mixture.mix(docs, block_words=block), rows, block)


def test_every_stretch_of_the_schedule_is_mixed_like_the_whole(docs, rows):
    slots = check_mixture(mixture.mix(docs, block_words=5), rows, 5)
    share = {g: n / len(slots) for g, n in collections.Counter(r["g"] for r in slots).items()}
    for start in range(0, len(slots) - 200, 100):
        seen = collections.Counter(r["g"] for r in slots[start : start + 200])
        assert all(abs(seen[g] - 200 * p) <= 6 for g, p in share.items())


def test_mixture_is_the_same_however_rows_are_dealt(docs):
    key = lambda m: (sorted(map(tuple, m.documents.collect()), key=repr), sorted(map(tuple, m.slots.collect())))
    assert key(mixture.mix(docs, block_words=16)) == key(mixture.mix(docs.repartition(7, "text"), block_words=16))


def test_mixture_of_nothing(docs):
    none = mixture.mix(docs.limit(0))
    assert none.documents.collect() == [] and none.slots.collect() == [] and none.pieces.collect() == []
    blank = mixture.mix(docs.where("source = 'only blank'"))
    assert {(r["target"], r["taken"]) for r in blank.documents.collect()} == {(0.0, 0)}
