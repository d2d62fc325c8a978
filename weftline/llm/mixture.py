"""Mixing sources to target weights by a low-discrepancy schedule.

Targets share out a budget of words by weight; a source's target stops at a
multiple of its size, and what it can't take goes to the others by weight.

Each source is one stream: its documents in an order shuffled by a keyed
hash, cut into blocks of equally many words (the last is shorter), passed as
often as the target asks. The schedule has a slot for each block to take. Slot
i has the point frac((i + 1) * golden ratio), which cumulative shares of slots map
to a source; the k-th slot of a source takes its k-th block, from the first again after
the last. As such points fill every interval evenly, any stretch of the schedule is mixed
like the whole. The few slots that a source has more than blocks to take go to the
sources that have fewer. A source's last block is cut where its target is reached.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from weftline.llm.common import Utf8, with_columns, written
from weftline.llm.ordering import BUCKET, before, bucketed, offsets

#: Words of a block.
BLOCK_WORDS = 1024
#: The golden ratio's fraction, in units of 10 ** -18.
_GOLDEN, _ONE = 618033988749894848, 10**18
#: Slots whose ranks are counted in one window.
_CHUNK = 1 << 14
_WIDE = "decimal(38,0)"


def word_counts(docs: DataFrame, text_col: str = "text", size_col: str = "size") -> DataFrame:
    """Add the number of words ``[^\\x20\\x09-\\x0D]+`` of each whole text; 0 for a null one."""

    def step(column) -> list:
        text = Utf8(column)
        return [text.per_text(text.words()[0])]

    return with_columns(docs, text_col, [T.StructField(size_col, T.LongType())], lambda: step)


def targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """(g, source_size, target) of sources (g, source_size): ``weights`` repeat over the sources in the order of g, and share ``percent`` of all words.

    A target stops at ``most`` times its source's size; the excess is shared by
    weight among the others, again until none is above. Sums and comparisons are of whole
    numbers, and each round is one aggregation over the sources.
    """
    rows = bucketed(sizes, ["g"]).withColumn("_all", F.lit(0))
    rank = before(rows, ["_all"], ["g"], F.lit(1), "_rank")
    plan = written(rank.select("g", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).alias("weight")))
    total, whole = plan.agg(F.sum("source_size"), F.sum("weight")).first()
    share, parts, stopped = percent * (total or 0), 100 * (whole or 1), 0
    lit = lambda x: F.lit(Decimal(x)).cast(_WIDE)
    while True:
        top = F.col("source_size") * most
        full = top.cast(_WIDE) * lit(parts) < F.col("weight").cast(_WIDE) * lit(share)
        now, rest = plan.agg(F.sum(F.when(full, top)), F.sum(F.when(~full, F.col("weight")))).first()
        if (now or 0) == stopped or not rest:
            break
        stopped = now
        share, parts = percent * total - 100 * stopped, 100 * rest
    if not rest:
        full = F.lit(True)
    target = F.when(full, top.cast("double")).otherwise((F.col("weight").cast(_WIDE) * lit(share)).cast("double") / F.lit(float(parts)))
    return plan.select("g", "source_size", target.alias("target"))


def schedule(plan: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, g, epoch, block, length) from sources (g, source_size, target): which block each slot takes, and how many of its words."""
    quota, size, blocks = F.round("target").cast("long"), F.col("source_size"), F.expr(f"(source_size + {block_words - 1}) div {block_words}")
    p = plan.where("source_size > 0").select("g", "source_size", quota.alias("quota"), blocks.alias("blocks"))
    p = p.withColumn("passes", F.expr("quota div source_size")).withColumn("rest", F.col("quota") - F.col("passes") * size)
    p = p.withColumn("slots", F.col("passes") * F.col("blocks") + F.expr(f"(rest + {block_words - 1}) div {block_words}"))
    p = bucketed(p.where("slots > 0"), ["g"]).withColumn("_all", F.lit(0))
    p = written(before(p, ["_all"], ["g"], "slots", "first").drop("_all"))
    n, sources = p.agg(F.sum("slots"), F.count("*")).first()
    spark, n = plan.sparkSession, n or 0

    # each source's interval of points, by the cells of a grid that it meets, so that slots find it by an equal join
    at = lambda c: ((c.cast(_WIDE) * F.lit(Decimal(_ONE)).cast("decimal(19,0)")) / F.lit(Decimal(max(n, 1))).cast("decimal(20,0)")).cast("long")
    cell = _ONE // max(1024, sources) + 1
    spans = p.select("g", F.col("slots").alias("asked"), at(F.col("first")).alias("low"), at(F.col("first") + F.col("slots")).alias("high"))
    spans = spans.select("*", F.explode(F.sequence(F.expr(f"low div {cell}"), F.expr(f"(high - 1) div {cell}"))).alias("cell"))
    point = F.pmod((F.col("id") + 1).cast("decimal(19,0)") * F.lit(Decimal(_GOLDEN)).cast("decimal(18,0)"), F.lit(Decimal(_ONE)).cast("decimal(19,0)")).cast("long")
    points = spark.range(n).select(F.col("id").alias("slot"), point.alias("x")).withColumn("cell", F.expr(f"x div {cell}"))
    slots = written(points.join(spans, (points["cell"] == spans["cell"]) & (F.col("low") <= F.col("x")) & (F.col("x") < F.col("high"))).select("slot", "g", "asked", F.expr(f"slot div {_CHUNK}").alias(BUCKET)))
    ranked = before(slots, ["g"], ["slot"], F.lit(1), "rank").select("slot", "g", "rank", "asked")

    # slots beyond a source's blocks, and blocks without a slot, are equally many and few: the i-th meets the i-th
    have = slots.groupBy("g").agg(F.count("*").alias("have"))
    lacking = p.join(have, "g", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < slots")
    lacking = lacking.select("g", F.explode(F.sequence("have", F.col("slots") - 1)).alias("rank"))
    number = lambda df, order: before(bucketed(df, order).withColumn("_all", F.lit(0)), ["_all"], order, F.lit(1), "i").drop("_all")
    moved = number(lacking, ["rank", "g"]).join(number(ranked.where("rank >= asked").select("slot"), ["slot"]), "i").select("slot", "g", "rank")
    found = ranked.where("rank < asked").select("slot", "g", "rank").unionByName(moved)

    # what a source's k-th block is follows from its rank alone; the source's figures come by chunks of ranks, so a large source is many keys
    chunks = p.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(slots - 1) div {_CHUNK}"))).alias("part"))
    both = found.withColumn("part", F.expr(f"rank div {_CHUNK}")).join(chunks, ["g", "part"])
    block, left = F.col("rank") % F.col("blocks"), F.col("rest") - F.col("block") * block_words
    out = both.select("slot", "g", F.expr("rank div blocks").alias("epoch"), block.alias("block"), "passes", "rest", "source_size")
    length = F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words)
    return out.select("slot", "g", "epoch", "block", F.when(F.col("epoch") < F.col("passes"), length).otherwise(F.least(length, left)).cast("long").alias("length"))


@dataclass(frozen=True)
class Mixture:
    """The result of ``mix``: ``slots`` (slot, g, epoch, block, length) say in which order blocks are taken; ``pieces`` (id, g, block, at, start,
    words) say which words of a document, from ``start`` on, lie at which place of a block; ``documents`` (id, size, source_size, target, taken) sum up."""

    slots: DataFrame
    pieces: DataFrame
    documents: DataFrame


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (3, 1, 2), percent: int = 150, most: int = 2, block_words: int = BLOCK_WORDS, seed: str = "mixture") -> Mixture:
    """Mix all documents by whole texts; see the module's text for how.

    Null, empty and blank texts have no words and are taken 0 times; sources of
    such texts alone have the target 0. Documents without a source are one
    source, after all others. Rows with one id are documents of their own; null ids
    are shuffled by their text. An empty table gives empty frames. Other columns are
    ignored, whatever their names. Reruns give the same, however rows are dealt.
    """
    source = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col)))
    own = docs.select(F.col(id_col).alias("id"), source.alias("g"), F.col(text_col).alias("text"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce("text", F.lit(""))))))).alias("key")
    bits = min(24, (8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).bit_length())
    bucket = F.expr(f"shiftright(cast(conv(substr(key, 1, 6), 16, 10) as int), {24 - bits})")
    rows = written(word_counts(own.withColumn("key", key)).select("id", "g", "key", "size").withColumn(BUCKET, bucket))

    plan = written(targets(rows.groupBy("g").agg(F.sum("size").alias("source_size")), weights, percent, most))
    slots = schedule(plan, block_words)
    # a source's figures reach its documents by bucket, so a large source is many keys
    starts = offsets(rows, ["g"], "size", "_before").join(plan, "g")
    rows = rows.withColumn("row", F.row_number().over(W.partitionBy("g", BUCKET).orderBy("key", "size"))).withColumn("part", F.col(BUCKET))
    placed = before(rows, ["g"], ["key", "size", "row"], "size", "start", starts=starts)
    every = ["id", "g", "part", "row", "size", "source_size", "target"]
    full = placed.where("size > 0").select(*every, "start", F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    pieces = full.select(*every, "block", (low - F.col("block") * block_words).alias("at"), (low - F.col("start")).alias("from"), (high - low).alias("words"))
    # a block is in at most ``most`` slots
    taken = slots.groupBy("g", "block").agg(F.collect_list("length").alias("lengths"))
    of = F.aggregate(F.coalesce("lengths", F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda s, n: s + F.greatest(F.lit(0), F.least(F.col("words"), n - F.col("at"))))
    sums = pieces.join(taken, ["g", "block"], "left").groupBy(*every).agg(F.sum(of).alias("taken"))
    documents = sums.select("id", "size", "source_size", "target", "taken").unionByName(placed.where("size = 0").select("id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))
    return Mixture(slots, pieces.select(F.col("id").alias(id_col), "g", "block", "at", F.col("from").alias("start"), "words"), documents.withColumnRenamed("id", id_col))
