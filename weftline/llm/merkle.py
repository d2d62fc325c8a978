"""A Merkle manifest of a dataset: a digest per row, trees per source, one root, and a proof for every row.

Rows are numbered within their source, in the order of their ids. A level of
the tree is a DataFrame: numbers divided by the fanout name the parents, whose
children, sorted, are hashed together. Levels are written, a third of the rows
each time, until every source is one node, its subroot; the subroots, in the
order of their sources, are the leaves of one more tree.

Proofs go down the same levels: what a parent's proof has is joined to its
children, each of which puts its own siblings before it. So a step joins a third of
the rows that it makes, and no leaf travels through all levels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import written
from weftline.llm.ordering import before, bucketed, grouped_key, offsets

FANOUT = 3
#: Columns of a row that its digest covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(values: Sequence[Column]) -> Column:
    """The digest of a row: each value as its UTF-8 length, a colon and itself, or ``-`` if null."""
    as_text = [v.cast("string") for v in values]
    parts = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in as_text]
    return F.sha2(F.concat(*parts), 256)


def _numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """The rows with their number ``idx`` in the group, and the group's ``size``."""
    rows = bucketed(rows, [group, *order])
    size = rows.groupBy(group).agg(F.count("*").alias("size"))
    starts = offsets(rows, [group], F.lit(1), "_before").join(size, group)
    return before(rows, [group], order, F.lit(1), "idx", starts=starts)


def _levels(nodes: DataFrame, fanout: int, payload: Sequence[str]) -> list[DataFrame]:
    """The levels above nodes (g, idx, size, digest, payload), as (g, idx, size, kids, digest), kids being their sorted children; size is a group's nodes on the level."""
    most = nodes.agg(F.max("size")).first()[0] or 0
    out, current, carried = [], nodes, list(payload)
    while most > 1:
        named = current.where("size > 1").select("g", F.expr(f"idx div {fanout}").alias("idx"), F.expr(f"(size + {fanout - 1}) div {fanout}").alias("size"), F.struct(F.col("idx").alias("at"), "digest", *carried).alias("kid"))
        kids = named.groupBy("g", "idx", "size").agg(F.sort_array(F.collect_list("kid")).alias("kids"))
        out.append(written(kids.withColumn("digest", F.sha2(F.array_join(F.transform("kids", lambda k: k["digest"]), ""), 256))))
        current, carried = out[-1].select("g", "idx", "size", "digest"), []
        most = -(-most // fanout)
    return out


def _descend(level: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths (g, idx, path, ...) of a level's nodes as paths of their children, with the children's payload."""
    rest = [c for c in paths.columns if c not in ("g", "idx", "path", "kid")]
    each = level.select("g", "idx", "kids").join(paths, ["g", "idx"]).select("g", "path", "kids", *rest, F.posexplode("kids").alias("_p", "kid"))
    text = lambda kids: F.array_join(F.transform(kids, lambda k: k["digest"]), "")
    side = F.struct(text(F.slice("kids", F.lit(1), F.col("_p"))).alias("l"), text(F.slice("kids", F.col("_p") + 2, F.size("kids"))).alias("r"))
    return each.select("g", F.col("kid.at").alias("idx"), "kid", F.concat(F.array(side), F.col("path")).alias("path"), *rest)


_PATH = "array<struct<l: string, r: string>>"


def manifest(rows: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", source_col: str = "source", fanout: int = FANOUT, tampered: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, path, proof_sha256, folded_root, verified) of every row.

    ``path`` has, level by level up to the root, the digests of the siblings left
    and right of the row's branch; ``proof_sha256`` is the digest of all of
    them. ``folded_root`` is the root that path gives for the leaf of the row as
    it is after ``tampered`` (new values of some fields; the siblings stay), and ``verified``
    whether that is the root.

    Null values have a mark of their own, so null and empty texts differ. Rows
    without an id come before the others of their source, rows without a source are a
    source before all others. Rows with one id are ordered by their
    digests; equal rows have equal digests and a proof each. An empty table
    gives no rows. Columns not among ``fields`` are not covered, whatever their names.
    """
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    values = {c: F.col(c) for c in fields}
    leaf = leaf_digest(list(values.values()))
    changed = leaf_digest([(tampered or {}).get(c, v) for c, v in values.items()]) if tampered else leaf
    leaves = rows.select(F.col(id_col).alias("id"), grouped_key(F.col(source_col)).alias("g"), leaf.alias("digest"), changed.alias("changed"))
    # texts are read and hashed once; ranges are sampled from the digests
    leaves = written(leaves.withColumn("changed", F.nullif("changed", "digest")), "zstd")
    leaves = written(_numbered(leaves, "g", ["id", "digest"]))
    levels = _levels(leaves, fanout, ["id", "changed"])

    # subroots with their depth, in the order of their sources, as the leaves of the upper tree
    tops = [f.where("size = 1").select(F.col("g").alias("source"), "digest", F.lit(k).alias("depth")) for k, f in enumerate([leaves, *levels])]
    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.unionByName(t)
    subroots = written(_numbered(subroots.withColumn("g", F.lit("")), "g", ["source"]))
    upper = _levels(subroots, fanout, ["source", "depth"])
    top = upper[-1].where("size = 1") if upper else subroots
    root = top.select("digest").first()
    none = F.array().cast(_PATH)
    if upper:
        paths = top.select("g", "idx", none.alias("path"))
        for level in reversed(upper):
            paths = _descend(level, paths)
        heads = paths.select(F.col("kid.source").alias("g"), F.col("kid.depth").alias("depth"), F.col("kid.digest").alias("subroot"), "path")
    else:
        heads = subroots.select(F.col("source").alias("g"), "depth", F.col("digest").alias("subroot"), none.alias("path"))
    heads = written(heads)

    paths = None
    at = lambda k: heads.where(F.col("depth") == k).select("g", F.lit(0).cast("long").alias("idx"), "path", "subroot")
    for k in range(len(levels), 0, -1):
        paths = at(k) if paths is None else paths.select("g", "idx", "path", "subroot").unionByName(at(k))
        paths = _descend(levels[k - 1], paths)
    lone = leaves.where("size = 1").join(heads.where("depth = 0"), "g").select("id", "digest", "changed", "path", "subroot")
    found = lone if paths is None else paths.select("kid.id", "kid.digest", "kid.changed", "path", "subroot").unionByName(lone)
    folded = F.aggregate("path", F.coalesce("changed", "digest"), lambda acc, x: F.sha2(F.concat(x["l"], acc, x["r"]), 256))
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["l"], x["r"])), "")
    out = found.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", F.lit(root[0] if root else None).cast("string").alias("root"), "path", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
