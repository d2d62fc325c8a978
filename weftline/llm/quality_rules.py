"""Quality rules by tokeniser fertility.

A public vocabulary measures each text: characters per token, the share of
byte-fallback tokens, and the entropy of its tokens. The entropy is taken over
blocks of ``BLOCK`` tokens and divided by its largest possible value, so that
it does not grow with the length of a text. Texts of one language (of one
script, where the language is not given or has few documents) agree closely in
these figures, so each gets its own bands, measured over all its documents by
medians, which junk does not move. A document outside a band is rejected; where
neither its language nor its script has enough documents, none is.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from weftline.llm.common import cut_lineage, fresh_name, mix, split_words, window_hashes, with_columns, written
from weftline.llm.passages import FlatWords
from weftline.llm.piece_codec import TEXT_SLICE, codec

BLOCK = 64
#: Defaults of the parameters that say how bands are made: blocks beyond which a longer text no longer narrows its band;
MOST_BLOCKS = 8
#: languages that have bands of their own, those with most documents (others have those of their script);
MOST_GROUPS = 4096
#: and documents a language or script needs for bands, as the medians of fewer would be their junk's as soon as not.
LEAST_GROUP = 50
#: Steps per unit of the grids on which medians are taken, so that they don't depend on how rows are dealt out.
STEPS = {"chars_per_token": 500, "entropy": 20_000, "byte_share": 10_000}
SYMBOLS = "#*$%&|<>"

LONG, REAL = T.LongType(), T.DoubleType()
FIELDS = [
    *(T.StructField(n, LONG) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")),
    *(T.StructField(n, REAL) for n in ("chars_per_token", "byte_share", "entropy")),
    T.StructField("blocks", LONG),
    T.StructField("script", T.StringType()),
]
# The scripts that are told apart, in the order that decides ties.
SCRIPTS = "Latin Cyrillic Greek Arabic Hebrew Devanagari Thai Hangul Hiragana Katakana Han Ethiopic Armenian Georgian Bengali Gurmukhi Gujarati Oriya Tamil Telugu Kannada Malayalam Sinhala Lao Tibetan Myanmar Khmer Mongolian Syriac Thaana Cherokee".split()
#: Code points from here on have no script of the list.
CODE_POINTS = 0x32000


@lru_cache(maxsize=1)
def _script_numbers() -> np.ndarray:
    """For each code point the place of its script in the list, or the list's length."""
    letters = [chr(c) for c in range(CODE_POINTS) if not 0xD800 <= c < 0xE000]
    place = np.array([c for c in range(CODE_POINTS) if not 0xD800 <= c < 0xE000])
    out = np.full(CODE_POINTS, len(SCRIPTS), np.uint8)
    for k, name in enumerate(SCRIPTS):
        for run in regex.finditer(rf"\p{{Script={name}}}+", "".join(letters)):
            out[place[run.start() : run.end()]] = k
    return out


def scripts_of(column: pa.Array) -> list[str]:
    """The script of most letters of each text; texts of ASCII characters alone are Latin, those without a script Other."""
    table, out = _script_numbers(), []
    for text in column.to_pylist():
        if not text or text.isascii():
            out.append("Latin")
            continue
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        counts = np.bincount(table[np.minimum(points, CODE_POINTS - 1)], minlength=len(SCRIPTS) + 1)[:-1]
        out.append(SCRIPTS[int(counts.argmax())] if counts.any() else "Other")
    return out


def repeat_words(words: list[str]) -> int:
    """Words in windows of five that occur twice or more in the text, first ones included."""
    windows = list(zip(*(words[k:] for k in range(5))))
    seen, end, total = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 5 - max(i, end)
            end = i + 5
    return total


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _per_text(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the marked bytes each text has."""
    return np.diff(np.concatenate([[0], np.cumsum(marks)])[bounds])


def _repeated_lines(flat: FlatWords) -> np.ndarray:
    """Per text the lines with a word that equal an earlier line of it."""
    text = flat.text
    feeds = text.raw[: text.n] == 10
    edges = np.zeros(text.n + 1, bool)
    edges[1:] = feeds
    edges[text.opens()] = True
    begin = np.flatnonzero(edges[:-1])
    last = np.zeros(text.n + 1, bool)
    last[text.bounds[1:]] = True
    ends = np.flatnonzero(feeds | last[1:]) + 1
    end = ends - feeds[ends - 1]
    held = np.searchsorted(flat.begin, end) > np.searchsorted(flat.begin, begin)
    begin, end = begin[held], end[held]
    row = np.searchsorted(text.bounds[1:], begin, "right")
    _, first = np.unique(text.hashes(begin, end, 41) ^ mix(row.astype(np.uint64), 43), return_index=True)
    n = len(text.bounds) - 1
    return np.bincount(row, minlength=n) - np.bincount(row[first], minlength=n)


def _measure(model: str):
    table = codec(model)
    line_feed = table.byte_id[10]

    def step(column: pa.Array) -> list:
        flat = FlatWords(column)
        sizes, row, n_texts = flat.sizes, flat.row, len(column)
        # Hashes find the texts that may repeat a window; those texts are then counted by their words.
        windows = window_hashes(flat.words, 5)
        inside = row[: len(windows)] == row[4:] if len(windows) else np.empty(0, bool)
        owner = row[: len(windows)][inside]
        keys, first, count = np.unique(windows[inside] ^ mix(owner.astype(np.uint64), 7), return_index=True, return_counts=True)
        repeats = np.zeros(n_texts, np.int64)
        for i in set(owner[first[count > 1]].tolist()):
            repeats[i] = repeat_words(split_words(column[i].as_py()))
        dup_lines = _repeated_lines(flat)
        text = flat.text
        raw = text.raw[: text.n]
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        chars = np.bincount(row, points[flat.end] - points[flat.begin], minlength=n_texts).astype(np.int64)
        symbols = _per_text(_SYMBOL[raw], text.bounds)

        ids, counts = table.encode(column)
        owner = np.repeat(np.arange(n_texts), counts)
        # Line feeds and spaces between words are layout, not tokens of the language.
        real = ids != line_feed
        ids, owner = ids[real], owner[real]
        n = np.bincount(owner, minlength=n_texts)
        starts = np.cumsum(n) - n
        blocks = np.maximum(1, n // BLOCK)
        place = np.minimum((np.arange(len(ids)) - starts[owner]) // BLOCK, blocks[owner] - 1)
        first_block = np.cumsum(blocks) - blocks
        block = first_block[owner] + place
        seen, count = np.unique(block * table.size + ids, return_counts=True)
        total = np.bincount(block, minlength=int(blocks.sum())).astype(float)
        at = seen // table.size
        share = count / total[at]
        bits = np.bincount(at, -share * np.log2(share), minlength=len(total)) / np.log2(np.maximum(total, 2))
        entropy = np.round(np.add.reduceat(bits, first_block) / blocks, 9) if n_texts else np.empty(0)
        byte = np.bincount(owner, table.is_byte[ids], minlength=n_texts) / np.maximum(n, 1)
        return [sizes, chars, symbols, dup_lines, repeats, n, chars / np.maximum(n, 1), byte, entropy, blocks, scripts_of(column)]

    return step


def measure(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """Add the figures of ``FIELDS`` to each document; a null text has no words and no tokens."""
    return with_columns(docs, text_col, FIELDS, lambda: _measure(model), TEXT_SLICE)


def base_failed() -> Column:
    """Too few words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _language(lang_col: str | None) -> Column:
    return F.nullif(F.col(lang_col), F.lit("")) if lang_col else F.lit(None).cast("string")


def _spread(most_blocks: int) -> Column:
    return F.sqrt(F.least(F.col("blocks"), F.lit(most_blocks)))


def _medians(rows: DataFrame) -> DataFrame:
    """(level, group, figure, n, middle) of rows (level, group, figure, step): the least step that half of the rows of a group don't exceed.

    Counts per step are added up before the shuffle, so a group, however
    large, comes to a window with no more rows than its grid has steps.
    """
    counts = rows.where("group is not null").groupBy("level", "group", "figure", "step").agg(F.count("*").alias("here"))
    over = W.partitionBy("level", "group", "figure")
    summed = counts.withColumn("upto", F.sum("here").over(over.orderBy("step"))).withColumn("n", F.sum("here").over(over))
    return summed.where("2 * upto >= n").groupBy("level", "group", "figure").agg(F.min("step").alias("middle"), F.max("n").alias("n"))


def bands(measured: DataFrame, lang_col: str | None = "lang", least_group: int = LEAST_GROUP, most_groups: int = MOST_GROUPS, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """(level, group, n, mid_chars, mid_entropy, mid_bytes, width_entropy, width_bytes) per language (level 0) and per script (level 1) with at least ``least_group`` documents.

    Medians and median deviations over all documents that pass the base rules,
    on fixed grids, so that they are the same however the rows are dealt out.
    The deviation of the entropy is per block, as longer texts stray less. Only
    the ``most_groups`` largest languages have bands. No documents, or none
    that pass, give no rows.
    """
    good = measured.where(~base_failed() & (F.col("n_tokens") > 0))
    levels = F.array(F.struct(F.lit(0).alias("level"), _language(lang_col).alias("group")), F.struct(F.lit(1).alias("level"), F.col("script").alias("group")))
    both = good.select(F.explode(levels).alias("of"), *STEPS, _spread(most_blocks).alias("spread")).select("of.*", *STEPS, "spread")
    on_grid = lambda c, figure: F.struct(F.lit(figure).alias("figure"), F.floor(c * STEPS[figure]).alias("step"))
    middles = _medians(both.select("level", "group", F.explode(F.array(*(on_grid(F.col(c), c) for c in STEPS))).alias("x")).select("level", "group", "x.*"))
    of = lambda c: F.max(F.when(F.col("figure") == c, F.col("middle"))) / STEPS[c]
    mid = middles.groupBy("level", "group").agg(of("chars_per_token").alias("mid_chars"), of("entropy").alias("mid_entropy"), of("byte_share").alias("mid_bytes"), F.max("n").alias("n")).where(F.col("n") >= least_group)
    # at most most_groups rows and the scripts
    mid = cut_lineage(mid.where("level = 1").union(mid.where("level = 0").orderBy(F.desc("n"), "group").limit(most_groups)))
    off = F.array(on_grid(F.abs(F.col("entropy") - F.col("mid_entropy")) * F.col("spread"), "entropy"), on_grid(F.abs(F.col("byte_share") - F.col("mid_bytes")), "byte_share"))
    widths = _medians(both.join(F.broadcast(mid), ["level", "group"]).select("level", "group", F.explode(off).alias("x")).select("level", "group", "x.*"))
    width = widths.groupBy("level", "group").agg((of("entropy") * 1.4826).alias("width_entropy"), (of("byte_share") * 1.4826).alias("width_bytes"))
    return mid.join(width, ["level", "group"])


def judge(
    measured: DataFrame, limits: DataFrame, lang_col: str | None = "lang", deviations: float = 4.0, most_bytes: float = 0.3, chars_range: tuple[float, float] = (0.5, 2.0), above: float = 6.0, most_blocks: int = MOST_BLOCKS
) -> DataFrame:
    """Add base_failed, kept and judged_by.

    Rejected are texts that fail the base rules, whose share of byte tokens is
    more than ``deviations`` (and than ``most_bytes``, as most texts of many
    languages have none and so no deviation) over the middle of their language
    or script, whose characters per token are outside ``chars_range`` times the
    middle, or whose entropy lies more than ``deviations`` below it (low entropy
    is repetition and padding) or more than ``above`` deviations over it (noise
    with no word twice; long names and lists stray upwards more than texts do
    downwards). judged_by is language, script or, where neither has bands and
    there is nothing to judge, none.
    """
    parts = ("mid_chars", "mid_entropy", "mid_bytes", "width_entropy", "width_bytes")
    own = {(k, c): fresh_name(measured, f"_{k}_{c}") for k in (0, 1) for c in ("group", *parts)}
    joined = measured
    for k, here in ((0, _language(lang_col)), (1, F.col("script"))):
        named = limits.where(F.col("level") == k).select(*(F.col(c).alias(own[k, c]) for c in ("group", *parts)))
        joined = joined.join(F.broadcast(named), here == F.col(own[k, "group"]), "left")
    of = lambda c: F.coalesce(F.col(own[0, c]), F.col(own[1, c]))
    chars = F.col("chars_per_token") / of("mid_chars")
    step = of("width_entropy") / _spread(most_blocks)
    stray = F.col("entropy") - of("mid_entropy")
    bytes_over = F.col("byte_share") > of("mid_bytes") + F.greatest(F.lit(most_bytes), deviations * of("width_bytes"))
    odd = bytes_over | (chars < chars_range[0]) | (chars > chars_range[1]) | (stray < -deviations * step) | (stray > above * step)
    failed = base_failed()
    by = F.when(F.col(own[0, "group"]).isNotNull(), "language").when(F.col(own[1, "group"]).isNotNull(), "script").otherwise("none")
    rest = [measured[c] for c in measured.columns if c not in ("base_failed", "kept", "judged_by")]
    return joined.select(*rest, failed.alias("base_failed"), (~failed & ~F.coalesce(odd, F.lit(False))).alias("kept"), by.alias("judged_by"))


def assess(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The figures and the verdict of every row, by its id; texts are measured once.

    A null or empty text has no words and fails the base rules. Rows that repeat
    an id have a result each, a null id stays null, and a null or empty language
    is judged by the script. An empty table gives no rows.
    """
    cols = [c for c in (id_col, lang_col) if c]
    measured = cut_lineage(measure(docs.select(*cols, text_col), model, text_col).drop(text_col))
    return judge(measured, bands(measured, lang_col), lang_col)


def keep_good(docs: DataFrame, model: str, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The documents that pass, with their own columns alone; nulls, repeats and empty tables are as in ``assess``.

    Texts are measured once and those that pass the base rules written with their figures, so none is shuffled; the bands read the figures alone.
    """
    names = {f.name: f"_doc_{i}" for i, f in enumerate(docs.schema.fields)}
    safe = docs.select(*(F.col(c).alias(n) for c, n in names.items()))
    measured = written(measure(safe, model, names[text_col]).where(~base_failed()), "zstd")
    lang = names[lang_col] if lang_col else None
    limits = cut_lineage(bands(measured, lang))
    return judge(measured, limits, lang).where("kept").select(*(F.col(n).alias(c) for c, n in names.items()))
