"""Queries of the corpus operators over the driver's tables, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, lexical_search, main_text, merkle, mixture, ngram_join, piece_codec, pseudonyms, quality_rules, suffix_dedup, token_counts, warc, window_dedup
from weftline.llm.common import read_table

PIECES = "piece_bpe_32k.model"
KEY = "weftline demonstration key"
BYTES = "byte_bpe_50k.json"


def op1_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path(PIECES)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piece_codec.round_trip(docs, model)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality_rules.assess(docs, public_tokenizers.path(PIECES))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "judged_by", "n_tokens", "chars_per_token", "byte_share", "entropy")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP3_SQL = r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (
        SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS t FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS u(p) WHERE len(w) > 0
    ),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (t) WHERE a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
    e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
    r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
    SELECT w.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.y) AS component_id
    FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.x = w.doc_id GROUP BY w.doc_id
"""


def op4_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return window_dedup.dedup_windows(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


#: The words, and which of them a window covers that also starts in a smaller document.
GONE_SQL = r"""d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    win AS (SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS k FROM d, unnest(range(1, len(w) - 48)) AS t(p)),
    f AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
    s AS (SELECT doc_id, p FROM win JOIN f USING (k) WHERE m < doc_id),
    gone AS (SELECT DISTINCT doc_id, p + o AS i FROM s, unnest(range(0, 50)) AS u(o))"""

OP4_SQL = f"""
    WITH {GONE_SQL},
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)
"""


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, read_table(spark, sf_dir, "benchmark"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = token_counts.token_counts(docs, public_tokenizers.path(BYTES))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    captures = warc.round_trip(pages)
    return captures.select(
        warc.metadata_field("page-id").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        warc.metadata_field("refers-to-page").cast("long").alias("refers_to"),
    )


OP9_SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    h AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS hex FROM p),
    d AS (
        SELECT page_id, payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST(((CAST('0x' || substr(hex, CAST(5 * (k // 4) + 1 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest
        FROM h),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
    FROM f
"""

def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return suffix_dedup.repeated_passages(docs).select("doc_id", "n_words", "n_repeated", spans.alias("spans"))


OP10_SQL = f"""
    WITH {GONE_SQL},
    islands AS (SELECT doc_id, min(i) - 1 AS s, max(i) AS e FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM gone) GROUP BY doc_id, g),
    found AS (SELECT doc_id, sum(e - s) AS n, string_agg(s || '-' || e, ',' ORDER BY s) AS spans FROM islands GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_repeated, coalesce(spans, '') AS spans
    FROM d LEFT JOIN found USING (doc_id)
"""



def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(read_table(spark, sf_dir, "documents"))
    return lexical_search.search(index, read_table(spark, sf_dir, "benchmark"))


#: The terms of a text: ASCII letters and digits and all that isn't ASCII.
TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".replace("\\\\", "\\")

OP11_SQL = f"""
    WITH d AS (SELECT doc_id, len(t) AS n, t FROM (SELECT doc_id, {TERMS_SQL} AS t FROM documents) WHERE len(t) > 0),
    c AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
    p AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM d) GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, c),
    q AS (SELECT item_id, term, CAST(count(*) AS BIGINT) AS x FROM (SELECT item_id, unnest({TERMS_SQL}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
    s AS (SELECT item_id, doc_id, CAST(sum(x * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score
        FROM q JOIN w USING (term) JOIN p USING (term), c GROUP BY ALL),
    r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
    SELECT * FROM r WHERE rank <= 10
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    broken = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    found = merkle.manifest(docs, tampered={"text": broken})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _leaf_sql(text: str) -> str:
    parts = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({p})) || ':' || {p}, '-')" for p in parts) + ")"


#: CRC-32 of the id's digits, bit by bit; the levels of both trees; and the fold of every leaf, level by level.
OP12_SQL = f"""
    WITH RECURSIVE crc AS (
        SELECT doc_id, xor(4294967295, list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(k AS INTEGER), 1)) AS BIGINT)),
            lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), CAST(4294967295 AS BIGINT))) AS crc
        FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
    leaves AS (
        SELECT doc_id, coalesce('1' || source, '0') AS g, {_leaf_sql("text")} AS leaf,
            CASE WHEN crc % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS broken
        FROM documents LEFT JOIN crc USING (doc_id)),
    rows AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM leaves),
    low AS (SELECT g, 0 AS lvl, idx, leaf AS digest, n FROM rows
        UNION ALL SELECT g, lvl + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY g, lvl, idx // 3, n),
    subs AS (SELECT g, lvl AS depth, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS many FROM low WHERE n = 1),
    high AS (SELECT 0 AS lvl, place AS idx, subroot AS digest, many AS n FROM subs
        UNION ALL SELECT lvl + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (n + 2) // 3 FROM high WHERE n > 1 GROUP BY lvl, idx // 3, n),
    beside AS (
        SELECT a.g, a.lvl, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS r
        FROM low a JOIN low b ON a.g = b.g AND a.lvl = b.lvl AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL
        UNION ALL SELECT s.g, s.depth + a.lvl, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), ''), coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '')
        FROM subs s JOIN high a ON a.idx = s.place // CAST(pow(3, a.lvl) AS BIGINT) JOIN high b ON a.lvl = b.lvl AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY s.g, s.depth, a.lvl, a.idx),
    fold AS (
        SELECT g AS fold_g, idx AS leaf_at, place, depth, 0 AS lvl, broken AS acc, '' AS proof FROM rows JOIN subs USING (g)
        UNION ALL SELECT fold_g, leaf_at, place, depth, f.lvl + 1, sha256(l || acc || r), proof || l || r
        FROM fold f JOIN beside b ON b.g = fold_g AND b.lvl = f.lvl AND b.idx = CASE WHEN f.lvl < depth THEN leaf_at // CAST(pow(3, f.lvl) AS BIGINT) ELSE place // CAST(pow(3, f.lvl - depth) AS BIGINT) END)
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified
    FROM (SELECT fold_g, leaf_at, arg_max(acc, lvl) AS acc, arg_max(proof, lvl) AS proof FROM fold GROUP BY fold_g, leaf_at)
    JOIN rows ON rows.g = fold_g AND rows.idx = leaf_at JOIN subs ON subs.g = rows.g, (SELECT digest AS root FROM high WHERE n = 1)
"""


def op13_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(read_table(spark, sf_dir, "documents")).documents.select("doc_id", "size", "source_size", "target", "taken")


#: The words that a source's stream gives until its target is reached; the schedule takes just these.
OP13_SQL = r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, coalesce('0' || source, '1') AS g, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS size,
            md5('mixture:' || coalesce(CAST(doc_id AS VARCHAR), '-' || md5(coalesce(text, '')))) AS key
        FROM documents),
    s AS (SELECT g, CAST(sum(size) AS BIGINT) AS n, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY g) - 1) % 3 + 1 AS INTEGER)] AS BIGINT) AS w FROM d GROUP BY g),
    t AS (
        SELECT 0 AS k, CAST(150 * sum(n) AS BIGINT) AS share, CAST(100 * sum(w) AS BIGINT) AS parts FROM s
        UNION ALL SELECT k + 1, CAST(150 * sum(n) - 100 * coalesce(sum(2 * n) FILTER (WHERE 2 * n * parts < w * share), 0) AS BIGINT), CAST(100 * coalesce(sum(w) FILTER (WHERE 2 * n * parts >= w * share), 0) AS BIGINT)
        FROM t, s WHERE k < 40 AND parts > 0 GROUP BY k, share, parts),
    e AS (SELECT arg_max(share, k) AS share, arg_max(parts, k) AS parts FROM t WHERE parts > 0),
    a AS (SELECT g, n AS source_size, CASE WHEN 2 * n * parts < w * share THEN CAST(2 * n AS DOUBLE) ELSE CAST(w * share AS DOUBLE) / CAST(parts AS DOUBLE) END AS target FROM s, e),
    p AS (SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY g ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, CAST(round(target) AS BIGINT) AS quota FROM d JOIN a USING (g))
    SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE (quota // source_size) * size + greatest(0, least(size, quota % source_size - start)) END AS BIGINT) AS taken FROM p
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_piece_codec": op1_piece_codec,
    "op2_quality_rules": op2_quality_rules,
    "op3_ngram_join": op3_ngram_join,
    "op4_window_dedup": op4_window_dedup,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_decontaminate": op6_decontaminate,
    "op7_main_text": op7_main_text,
    "op8_token_counts": op8_token_counts,
    "op9_warc": op9_warc,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_source_mixture": op13_source_mixture,
}

ORACLES: dict[str, str] = {"op3_ngram_join": OP3_SQL, "op4_window_dedup": OP4_SQL, "op9_warc": OP9_SQL, "op10_suffix_dedup": OP10_SQL, "op11_lexical_search": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_source_mixture": OP13_SQL}
