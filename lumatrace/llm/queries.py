"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import batch_dedup, components, mixture, near_duplicates, packing, survivorship, text_quality, vector_index


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return batch_dedup.refuse_duplicates(_read(spark, d, "hashes"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(_read(spark, d, "hashes"))


def p2_close(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that differ in nine bits at most, of which sketches miss hardly one in twenty thousand."""
    return near_duplicates.near_duplicate_pairs(_read(spark, d, "hashes"), 9)


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(_read(spark, d, "hashes"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return components.match_groups(_read(spark, d, "edges"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.best_files(_read(spark, d, "scan_results")).select("group_id", "path")


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.surviving_files(_read(spark, d, "scan_results"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return vector_index.near_pairs(_read(spark, d, "fingerprints"))


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return vector_index.nearest_items(_read(spark, d, "fingerprints"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    packed = packing.pack_documents(_read(spark, d, "documents"))
    return packed.where((F.col("piece") == 0) & (F.col("pieces") > 1)).select("doc_id")


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_read(spark, d, "documents"))


def p6_documents(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and pieces of each packed text."""
    return p6_packing(spark, d).groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.max("pieces").cast("bigint").alias("pieces"), F.count("*").alias("laid"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Over all containers: those over capacity, those with a gap or an overlap, and whether at most 3 % more than the least number were used."""
    boxes = p6_packing(spark, d).groupBy("container").agg(F.sum("tokens").alias("n"), F.min("start").alias("a"), F.max(F.col("start") + F.col("tokens")).alias("z"), F.count_distinct("start").alias("starts"), F.count("*").alias("pieces"))
    apart = (F.col("a") != 0) | (F.col("z") != F.col("n")) | (F.col("starts") != F.col("pieces"))
    few = F.count("*") <= F.ceil(F.sum("n") / packing.CAPACITY) * 1.03 + 1
    return boxes.agg(F.count_if(F.col("n") > packing.CAPACITY).alias("overfull"), F.count_if(apart).alias("not_seamless"), few.alias("few"), F.sum("n").alias("tokens"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    report = mixture.mix(_read(spark, d, "documents"), _read(spark, d, "source_targets"))[2]
    return report.where("short").select("source")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(_read(spark, d, "documents"), _read(spark, d, "source_targets"))[2]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Of each source whether it is short, was used at most as often as allowed, and has its wanted tokens up to one in a hundred of all, or all it may give."""
    r = p7_report(spark, d)
    most = F.col("max_repeats") * F.col("tokens")
    meant = F.least(F.col("wanted_tokens"), most.cast("double"))
    near = F.abs(F.col("mixed_tokens") - meant) <= 0.01 * F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # over the listed sources only
    return r.select("source", "tokens", "short", (F.col("most_uses") <= F.col("max_repeats")).alias("within_cap"), near.alias("as_meant"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixed_documents(_read(spark, d, "documents"), _read(spark, d, "source_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return text_quality.not_prose(_read(spark, d, "documents"), _read(spark, d, "common_words"))


def p8_quality(spark: SparkSession, d: str) -> DataFrame:
    return text_quality.text_quality(_read(spark, d, "documents"), _read(spark, d, "common_words"))


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counts of p8_quality that SQL can state."""
    shares = ["mean_word_length", "symbol_share", "digit_share", "distinct_share", "closed_line_share"]
    return p8_quality(spark, d).select("doc_id", "word_count", *(F.round(c, 9).alias(c) for c in shares))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p2_found, p2_classes, p2_close, p3_found, p4_found, p4_records, p5_found, p5_neighbours]
    found += [p6_found, p6_packing, p6_documents, p6_containers, p7_found, p7_report, p7_shares, p7_mixture, p8_found, p8_quality, p8_counts]
    return {f.__name__: f for f in found}


_TOKENS = r"""coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')), 0)"""

_KEY = "replace(path{n}, chr(92), '/') || CASE WHEN channel{n} IS NULL OR channel{n} IN ('', 'RGB', 'Composite') THEN '' ELSE '|' || channel{n} END"

_FILES = """
    SELECT group_id, path,
        arg_max(struct_pack(w := resolution_w, h := resolution_h), struct_pack(t := observed_at, p := resolution_w::BIGINT * resolution_h, w := resolution_w, h := resolution_h))
            FILTER (resolution_w > 0 AND resolution_h > 0) AS res,
        arg_max(file_size, struct_pack(t := observed_at, v := file_size)) FILTER (file_size > 0) AS file_size,
        arg_max(bit_depth, struct_pack(t := observed_at, v := bit_depth)) FILTER (bit_depth > 0) AS bit_depth
    FROM scan_results WHERE group_id IS NOT NULL AND path IS NOT NULL GROUP BY group_id, path
"""


_XX = "CASE WHEN regexp_full_match(lower(trim(xxhash)), '(0x)?[0-9a-f]{1,16}') THEN lpad(regexp_replace(lower(trim(xxhash)), '^0x', ''), 16, '0') END"

_TRIPLES = """
    SELECT item_id, max(analysis_type) AS kind, max(phash) AS p, max(dhash) AS d, max(whash) AS w FROM hashes
    WHERE item_id IS NOT NULL AND analysis_type IS NOT NULL AND phash IS NOT NULL AND dhash IS NOT NULL AND whash IS NOT NULL GROUP BY item_id"""
_BITS = "bit_count(xor(a.p, b.p))::INT + bit_count(xor(a.d, b.d))::INT + bit_count(xor(a.w, b.w))::INT"

_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WORD = r"\p{L}\p{N}_"


def oracle_sql() -> dict[str, str]:
    """SQL for those whose exact result SQL can state on whole tables in reasonable time; the others are tested by brute force."""
    return {
        # item after item in order: refused by the history, or by a partner before it that is not refused
        "p1_found": f"""
            WITH RECURSIVE i AS (SELECT item_id, min(batch_no) AS b, max(analysis_type) AS kind, max({_XX}) AS xx, max(phash) AS p, max(dhash) AS d
                FROM hashes WHERE item_id IS NOT NULL AND batch_no IS NOT NULL GROUP BY item_id),
            e AS (SELECT y.item_id AS later, x.item_id AS earlier, x.b <= 0 AS old FROM i x JOIN i y ON x.kind = y.kind AND y.b > 0 AND (x.b, x.item_id) < (y.b, y.item_id)
                AND (x.xx = y.xx OR (bit_count(xor(x.p, y.p)) <= 8 AND bit_count(xor(x.d, y.d)) <= 8))),
            h AS (SELECT DISTINCT later FROM e WHERE old),
            n AS (SELECT later, list(earlier) AS es FROM e WHERE NOT old AND later NOT IN (FROM h) AND earlier NOT IN (FROM h) GROUP BY later),
            o AS (SELECT later, es, row_number() OVER (ORDER BY b, item_id) AS k FROM n JOIN i ON i.item_id = n.later),
            r(k, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
                SELECT o.k, CASE WHEN len(list_filter(o.es, lambda x: NOT list_contains(r.gone, x))) > 0 THEN list_append(r.gone, o.later) ELSE r.gone END FROM r JOIN o ON o.k = r.k + 1)
            SELECT later AS item_id FROM h UNION ALL SELECT unnest(gone) FROM (SELECT gone FROM r ORDER BY k DESC LIMIT 1)""",
        "p2_close": f"WITH i AS ({_TRIPLES}) SELECT a.item_id AS item_id_a, b.item_id AS item_id_b FROM i a JOIN i b ON a.kind = b.kind AND a.item_id < b.item_id AND {_BITS} <= 9",
        "p3_found": f"""
            WITH RECURSIVE e AS (SELECT {_KEY.format(n=1)} AS a, {_KEY.format(n=2)} AS b FROM edges WHERE path1 IS NOT NULL AND path2 IS NOT NULL),
            t AS (SELECT a AS x, b AS y FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
            r(node, other) AS (SELECT x, x FROM t UNION SELECT r.node, t.y FROM r JOIN t ON r.other = t.x)
            SELECT min(other) AS group_key, node AS member_key FROM r GROUP BY node""",
        "p4_found": f"""
            WITH f AS ({_FILES})
            SELECT group_id, path FROM f QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY
                coalesce(res.w::BIGINT * res.h, 0) DESC, coalesce(bit_depth, 0) DESC, coalesce(file_size, 0) DESC, path) = 1""",
        "p4_records": f"WITH f AS ({_FILES}) SELECT group_id, path, res.w AS resolution_w, res.h AS resolution_h, file_size, bit_depth FROM f",
        "p5_found": """
            WITH o AS (SELECT DISTINCT item_id, vector::DOUBLE[] AS v FROM fingerprints WHERE item_id IS NOT NULL AND len(vector) = 96),
            u AS (SELECT item_id, v FROM o WHERE list_bool_and(list_transform(v, lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(v, lambda x: x <> 0))),
            n AS (SELECT a.item_id AS x, b.item_id AS y, round(1 - list_cosine_similarity(a.v, b.v), 6) AS d FROM u a JOIN u b ON a.item_id <> b.item_id
                QUALIFY row_number() OVER (PARTITION BY a.item_id ORDER BY round(1 - list_cosine_similarity(a.v, b.v), 6), b.item_id) <= 10)
            SELECT DISTINCT least(x, y) AS item_id_a, greatest(x, y) AS item_id_b FROM n WHERE d <= 0.2""",
        "p6_found": f"SELECT doc_id FROM documents WHERE {_TOKENS} > 512",
        "p6_documents": f"SELECT doc_id, tokens::BIGINT AS tokens, ceil(tokens / 512)::BIGINT AS pieces, ceil(tokens / 512)::BIGINT AS laid FROM (SELECT doc_id, {_TOKENS} AS tokens FROM documents WHERE doc_id IS NOT NULL) WHERE tokens > 0",
        "p6_containers": f"SELECT 0::BIGINT AS overfull, 0::BIGINT AS not_seamless, true AS few, sum({_TOKENS})::BIGINT AS tokens FROM documents WHERE doc_id IS NOT NULL",
        "p7_shares": f"""
            WITH d AS (SELECT regexp_replace(lower(source), '[^\\p{{L}}]', '', 'g') AS name, {_TOKENS} AS n FROM documents WHERE doc_id IS NOT NULL),
            s AS (SELECT t.source, t.target_share, t.max_repeats, coalesce((SELECT sum(n) FROM d WHERE d.name = regexp_replace(lower(t.source), '[^\\p{{L}}]', '', 'g')), 0)::BIGINT AS tokens FROM source_targets t)
            SELECT source, tokens, max_repeats * tokens < target_share * (SELECT sum(tokens) FROM s) AS short, true AS within_cap, true AS as_meant FROM s""",
        "p8_counts": rf"""
            WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '([^{_SPACE}] )(?:\b[A-Za-z]:)?(?:/[^{_SPACE}/,;|:]+){{2,}}', '\1file', 'g') AS x FROM documents WHERE doc_id IS NOT NULL),
            w AS (SELECT doc_id, x, regexp_extract_all(lower(x), '[{_WORD}]+(?:[''’][{_WORD}]+)?') AS words, len(regexp_replace(x, '[{_SPACE}]', '', 'g')) AS solid,
                list_filter(regexp_split_to_array(x, '[\n\r\v\f\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda l: regexp_matches(l, '[^{_SPACE}]')) AS lines FROM t)
            SELECT doc_id, len(words)::BIGINT AS word_count, round(list_sum(list_transform(words, lambda y: len(y))) / nullif(len(words), 0), 9) AS mean_word_length,
                round(len(regexp_extract_all(x, '[^{_WORD}{_SPACE}]|_')) / nullif(solid, 0), 9) AS symbol_share, round(len(regexp_extract_all(x, '\p{{Nd}}')) / nullif(solid, 0), 9) AS digit_share,
                round(len(list_distinct(words)) / nullif(len(words), 0), 9) AS distinct_share,
                round(len(list_filter(lines, lambda l: regexp_matches(l, '[.!?…。]["''”’»)\]]*[{_SPACE}]*$'))) / nullif(len(lines), 0), 9) AS closed_line_share FROM w""",
        "p7_found": f"""
            WITH d AS (SELECT regexp_replace(lower(source), '[^\\p{{L}}]', '', 'g') AS name, {_TOKENS} AS n FROM documents),
            s AS (SELECT t.source, t.target_share, t.max_repeats, coalesce((SELECT sum(n) FROM d WHERE d.name = regexp_replace(lower(t.source), '[^\\p{{L}}]', '', 'g')), 0) AS tokens FROM source_targets t)
            SELECT source FROM s WHERE max_repeats * tokens < target_share * (SELECT sum(tokens) FROM s)""",
    }
