"""Registered queries of the engine's own operators, each beside its SQL.

Files and metadata are bound to the tables at hand: ``catalog`` makes files of
documents, ``results`` makes one row a file and group of scan_results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display, hashing, paths, pixels
from ..functions import vectors as vec
from ..operators import bands, clusters, exact, graph, incremental, items, similar
from ..operators import results as res
from ..sources import files as src
from ..sources.tables import with_defaults
from ..streaming.discovery import arrivals as arrivals_by_window
from .config import ScanConfig
from .pipeline import duplicate_scan, search, vector_links
from .scratch import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


# --- views -------------------------------------------------------------------


def catalog(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    lang = F.lower(F.substring(F.coalesce("lang", F.lit("en")), 1, 2))
    ext = F.when(lang == "en", "png").when(lang == "de", "JPG").when(lang == "fr", "tga").when(lang == "es", "txt").otherwise("gif")
    return docs.select(
        F.concat(F.lit("/lib/"), F.coalesce("library", F.lit("none")), F.lit("/"), lang, F.lit("_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"),
        F.lit(None).cast("string").alias("channel"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("file_size"),
        (256 + F.col("doc_id") % 4 * 256).cast("int").alias("resolution_w"),
        F.lit(256).alias("resolution_h"),
        F.when(F.col("doc_id") % 3 != 0, F.lit(1.6e9) + F.col("doc_id")).alias("capture_date"),
        (F.lit(1.7e9) + F.col("doc_id") * 10).alias("mtime"),
        F.upper(ext).alias("format_str"),
        F.md5("text").alias("hash"),
        F.col("doc_id"),
    )


CATALOG = """
    SELECT '/lib/' || coalesce(library, 'none') || '/' || l || '_' || doc_id || '.' || e AS path, NULL::VARCHAR AS channel,
        coalesce(octet_length(encode(text)), 0)::BIGINT AS file_size, (256 + doc_id % 4 * 256)::INT AS resolution_w, 256 AS resolution_h,
        CASE WHEN doc_id % 3 <> 0 THEN 1.6e9::DOUBLE + doc_id END AS capture_date, 1.7e9::DOUBLE + doc_id * 10 AS mtime, upper(e) AS format_str, md5(text) AS hash, doc_id
    FROM (SELECT *, CASE l WHEN 'en' THEN 'png' WHEN 'de' THEN 'JPG' WHEN 'fr' THEN 'tga' WHEN 'es' THEN 'txt' ELSE 'gif' END AS e
        FROM (SELECT *, lower(substr(coalesce(lang, 'en'), 1, 2)) AS l FROM documents))"""


def results(spark: SparkSession, d: str) -> DataFrame:
    big = ["resolution_w", "resolution_h", "file_size", "bit_depth", "mipmap_count", "capture_date", "format_str", "compression_format", "color_space", "format_details", "texture_type"]
    rows = read(spark, d, "scan_results").where(F.col("group_id").isNotNull() & F.col("path").isNotNull())
    return rows.groupBy("group_id", "path").agg(
        F.min("channel").alias("channel"), *(F.max(c).alias(c) for c in big), F.max(F.coalesce("is_best", F.lit(False))).alias("is_best"),
        F.max(F.coalesce("distance", F.lit(0))).alias("distance"), F.min(F.coalesce("found_by", F.lit("AI"))).alias("found_by"),
    )


RESULTS = """
    SELECT group_id, path, min(channel) AS channel, max(resolution_w) AS resolution_w, max(resolution_h) AS resolution_h, max(file_size) AS file_size, max(bit_depth) AS bit_depth,
        max(mipmap_count) AS mipmap_count, max(capture_date) AS capture_date, max(format_str) AS format_str, max(compression_format) AS compression_format, max(color_space) AS color_space,
        max(format_details) AS format_details, max(texture_type) AS texture_type, max(coalesce(is_best, false)) AS is_best, max(coalesce(distance, 0)) AS distance, min(coalesce(found_by, 'AI')) AS found_by
    FROM scan_results WHERE group_id IS NOT NULL AND path IS NOT NULL GROUP BY group_id, path"""
NAME = "regexp_extract(path, '[^/]*$')"
STEM = f"regexp_replace({NAME}, '^(.+)\\.[^.]+$', '\\1')"
FORMAT = "CASE WHEN upper(format_str) IN ('PNG','BMP','TIFF','TIF','EXR') THEN 2 WHEN upper(format_str) IN ('JPEG','JPG','WEBP','AVIF','TGA') THEN 1 ELSE 0 END"
LEADER = f"""coalesce(resolution_w, 0)::BIGINT * coalesce(resolution_h, 0) DESC, {FORMAT} DESC, coalesce(file_size, 0) DESC, length({NAME}), coalesce(capture_date, 0), path, coalesce(channel, '')"""
SUMMARY = f"""
    SELECT group_id, arg_max({STEM} || CASE WHEN coalesce(channel, '') <> '' THEN ' (' || channel || ')' ELSE '' END, (is_best::INT, path)) AS name,
        count(*) - 1 AS dup_count, count(*) AS member_count, sum(coalesce(file_size, 0))::BIGINT AS total_size FROM ({RESULTS}) GROUP BY group_id"""
KEY = "{p} || '|' || CASE WHEN {c} IS NULL OR {c} IN ('', 'RGB', 'Composite', 'Luminance') THEN '' ELSE {c} END"
K1, K2 = KEY.format(p="path1", c="channel1"), KEY.format(p="path2", c="channel2")
RANK = "CASE method WHEN 'xxHash' THEN 1 WHEN 'dHash' THEN 2 WHEN 'pHash' THEN 3 WHEN 'wHash' THEN 4 WHEN 'AI' THEN 5 ELSE 6 END"
PAIRS = f"""
    SELECT least(a, b) AS node_a, greatest(a, b) AS node_b, min((r, distance, method)) AS e
    FROM (SELECT {K1} AS a, {K2} AS b, {RANK} AS r, distance, method FROM edges WHERE path1 IS NOT NULL AND path2 IS NOT NULL) WHERE a <> b GROUP BY 1, 2"""
REACH = f"""
    pairs AS ({PAIRS}), tie AS (SELECT node_a AS x, node_b AS y FROM pairs UNION SELECT node_b, node_a FROM pairs),
    reach(node, other) AS (SELECT x, x FROM tie UNION SELECT r.node, t.y FROM reach r JOIN tie t ON r.other = t.x),
    comp AS (SELECT node, least(min(other), node) AS component FROM reach GROUP BY node)"""


# --- sources and scalar functions --------------------------------------------


@query(f"""
    WITH c AS ({CATALOG}) SELECT path, lower(regexp_extract(path, '\\.[^./]+$')) AS suffix FROM c
    WHERE lower(regexp_extract(path, '\\.[^./]+$')) IN ('.png', '.jpg', '.tga', '.gif') AND NOT starts_with(path, '/lib/none/')""")
def file_discovery(spark: SparkSession, d: str) -> DataFrame:
    c, p = catalog(spark, d), F.col("path")
    return c.where(src.supported(p) & src.not_excluded(p, "/lib", ["none"])).select("path", paths.suffix(p).alias("suffix"))


@query(f"""
    SELECT path, {NAME} AS name, {STEM} AS stem, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, {FORMAT} AS format_score, {STEM} || CASE WHEN coalesce(channel, '') <> '' THEN ' (' || channel || ')' ELSE '' END AS label,
        CASE WHEN file_size > 52428800 THEN 8 WHEN file_size > 10485760 THEN 4 WHEN file_size > 2097152 THEN 2 ELSE 1 END AS shrink,
        CASE WHEN (resolution_w > 384 OR resolution_h > 384) AND floor(least(resolution_w / 384.0, resolution_h / 384.0)) > 1
            THEN (2 ** ceil(log2(floor(least(resolution_w / 384.0, resolution_h / 384.0)))))::INT ELSE 1 END AS thumb_shrink
    FROM ({RESULTS})""")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p, c = F.col("path"), F.col("channel")
    return results(spark, d).select(
        "path", paths.file_name(p).alias("name"), paths.stem(p).alias("stem"), paths.parent(p).alias("parent"), paths.format_score(F.col("format_str")).alias("format_score"),
        paths.group_name(p, c).alias("label"), paths.load_shrink(F.col("file_size")).alias("shrink"), paths.thumbnail_shrink(F.col("resolution_w"), F.col("resolution_h"), 256).alias("thumb_shrink"),
    )


@query(f"""
    SELECT path, concat_ws(' | ', coalesce(resolution_w, 0) || 'x' || coalesce(resolution_h, 0), printf('%.2f MB', coalesce(file_size, 0) / 1048576.0::DOUBLE), nullif(format_str, ''), nullif(compression_format, ''),
        nullif(color_space, ''), coalesce(bit_depth, 0) || '-bit', nullif(format_details, ''), nullif(texture_type, ''), 'Mips: ' || coalesce(mipmap_count, 0)) AS line, group_id FROM ({RESULTS})""")
def metadata_string(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).select("path", display.metadata_string().alias("line"), "group_id")


@query("""
    SELECT item_id, batch_no, b AS band, ((dhash >> (16 * b)) & 65535)::BIGINT AS key FROM hashes, (SELECT unnest([0, 1, 2, 3]) AS b) WHERE dhash IS NOT NULL""")
def band_keys(spark: SparkSession, d: str) -> DataFrame:
    h = read(spark, d, "hashes").where("dhash IS NOT NULL")
    return h.select("item_id", "batch_no", F.explode(hashing.bands(F.col("dhash"))).alias("b")).select("item_id", "batch_no", "b.band", "b.key")


@query("""
    SELECT vec_id, (CASE WHEN u >= 9223372036854775808::HUGEINT THEN u - 18446744073709551616::HUGEINT ELSE u END)::BIGINT AS h
    FROM (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN v[i] > list_median(v) THEN (1::HUGEINT) << (64 - i)::HUGEINT ELSE 0::HUGEINT END)) AS u
        FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))""")
def fingerprint64(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    s = F.array_sort(v)
    return read(spark, d, "embeddings").select("vec_id", hashing.pack_bits(F.transform(v, lambda x: x > (s[31] + s[32]) / 2)).alias("h"))


@query(f"""
    SELECT group_id, path, sha1(concat_ws('|', path, '0', '256', 'filmic', coalesce(channel, 'full'))) AS thumb_key, md5(path) || '_' || translate('org/model-x', '/-', '__') AS store FROM ({RESULTS})""")
def storage_keys(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return results(spark, d).select(
        "group_id", "path", hashing.thumbnail_key(p, F.lit("0"), F.lit(256), F.lit("filmic"), F.col("channel")).alias("thumb_key"), hashing.store_name(p, F.lit("org/model-x")).alias("store")
    )


@query("""
    WITH s AS (SELECT path, channel, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(path || coalesce(channel, ''))) AS h FROM fingerprints)
    SELECT path, channel, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM s""")
def vector_ids(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "fingerprints").select("path", "channel", hashing.vector_id(F.col("path"), F.col("channel")).alias("id"))


@query("""
    SELECT vec_id, round(list_sum(list_transform(n, lambda x: round(x, 6))), 4) AS total, round(n[1], 6) AS first FROM (
        SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS v FROM embeddings))""")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    n = vec.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3))
    e = read(spark, d, "embeddings").select("vec_id", n.alias("n"))
    total = F.aggregate(F.transform("n", lambda x: F.round(x, 6)), F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", F.round(total, 4).alias("total"), F.round(F.col("n")[0], 6).alias("first"))


@query("""
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(0, least(255, floor((x::DOUBLE + 0.4) * 320)))) AS v FROM embeddings)
    SELECT vec_id, list_min(v) <> list_max(v) AS active, (list_max(v) < 5 OR list_min(v) > 250 OR list_avg(v) < 5 OR list_avg(v) > 250) AS solid, list_sum(list_transform(v, lambda x: abs(x - v[1])))::DOUBLE AS diff FROM e""")
def channel_checks(spark: SparkSession, d: str) -> DataFrame:
    v = F.transform("embedding", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor((x.cast("double") + 0.4) * 320).cast("double"))))
    e = read(spark, d, "embeddings").select("vec_id", v.alias("v"))
    diff = pixels.pixel_diff(F.col("v"), F.transform("v", lambda _: F.col("v")[0]))
    return e.select("vec_id", pixels.channel_active(F.col("v")).alias("active"), pixels.solid_channel(F.col("v")).alias("solid"), F.aggregate(diff, F.lit(0.0), lambda a, x: a + x).alias("diff"))


@query(f"""
    WITH s AS (SELECT group_id, list({STEM}) AS l FROM ({RESULTS}) GROUP BY group_id),
    m AS (SELECT group_id, list_min(l) AS a, list_max(l) AS z, list_min(list_transform(l, lambda x: length(x))) AS k, list_min(list_transform(l, lambda x: lpad(length(x)::VARCHAR, 6, '0') || x)) AS sh FROM s),
    n AS (SELECT *, len(list_filter(range(1, k + 1), lambda i: substr(a, 1, i::INT) = substr(z, 1, i::INT))) AS c FROM m)
    SELECT group_id, CASE WHEN c >= k THEN substr(sh, 7) WHEN regexp_matches(substr(a, 1, c::INT), '[_\\- ]') THEN regexp_extract(substr(a, 1, c::INT), '^(.*)[_\\- ][^_\\- ]*$', 1) ELSE substr(a, 1, c::INT) END AS base FROM n""")
def common_base_name(spark: SparkSession, d: str) -> DataFrame:
    stems = results(spark, d).groupBy("group_id").agg(F.collect_list(paths.stem(F.col("path"))).alias("s"))
    return stems.select("group_id", paths.common_base_name(F.col("s")).alias("base"))


@query(f"""
    SELECT path, unnest(CASE WHEN contains(lower({NAME}), 'de_') OR contains(lower({NAME}), 'fr_') THEN ['R', 'G'] ELSE ['Luminance'] END) AS analysis_type FROM ({CATALOG})""")
def item_generation(spark: SparkSession, d: str) -> DataFrame:
    return items.analysis_items(catalog(spark, d), by_channel=True, by_luminance=True, channels=["R", "G"], tags=["de_", "fr_"])


@query("""
    SELECT item_id, path, coalesce(resolution_w, 0) AS resolution_w, coalesce(file_size, 0) AS file_size, coalesce(bit_depth, 8) AS bit_depth, coalesce(mipmap_count, 1) AS mipmap_count,
        coalesce(texture_type, '2D') AS texture_type, coalesce(color_space, 'sRGB') AS color_space, coalesce(compression_format, format_str, 'Unknown') AS compression_format FROM fingerprints""")
def row_defaults(spark: SparkSession, d: str) -> DataFrame:
    cols = ["item_id", "path", "resolution_w", "file_size", "bit_depth", "mipmap_count", "texture_type", "color_space", "compression_format"]
    return with_defaults(read(spark, d, "fingerprints")).select(cols)


@query("""
    SELECT event_id, list_filter(list_transform(string_split(event_type || ', ,' || upper(event_type) || ' ', ','), lambda x: lower(trim(x))), lambda x: x <> '')[2] AS tag,
        round(10 + CASE WHEN event_id > 0 THEN (event_id / 2) / event_id ELSE 0 END * 40, 6) AS progress FROM events""")
def list_parsing(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat("event_type", F.lit(", ,"), F.upper("event_type"), F.lit(" "))
    done = display.progress(F.lit(10.0), F.col("event_id") / 2, F.col("event_id"), F.lit(40.0))
    return read(spark, d, "events").select("event_id", paths.parse_list(t)[1].alias("tag"), F.round(done, 6).alias("progress"))


# --- exact and perceptual duplicates -----------------------------------------


@query(f"SELECT hash, count(*) AS members, min(path) AS rep FROM ({CATALOG}) WHERE hash IS NOT NULL GROUP BY hash")
def exact_hash_groups(spark: SparkSession, d: str) -> DataFrame:
    return exact.hash_groups(catalog(spark, d))


@query(f"SELECT rep AS path1, path AS path2 FROM (SELECT path, min(path) OVER (PARTITION BY hash) AS rep FROM ({CATALOG}) WHERE hash IS NOT NULL) WHERE path <> rep")
def exact_edges(spark: SparkSession, d: str) -> DataFrame:
    return exact.exact_edges(catalog(spark, d))


@query(f"SELECT path, file_size FROM (SELECT *, min(path) OVER (PARTITION BY hash) AS rep FROM ({CATALOG}) WHERE hash IS NOT NULL) WHERE path = rep")
def representatives(spark: SparkSession, d: str) -> DataFrame:
    return exact.representatives(catalog(spark, d)).select("path", "file_size")


EXACT_SCAN = f"""
    WITH c AS ({CATALOG}), g AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY {LEADER}) AS r, count(*) OVER (PARTITION BY hash) AS n FROM c WHERE hash IS NOT NULL),
    s AS (SELECT *, first_value(path) OVER (PARTITION BY hash ORDER BY r) AS leader FROM g WHERE n > 1)
    SELECT path, file_size, dense_rank() OVER (ORDER BY leader || '|') AS group_id, r = 1 AS is_best, CASE WHEN r = 1 THEN 0 ELSE 100 END AS distance, CASE WHEN r = 1 THEN 'Best' ELSE 'xxHash' END AS found_by FROM s"""


@query(EXACT_SCAN)
def exact_duplicate_scan(spark: SparkSession, d: str) -> DataFrame:
    config = ScanConfig("/lib", find_dhash=False, find_phash=False)
    return duplicate_scan(config, catalog(spark, d)).select("path", "file_size", "group_id", "is_best", "distance", "found_by")


@query(f"""
    SELECT group_id, max(CASE WHEN is_best THEN {STEM} END) AS name, count(*) - 1 AS dup_count, count(*) AS member_count, sum(file_size)::BIGINT AS total_size FROM ({EXACT_SCAN}) GROUP BY group_id""")
def exact_group_summary(spark: SparkSession, d: str) -> DataFrame:
    config = ScanConfig("/lib", find_dhash=False, find_phash=False)
    return clusters.group_summary(duplicate_scan(config, catalog(spark, d)))


@query("""
    WITH h AS (SELECT phash AS h, min(item_id) AS id FROM hashes WHERE phash IS NOT NULL AND item_id IS NOT NULL GROUP BY phash)
    SELECT a.id AS id_a, b.id AS id_b, bit_count(xor(a.h, b.h))::INT AS bits FROM h a JOIN h b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 3""")
def hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    return bands.banded_pairs(read(spark, d, "hashes"), "item_id", "phash", 3, mode="all_pairs")


@query("SELECT DISTINCT item_id, min(item_id) OVER (PARTITION BY phash) AS rep FROM hashes WHERE phash IS NOT NULL AND item_id IS NOT NULL")
def hamming_members(spark: SparkSession, d: str) -> DataFrame:
    """Whom the ends of :func:`hamming_pairs` stand for."""
    h = read(spark, d, "hashes")
    return bands.class_members(h, bands.no_pairs(h, "item_id"), "item_id", "phash").select("item_id", "rep")


WHOLE = """
    WITH r AS (SELECT DISTINCT item_id, phash AS h FROM hashes WHERE phash IS NOT NULL AND item_id IS NOT NULL), p AS (SELECT h, min(item_id) AS rep FROM r GROUP BY h)"""


@query(f"{WHOLE} SELECT a.rep AS id_a, b.rep AS id_b, bit_count(xor(a.h, b.h))::INT AS bits FROM p a JOIN p b ON a.rep < b.rep AND bit_count(xor(a.h, b.h)) <= 8")
def hamming_pairs_whole(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of representatives at the configured threshold; :func:`hamming_classes` has whom they stand for."""
    return bands.whole_pairs(read(spark, d, "hashes"), "item_id", "phash", ScanConfig("/").phash_bits)


@query(f"""{WHOLE}, n AS (SELECT a.rep, count(*) AS links FROM p a JOIN p b ON a.rep <> b.rep AND bit_count(xor(a.h, b.h)) <= 8 GROUP BY a.rep)
    SELECT item_id, rep, coalesce(links, 0) AS links FROM r JOIN p USING (h) LEFT JOIN n USING (rep)""")
def hamming_classes(spark: SparkSession, d: str) -> DataFrame:
    return bands.class_members(read(spark, d, "hashes"), materialize(hamming_pairs_whole(spark, d), "pairs"), "item_id", "phash")


@query("""
    WITH f AS (SELECT item_id AS id, dhash AS h, b, (dhash >> (16 * b)) & 65535 AS k FROM hashes, (SELECT unnest([0, 1, 2, 3]) AS b) WHERE dhash IS NOT NULL),
    p AS (SELECT b, k, min((id, h)) AS p FROM f GROUP BY b, k)
    SELECT DISTINCT p.p[1] AS id_a, f.id AS id_b, bit_count(xor(p.p[2], f.h))::INT AS bits FROM f JOIN p USING (b, k) WHERE p.p[1] < f.id AND bit_count(xor(p.p[2], f.h)) <= 8""")
def banded_pivot_pairs(spark: SparkSession, d: str) -> DataFrame:
    return bands.banded_pairs(read(spark, d, "hashes"), "item_id", "dhash", 8)


XX = "CASE WHEN regexp_full_match(lower(trim(xxhash)), '(0x)?[0-9a-f]{1,16}') THEN lpad(regexp_replace(lower(trim(xxhash)), '^0x', ''), 16, '0') END"


def _pivots(column: str, method: str) -> str:
    return f"""{column}_f AS (SELECT node AS id, {column} AS h, b, ({column} >> (16 * b)) & 65535 AS k FROM nodes, (SELECT unnest([0, 1, 2, 3]) AS b) WHERE {column} IS NOT NULL),
    {column}_p AS (SELECT b, k, min((id, h)) AS p FROM {column}_f GROUP BY b, k),
    {column}_e AS (SELECT DISTINCT p[1] AS a, id AS z, '{method}' AS method, 0.0::DOUBLE AS distance FROM {column}_f JOIN {column}_p USING (b, k) WHERE p[1] < id AND bit_count(xor(p[2], h))::INT <= 8)"""


@query(f"""
    WITH RECURSIVE h AS (SELECT path, CASE WHEN analysis_type IN ('R', 'G', 'B', 'A') THEN analysis_type END AS channel, {XX} AS hash, dhash, phash FROM hashes WHERE item_id IS NOT NULL AND path IS NOT NULL),
    nodes AS (SELECT path, channel, path || '|' || coalesce(channel, '') AS node, max(hash) AS hash, max(dhash) AS dhash, max(phash) AS phash FROM h GROUP BY path, channel),
    prints AS (SELECT * FROM fingerprints WHERE item_id IS NOT NULL AND path IS NOT NULL),
    meta AS (SELECT path, max((resolution_w::BIGINT * resolution_h, resolution_w, resolution_h)) FILTER (resolution_w > 0 AND resolution_h > 0) AS s, max(file_size) FILTER (file_size > 0) AS file_size, max(capture_date) AS capture_date, max(format_str) AS format_str FROM prints GROUP BY path),
    every AS (SELECT path, channel, node, hash FROM nodes UNION ALL SELECT path, NULL, path || '|', arg_min(hash, channel) FILTER (hash IS NOT NULL) FROM nodes GROUP BY path HAVING NOT bool_or(channel IS NULL) AND count(hash) > 0),
    files AS (SELECT e.*, s[2] AS resolution_w, s[3] AS resolution_h, file_size, capture_date, coalesce(format_str, upper(regexp_extract(path, '\\.([^.]+)$', 1))) AS format_str FROM every e LEFT JOIN meta USING (path)),
    same AS (SELECT DISTINCT path, min(path) OVER (PARTITION BY hash) AS rep FROM files WHERE hash IS NOT NULL),
    {_pivots('dhash', 'dHash')}, {_pivots('phash', 'pHash')},
    v AS (SELECT item_id, path || '|' || coalesce(CASE WHEN channel NOT IN ('RGB', 'Composite', 'Luminance') THEN channel END, '') AS node, vector::DOUBLE[] AS v FROM prints
       WHERE len(vector) = 96 AND list_bool_and(list_transform(vector, lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(vector, lambda x: x <> 0))
       QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY path, channel NULLS FIRST, vector) = 1),
    near AS (SELECT a.item_id AS x, b.item_id AS y, a.node AS a, b.node AS z, round(1 - list_cosine_similarity(a.v, b.v), 6) AS distance FROM v a, v b QUALIFY row_number() OVER (PARTITION BY a.item_id ORDER BY distance, b.item_id) <= 50),
    evidence AS (SELECT rep || '|' AS a, path || '|' AS z, 'xxHash' AS method, 0.0::DOUBLE AS distance FROM same UNION ALL FROM dhash_e UNION ALL FROM phash_e UNION ALL SELECT a, z, 'AI', distance FROM near WHERE x <> y AND distance <= 0.05),
    pairs AS (SELECT least(a, z) AS node_a, greatest(a, z) AS node_b, min((CASE method WHEN 'xxHash' THEN 1 WHEN 'dHash' THEN 2 WHEN 'pHash' THEN 3 ELSE 5 END, distance, method)) AS e FROM evidence WHERE a <> z GROUP BY 1, 2),
    tie AS (SELECT node_a AS x, node_b AS y FROM pairs UNION SELECT node_b, node_a FROM pairs),
    label(node, l) USING KEY (node) AS (SELECT x, least(x, min(y)) FROM tie GROUP BY x UNION SELECT t.y, min(r.l) FROM label r JOIN tie t ON r.node = t.x JOIN recurring.label o ON o.node = t.y WHERE r.l < o.l GROUP BY t.y),
    known AS (SELECT f.*, l AS component, first_value(node) OVER (PARTITION BY l ORDER BY {LEADER}) AS leader, count(*) OVER (PARTITION BY l) AS n FROM files f JOIN label USING (node)),
    tied AS (SELECT k.component, k.leader, k.node, p.e FROM known k JOIN pairs p ON p.node_a = least(k.node, k.leader) AND p.node_b = greatest(k.node, k.leader) WHERE n > 1
       UNION ALL SELECT k.component, k.leader, k.node, (1, 0.0::DOUBLE, 'xxHash') FROM known k JOIN files f ON f.node = k.leader WHERE k.node <> k.leader AND n > 1 AND f.hash = k.hash),
    best AS (SELECT component, leader, node, min(e) AS e FROM tied GROUP BY ALL),
    out AS (SELECT leader, node, false AS is_best, e[3] AS found_by, CASE WHEN e[3] = 'AI' THEN floor(round(greatest(0, 1 - e[2]) * 100, 6)) ELSE 100 END::INT AS distance FROM best UNION ALL SELECT DISTINCT leader, leader, true, 'Best', 0 FROM best)
    SELECT path, channel, dense_rank() OVER (ORDER BY leader) AS group_id, is_best, distance, found_by FROM out JOIN files USING (node)""")
def duplicate_scan_full(spark: SparkSession, d: str) -> DataFrame:
    h = read(spark, d, "hashes").where("item_id IS NOT NULL AND path IS NOT NULL")
    chan = F.when(F.col("analysis_type").isin("R", "G", "B", "A"), F.col("analysis_type"))
    nodes = h.groupBy("path", chan.alias("channel")).agg(F.max(hashing.content_number(F.col("xxhash"))).alias("hash"), *(F.max(c).alias(c) for c in ("dhash", "phash", "whash")))
    nodes = materialize(nodes, "nodes")
    prints = read(spark, d, "fingerprints").where("item_id IS NOT NULL AND path IS NOT NULL")
    whole = nodes.join(_print_metadata(prints), "path", "left").withColumn("format_str", F.coalesce("format_str", F.upper(F.regexp_extract("path", r"\.([^.]+)$", 1))))
    config = ScanConfig("/", use_ai=True)
    return duplicate_scan(config, whole, nodes, vector_links(config, prints, 96)).select("path", "channel", "group_id", "is_best", "distance", "found_by")


def _print_metadata(prints: DataFrame) -> DataFrame:
    """Metadata of each file as far as any of its rows has it."""
    size = F.struct((F.col("resolution_w").cast("bigint") * F.col("resolution_h")).alias("n"), F.col("resolution_w").alias("w"), F.col("resolution_h").alias("h"))
    of = prints.groupBy("path").agg(
        F.max(F.when((F.col("resolution_w") > 0) & (F.col("resolution_h") > 0), size)).alias("size"), F.max(F.when(F.col("file_size") > 0, F.col("file_size"))).alias("file_size"),
        F.max("capture_date").alias("capture_date"), F.max("format_str").alias("format_str"),
    )
    return of.select("path", F.col("size.w").alias("resolution_w"), F.col("size.h").alias("resolution_h"), "file_size", "capture_date", "format_str")


# --- vectors ------------------------------------------------------------------

COS = "round(1 - list_cosine_similarity(a.v, b.v), 6)"
NEAR = f"""
    WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    n AS (SELECT a.vec_id AS id, b.vec_id AS other, {COS} AS distance FROM e a, e b QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS}, b.vec_id) <= 50)"""


@query(f"{NEAR} SELECT least(id, other) AS id_a, greatest(id, other) AS id_b, min(distance) AS distance FROM n WHERE id <> other AND distance <= 0.65 GROUP BY 1, 2")
def knn_links(spark: SparkSession, d: str) -> DataFrame:
    return similar.link_pairs(similar.knn_exact(read(spark, d, "embeddings")), 0.65)


SEARCH = f"""
    WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v FROM e WHERE vec_id = (SELECT min(vec_id) FROM e)),
    t AS (SELECT b.vec_id, {COS.replace('a.v', 'q.v')} AS distance FROM e b, q ORDER BY distance, b.vec_id LIMIT 100)"""


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return list(read(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0])


@query(f"{SEARCH} SELECT vec_id, distance FROM t WHERE distance < 0.9")
def vector_search(spark: SparkSession, d: str) -> DataFrame:
    return similar.vector_search(read(spark, d, "embeddings"), _query_vector(spark, d), 0.9, top=100)


@query(f"""{SEARCH} SELECT 'Query: sample' AS path, 1::BIGINT AS group_id, true AS is_best, 0 AS distance, 'Query' AS found_by
    UNION ALL SELECT vec_id::VARCHAR, 1, false, floor(round(greatest(0, 1 - distance) * 100, 6))::INT, 'AI' FROM t WHERE distance < 0.9""")
def sample_search_group(spark: SparkSession, d: str) -> DataFrame:
    hits = vector_search(spark, d).select(F.col("vec_id").cast("string").alias("path"), "distance")
    return clusters.search_group(spark.createDataFrame([("Query: sample",)], "path string"), hits)


# The two queries above keep the LIMIT of their SQL; these have the operator's own, SEARCH_TOP.
SEARCH_WHOLE = SEARCH.replace("LIMIT 100)", f"LIMIT {similar.SEARCH_TOP})")


@query(f"{SEARCH_WHOLE} SELECT vec_id, distance FROM t WHERE distance < 0.9")
def vector_search_whole(spark: SparkSession, d: str) -> DataFrame:
    return similar.vector_search(read(spark, d, "embeddings"), _query_vector(spark, d), 0.9)


@query(f"""{SEARCH_WHOLE} SELECT 'Query: sample' AS path, 1::BIGINT AS group_id, true AS is_best, 0 AS distance, 'Query' AS found_by
    UNION ALL SELECT vec_id::VARCHAR, 1, false, floor(round(greatest(0, 1 - distance) * 100, 6))::INT, 'AI' FROM t WHERE distance < 0.9""")
def sample_search_whole(spark: SparkSession, d: str) -> DataFrame:
    hits = vector_search_whole(spark, d).select(F.col("vec_id").cast("string").alias("path"), "distance")
    return clusters.search_group(spark.createDataFrame([("Query: sample",)], "path string"), hits)


USABLE = "len(vector) = 96 AND list_bool_and(list_transform(vector, lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(vector, lambda x: x <> 0))"


@query(f"""
    WITH v AS (SELECT item_id, path, channel, vector::DOUBLE[] AS v FROM fingerprints WHERE item_id IS NOT NULL AND path IS NOT NULL AND {USABLE}
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY path, channel NULLS FIRST, vector) = 1),
    n AS (SELECT least(a.item_id, b.item_id) AS x, greatest(a.item_id, b.item_id) AS y, a.item_id <> b.item_id AS other, {COS} AS distance FROM v a, v b QUALIFY row_number() OVER (PARTITION BY a.item_id ORDER BY distance, b.item_id) <= 50),
    p AS (SELECT x, y, min(distance) AS distance FROM n WHERE other AND distance <= 0.05 GROUP BY x, y)
    SELECT a.path AS path1, a.channel AS channel1, b.path AS path2, b.channel AS channel2, 'AI' AS method, distance FROM p JOIN v a ON a.item_id = x JOIN v b ON b.item_id = y""")
def ai_links(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of vectors at the default similarity of 95 percent."""
    return vector_links(ScanConfig("/"), read(spark, d, "fingerprints"), 96)


@query(f"""
    WITH u AS (SELECT path, vector::DOUBLE[] AS v FROM fingerprints WHERE {USABLE}), q AS (SELECT v FROM u ORDER BY path LIMIT 1),
    t AS (SELECT path, round(1 - list_cosine_similarity(u.v, q.v), 6) AS distance FROM u, q ORDER BY distance, path LIMIT {similar.SEARCH_TOP})
    SELECT 'Query: moss' AS path, 1::BIGINT AS group_id, true AS is_best, 0 AS distance, 'Query' AS found_by
    UNION ALL SELECT path, 1, false, floor(round(greatest(0, 1 - distance) * 100, 6))::INT, 'AI' FROM t WHERE distance < 0.3""")
def text_search_group(spark: SparkSession, d: str) -> DataFrame:
    """A search at 70 percent by the vector that a model would give for the words; here that of the first path."""
    good = read(spark, d, "fingerprints").where(vec.usable(F.col("vector"), 96))
    asked = list(good.orderBy("path").select("vector").first()[0])
    config = ScanConfig("/", mode="text_search", query="moss", similarity=70.0)
    return search(config, good, asked, spark.createDataFrame([("Query: moss",)], "path string"))


@query()
def ivf_probe(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return similar.probe(e, similar.fit_cells(e, 16), k=10, probes=8)


# --- evidence and groups --------------------------------------------------------


@query(f"WITH p AS ({PAIRS}) SELECT node_a, node_b, e[3] AS method, e[2] AS distance FROM p")
def evidence_merge(spark: SparkSession, d: str) -> DataFrame:
    return clusters.merge_evidence(read(spark, d, "edges"))


@query(f"WITH RECURSIVE {REACH} SELECT node, component FROM comp")
def components(spark: SparkSession, d: str) -> DataFrame:
    return graph.connected_components(clusters.merge_evidence(read(spark, d, "edges")), "node_a", "node_b")


def _edge_files(spark: SparkSession, d: str) -> DataFrame:
    """Each node of edges as a file without metadata."""
    e = read(spark, d, "edges").where("path1 IS NOT NULL AND path2 IS NOT NULL")
    plain = F.col("channel").isNull() | F.col("channel").isin("", "RGB", "Composite", "Luminance")
    nodes = e.select(F.col("path1").alias("path"), F.col("channel1").alias("channel")).union(e.select("path2", "channel2")).select("path", F.when(~plain, F.col("channel")).alias("channel")).distinct()
    types = {"resolution_w": "int", "resolution_h": "int", "file_size": "bigint", "capture_date": "double", "format_str": "string"}
    return nodes.withColumns({c: F.lit(None).cast(t) for c, t in types.items()})


@query(f"""
    WITH RECURSIVE {REACH}, f AS (SELECT node, component, regexp_replace(node, '\\|[^|]*$', '') AS path, regexp_extract(node, '\\|([^|]*)$', 1) AS channel FROM comp),
    l AS (SELECT component, first_value(node) OVER (PARTITION BY component ORDER BY length({NAME}), path, channel) AS leader, node FROM f),
    t AS (SELECT l.component, l.leader, l.node, p.e[3] AS method, p.e[2] AS distance FROM l JOIN pairs p ON p.node_a = least(l.node, l.leader) AND p.node_b = greatest(l.node, l.leader))
    SELECT component, node, leader, method, distance, false AS is_best FROM t UNION ALL SELECT DISTINCT component, leader, leader, 'Best', 0.0::DOUBLE, true FROM t""")
def star_groups(spark: SparkSession, d: str) -> DataFrame:
    pairs = materialize(clusters.merge_evidence(read(spark, d, "edges")), "pairs")
    return clusters.star_groups(_edge_files(spark, d), pairs).select("component", "node", "leader", "method", "distance", "is_best")


@query(f"SELECT group_id, path || '|' || coalesce(channel, '') AS leader FROM ({RESULTS}) QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY {LEADER}) = 1")
def leader_per_group(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).withColumn("node", F.concat("path", F.lit("|"), F.coalesce("channel", F.lit(""))))
    return clusters.leaders(r, "group_id")


@query(SUMMARY)
def group_summary(spark: SparkSession, d: str) -> DataFrame:
    return clusters.group_summary(results(spark, d))


@query(f"SELECT count(*) AS groups, sum(greatest(0, dup_count))::BIGINT AS duplicates, sum(total_size)::BIGINT AS total_size FROM ({SUMMARY})")
def summary_totals(spark: SparkSession, d: str) -> DataFrame:
    return res.totals(group_summary(spark, d))


# --- results ----------------------------------------------------------------------


@query(f"SELECT path, is_best, distance FROM ({RESULTS}) WHERE group_id = 1 ORDER BY is_best DESC, distance DESC, path LIMIT 10000")
def group_fetch(spark: SparkSession, d: str) -> DataFrame:
    return res.fetch_group(results(spark, d), 1).select("path", "is_best", "distance")


def _sorted(by: str, order: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return res.sorted_groups(group_summary(spark, d), by)

    run.__name__ = f"group_sort_{by}"
    query(f"SELECT * FROM ({SUMMARY}) ORDER BY {order}, group_id")(run)


for _by, _order in (("count", "dup_count DESC"), ("size", "total_size DESC"), ("name", "name")):
    _sorted(_by, _order)


@query(f"""
    SELECT group_id, path, CASE WHEN is_best THEN 102 WHEN found_by = 'xxHash' THEN 101 WHEN found_by = 'dHash' THEN 100 WHEN found_by = 'pHash' THEN 99 ELSE distance END::INT AS priority,
        CASE found_by WHEN 'xxHash' THEN 'Exact Match' WHEN 'dHash' THEN 'Simple Match' WHEN 'pHash' THEN 'Near-Identical' WHEN 'wHash' THEN 'Structural Match' ELSE distance || '%' END AS label FROM ({RESULTS})""")
def result_priority(spark: SparkSession, d: str) -> DataFrame:
    return res.with_priority(results(spark, d)).select("group_id", "path", "priority", display.method_label(F.col("found_by"), F.col("distance")).alias("label"))


ORDERED = f"SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY is_best DESC, distance DESC, path, coalesce(channel, '')) AS position FROM ({{t}})"


@query(f"SELECT group_id, path, position FROM ({ORDERED.format(t=RESULTS)})")
def child_order(spark: SparkSession, d: str) -> DataFrame:
    return res.child_order(results(spark, d)).select("group_id", "path", "position")


@query(f"SELECT group_id, path, distance FROM ({RESULTS}) WHERE is_best OR found_by <> 'AI' OR distance >= 90")
def similarity_slider(spark: SparkSession, d: str) -> DataFrame:
    return res.min_similarity(results(spark, d), 90).select("group_id", "path", "distance")


@query(f"SELECT group_id, path FROM ({RESULTS}) WHERE contains(lower({NAME}), 'moss')")
def name_filter(spark: SparkSession, d: str) -> DataFrame:
    return res.name_filter(results(spark, d), "Moss").select("group_id", "path")


def _checked(spark: SparkSession, d: str) -> DataFrame:
    """Some rows of results marked: AI matches from score 80."""
    return results(spark, d).withColumn("checked", (F.col("found_by") == "AI") & (F.col("distance") >= 80))


CHECKED = f"SELECT *, found_by = 'AI' AND distance >= 80 AS checked FROM ({RESULTS})"


@query(f"SELECT group_id, path, NOT is_best AS checked FROM ({RESULTS})")
def select_except_best(spark: SparkSession, d: str) -> DataFrame:
    return res.check(results(spark, d), "except_best").select("group_id", "path", "checked")


@query(f"SELECT group_id, path, NOT checked AS checked FROM ({CHECKED})")
def invert_selection(spark: SparkSession, d: str) -> DataFrame:
    return res.check(_checked(spark, d), "invert").select("group_id", "path", "checked")


@query(f"SELECT group_id, CASE WHEN sum(checked::INT) = 0 THEN 'none' WHEN sum(checked::INT) = count(*) THEN 'all' ELSE 'partial' END AS state FROM ({CHECKED}) GROUP BY group_id")
def check_rollup(spark: SparkSession, d: str) -> DataFrame:
    return res.check_rollup(_checked(spark, d))


@query(f"SELECT count(DISTINCT group_id) AS groups, count(DISTINCT path) AS files FROM ({CHECKED}) WHERE checked")
def affected_counts(spark: SparkSession, d: str) -> DataFrame:
    return res.affected(_checked(spark, d))


@query(f"""
    WITH c AS ({CHECKED}), b AS (SELECT group_id, min(path) AS target FROM c WHERE is_best GROUP BY group_id)
    SELECT DISTINCT path AS source, target, 'hardlink' AS method FROM c JOIN b USING (group_id) WHERE checked AND NOT is_best AND path <> target""")
def link_plan(spark: SparkSession, d: str) -> DataFrame:
    return res.link_plan(_checked(spark, d))


@query(f"SELECT DISTINCT path AS source, NULL::VARCHAR AS target, 'delete' AS method FROM ({CHECKED}) WHERE checked")
def delete_plan(spark: SparkSession, d: str) -> DataFrame:
    return res.delete_plan(_checked(spark, d))


GONE = f"SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM ({CHECKED}) WHERE lower(translate(path, '\\', '/')) NOT IN (SELECT lower(translate(path, '\\', '/')) FROM ({CHECKED}) WHERE checked OR (is_best AND group_id % 3 = 0))"


@query(f"SELECT group_id, path, position = 1 AS is_best FROM ({ORDERED.format(t=GONE)}) WHERE n >= 2")
def remove_paths_promote(spark: SparkSession, d: str) -> DataFrame:
    c = _checked(spark, d)
    gone = c.where(F.col("checked") | (F.col("is_best") & (F.col("group_id") % 3 == 0))).select("path")
    return res.remove_paths(c, gone).select("group_id", "path", "is_best")


@query(f"SELECT group_id, ((position - 1) // 50)::INT AS page, (position - 1) % 50 AS place, path FROM ({ORDERED.format(t=RESULTS)}) WHERE position <= 200")
def report_pages(spark: SparkSession, d: str) -> DataFrame:
    return res.report_pages(results(spark, d))


@query(f"SELECT group_id, arg_max(path, (is_best::INT, distance, path)) AS best, (count(*) - sum(is_best::INT))::BIGINT AS dups FROM ({RESULTS}) GROUP BY group_id")
def group_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    return res.reconstruct_groups(results(spark, d)).select("group_id", "best", F.size("duplicates").cast("bigint").alias("dups"))


@query(f"SELECT group_id, coalesce(string_agg(path || ' ' || found_by, '; ' ORDER BY distance DESC, path) FILTER (NOT is_best), '') AS duplicates FROM ({RESULTS}) GROUP BY group_id")
def group_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """The nested duplicates of each group, written out in their order."""
    text = F.transform("duplicates", lambda x: F.concat(x["path"], F.lit(" "), x["found_by"]))
    return res.reconstruct_groups(results(spark, d)).select("group_id", F.array_join(text, "; ").alias("duplicates"))


@query("""
    SELECT event_type, sum((value >= 20)::INT)::BIGINT AS ok, sum((value < 20)::INT)::BIGINT AS failed, sum((value IS NULL)::INT)::BIGINT AS not_applicable,
        round(min(value) FILTER (value >= 20), 6) AS min_ms, round(avg(value) FILTER (value >= 20), 6) AS avg_ms, round(max(value) FILTER (value >= 20), 6) AS max_ms, round(sum(value / 1024), 6) AS sum_mb
    FROM events GROUP BY event_type""")
def reader_stats(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return res.reader_stats(read(spark, d, "events"), "event_type", v >= 20, v, v / 1024)


# --- incremental --------------------------------------------------------------------


def _disk(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).select("path", "channel", "mtime", "file_size", "doc_id")


def _cache(spark: SparkSession, d: str) -> DataFrame:
    size = F.when(F.col("doc_id") % 7 == 0, F.col("file_size") + 1).otherwise(F.col("file_size"))
    vector = F.when(F.col("doc_id") % 5 != 0, F.array(F.lit(1.0).cast("float")))
    return _disk(spark, d).where("doc_id % 11 <> 0").select("path", "channel", "mtime", size.alias("file_size"), vector.alias("vector"))


CACHE = f"SELECT path, channel, mtime, CASE WHEN doc_id % 7 = 0 THEN file_size + 1 ELSE file_size END AS file_size, doc_id % 5 <> 0 AS vector FROM ({CATALOG}) WHERE doc_id % 11 <> 0"


@query(f"SELECT d.path, d.mtime, d.file_size FROM ({CATALOG}) d LEFT JOIN ({CACHE}) c USING (path) WHERE c.mtime IS NULL OR c.mtime <> d.mtime OR c.file_size <> d.file_size")
def cache_diff_new(spark: SparkSession, d: str) -> DataFrame:
    return incremental.to_process(_disk(spark, d).select("path", "mtime", "file_size"), _cache(spark, d))


@query(f"SELECT d.path, d.mtime, d.file_size FROM ({CATALOG}) d JOIN ({CACHE}) c USING (path) WHERE c.mtime = d.mtime AND c.file_size = d.file_size AND c.vector")
def cache_hits(spark: SparkSession, d: str) -> DataFrame:
    return incremental.cache_hits(_disk(spark, d).select("path", "mtime", "file_size"), _cache(spark, d))


@query(f"""
    WITH n AS (SELECT path, channel, mtime + 1 AS mtime, file_size FROM ({CATALOG}) WHERE doc_id % 7 = 0 OR doc_id % 11 = 0)
    SELECT path, channel, mtime, file_size FROM ({CACHE}) c WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.path = c.path AND n.channel IS NOT DISTINCT FROM c.channel) UNION ALL SELECT * FROM n""")
def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    fresh = _disk(spark, d).where("doc_id % 7 = 0 OR doc_id % 11 = 0").select("path", "channel", (F.col("mtime") + 1).alias("mtime"), "file_size", F.lit(None).cast("array<float>").alias("vector"))
    return incremental.upsert(_cache(spark, d), fresh).select("path", "channel", "mtime", "file_size")


@query(f"SELECT path, file_size FROM ({CACHE}) WHERE path NOT IN (SELECT path FROM ({CATALOG}) WHERE hash IS NULL OR file_size < 200)")
def delete_paths(spark: SparkSession, d: str) -> DataFrame:
    gone = catalog(spark, d).where("hash IS NULL OR file_size < 200").select("path")
    return incremental.delete_paths(_cache(spark, d), gone).select("path", "file_size")


@query(f"SELECT path, file_size FROM ({CACHE}) WHERE path IN (SELECT path FROM ({CATALOG}) WHERE file_size >= 200)")
def select_paths(spark: SparkSession, d: str) -> DataFrame:
    return incremental.select_paths(_cache(spark, d), catalog(spark, d).where("file_size >= 200").select("path")).select("path", "file_size")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def arrivals(spark: SparkSession, d: str) -> DataFrame:
    return arrivals_by_window(read(spark, d, "events"))
