"""Problem 8: statistics of a text that tell running prose from lists, tables and junk.

Method: robust Mahalanobis distance. A text is divided into passages of some
thirty to sixty words (neighbouring lines of one kind joined, long lines cut). Each passage has a
vector of statistics, among them the word count of its text. For every language the mean and covariance of prose are
estimated robustly from all passages: median and median deviation first, then concentration
steps that keep what lies within a quantile of the chi-square distribution.
The squared distance of a passage from the prose of its language is the sum of one
contribution for each statistic. A text whose passages outside the prose cutoff
hold over half of its characters is no running prose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize
from .text_scan import LEAST_WORDS, Lexicon, chunks, passage_counts, passages

__all__ = ["STATS", "fit_prose", "judged_passages", "not_prose", "passages", "text_quality"]

STATS = ["log_word_count", "mean_word_length", "symbol_share", "closed_line_share", "common_share", "clause_share", "digit_share", "distinct_share", "listed_share"]
#: variance added to each statistic. For most a little, so that one that hardly varies in prose does not decide alone;
#: for word count and closed lines as much as their whole range gives, as prose may have any length, lack closing punctuation or be wrapped
FLOOR = [8.0, 1e-2, 1e-5, 1.0, 1e-4, 1e-4, 1e-5, 1e-4, 1e-2]
#: what a text's own shares are made of; sums over its passages
COUNTS = ["words", "common", "clause", "letters", "signs", "digits", "solid", "fresh", "own_listed", "own_closed", "own_lines"]
SHARES = {
    "mean_word_length": ("letters", "words"), "symbol_share": ("signs", "solid"), "closed_line_share": ("own_closed", "own_lines"), "common_share": ("common", "words"),
    "clause_share": ("clause", "words"), "digit_share": ("digits", "solid"), "distinct_share": ("fresh", "words"), "listed_share": ("own_listed", "own_lines"),
}
STEPS = 5
#: chi-square with nine degrees of freedom: its 0.99 quantile, and one beyond which 1.1e-7 lies
KEEP, CUTOFF = 21.67, 50.0
LEAST_PASSAGES = 60
#: Common words that join names in lists as they do in sentences; the other common words show a clause.
JOINING = {
    "en": "the a an and on with for of or",
    "de": "der die das den dem des ein eine und oder auf mit für von",
    "fr": "le la les un une des du de et ou sur avec pour",
    "es": "el la los las un una y o sobre con para de del",
}


def _statistics(of: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    n, solid = np.maximum(of["words"], 1), np.maximum(of["solid"], 1)
    whole = np.bincount(of["text"], weights=of["words"], minlength=1)
    return {
        "log_word_count": np.log1p(whole)[of["text"]], "mean_word_length": np.minimum(30.0, of["letters"] / n), "symbol_share": of["signs"] / solid,
        "closed_line_share": of["closed"] / np.maximum(of["lines"], 1), "common_share": of["common"] / n, "clause_share": of["clause"] / n,
        "digit_share": of["digits"] / solid, "distinct_share": of["distinct"] / n, "listed_share": of["listed"] / np.maximum(of["lines"], 1),
    }


UNIT_SCHEMA = "doc_id bigint, lang string, chars bigint, " + ", ".join([*(f"{s} double" for s in STATS), *(f"{c} bigint" for c in COUNTS)])


def _language(col: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(col, F.lit("")), r"^\s*([A-Za-z]{2})", 1))


def passage_stats(documents: DataFrame, common_words: dict[str, frozenset[str]]) -> DataFrame:
    """One row for each passage of each text with its language, size and statistics."""
    lexicon = Lexicon.of(common_words, {c: frozenset(w.split()) for c, w in JOINING.items()})
    names = np.array(lexicon.languages, dtype=object)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            texts, declared = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for first, last in chunks(texts):
                of = passage_counts(texts[first:last], declared[first:last], lexicon)
                said = names[of["language"]] if len(names) else np.array(declared[first:last], dtype=object)[of["text"]]
                values = _statistics(of)
                cols = [pa.array(ids[first:last][of["text"]], pa.int64()), pa.array(said, pa.string()), pa.array(of["chars"], pa.int64())]
                cols += [pa.array(values[x], pa.float64()) for x in STATS] + [pa.array(of[x], pa.int64()) for x in COUNTS]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang", "chars", *STATS, *COUNTS])

    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", _language(F.col("lang")).alias("lang"))
    return texts.mapInArrow(stats, UNIT_SCHEMA)


class ProseModel:
    """Mean and inverse covariance of prose statistics for each language; '' stands for all languages together."""

    def __init__(self, parts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.parts = parts

    def contributions(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Languages, statistics and the contribution of each statistic to the squared distance.

        Short passages weigh less, as their shares scatter more.
        """
        x = np.stack([batch.column(s).to_numpy(zero_copy_only=False) for s in STATS], axis=1)
        coded = batch.column("lang").fill_null("").dictionary_encode()
        names, lang = np.array(coded.dictionary.to_pylist(), dtype=object), coded.indices.to_numpy()
        size = np.maximum(batch.column("words").to_numpy(), batch.column("chars").to_numpy() / 8)
        out = np.zeros_like(x)
        for i, code in enumerate(names):
            at = lang == i
            mean, inv = self.parts.get(code) or self.parts.get("") or (np.zeros(len(STATS)), np.eye(len(STATS)))
            z = x[at] - mean
            out[at] = z * (z @ inv)
        return names[lang], x, out * np.sqrt(np.minimum(1.0, size / LEAST_WORDS))[:, None]


def _start(full: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Median and median deviation of each language, and of all together."""
    middle = [F.percentile_approx(s, 0.5, 1000).alias(s) for s in STATS]
    med = full.rollup("lang").agg(F.grouping("lang").alias("whole"), F.count("*").alias("n"), *middle).collect()
    if not med or not any(r["n"] for r in med):
        return {}
    rows = [(r["lang"], *(float(r[s]) for s in STATS)) for r in med if not r["whole"]]
    centre = full.sparkSession.createDataFrame(rows, "lang string, " + ", ".join(f"m_{s} double" for s in STATS))  # one row a language
    off = full.join(F.broadcast(centre), "lang").select("lang", *(F.abs(F.col(s) - F.col(f"m_{s}")).alias(s) for s in STATS))
    dev = {("" if r["whole"] else r["lang"]): r for r in off.rollup("lang").agg(F.grouping("lang").alias("whole"), *middle).collect()}
    out = {}
    for r in med:
        code = "" if r["whole"] else r["lang"]
        if r["whole"] or r["n"] >= LEAST_PASSAGES:
            spread = np.array([1.4826 * dev[code][s] for s in STATS])
            out[code] = (np.array([float(r[s]) for s in STATS]), np.diag(1 / (spread**2 + FLOOR)))
    return out


def fit_prose(units: DataFrame) -> ProseModel:
    """Concentration steps over all passages of at least half the least length, by language.

    Only counts, sums and cross products (some forty numbers a language) come to the driver.
    A language with few passages uses the model of all languages.
    """
    full = units.where(F.col("words") >= LEAST_WORDS // 2).select("lang", "chars", "words", *STATS)
    k = len(STATS)
    parts = _start(full)
    upper = np.triu_indices(k)
    for _ in range(STEPS if parts else 0):
        model = ProseModel(parts)

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                lang, x, part = model.contributions(b)
                near = part.sum(axis=1) <= KEEP
                for code in set(lang[near].tolist()):
                    y = x[near & (lang == code)]
                    new = np.concatenate([[len(y)], y.sum(axis=0), (y.T @ y)[upper]])
                    sums[code] = sums.get(code, 0) + new
            codes = [c for c, v in sums.items() for _ in v]
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes, pa.string()), pa.array([i for v in sums.values() for i in range(len(v))], pa.int32()), pa.array([float(z) for v in sums.values() for z in v], pa.float64())],
                names=["lang", "i", "v"],
            )

        rows = full.mapInArrow(moments, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v")).collect()
        by_lang: dict[str, np.ndarray] = {}
        for r in rows:
            by_lang.setdefault(r["lang"], np.zeros(1 + k + len(upper[0])))[r["i"]] = r["v"]
        if by_lang:
            by_lang[""] = sum(by_lang.values())
        new = {}
        for code, v in by_lang.items():
            if code not in parts or v[0] < LEAST_PASSAGES // 2:
                continue
            mean = v[1 : k + 1] / v[0]
            cov = np.zeros((k, k))
            cov[upper] = v[k + 1 :] / v[0]
            cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
            new[code] = (mean, np.linalg.inv(1.15 * cov + np.diag(FLOOR)))
        parts = {**parts, **new}
    return ProseModel(parts)


def _common(common_words: DataFrame, most: int = 100_000) -> dict[str, frozenset[str]]:
    rows = common_words.where(F.col("lang").isNotNull() & F.col("word").isNotNull()).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} common words; this list is a small fixed table")
    out: dict[str, set[str]] = {}
    for r in rows:
        out.setdefault(r["lang"].strip().lower(), set()).add(r["word"].lower())
    return {k: frozenset(v) for k, v in sorted(out.items())}


def judged_passages(documents: DataFrame, common_words: DataFrame, kept: tuple[str, ...] = ("doc_id", "lang", "chars", *COUNTS)) -> DataFrame:
    """Passages with the ``kept`` columns, ``distance`` (squared), one ``by_...`` contribution a statistic, and ``outlying``."""
    units = materialize(passage_stats(documents, _common(common_words)), "passages")
    model = fit_prose(units)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, part = model.contributions(b)
            extra = [pa.array(part.sum(axis=1)), *(pa.array(np.ascontiguousarray(part[:, i])) for i in range(len(STATS)))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *extra], names=[*kept, "distance", *(f"by_{x}" for x in STATS)])

    schema = ", ".join([x for x in UNIT_SCHEMA.split(", ") if x.split()[0] in kept] + ["distance double", *(f"by_{x} double" for x in STATS)])
    needed = dict.fromkeys([*kept, "lang", "chars", "words", *STATS])
    return units.select(*needed).mapInArrow(judge, schema).withColumn("outlying", F.col("distance") > CUTOFF)


def text_quality(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """One row a document: its statistics, distance, contributions, ``odd_share`` and ``is_prose``.

    Statistics are those of the whole text: words by words, signs and digits by its
    solid characters, list items by lines; a share of nothing is null.
    ``odd_share`` is the share of its characters in outlying passages; distance
    and contributions are means over its passages weighted by characters. A null or
    blank text has no passages: counts 0, shares null, not prose. Rows without an id are left out.
    """
    by_doc = judged_passages(documents, common_words)
    weighted = [(F.sum(F.col(c) * F.col("chars")) / F.sum("chars")).alias(c) for c in ["distance", *(f"by_{s}" for s in STATS)]]
    shares = [(F.sum(n) / F.when(F.sum(of) > 0, F.sum(of))).alias(s) for s, (n, of) in SHARES.items()]
    agg = by_doc.groupBy("doc_id").agg(
        F.sum("words").alias("word_count"), F.log1p(F.sum("words")).alias("log_word_count"), *shares, *weighted, (F.sum(F.when(F.col("outlying"), F.col("chars")).otherwise(0)) / F.sum("chars")).alias("odd_share")
    )
    return (
        documents.where(F.col("doc_id").isNotNull()).select("doc_id")
        .join(agg, "doc_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("word_count", "log_word_count")})
        .withColumn("is_prose", F.coalesce(F.col("odd_share") <= 0.5, F.lit(False)))
    )


def not_prose(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """``doc_id`` of each document that is no running prose."""
    odd = (
        judged_passages(documents, common_words, ("doc_id", "chars"))
        .groupBy("doc_id")
        .agg((F.sum(F.when(F.col("outlying"), F.col("chars")).otherwise(0)) / F.sum("chars")).alias("odd_share"))
        .where(F.col("odd_share") <= 0.5)
        .select("doc_id")
    )
    return documents.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().join(odd, "doc_id", "left_anti")
