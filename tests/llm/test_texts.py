"""Tokens, packing, mixing and text quality."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumatrace.llm import mixture, packing, text_quality
from lumatrace.llm.tokens import token_count

DOCS = "doc_id bigint, text string, lang string, source string, tokens string, bin string, turn string, name string"
WORDPUNCT = re.compile(r"\w+|[^\w\s]+")


def docs(spark, texts, source="forum", lang="en"):
    rows = [(i, x, lang, source if isinstance(source, str) or source is None else source[i], "t", "b", "u", "n") for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def test_token_counts_are_those_of_the_pattern(spark):
    texts = ["", " \t\n", "a b", "don't!! stop_it", "é²½ 漢字 ١٢٣", "x\u0300y", "a\u2028b\u3000c\x1cd", "——…", "€5 + 3%", "word " * 20_000, "._-" * 5000, None]
    got = [r.n for r in docs(spark, texts).orderBy("doc_id").select(token_count(F.col("text")).alias("n")).collect()]
    assert got == [len(WORDPUNCT.findall(x)) if x else 0 for x in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_packing_places_every_item_once(sizes):
    box, start = packing.sum_of_squares(np.array(sizes, dtype=np.int64), 64)
    level = {}
    for s, b, at in zip(sizes, box.tolist(), start.tolist()):
        assert level.get(b, 0) == at and at + s <= 64
        level[b] = at + s
    assert len(level) <= 2 * -(-sum(sizes) // 64) + 1


def test_only_long_texts_are_divided(spark):
    texts = ["w " * n for n in (0, 1, 511, 512, 513, 1024, 1500)] + [None, "w " * 100, "w " * 100]
    out = packing.pack_documents(docs(spark, texts), per_bin=3).toPandas()
    assert set(out.doc_id[out.pieces > 1]) == {4, 5, 6}
    assert out.groupby("doc_id").tokens.sum().to_dict() == {1: 1, 2: 511, 3: 512, 4: 513, 5: 1024, 6: 1500, 8: 100, 9: 100}
    assert out.groupby("container").tokens.sum().max() <= 512
    for _, g in out.groupby("container"):
        ends = 0
        for s, n in sorted(zip(g.start, g.tokens)):
            assert s == ends
            ends = s + n
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_containers_are_nearly_full(spark, data):
    packed = packing.pack_documents(spark.read.parquet(f"{data}/sf0.01/documents.parquet"))
    assert packing.packing_report(packed).first().fill > 0.97


TARGETS = "source string, target_share double, max_repeats int, tokens string"


def test_mixture_meets_shares_and_caps(spark):
    texts, source = [], []
    for i in range(400):
        texts.append("w " * (50 + i % 90))
        source.append(["asset_notes", "Asset Notes", "wiki", "WIKI ", "cap-tions", None, "other"][i % 7] if i % 40 else "cap-tions")
    targets = spark.createDataFrame([("asset_notes", 0.4, 2, "x"), ("wiki", 0.5, 3, "x"), ("captions", 0.05, 1, "x"), ("manuals", 0.05, 4, "x")], TARGETS)
    plan, pieces, report = mixture.mix(docs(spark, texts, source), targets, block=64)
    rep = {r.source: r for r in report.collect()}
    total = sum(r.tokens for r in rep.values())
    for r in rep.values():
        assert r.short == (r.max_repeats * r.tokens < r.target_share * total)
        assert r.most_uses <= r.max_repeats
        if not r.short:
            assert abs(r.mixed_tokens - r.wanted_tokens) < 0.03 * total
        else:
            assert r.mixed_tokens <= r.max_repeats * r.tokens
    assert rep["manuals"].tokens == 0 and rep["manuals"].short and rep["manuals"].empty_slots > 0
    # every text lies whole in the blocks of its source
    size = {i: len(x.split()) for i, x in enumerate(texts)}
    laid = pieces.groupBy("doc_id").agg(F.sum("tokens").alias("n"), F.min("start").alias("s")).collect()
    assert all(r.n == size[r.doc_id] and r.s == 0 for r in laid)
    assert pieces.groupBy("source", "block").agg(F.sum("tokens").alias("n")).agg(F.max("n")).first()[0] <= 64
    assert plan.groupBy("source", "block", "pass").count().where("count > 1").count() == 0


def test_mixture_of_nothing(spark):
    plan, _, report = mixture.mix(docs(spark, []), spark.createDataFrame([("wiki", 1.0, 2, "x")], TARGETS))
    assert plan.count() == 0 and report.first().mixed_tokens == 0
    _, _, report = mixture.mix(docs(spark, ["a b"]), spark.createDataFrame([], TARGETS))
    assert report.count() == 0


def test_shards_add_up_to_the_totals():
    totals = np.array([1000, 1, 0, 777])
    counts, ends = zip(*(mixture.shard_counts(i, 9, totals, 200, 3) for i in range(9)))
    assert (sum(counts) == totals).all()
    assert all((b == sum(counts[:i], np.zeros(4))).all() for i, b in enumerate(ends))


def test_large_totals_are_divided_in_proportion():
    totals = np.array([3_000_000_000, 1, 0, 2_000_000_000, 40])
    for seed in range(20):
        left = mixture._big_split(np.random.Generator(np.random.PCG64(seed)), totals, 1_250_000_010)
        assert left.sum() == 1_250_000_010 and (left >= 0).all() and (left <= totals).all()
        assert abs(left[0] - 750_000_006) < 200_000 and abs(left[3] - 500_000_004) < 200_000
    counts, before = mixture.shard_counts(5, 500, totals, 10_000_001, 3)
    assert counts.sum() == 10_000_001 and before.sum() == 5 * 10_000_001


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutation(n):
    assert sorted(mixture.permuted(np.arange(n), n, 12345).tolist()) == list(range(n))


PROSE = "We kept the old folder because it is clean and the other one was not, which nobody had expected when they told us. "
SAME = "The colours were fine until the team saved it again, so please do not rename this before you look at what it was. "
WORDS = "common_words"


def test_prose_and_junk(spark, data):
    base = spark.read.parquet(f"{data}/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    extra = [
        (-1, None), (-2, ""), (-3, " \n\t "), (-4, PROSE * 3), (-5, (PROSE + SAME) * 300), (-6, "\n".join(f"D:/assets/a/b{i}.png" for i in range(30))),
        (-7, "| a | b |\n|---|---|\n" + "\n".join(f"| x{i} | {i * 37} |" for i in range(40))), (-8, "=" * 5000), (-9, PROSE.lower().replace(",", "").replace(".", "") * 2),
        (-10, "foliage, moss, atlas, granite, rope, wheel, velvet, fern, " * 6), (-11, PROSE + SAME + "\n\n- a1\n- b2"), (-12, PROSE + "\n" + "\n".join(f"row{i}   {i}x{i}   {i * 991}" for i in range(60))),
        (-13, "the map sign! " * 200), (-14, "\x00\ud7ff" + "€" * 10), (-15, "0.123 -0.53 0.77 0.1\n" * 40),
    ]
    more = spark.createDataFrame([(i, x, None, None) for i, x in extra], base.schema)
    words = spark.read.parquet(f"{data}/sf0.01/{WORDS}.parquet")
    bad = {r.doc_id for r in text_quality.not_prose(base.union(more), words).collect()}
    assert {-1, -2, -3, -6, -7, -8, -10, -12, -13, -14, -15} <= bad
    assert not bad & {-4, -5, -9, -11}
    q = {r.doc_id: r for r in text_quality.text_quality(base.union(more), words).collect()}
    assert {i for i, r in q.items() if not r.is_prose} == bad
    assert q[-4].closed_line_share == 1.0 and q[-1].word_count == 0
    parts = [q[-7][f"by_{s}"] for s in text_quality.STATS]
    assert abs(sum(parts) - q[-7].distance) < 1e-6 * max(1, q[-7].distance)


def test_quality_of_nothing(spark):
    words = spark.createDataFrame([], "lang string, word string")
    assert text_quality.not_prose(docs(spark, []), words).count() == 0
    assert [r.doc_id for r in text_quality.not_prose(docs(spark, [None]), words).collect()] == [0]
    assert text_quality.text_quality(docs(spark, [None, "=="]), words).count() == 2


def test_passages_hold_the_whole_text():
    text = (PROSE * 40 + "\n" + "a b\n" * 50 + "=" * 300 + "\n") * 2
    joined = "".join("".join(text_quality.passages(text)).split())
    assert joined == "".join(text.split())


def test_shares_are_those_of_the_whole_text(spark):
    words = spark.createDataFrame([("en", w) for w in ("we", "the", "it", "is", "and", "was", "not", "when")], "lang string, word string")
    signs, digits = "=" * 3000, "7" * 10
    texts = [signs, PROSE * 3 + "\n" + signs, (PROSE * 8).strip(), "\n".join(f"- {x}" for x in PROSE.split()) + "\n" + "=" * 50, PROSE * 20 + "\n- one\n" + digits]
    q = {r.doc_id: r for r in text_quality.text_quality(docs(spark, texts), words).collect()}
    token = re.compile(r"\w+(?:['’]\w+)?")
    for i, x in enumerate(texts):
        solid, tokens = len("".join(x.split())), token.findall(x.lower())
        assert q[i].symbol_share == pytest.approx(len(re.findall(r"[^\w\s]|_", x)) / solid)
        assert q[i].digit_share == pytest.approx(len(re.findall(r"\d", x)) / solid)
        if not tokens:
            assert q[i].distinct_share is None and q[i].mean_word_length is None
            continue
        assert q[i].distinct_share == pytest.approx(len(set(tokens)) / len(tokens))
        assert q[i].mean_word_length == pytest.approx(sum(map(len, tokens)) / len(tokens))
    assert q[0].symbol_share == 1.0
    assert q[3].listed_share == pytest.approx(len(PROSE.split()) / (len(PROSE.split()) + 1)) and q[4].listed_share == pytest.approx(1 / 3)
