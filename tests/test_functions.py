"""Scalar functions against Python."""

import os
import uuid
from pathlib import PurePosixPath

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumatrace.functions import display, hashing, paths, pixels
from lumatrace.functions import vectors as vec
from lumatrace.plans.config import ScanConfig, choose_mode, migrate, plan


def test_hash_expressions(spark):
    bits = [bool(i % 3 == 0) for i in range(64)]
    r = spark.createDataFrame([(b"abc", bits, 5, -1, "/a/b.png", "R")], "c binary, bits array<boolean>, x bigint, y bigint, p string, ch string").select(
        hashing.xxh64_hex("c").alias("xx"), hashing.pack_bits(F.col("bits")).alias("h"), hashing.hamming(F.col("x"), F.col("y")).alias("d"), hashing.vector_id(F.col("p"), F.col("ch")).alias("id"),
        F.transform(hashing.bands(F.col("y")), lambda b: b["key"]).alias("keys"),
    ).first()
    assert r.xx == "44bc2cf5ad770999"
    want = int("".join("1" if b else "0" for b in bits), 2)
    assert r.h & (1 << 64) - 1 == want
    assert r.d == 62 and list(r["keys"]) == [65535] * 4
    assert r.id == str(uuid.uuid5(uuid.NAMESPACE_URL, "/a/b.pngR"))


def test_every_uuid_variant(spark):
    names = [f"n{i}é" for i in range(200)]
    got = [r.u for r in spark.createDataFrame([(n,) for n in names], "n string").select(hashing.uuid5_url(F.col("n")).alias("u")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_paths(spark):
    names = ["/a/b.c/d.tar.GZ", "x", "/n/.hidden", "/q/a_b.PNG", "/e/", "/u/ü.jpg"]
    p = F.col("p")
    rows = spark.createDataFrame([(n,) for n in names], "p string").select("p", paths.file_name(p).alias("n"), paths.stem(p).alias("s"), paths.suffix(p).alias("x")).collect()
    for r in rows:
        if not r.p.endswith("/"):
            q = PurePosixPath(r.p)
            assert (r.n, r.s, r.x) == (q.name, q.stem, q.suffix.lower())


@pytest.mark.parametrize("stems,want", [(["tree_01", "tree_02"], "tree"), (["tree", "treehouse"], "tree"), (["abc", "abd"], "ab"), (["a-b c1", "a-b c2"], "a-b"), (["one"], "one"), (["x", "y"], ""), (["same", "same"], "same")])
def test_common_base_name(spark, stems, want):
    assert spark.createDataFrame([(stems,)], "s array<string>").select(paths.common_base_name(F.col("s")).alias("b")).first().b == want


def test_scores(spark):
    rows = [("AI", 0.92), ("AI", 0.0), ("AI", 1.7), ("pHash", 0.3), ("AI", 0.151)]
    got = [r.s for r in spark.createDataFrame(rows, "m string, d double").select(display.score(F.col("m"), F.col("d")).alias("s")).collect()]
    assert got == [8, 100, 0, 100, 84]


def test_vectors(spark):
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>").select(vec.l2_normalize(F.col("a")).alias("n"), vec.l2_normalize(F.col("z")).alias("z"), vec.cosine_distance(F.col("a"), F.col("a")).alias("d")).first()
    assert list(r.n) == [0.6, 0.8] and list(r.z) == [0.0, 0.0] and r.d == 0.0


def test_perceptual_hashes_hold_under_small_changes():
    rng = np.random.default_rng(0)
    base = pixels.resize_mean(rng.random((12, 12)) * 255, 128, 128)
    small = pixels.resize_mean(base, 64, 64)
    other = pixels.resize_mean(rng.random((12, 12)) * 255, 128, 128)
    for f in (pixels.dhash, pixels.phash, pixels.whash):
        near = ((f(base) ^ f(small)) & (1 << 64) - 1).bit_count()
        far = ((f(base) ^ f(other)) & (1 << 64) - 1).bit_count()
        assert near <= 8 < far


def test_pixel_rules():
    assert pixels.is_solid(np.full((4, 4), 2)) and pixels.is_solid(np.full((4, 4), 255))
    low = np.zeros((20, 20))
    low[0, 0] = 255
    assert pixels.is_solid(low) and not pixels.is_solid(np.arange(256).reshape(16, 16))
    rgba = np.zeros((2, 2, 4), np.uint8)
    rgba[..., 3] = 255
    assert pixels.resolve_alpha(rgba).shape[-1] == 3
    glow = np.array([[[10, 200, 3, 0]]], np.uint8)
    assert pixels.resolve_alpha(glow)[0, 0, 3] == 200
    mask = np.array([[[0, 0, 0, 77], [0, 0, 0, 0]]], np.uint8)
    assert pixels.resolve_alpha(mask)[0, 0].tolist() == [77, 77, 77, 77]
    half = np.array([[[50, 20, 0, 128], [1, 1, 1, 255]]], np.uint8)
    assert pixels.resolve_alpha(half)[0, 0, 0] == int(50 * 255 / 128)
    assert pixels.tonemap(np.array([-1.0, 0.0, 100.0])).tolist()[:2] == [0, 0]


def test_config():
    with pytest.raises(ValueError):
        ScanConfig("").validate()
    with pytest.raises(ValueError):
        ScanConfig("/a", mode="text_search", query=" ").validate()
    assert choose_mode("cat", "s.png") == "sample_search" and choose_mode("cat") == "text_search" and choose_mode("cat", model_has_text=False) == "duplicates"
    names = [n for n, _ in plan(ScanConfig("/a", find_exact=False, use_ai=True))]
    assert names == ["discover", "items", "perceptual", "embed", "index", "link", "cluster"]
    assert abs(sum(w for _, w in plan(ScanConfig("/a"))) - 1) < 1e-5
    assert migrate({"threshold": 90, "junk": 1, "exclude": ["x"]}) == {"similarity": 90, "excluded": ("x",)}


def test_nothing_outside_imports_the_training_package():
    root = os.path.join(os.path.dirname(__file__), "..", "lumatrace")
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    text = open(os.path.join(folder, n)).read()
                    assert "import llm" not in text and "lumatrace.llm" not in text and "from .llm" not in text and "..llm" not in text
