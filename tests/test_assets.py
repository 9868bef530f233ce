"""From files with pixels to hashes, groups and vectors."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumatrace.functions import pixels
from lumatrace.plans import assets, embedding
from lumatrace.plans.config import ScanConfig
from lumatrace.sources import dds, files, metadata, rasters

from .test_sources import png, texture


def picture(seed, side=64):
    """Soft shapes, so that a rescaled copy has nearly the same hashes."""
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:side, 0:side] / side
    planes = [sum(r.normal() * np.cos(np.pi * (i * x + j * y) + r.normal()) for i in range(4) for j in range(4)) for _ in range(3)]
    a = np.stack(planes, axis=-1)
    return ((a - a.min()) / (a.max() - a.min()) * 255).astype(np.uint8)


def library(root):
    (root / "sub").mkdir(parents=True)
    a, b = picture(1), picture(2)
    (root / "a.png").write_bytes(png(a))
    (root / "sub/copy of a.PNG").write_bytes(png(a))
    (root / "a_large.png").write_bytes(png(np.repeat(np.repeat(a, 2, 0), 2, 1)))
    (root / "b.png").write_bytes(png(b))
    flat = b.copy()
    flat[..., 0] = 255
    (root / "solid_red.png").write_bytes(png(flat))
    (root / "cut.png").write_bytes(png(b)[:200])
    bgra = np.concatenate([a[..., ::-1], np.full((64, 64, 1), 255, np.uint8)], axis=-1)
    (root / "a.dds").write_bytes(texture(87, 64, 64, bgra.tobytes()))
    (root / "note.txt").write_text("none")
    return a, b


def scanned(spark, root, **settings):
    out = assets.scan_folder(spark, ScanConfig(str(root), **settings), into=str(root.parent / "results")).collect()
    groups = {}
    for r in out:
        groups.setdefault(r.group_id, {})[r.path[len(str(root)) + 1 :]] = r
    return list(groups.values())


def test_a_folder_is_scanned(spark, tmp_path):
    library(tmp_path / "lib")
    (g,) = scanned(spark, tmp_path / "lib", find_dhash=False, find_phash=False)
    assert {p: r.is_best for p, r in g.items()} == {"a.png": True, "sub/copy of a.PNG": False} and g["sub/copy of a.PNG"].found_by == "xxHash"
    (g,) = scanned(spark, tmp_path / "lib", dhash_bits=4, phash_bits=4)
    # groups are stars: the pivot of the bucket, the texture, is what the largest file is tied to
    assert {p: r.is_best for p, r in g.items()} == {"a_large.png": True, "a.dds": False}
    assert (g["a_large.png"].resolution_w, g["a_large.png"].format_str, g["a.dds"].found_by) == (128, "PNG", "dHash")
    (tmp_path / "lib/a.dds").unlink()
    (g,) = scanned(spark, tmp_path / "lib", dhash_bits=4, phash_bits=4)
    assert set(g) == {"a_large.png", "a.png"}


def test_planes_and_solid_channels(spark, tmp_path):
    a, b = library(tmp_path)
    found = rasters.rasters(spark, str(tmp_path)).collect()
    shape = {r.path[len(str(tmp_path)) + 1 :]: (r.width, r.height) for r in found}
    assert shape == {"a.png": (64, 64), "sub/copy of a.PNG": (64, 64), "a_large.png": (128, 128), "b.png": (64, 64), "solid_red.png": (64, 64), "a.dds": (64, 64)}
    (one,) = [r for r in found if r.path.endswith("/b.png")]
    assert (np.frombuffer(one.data, np.uint8).reshape(64, 64, 4)[..., :3] == b).all()
    items = spark.createDataFrame([(f"{tmp_path}/solid_red.png", t) for t in ("R", "G", "Luminance", "A")] + [(f"{tmp_path}/cut.png", "R"), (None, "R")], "path string, analysis_type string")
    pictures = rasters.rasters(spark, str(tmp_path))
    assert {r.analysis_type for r in rasters.perceptual_hashes(pictures, items).collect()} == {"G", "Luminance"}
    assert {r.analysis_type for r in rasters.perceptual_hashes(pictures, items, ignore_solid=False).collect()} == {"R", "G", "Luminance", "A"}


def test_excluded_folders_and_empty_ones(spark, tmp_path):
    library(tmp_path / "lib")
    kept = rasters.rasters(spark, str(tmp_path / "lib"), ["sub"])
    assert not [r for r in kept.collect() if "/sub/" in r.path]
    (tmp_path / "none").mkdir()
    assert assets.scan_folder(spark, ScanConfig(str(tmp_path / "none"))).count() == 0


def test_block_compression():
    black_white = struct.pack("<HHI", 0xFFFF, 0x0000, 0b11_10_01_00)
    px = dds.decode_blocks(texture(71, 4, 4, black_white))
    assert px[0, :, 0].tolist() == [255, 0, 170, 85] and px[1, 0].tolist() == [255, 255, 255, 255]
    clear = dds.decode_blocks(texture(71, 4, 4, struct.pack("<HHI", 0x0000, 0xFFFF, 0b11_10)))
    assert clear[0, 0].tolist() == [128, 128, 128, 255] and clear[0, 1].tolist() == [0, 0, 0, 0]
    grey = dds.decode_blocks(texture(80, 4, 4, bytes([70, 0, 0b10_001_000, 0, 0, 0, 0, 0])))
    assert grey[0, :3, 0].tolist() == [70, 0, 60]
    both = dds.decode_blocks(texture(77, 4, 4, bytes([255, 255]) + b"\0" * 6 + black_white))
    assert both.shape == (4, 4, 4) and (both[..., 3] == 255).all()
    assert dds.decode_blocks(texture(74, 4, 4, bytes([0x0F] * 8) + black_white))[0, :2, 3].tolist() == [255, 0]
    assert dds.decode_blocks(texture(83, 5, 3, b"\0" * 32)).shape == (3, 5, 2)
    assert dds.decode_blocks(texture(71, 4, 4, black_white * 2, mips=1), array_index=1) is not None
    assert dds.decode_blocks(texture(98, 4, 4, b"\0" * 16)) is None and dds.decode_blocks(texture(71, 4, 4, b"\0")) is None
    assert rasters.decode(texture(83, 4, 4, b"\0" * 16), ".dds").shape == (4, 4, 4)


def fourcc(code, w, h, body):
    head = b"DDS " + struct.pack("<IIIIIII", 124, 0x1007, h, w, 0, 0, 1) + b"\0" * 44 + struct.pack("<II4sIIIII", 32, 4, code, 0, 0, 0, 0, 0)
    return head + struct.pack("<IIIII", 0x1000, 0, 0, 0, 0) + body


@pytest.mark.parametrize("across,down", [(1, 1), (4, 4), (8, 2), (2, 8), (3, 5)])
def test_textures_of_consoles_and_engines(across, down):
    r = np.random.default_rng(across * 10 + down)
    blocks = r.integers(0, 256, size=(down, across, 8), dtype=np.uint8)
    w, h = across * 4, down * 4
    want = dds.decode_blocks(fourcc(b"DXT1", w, h, blocks.tobytes()))
    side = 1 << max(across - 1, down - 1).bit_length()
    mixed = np.zeros((side * side, 8), dtype=np.uint8)
    for y in range(down):
        for x in range(across):
            nx, ny = (across - 1).bit_length(), (down - 1).bit_length()
            bits, at, place = [], 0, 0
            for i in range(max(nx, ny)):
                bits += ([x >> i & 1] if i < nx else []) + ([y >> i & 1] if i < ny else [])
            for place, bit in enumerate(bits):
                at |= bit << place
            mixed[at] = blocks[y, x]
    assert (dds.decode_blocks(dds.standard(fourcc(b"DXT1", w, h, b"CRYF\0\0\0\0" + mixed.tobytes()))) == want).all()
    assert (dds.decode_blocks(dds.standard(fourcc(b"DXT1", w, h, b"FYRC" + blocks.tobytes()))) == want).all()
    turned = blocks.reshape(-1, 8).copy()
    turned[:, :4] = turned[:, [1, 0, 3, 2]]
    assert (dds.decode_blocks(dds.standard(fourcc(b"1TXD", w, h, turned.tobytes()))) == want).all()
    assert (rasters.decode(fourcc(b"1TXD", w, h, turned.tobytes()), ".dds").shape) == (h, w, 4)
    assert metadata.read_metadata(fourcc(b"1TXD", w, h, turned.tobytes()))["compression"] == "BC1_UNORM"


def test_other_decoders():
    head = lambda kind, bits, flags=0x20: bytes([0, 0, kind]) + b"\0" * 9 + struct.pack("<HHBB", 2, 2, bits, flags)
    plain = rasters.read_tga(head(2, 24) + bytes(range(12)))
    assert plain[0, 0].tolist() == [2, 1, 0]
    assert rasters.read_tga(head(2, 24, 0) + bytes(range(12)))[1, 0].tolist() == [2, 1, 0]
    packed = rasters.read_tga(head(10, 24) + bytes([0x82, 1, 2, 3, 0x00, 7, 8, 9]))
    assert packed.reshape(-1, 3).tolist() == [[3, 2, 1]] * 3 + [[9, 8, 7]]
    assert rasters.read_tga(head(10, 24) + b"\x82") is None and rasters.read_tga(b"") is None
    hdr = b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y 1 +X 2\n" + bytes([128, 64, 0, 129, 0, 0, 0, 0])
    assert rasters.read_hdr(hdr)[0].tolist() == [[1.0, 0.5, 0.0], [0.0, 0.0, 0.0]]
    runs = b"#?RGBE\n\n-Y 1 +X 8\n" + bytes([2, 2, 0, 8]) + bytes([136, 128]) * 3 + bytes([136, 129])
    assert (rasters.read_hdr(runs) == 1.0).all() and rasters.read_hdr(runs[:-1]) is None
    assert rasters.decode(hdr, ".hdr").dtype == np.uint8 and rasters.decode(b"#?RGBE", ".hdr") is None


def tiff(order="<", date=b"2024:03:01 10:20:30"):
    mark = b"II*\0" if order == "<" else b"MM\0*"
    tags = [(256, 3, 1, 7), (257, 3, 1, 5), (258, 3, 1, 16), (277, 3, 1, 3), (306, 2, 20, 8 + 2 + 12 * 5 + 4)]
    entry = lambda t, k, n, v: struct.pack(order + "HHI", t, k, n) + (struct.pack(order + "HH", v, 0) if k == 3 else struct.pack(order + "I", v))
    return mark + struct.pack(order + "I", 8) + struct.pack(order + "H", 5) + b"".join(entry(*t) for t in tags) + b"\0" * 4 + date + b"\0"


TAKEN = 1709288430.0


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_and_dates(order):
    m = metadata.read_metadata(tiff(order))
    assert (m["w"], m["h"], m["depth"], m["format"], m["details"], m["taken"]) == (7, 5, 16, "TIFF", "RGB", TAKEN)
    exif = b"Exif\0\0" + tiff(order)
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0\x00\x11" + struct.pack(">BHHB", 8, 3, 4, 3) + b"\0" * 20
    assert metadata.read_metadata(jpeg)["taken"] == TAKEN
    plain = png(picture(0, 4))
    with_date = plain[:33] + struct.pack(">I4s", len(tiff(order)), b"eXIf") + tiff(order) + b"\0" * 4 + plain[33:]
    assert metadata.read_metadata(with_date)["taken"] == TAKEN and metadata.read_metadata(plain)["taken"] is None
    assert metadata.read_metadata(tiff(order, b"0000:00:00 00:00:00"))["taken"] is None


def test_more_headers():
    read = lambda b: (lambda m: (m["format"], m["w"], m["h"]))(metadata.read_metadata(b))
    attribute = lambda n, t, v: n + b"\0" + t + b"\0" + struct.pack("<i", len(v)) + v
    planes = b"".join(c + b"\0" + struct.pack("<iB3xii", 1, 0, 1, 1) for c in (b"A", b"B", b"G", b"R")) + b"\0"
    exr = b"\x76\x2f\x31\x01\x02\0\0\0" + attribute(b"channels", b"chlist", planes) + attribute(b"dataWindow", b"box2i", struct.pack("<4i", 0, 0, 8, 3)) + b"\0"
    assert read(exr) == ("OPENEXR", 9, 4) and metadata.read_metadata(exr)["alpha"] and metadata.read_metadata(exr)["depth"] == 16
    assert read(b"#?RADIANCE\nA=b\n\n-Y 3 +X 5\n") == ("HDR", 5, 3)
    assert read(b"\0\0\0\x18ftypavif\0\0\0\0" + b"\0\0\0\x14ispe\0\0\0\0" + struct.pack(">II", 11, 12)) == ("AVIF", 11, 12)
    assert read(b"\0\0\0\x0cjP  \r\n\x87\n" + b"\0\0\0\x16ihdr" + struct.pack(">IIHB", 6, 8, 4, 7) + b"\0" * 3) == ("JPEG2000", 8, 6)
    assert read(b"\0\0\1\0\1\0\x10\x20\0\0\1\0\x20\0") == ("ICO", 16, 32)
    assert read(b"SDPX" + b"\0" * 768 + struct.pack(">II", 20, 10) + b"\0" * 40) == ("DPX", 20, 10)
    assert read(bytes([0, 0, 2]) + b"\0" * 9 + struct.pack("<HHBB", 2, 3, 24, 0)) == ("TARGA", 2, 3)
    for junk in (b"", b"\0", b"II*\0", b"\x76\x2f\x31\x01", b"hello world, this is no picture at all"):
        assert metadata.read_metadata(junk) == metadata.FAILED


def make_mean():
    return lambda x: x.astype(np.float64).mean(axis=(2, 3)) + 2


def make_broken():
    raise RuntimeError("no model")


def test_vectors_of_pictures(spark, tmp_path):
    library(tmp_path)
    pictures = rasters.rasters(spark, str(tmp_path))
    items = spark.createDataFrame([(f"{tmp_path}/solid_red.png", t) for t in ("R", "Composite")] + [(f"{tmp_path}/a.png", "Composite"), (f"{tmp_path}/cut.png", "Composite")], "path string, analysis_type string")
    prepare = embedding.Preparation(size=8)
    got = {(r.path.rsplit("/", 1)[1], r.analysis_type): r for r in embedding.embed_pictures(pictures, items, "mean", make_mean, prepare, batch=2).collect()}
    assert set(got) == {("solid_red.png", "R"), ("solid_red.png", "Composite"), ("a.png", "Composite")}
    assert got["solid_red.png", "R"].error == "solid channel" and got["solid_red.png", "R"].vector is None
    v = np.array(got["a.png", "Composite"].vector)
    assert np.linalg.norm(v) == pytest.approx(1) and got["a.png", "Composite"].error is None
    failed = embedding.embed_pictures(pictures, items, "broken", make_broken, prepare)
    assert failed.where("vector IS NULL AND error IS NOT NULL").count() == 3 == failed.count()
    meta = metadata.image_metadata(files.discover(spark, str(tmp_path), content=True)).withColumn("channel", F.lit(None).cast("string"))
    rows = embedding.fingerprints(embedding.embed_pictures(pictures, items, "mean", make_mean, prepare), meta).collect()
    assert {(r.path.rsplit("/", 1)[1], r.channel, r.resolution_w) for r in rows} == {("a.png", None, 64), ("solid_red.png", None, 64)}
    assert len({r.id for r in rows}) == 2
    assert np.linalg.norm(embedding.embed_text("ab", lambda t: np.array([[len(t)] * 3] * 3, dtype=float).reshape(3, 3), lambda x: x.reshape(len(x), -1))) == pytest.approx(1)
    assert not embedding.model_ready(str(tmp_path), True)
    (tmp_path / "m_fp16").mkdir()
    (tmp_path / "m_fp16/visual.onnx").write_bytes(b"")
    assert embedding.model_ready(str(tmp_path / "m"), False, "fp16") and not embedding.model_ready(str(tmp_path / "m"), True, "fp16")


def test_pixel_helpers():
    a = picture(3, 8)
    assert (pixels.resize_bilinear(a, 8, 8) == a).all() and pixels.resize_bilinear(a, 4, 2).shape == (2, 4, 3)
    rgba = np.concatenate([a, a[..., :1]], axis=-1)
    assert (pixels.masked(rgba, "G")[..., 0] == a[..., 1]).all()
    assert pixels.masked(rgba, "RB")[0, 0].tolist() == [a[0, 0, 0], 0, a[0, 0, 2], 255]
    assert pixels.unit_rows(np.array([[3.0, 4.0], [0, 0]])).tolist() == [[0.6, 0.8], [0, 0]]
