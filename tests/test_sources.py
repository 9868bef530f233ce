"""Files, headers, textures, stored tables and streams."""

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from lumatrace.functions import pixels
from lumatrace.sources import dds, files, metadata, tables
from lumatrace.streaming import discovery


def png(pixels_):
    h, w, c = pixels_.shape
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    raw = b"".join(b"\0" + pixels_[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6 if c == 4 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def texture(fmt, w, h, body, mips=1, masks=None):
    pf = struct.pack("<II4sIIIII", 32, 4, b"DX10", 0, 0, 0, 0, 0) if masks is None else struct.pack("<IIIIIIII", 32, masks[4], 0, masks[0], *masks[1:4], masks[5])
    head = b"DDS " + struct.pack("<IIIIIII", 124, 0x1007, h, w, 0, 0, mips) + b"\0" * 44 + pf + struct.pack("<IIIII", 0x1000, 0, 0, 0, 0)
    return head + (struct.pack("<IIIII", fmt, 3, 0, 1, 0) if masks is None else b"") + body


def library(root):
    rng = np.random.default_rng(0)
    img = (rng.random((16, 12, 3)) * 255).astype(np.uint8)
    (root / "sub/skip").mkdir(parents=True)
    (root / "a.png").write_bytes(png(img))
    (root / "sub/B.PNG").write_bytes(png(img))
    (root / "sub/c.png").write_bytes(png(np.dstack([img, img[..., :1]])))
    (root / "sub/skip/d.png").write_bytes(png(img))
    (root / "note.txt").write_text("no image")
    (root / "bad.jpg").write_bytes(b"\xff\xd8\xff")
    return img


def test_discovery_and_headers(spark, tmp_path):
    library(tmp_path)
    rows = files.discover(spark, str(tmp_path), excluded=["sub/skip"], content=True)
    meta = {r.path[len(str(tmp_path)) :]: r for r in metadata.image_metadata(rows).collect()}
    assert set(meta) == {"/a.png", "/sub/B.PNG", "/sub/c.png", "/bad.jpg"}
    assert (meta["/a.png"].resolution_w, meta["/a.png"].resolution_h, meta["/a.png"].has_alpha) == (12, 16, False)
    assert meta["/sub/c.png"].has_alpha and meta["/sub/c.png"].format_details == "RGBA"
    assert meta["/bad.jpg"].format_str == "METADATA FAILED" and meta["/bad.jpg"].resolution_w == 0
    listed = [r.path for r in files.listed(files.discover(spark, str(tmp_path))).collect()]
    assert listed == sorted(listed) and len(listed) == 5


def test_headers():
    assert metadata.read_metadata(b"GIF89a" + struct.pack("<HH", 7, 9))["w"] == 7
    assert metadata.read_metadata(b"BM" + b"\0" * 16 + struct.pack("<iiHH", 5, -6, 1, 32) + b"\0" * 8)["h"] == 6
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11" + struct.pack(">BHHB", 8, 3, 4, 3) + b"\0" * 20
    assert (metadata.read_metadata(jpeg)["w"], metadata.read_metadata(jpeg)["h"]) == (4, 3)
    assert metadata.read_metadata(b"")["format"] == "METADATA FAILED"


def test_textures():
    body = np.arange(64, dtype=np.uint8).tobytes()
    h = dds.read_header(texture(29, 4, 4, body, mips=3))
    assert (h["format"], h["mips"], h["alpha"], h["texture_type"]) == ("R8G8B8A8_UNORM_SRGB", 3, True, "2D")
    assert dds.decode(texture(28, 4, 4, body)).shape == (4, 4, 4)
    bgra = dds.decode(texture(87, 1, 1, bytes([1, 2, 3, 4])))
    assert bgra[0, 0].tolist() == [3, 2, 1, 4]
    red = dds.decode(texture(0, 1, 1, struct.pack("<H", 0xF800), masks=(16, 0xF800, 0x7E0, 0x1F, 0x40, 0)))
    assert red[0, 0].tolist() == [255, 0, 0, 255]
    assert dds.decode(texture(28, 4, 4, body + bytes(range(16)), mips=2), mip_level=1)[0, 0].tolist() == [0, 1, 2, 3]
    assert dds.decode(texture(28, 4, 4, body[:10])) is None and dds.decode(texture(71, 4, 4, body)) is None and dds.read_header(b"x") is None
    half = dds.decode(texture(10, 1, 1, np.array([0.5, 1, 2, 0], "<f2").tobytes()))
    assert dds.to_bytes(half)[0, 0].tolist() == [127, 255, 255, 0]
    assert dds.to_bytes(np.array([65535, 257], np.uint16)).tolist() == [255, 1]


def test_image_source_and_hashes(spark, tmp_path):
    img = library(tmp_path)
    row = spark.read.format("image").load(str(tmp_path / "a.png")).select("image.*").first()
    bgr = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels)
    assert (bgr[..., ::-1] == img).all()
    assert pixels.dhash(pixels.luminance(bgr[..., ::-1].astype(float))) == pixels.dhash(pixels.luminance(img.astype(float)))


def test_tables(spark, tmp_path):
    row = ("i", [1.0], "/p", None, None, None, None, None, None, None, None, None, None, None, None, None, None)
    df = spark.createDataFrame([row], tables.FINGERPRINTS)
    tables.create_table(df, str(tmp_path / "t"))
    tables.append_table(df, str(tmp_path / "t"))
    back = tables.with_defaults(tables.read_table(spark, str(tmp_path / "t"), tables.FINGERPRINTS))
    r = back.first()
    assert back.count() == 2 and (r.bit_depth, r.mipmap_count, r.texture_type, r.color_space, r.compression_format) == (8, 1, "2D", "sRGB", "Unknown")
    kv = spark.createDataFrame([("a", b"1"), ("b", b"2")], "key string, data binary")
    put = tables.key_put(kv, spark.createDataFrame([("a", b"9")], kv.schema))
    assert bytes(tables.key_lookup(put, "a").first().data) == b"9" and put.count() == 2


def test_streams(spark, tmp_path):
    lib = tmp_path / "lib"
    lib.mkdir()
    library(lib)
    rows = discovery.stream_files(spark, str(lib), excluded=["sub/skip"], per_batch=2).select("path", F.lit(None).cast("string").alias("channel"), "mtime", "file_size")
    discovery.upsert_stream(rows, str(tmp_path / "table"), str(tmp_path / "check")).awaitTermination()
    last = max(int(p.name[1:]) for p in (tmp_path / "table").iterdir())
    assert last >= 1
    assert spark.read.parquet(str(tmp_path / f"table/v{last}")).count() == 4
