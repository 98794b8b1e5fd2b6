"""Streamed digests, image sizes and copies, and overlaps of boxes."""

import hashlib
import io
import os
import random
import struct
import zlib

import pytest

from terrace.operators import label_overlap
from terrace.sources import streamed


def png(width, height):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IEND", b"")


def jpeg(width, height, before=b""):
    frame = b"\xff\xc2" + struct.pack(">HBHH", 11, 8, height, width) + b"\x01\x01\x11\x00"
    return b"\xff\xd8" + before + frame + b"\xff\xda"


def bmp(width, height):
    return b"BM" + bytes(12) + struct.pack("<Iii", 40, width, height) + bytes(28)


LATE = b"".join(b"\xff\xe1" + struct.pack(">H", 65535) + bytes(65533) for _ in range(40)) + b"\xff\xff"  # 2.6 MB of metadata, then fill
IMAGES = {
    "a.png": (png(300, 200), ("png", 300, 200)), "b.jpg": (jpeg(1200, 300), ("jpeg", 1200, 300)), "late.jpg": (jpeg(7, 9, LATE), ("jpeg", 7, 9)), "c.bmp": (bmp(64, -48), ("bmp", 64, 48)),
    "old.bmp": (b"BM" + bytes(12) + struct.pack("<IHH", 12, 5, 6) + bytes(20), ("bmp", 5, 6)), "d.gif": (b"GIF89a" + struct.pack("<HH", 11, 12), ("gif", 11, 12)),
    "cut.png": (png(300, 200)[:18], None), "cut.jpg": (jpeg(5, 5)[:9], None), "empty.png": (b"", None), "text.png": (b"no image at all", None), "scan.jpg": (b"\xff\xd8\xff\xda" + bytes(20), None), "flat.png": (png(0, 5), None), "zero.jpg": (b"\xff\xd8\xff\xe0\x00\x00" + bytes(9), None),
}


def test_sizes_from_headers(spark, tmp_path):
    folder = tmp_path / "with space é"
    folder.mkdir()
    for name, (data, _) in IMAGES.items():
        (folder / name).write_bytes(data)
    rows = {os.path.basename(r["path"]): r for r in streamed.sizes(streamed.listing(spark, str(tmp_path), ("png", "jpg", "bmp", "gif"))).collect()}
    assert rows.keys() == IMAGES.keys()
    for name, (data, want) in IMAGES.items():
        r = rows[name]
        assert ((r["format"], r["width"], r["height"]) if want else None) == want and (r["error"] is None) == (want is not None), name
        assert r["length"] == len(data)


def test_only_headers_are_read():
    class Counting(io.BytesIO):
        total = 0

        def read(self, n=-1):
            out = super().read(n)
            Counting.total += len(out)
            return out

    assert streamed.image_size(streamed._Bytes(Counting(jpeg(7, 9, LATE)))) == ("jpeg", 7, 9)
    assert Counting.total < 1000


def test_digests_of_files_of_any_length(spark, tmp_path):
    (tmp_path / "small").write_bytes(b"abc")
    (tmp_path / "empty").write_bytes(b"")
    size = (1 << 31) + 5
    with open(tmp_path / "large", "wb") as f:  # over 2 GiB, without taking disk
        f.truncate(size)
    state, left = hashlib.sha256(), size
    while left:
        state.update(bytes(min(left, 1 << 24)))
        left -= min(left, 1 << 24)
    files = streamed.listing(spark, str(tmp_path))
    rows = {os.path.basename(r["path"]): r for r in streamed.digests(files).collect()}
    assert {n: (r["size"], r["sha256"]) for n, r in rows.items()} == {n: (s, d) for n, s, d in (("small", 3, hashlib.sha256(b"abc").hexdigest()), ("empty", 0, hashlib.sha256().hexdigest()), ("large", size, state.hexdigest()))}
    gone = spark.createDataFrame([(f"{tmp_path}/missing", 1)], "path string, length long")
    assert streamed.digests(gone).first()["error"].startswith("FileNotFoundError")


def test_copies_are_verified(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir(), target.mkdir()
    digest = {}
    for n in ("good", "changed", "there", "same"):
        (source / n).write_bytes(n.encode() * 1000)
        digest[n] = hashlib.sha256(n.encode() * 1000).hexdigest()
    (target / "there").write_bytes(b"other")
    (target / "same").write_bytes(b"same" * 1000)
    rows = [(f"file:{source}/{n}", f"{target}/{'deep/' if n == 'good' else ''}{n}", "0" * 64 if n == "changed" else digest[n]) for n in digest] + [(f"{source}/missing", f"{target}/missing", "0" * 64)]
    df = spark.createDataFrame(rows, "path string, target string, content_sha256 string")
    got = {os.path.basename(r["path"]): r["status"] for r in streamed.copied(df).collect()}
    assert got.pop("missing").startswith("FileNotFoundError")
    assert got == {"good": "copied", "changed": "content differs from its digest", "there": "another file is there", "same": "same"}
    assert (target / "deep" / "good").read_bytes() == b"good" * 1000 and (target / "there").read_bytes() == b"other"
    assert sorted(p.name for p in target.rglob("*") if p.is_file()) == ["good", "same", "there"]
    again = {os.path.basename(r["path"]): r["status"] for r in streamed.copied(df).collect()}
    assert again["good"] == "same"


BOX = "image_id long, object_id long, box struct<x1:double,y1:double,x2:double,y2:double>"


def plain_overlaps(rows):
    out = {}
    for i, a, p in rows:
        for j, b, q in rows:
            if i == j and a < b and p and q and min(p[2], p[0]) == p[0]:
                w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
                area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
                if w > 0 and h > 0 and area(p) > 0 and area(q) > 0:
                    out[i, a, b] = w * h / (area(p) + area(q) - w * h)
    return out


@pytest.mark.parametrize("crowd", [2, 64])
def test_overlaps_equal_all_pairs(spark, crowd):
    draw = random.Random(crowd)
    rows = []
    for image in range(3):
        for k in range(120):
            x, y = (draw.uniform(-50, 400), draw.uniform(-50, 400)) if k % 3 else (draw.choice([0.0, 64.0, 128.0, 256.0]), draw.choice([0.0, 128.0]))
            w, h = draw.choice([(3, 3), (10, 8), (64, 64), (300, 5), (128, 128), (0, 5)])
            rows.append((image, k, (x, y, x + w, y + h)))
    rows += [(9, k, (5.0, 5.0, 6.0, 6.0)) for k in range(80)]  # one crowded spot of equal boxes
    rows.append((9, 100, None))
    got = label_overlap.overlaps(spark.createDataFrame(rows, BOX).repartition(4), crowd=crowd).collect()
    found = {(r["image_id"], r["a"], r["b"]): r["iou"] for r in got}
    want = plain_overlaps(rows)
    assert len(found) == len(got) and found.keys() == want.keys()
    assert all(abs(found[k] - want[k]) < 1e-12 for k in want)
