"""Packed pictures: containers, decoding, damaged files."""
import os
import struct
import tempfile
import zlib

import numpy as np
import pytest

from recsmith.sources import pictures as PX


def pgm(p):
    h, w, c = p.shape
    return b"P%d\n# made here\n%d %d\n255\n" % (5 if c == 1 else 6, w, h) + p.astype(np.uint8).tobytes()


def png(p, kinds=(0,), colour=None):
    """A PNG whose lines are stored with the given kinds of differences in turn."""
    h, w, c = p.shape
    known, body = np.zeros((h + 1, w * c), int), b""
    known[1:] = p.reshape(h, w * c)
    for y in range(h):
        kind, now, up = kinds[y % len(kinds)], known[y + 1], known[y]
        left = np.concatenate([np.zeros(c, int), now[:-c]])
        corner = np.concatenate([np.zeros(c, int), up[:-c]])
        near = left + up - corner
        d = np.stack([abs(near - left), abs(near - up), abs(near - corner)])
        paeth = np.choose(d.argmin(0), [left, up, corner])
        guess = [0 * now, left, up, (left + up) // 2, paeth][kind]
        body += bytes([kind]) + ((now - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[c] if colour is None else colour
    z = zlib.compress(body)
    return (PX._PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"tEXt", b"a\0b")
            + chunk(b"IDAT", z[:7]) + chunk(b"IDAT", z[7:]) + chunk(b"IEND", b""))


@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 1), (6, 3, 3), (4, 4, 2), (9, 5, 4)])
def test_pixels(shape):
    p = np.random.default_rng(sum(shape)).integers(0, 256, shape)
    for kinds in ((0,), (1,), (2,), (3,), (4,), (4, 1, 3, 2, 0)):
        assert (PX.pixels(png(p, kinds)) == p).all()
    if shape[2] in (1, 3):
        assert (PX.pixels(pgm(p)) == p).all()


def test_damaged_pictures_are_rows_with_a_reason(spark):
    p = np.random.default_rng(1).integers(0, 256, (8, 8, 3))
    whole = png(p)
    bad = {"cut": whole[:-20], "flip": whole[:60] + bytes([whole[60] ^ 1]) + whole[61:], "pgm": pgm(p)[:-5], "head": b"P5 x", "none": None, "empty": b"",
           "gif": b"GIF89a...", "kind": png(p, colour=3), "levels": pgm(p).replace(b"255", b"99", 1), "zero": b"P5\n0 0\n255\n"}
    rows = [(k, v, 1) for k, v in bad.items()] + [("ok", whole, 1), ("same", pgm(p), 1)]
    df = spark.createDataFrame(rows, "pic_id string, content binary, width int").repartition(3)
    got = {r.pic_id: r for r in PX.decode(df, cells=2).collect()}
    assert all(got[k].error and got[k].width is None and got[k].grid is None for k in bad) and len(got) == len(rows)
    assert got["ok"].error is None and (got["ok"].width, got["ok"].height, got["ok"].channels) == (8, 8, 3)
    assert np.allclose(got["ok"].means, p.mean((0, 1))) and got["ok"].means == got["same"].means
    grey = p.mean(2) / 255
    assert np.allclose(got["ok"].grid, [grey[a:a + 4, b:b + 4].mean() for a in (0, 4) for b in (0, 4)])


def test_folder_is_packed_and_read_without_it(spark):
    d = tempfile.mkdtemp(prefix="pics-")
    os.makedirs(f"{d}/in/sub")
    p = np.arange(64).reshape(8, 8, 1)
    for i in range(30):
        with open(f"{d}/in/{'sub/' if i % 2 else ''}p{i}.pgm", "wb") as f:
            f.write(pgm(p + i) if i != 7 else b"P5 broken")
    PX.pack(PX.list_files(spark, f"{d}/in"), f"{d}/out", per_file=4)
    files = [n for n in os.listdir(f"{d}/out") if n.endswith(".parquet")]
    assert 8 <= len(files) < 30
    assert PX.scan(spark, f"{d}/out").count() == 30
    wanted = spark.createDataFrame([("p3",), ("p7",), ("p3",), ("absent",)], "pic_id string")
    got = {r.pic_id: r for r in PX.decode(PX.scan(spark, f"{d}/out", wanted)).collect()}
    assert set(got) == {"p3", "p7", "absent"} and got["absent"].error == "no bytes" and got["p7"].error == "damaged header"
    assert got["p3"].means == [p.mean() + 3]
    none = spark.createDataFrame([], "pic_id string, content binary")
    PX.pack(none, f"{d}/none")
    assert PX.decode(PX.scan(spark, f"{d}/none")).count() == 0
