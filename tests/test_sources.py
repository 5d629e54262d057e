import struct

import numpy as np
import pytest

from silvaspark.sources import points as S
from silvaspark.sources.config import Config

PTS = np.array([[1.25, -2.5, 0.125], [0.5, 0.25, 3.0], [-7.0, 8.0, 9.0], [0.001, 0.002, 0.003]])


def got(df):
    return sorted((round(r.x, 6), round(r.y, 6), round(r.z, 6)) for r in df.collect())


WANT = sorted(tuple(map(float, p)) for p in PTS.tolist())


def las(minor, fmt, extra=0, pts=PTS, cut=0, **broken):
    offset, scale = (500000.0, 4400000.0, 100.0), 0.001
    head = {4: 375, 3: 235}.get(minor, 227)
    length = S.LAS_LENGTH[fmt if fmt < 11 else 6] + extra
    h = bytearray(head)
    h[:4] = broken.get("sign", b"LASF")
    h[24], h[25] = 1, minor
    struct.pack_into("<HI", h, 94, head, head)
    h[104] = broken.get("fmt_byte", fmt)
    struct.pack_into("<HI", h, 105, broken.get("length", length), len(pts) if fmt < 6 else 0)
    struct.pack_into("<6d", h, 131, scale, scale, scale, *offset)
    if minor == 4:
        struct.pack_into("<Q", h, 247, len(pts))
    body = b"".join(struct.pack("<3i", *np.round(p / scale).astype(int)).ljust(length, b"\0") for p in pts)
    data = bytes(h) + body
    return (data[:-cut] if cut else data), np.array(offset)


def test_ascii(spark, tmp_path):
    f = tmp_path / "a.xyz"
    f.write_text("# comment\nx y z\n1.25,-2.5,0.125\n0.5 0.25 3.0 77 88\n\n-7;8;9\n0.001\t0.002\t0.003\nbad 1 2\n")
    points, skipped = S.read_points(spark, str(f))
    assert got(points) == WANT
    assert [r.n for r in skipped.collect()] == [3]


@pytest.mark.parametrize("minor,fmt,extra", [(0, 0, 0), (2, 3, 6), (3, 5, 0), (4, 6, 6), (4, 10, 0)])
def test_las(spark, tmp_path, minor, fmt, extra):
    data, offset = las(minor, fmt, extra)
    f = tmp_path / "a.LAS"
    f.write_bytes(data)
    rows = sorted((r.x, r.y, r.z) for r in S.read_points(spark, str(f))[0].collect())
    assert np.allclose(rows, sorted(map(tuple, PTS + offset)), atol=5e-4)


@pytest.mark.parametrize("kw,why", [
    ({"minor": 2, "fmt": 6}, "does not exist"), ({"minor": 4, "fmt": 11}, "does not exist"), ({"minor": 2, "fmt": 0, "fmt_byte": 0x80}, "compressed"),
    ({"minor": 2, "fmt": 0, "cut": 5}, "cut off"), ({"minor": 2, "fmt": 0, "sign": b"XXXX"}, "signature"), ({"minor": 2, "fmt": 3, "length": 30}, "record length"),
])
def test_bad_las(spark, tmp_path, kw, why):
    f = tmp_path / "b.las"
    f.write_bytes(las(**kw)[0])
    with pytest.raises(S.PointFormatError, match=why):
        S.read_points(spark, str(f))


def lzf_literal(data: bytes) -> bytes:
    return b"".join(bytes([len(data[k : k + 32]) - 1]) + data[k : k + 32] for k in range(0, len(data), 32))


def test_lzf_copies():
    assert S.lzf_decompress(b"\x00a" + bytes([(3 << 5), 0]), 6) == b"aaaaaa"


@pytest.mark.parametrize("kind", ["ascii", "binary", "binary_compressed"])
def test_pcd(spark, tmp_path, kind):
    f = tmp_path / "a.pcd"
    head = f"# .PCD\nVERSION 0.7\nFIELDS intensity x y z\nSIZE 4 8 8 8\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH 4\nHEIGHT 1\nPOINTS 4\nDATA {kind}\n".encode()
    rec = np.zeros(4, np.dtype([("i", "<f4"), ("x", "<f8"), ("y", "<f8"), ("z", "<f8")]))
    rec["x"], rec["y"], rec["z"] = PTS.T
    if kind == "ascii":
        body = "\n".join(f"0 {x!r} {y!r} {z!r}" for x, y, z in PTS.tolist()).encode() + b"\n"
    elif kind == "binary":
        body = rec.tobytes()
    else:
        raw = b"".join(rec[c].tobytes() for c in rec.dtype.names)
        body = struct.pack("<II", len(lzf_literal(raw)), len(raw)) + lzf_literal(raw)
    f.write_bytes(head + body)
    assert got(S.read_points(spark, str(f))[0]) == WANT


@pytest.mark.parametrize("kind,eol", [("ascii", "\n"), ("binary_little_endian", "\r\n"), ("binary_big_endian", "\n")])
def test_ply(spark, tmp_path, kind, eol):
    f = tmp_path / "a.ply"
    head = eol.join(["ply", f"format {kind} 1.0", "element vertex 5", "property double x", "property double y", "property double z", "property uchar red", "end_header", ""]).encode()
    rows = np.vstack([PTS, [np.nan, 0, 0]])
    if kind == "ascii":
        body = "\n".join(f"{x!r} {y!r} {z!r} 7" for x, y, z in rows.tolist()).encode()
    else:
        o = ">" if "big" in kind else "<"
        rec = np.zeros(5, np.dtype([(c, o + "f8") for c in "xyz"] + [("r", "u1")]))
        rec["x"], rec["y"], rec["z"] = rows.T
        body = rec.tobytes()
    f.write_bytes(head + body)
    points, skipped = S.read_points(spark, str(f))
    assert got(points) == WANT and [r.n for r in skipped.collect()] == [1]


def test_unknown(spark):
    for name, why in (("a.laz", "decompress"), ("a.foo", "unknown extension")):
        with pytest.raises(S.PointFormatError, match=why):
            S.read_points(spark, name)


def test_config_round_trip():
    c = Config.load("[scanner]\nx0=1.5 # place\n[dtm]\nslope_filter=no\n", ["--cylinder.min_points=12"])
    assert c.scanner.position_given and not c.dtm.slope_filter and c.cylinder.min_points == 12
    assert Config.load(c.dump()) == c and Config.load(Config().dump()) == Config()
    for bad in (["--a.b=1"], ["--dtm.cell=x"], ["--dtm.slope_filter=maybe"], ["--dtm.cell"]):
        with pytest.raises(ValueError):
            Config.load("", bad)
