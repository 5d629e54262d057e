"""The data source of point clouds against the readers of single files, with ranges of a few bytes."""

import struct

import numpy as np
import pytest

from silvaspark.sources import datasource as D
from silvaspark.sources import points as S
from test_sources import las

PTS = np.round(np.random.default_rng(1).uniform(-50, 50, (200, 3)), 3)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("clouds")
    (at / "sub").mkdir()
    text = "\n".join(f"{x!r} {y!r} {z!r}" for x, y, z in PTS.tolist())
    (at / "a.xyz").write_text("# comment\n" + text.replace(" ", ",") + "\n\nword 1 2\r\n")
    head = "ply\nformat {} 1.0\nelement vertex 200\nproperty double x\nproperty double y\nproperty double z\n{}end_header\n"
    (at / "b.ply").write_text(head.format("ascii", "") + text)
    (at / "c.ply").write_text(head.format("ascii", "element face 1\nproperty list uchar int vertex_indices\n") + text + "\n3 0 1 2\n")
    (at / "d.PLY").write_bytes(head.format("binary_big_endian", "").encode() + PTS.astype(">f8").tobytes())
    pcd = "VERSION .7\nFIELDS n x y z\nSIZE 4 8 8 8\nTYPE F F F F\nCOUNT 2 1 1 1\nWIDTH 200\nHEIGHT 1\nPOINTS 200\nDATA ascii\n"
    (at / "sub" / "e.pcd").write_text(pcd + "\n".join(f"0 1 {row}" for row in text.split("\n")) + "\n")
    data, offset = las(2, 0, pts=PTS)
    data = bytearray(data)
    corners = [v + o for c, o in enumerate(offset) for v in (PTS[:, c].max(), PTS[:, c].min())]
    struct.pack_into("<6d", data, 179, *corners)
    (at / "sub" / "f.las").write_bytes(bytes(data))
    (at / "notes.md").write_text("not a cloud")
    return at, offset


@pytest.mark.parametrize("split", [100, 1 << 20])
def test_folder(spark, folder, split):
    at, offset = folder
    points, skipped = D.read_clouds(spark, str(at), split=split)
    rows = points.collect()
    for name in ("a.xyz", "b.ply", "c.ply", "d.PLY", "sub/e.pcd", "sub/f.las"):
        own = sorted((r.pid, r.x, r.y, r.z) for r in rows if r.file.endswith(name))
        assert len({k for k, *_ in own}) == 200 and np.allclose([p[1:] for p in own], PTS + (offset if name.endswith("las") else 0), atol=1e-6), name
    assert [(r.file.rsplit("/", 1)[-1], r.n) for r in skipped.collect()] == [("a.xyz", 2)]
    if split == 100:
        assert points.rdd.getNumPartitions() > 60


def test_same_points_as_the_readers_of_files(spark, folder):
    at, _ = folder
    for name in ("a.xyz", "b.ply", "sub/f.las"):
        one = sorted((r.x, r.y, r.z) for r in S.read_points(spark, str(at / name))[0].collect())
        assert one == sorted((r.x, r.y, r.z) for r in D.read_clouds(spark, str(at / name), split=300)[0].collect())


def test_boxes_choose_las_files(spark, folder):
    at, offset = folder
    path = str(at / "sub" / "f.las")
    far = [[float(offset[0] + 1000), None], [None, None], [None, None]]
    r = D.PointReader({"path": path, "box": D.json.dumps(far)})
    assert [list(r.read(p)) for p in r.partitions()] == [[]]
    assert sum(b.num_rows for p in r.partitions() for b in D.PointReader({"path": path}).read(p)) == 200
    half, _ = D.read_clouds(spark, path, box=[[float(offset[0]), None], [None, None], [None, float(offset[2])]])
    assert half.count() == ((PTS[:, 0] >= 0) & (PTS[:, 2] <= 0)).sum()
    assert D.read_clouds(spark, path, box=far)[0].count() == 0


def test_errors_and_empty_files(spark, tmp_path):
    with pytest.raises(Exception, match="not found"):
        D.read_clouds(spark, str(tmp_path / "none.xyz"))[0].collect()
    (tmp_path / "empty.xyz").write_text("")
    assert D.read_clouds(spark, str(tmp_path))[0].count() == 0
    (tmp_path / "bad.ply").write_text("plain text\n")
    with pytest.raises(Exception, match="not a PLY file"):
        D.read_clouds(spark, str(tmp_path / "bad.ply"))[0].collect()
