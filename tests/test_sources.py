import gzip
import struct

import numpy as np
import pytest

from voxlake.sources import files, text

RNG = np.random.default_rng(5)


def test_nifti_round_trip():
    a = RNG.normal(size=(3, 4, 5)).astype("f4")
    got, head = files.read_nifti(gzip.compress(files.write_nifti(a, (1, 2, 3))))
    assert np.allclose(got[0], a) and head["pixdim"][1:4] == [1, 2, 3]
    b = RNG.integers(-9, 9, (6, 3, 4, 5))
    got, head = files.read_nifti(files.write_nifti(b, tr_ms=2000, kind="i2"))
    assert np.array_equal(got, b) and head["tr_ms"] == 2000


def test_nifti_bad_values_become_zero():
    a = np.array([[[1, np.nan, np.inf]]], "f4")
    assert files.read_nifti(files.write_nifti(a))[0].tolist() == [[[[1, 0, 0]]]]


def test_attribute_file_round_trip():
    a, m = RNG.normal(size=(2, 3, 4)).astype("f4"), RNG.random((2, 3, 5)) > 0.5
    data = files.write_v([("image", a, "float", {"name": 'two "words"'}), ("mask", m, "bit", {})], {"history": "a b"})
    listed, images = files.read_v(data)
    assert listed[0] == ("history", "a b") and images[0][2]["name"] == 'two "words"'
    assert np.allclose(images[0][1], a) and np.array_equal(images[1][1], m)


@pytest.mark.parametrize("kind", ["ubyte", "sbyte", "short", "ushort", "integer", "long", "double"])
def test_attribute_file_types(kind):
    a = RNG.integers(0, 100, (1, 3, 4))
    assert np.array_equal(files.read_v(files.write_v([("image", a, kind, {})]))[1][0][1], a)


def test_pnm_and_plain():
    assert files.read_pnm(b"P2\n# c\n3 2\n255\n1 2 3\n4 5 6\n")[0].tolist() == [[1, 2, 3], [4, 5, 6]]
    assert files.read_pnm(b"P5 2 2 255\n" + bytes([1, 2, 3, 4]))[0].tolist() == [[1, 2], [3, 4]]
    assert files.read_pnm(b"P6 1 2 255\n" + bytes(range(6))).shape == (3, 2, 1)
    assert files.read_plain(b"1 2 2\n1 2 3 4").tolist() == [[[1, 2], [3, 4]]]


def test_dicom_and_mosaic():
    def item(g, e, vr, v):
        return struct.pack("<HH2sH", g, e, vr, len(v)) + v if vr not in (b"OW",) else struct.pack("<HH2sHI", g, e, vr, 0, len(v)) + v

    a = np.arange(16, dtype="<u2").reshape(4, 4)
    body = item(8, 8, b"CS", b"MOSAIC") + item(0x28, 0x10, b"US", struct.pack("<H", 4)) + item(0x28, 0x11, b"US", struct.pack("<H", 4)) + item(0x28, 0x100, b"US", struct.pack("<H", 16)) + item(0x7FE0, 0x10, b"OW", a.tobytes())
    got, _ = files.read_dicom(b"\0" * 128 + b"DICM" + body)
    assert got.shape == (4, 2, 2) and got[1].tolist() == [[2, 3], [6, 7]]


def test_read_volumes(spark, tmp_path):
    a = RNG.normal(size=(2, 3, 3, 3))
    (tmp_path / "x.nii.gz").write_bytes(gzip.compress(files.write_nifti(a)))
    (tmp_path / "y.v").write_bytes(files.write_v([("image", a[0], "double", {})]))
    rows = files.read_volumes(spark, str(tmp_path / "*"))
    assert rows.count() == 54 + 27
    again = files.encode_volumes(rows.filter("path like '%nii.gz'"), (3, 3, 3)).first().content
    assert np.allclose(files.read_nifti(bytes(again))[0], a, atol=1e-6)
    from voxlake.sources.datasource import VolumeSource

    spark.dataSource.register(VolumeSource)
    assert spark.read.format("volume").option("paths", str(tmp_path / "x.nii.gz")).load().count() == 54


def test_text_inputs(spark, tmp_path):
    (tmp_path / "d.txt").write_text("% id onset duration height\n1 10 0.2 1\n2 20 5 2\n# end\n1 30 0 \n")
    rows = text.read_trials(spark, str(tmp_path / "d.txt")).collect()
    assert [(r.id, r.duration, r.height) for r in rows] == [(1, 0.5, 1), (2, 5, 2), (1, 0.5, 1)]
    (tmp_path / "m.txt").write_text("1 2\n3 4\n")
    assert [r.x for r in text.read_matrix(spark, str(tmp_path / "m.txt")).orderBy("row").collect()] == [[1, 2], [3, 4]]
    (tmp_path / "bad.txt").write_text("1 2\n3\n")
    with pytest.raises(ValueError):
        text.read_matrix(spark, str(tmp_path / "bad.txt"))
    (tmp_path / "c.csv").write_text("# c\n" + ",".join(str(i / 10) for i in range(6)) + "\n")
    assert len(text.read_connectomes(spark, str(tmp_path / "c.csv"), 4).first().feats) == 6
    with pytest.raises(ValueError):
        text.read_connectomes(spark, str(tmp_path / "c.csv"), 5)


def test_streaming_histogram(spark, tmp_path):
    from voxlake.operators import stats
    from voxlake.streaming.histograms import streaming_histogram

    rows = spark.range(1000).selectExpr("cast((id % 37) - 18 as double) as value")
    rows.write.parquet(str(tmp_path / "in"))
    q = streaming_histogram(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), -10.0, 10.0, 20).writeStream.format("memory").queryName("hist").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = {r.bin: r.n for r in stats.histogram(rows.filter("value <> 0"), -10.0, 10.0, 20).collect()}
    got = {r.bin: r.n for r in spark.table("hist").collect()}
    assert sum(got.values()) == 1000 and all(got[b] >= n for b, n in want.items())
