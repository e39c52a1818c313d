"""Matrix files: round trips, ranges, damaged files, files of failed tasks."""
import os
import tempfile

import numpy as np
import pytest

from recsmith.sources import matrices as MX


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="npy-")


def rows_of(df):
    return [(r.row_id, list(r.vec)) for r in df.orderBy("row_id").collect()]


def same(df, m):
    got = rows_of(df)
    return [k for k, _ in got] == list(range(len(m))) and np.array_equal(np.array([v for _, v in got]).reshape(m.shape), m)


@pytest.mark.parametrize("dtype", ["<f4", "<f8", "<f2", "<i4", ">f4"])
def test_reads_ranges_of_foreign_files(spark, folder, dtype):
    m = (np.arange(60).reshape(20, 3) * 0.5).astype(dtype)
    np.save(f"{folder}/a.npy", m)
    df = MX.read_matrix(spark, f"{folder}/a.npy", max_partition_bytes=m[:3].nbytes)
    assert df.rdd.getNumPartitions() == 7 and same(df, m)
    np.savez(f"{folder}/s.npz", one=m[:2], two=m)
    assert same(MX.read_matrix(spark, f"{folder}/s.npz", "two", m[:3].nbytes), m)
    np.savez_compressed(f"{folder}/c.npz", one=m[:2], two=m)
    assert same(MX.read_matrix(spark, f"file://{folder}/c.npz", "two", 1), m)


def test_round_trip_in_order(spark, folder):
    rng = np.random.default_rng(0)
    m = rng.standard_normal((257, 5)).astype("f4")
    df = spark.createDataFrame([(i, m[i].tolist()) for i in rng.permutation(257).tolist()], "k int, v array<float>").repartition(5)
    MX.write_matrix(df, f"{folder}/m", "v", ["k"], rows_per_file=20)
    assert same(MX.read_matrix(spark, f"{folder}/m", max_partition_bytes=100), m)
    assert all(np.load(f"{folder}/m/{n}").shape[0] <= 20 for n in os.listdir(f"{folder}/m") if n.endswith(".npy"))
    # a file of a failed task is in the folder, but not in its manifest
    np.save(f"{folder}/m/part-00000-99999-left.npy", m[:3])
    assert same(MX.read_matrix(spark, f"{folder}/m"), m)
    MX.write_matrix(df.filter("k < 30"), f"{folder}/m", "v", ["k"])
    assert same(MX.read_matrix(spark, f"{folder}/m"), m[:30])
    assert sum(np.load(f"{folder}/m/{n}").shape[0] for n in os.listdir(f"{folder}/m") if n.endswith(".npy")) == 30


def test_empty_frame_and_one_dimension(spark, folder):
    df = spark.createDataFrame([], "k int, v array<float>")
    MX.write_matrix(df, f"{folder}/m", "v", ["k"])
    assert rows_of(MX.read_matrix(spark, f"{folder}/m")) == []
    np.save(f"{folder}/one.npy", np.array([1.5, 2.5]))
    assert rows_of(MX.read_matrix(spark, f"{folder}/one.npy")) == [(0, [1.5]), (1, [2.5])]


def test_damaged_files_are_errors(spark, folder):
    m = np.arange(40.0).reshape(10, 4)
    np.save(f"{folder}/a.npy", m)
    data = open(f"{folder}/a.npy", "rb").read()
    for name, body in (("short", data[:-8]), ("long", data + b"x"), ("none", b""), ("other", b"PK not a matrix")):
        with open(f"{folder}/{name}.npy", "wb") as f:
            f.write(body)
        with pytest.raises(Exception, match="by its header|not a matrix file"):
            MX.read_matrix(spark, f"{folder}/{name}.npy").collect()
    np.save(f"{folder}/cube.npy", np.zeros((2, 2, 2)))
    np.save(f"{folder}/cols.npy", np.asfortranarray(m))
    np.save(f"{folder}/text.npy", np.array([["a"]]))
    for name in ("cube", "cols", "text"):
        with pytest.raises(Exception, match="rows of a matrix|not numbers"):
            MX.read_matrix(spark, f"{folder}/{name}.npy").collect()
    np.savez(f"{folder}/two.npz", a=m, b=m)
    with pytest.raises(Exception, match="choose one of"):
        MX.read_matrix(spark, f"{folder}/two.npz").collect()
    with pytest.raises(Exception, match="FileNotFound|no-such"):
        MX.read_matrix(spark, f"{folder}/no-such.npy").collect()


def test_vectors_that_make_no_matrix(spark, folder):
    for rows in ([(1, [1.0]), (2, None)], [(1, [1.0]), (2, [1.0, 2.0])]):
        df = spark.createDataFrame(rows, "k int, v array<float>")
        for parts in (df.coalesce(1), df):
            with pytest.raises(Exception, match="null vector|different lengths"):
                MX.write_matrix(parts, f"{folder}/bad", "v", ["k"])
    assert not os.path.exists(f"{folder}/bad/{MX.MANIFEST}")
