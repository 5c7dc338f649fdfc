"""The .npy data source: NumPy's files read in ranges, written files read by NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.sources import npy


def test_files_of_several_models_are_read_in_ranges(spark, tmp_path):
    rng = np.random.default_rng(0)
    a, b, c = rng.random((1000, 7)), rng.random((3, 7)).astype("<f4"), np.arange(5)
    for name, x in (("m-1", a), ("m-2", b), ("flat", c)):
        np.save(tmp_path / f"{name}.npy", x)
    df = npy.read_npy(spark, str(tmp_path), partition_bytes=7 * 8 * 90)
    assert df.rdd.getNumPartitions() == 12 + 1 + 1
    got = {}
    for r in df.collect():
        got.setdefault(r.model, {})[r.row] = r.latent
    for name, x in (("m-1", a), ("m-2", b), ("flat", c.reshape(-1, 1))):
        assert np.array_equal([got[name][i] for i in range(len(x))], x.astype(float))


def test_round_trip_and_numpy_reads_it(spark, tmp_path):
    x = np.random.default_rng(1).random((500, 4))
    df = spark.createDataFrame([(10 * i, [float(v) for v in r]) for i, r in enumerate(x)], "user_id long, latent array<double>")
    path = str(tmp_path / "model.npy")
    npy.write_npy(df.repartition(5), path, parts=4)
    assert np.array_equal(np.load(path), x)
    back = npy.read_npy(spark, path)
    assert back.select("model").distinct().first()[0] == "model" and back.count() == 500
    assert [p.name for p in tmp_path.iterdir()] == ["model.npy"]  # no parts are left
    with pytest.raises(Exception, match="FileExistsError"):
        npy.write_npy(df, path)
    assert np.array_equal(np.load(path), x)


def test_errors_and_empty_arrays(spark, tmp_path):
    np.save(tmp_path / "none.npy", np.zeros((0, 3)))
    assert npy.read_npy(spark, str(tmp_path / "none.npy")).collect() == []
    np.save(tmp_path / "fortran.npy", np.asfortranarray(np.ones((2, 3))))
    with pytest.raises(Exception, match="C order"):
        npy.read_npy(spark, str(tmp_path / "fortran.npy")).collect()
    ragged = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "user_id long, latent array<double>")
    with pytest.raises(Exception, match="one width"):
        npy.write_npy(ragged, str(tmp_path / "ragged.npy"), parts=1)
    assert not (tmp_path / "ragged.npy").exists()


def test_column_means_match_numpy(spark, tmp_path):
    x = np.random.default_rng(2).random((200, 3))
    np.save(tmp_path / "z.npy", x)
    df = npy.read_npy(spark, str(tmp_path / "z.npy")).select(F.posexplode("latent").alias("dim", "value"))
    means = [r.m for r in df.groupBy("dim").agg(F.avg("value").alias("m")).orderBy("dim").collect()]
    assert np.allclose(means, x.mean(axis=0))
