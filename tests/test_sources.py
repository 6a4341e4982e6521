"""The data sources, their writer, and reads of parts of files."""

import inspect
import os
import time

import numpy as np
import pytest
from grids import arrays, cdl_text, write
from pyspark.sql import functions as F

from halfstep import FCNN, NetCDFDataLoader
from halfstep.sources import cdl, classic, feature_rows, grid_rows, read_grid, registered, write_classic
from halfstep.sources.datasource import PUSHDOWN, ClassicWriter
from halfstep.sources.ranges import HEADER, File
from halfstep.streaming import arriving, class_widths, widened


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(params=["cdl", "1", "5"])
def folder(request, tmp_path):
    return write(tmp_path, request.param)


@pytest.fixture
def pushing(spark):
    spark.conf.set(PUSHDOWN, "true")
    yield spark
    spark.conf.unset(PUSHDOWN)


def test_rows_by_format_name(spark, folder):
    df = registered(spark).read.format("halfstep_grid").options(path=folder, variable="two", rank=2, num_timesteps=3).load()
    assert df.rdd.getNumPartitions() == 3
    want = read_grid(spark, folder, {"two": 2}, 3)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))
    wide = registered(spark).read.format("halfstep_features").options(path=folder, features_1d='["one"]', features_2d='["two"]', num_timesteps=3, dtype="double").load()
    assert wide.columns == ["timestep", "x", "one", "two_0", "two_1", "two_2"] and dict(wide.dtypes)["two_2"] == "double"
    assert wide.filter("one <> 10 * (timestep - 1) + x or two_2 <> 30 * (timestep - 1) + 20 + x").count() == 0 and wide.count() == 30


@pytest.mark.parametrize("values", [1, 7, 10, 1000])
def test_variables_in_parts(spark, tmp_path, values):
    folder = write(tmp_path, "2")
    df = grid_rows(spark, folder, "two", 2, 3, values=values)
    assert df.rdd.getNumPartitions() == 3 * max(1, -(-30 // values))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, read_grid(spark, folder, {"two": 2}, 3).collect()))
    assert feature_rows(spark, folder, ["one"], {"two": 3}, 3, values=values).filter("two_1 = 30 * (timestep - 1) + 10 + x").count() == 30


def test_filters_leave_only_their_timesteps(pushing, folder):
    for condition, n in (("timestep = 2", 1), ("timestep in (1, 3)", 2), ("timestep > 1", 2), ("timestep <= 1 and x > 3", 1), ("timestep > 3", 1), ("value > 5", 3)):
        df = grid_rows(pushing, folder, "two", 2, 3, pushdown=True).filter(condition)
        assert df.rdd.getNumPartitions() == n
        assert df.count() == read_grid(pushing, folder, {"two": 2}, 3).filter(condition).count()
    assert feature_rows(pushing, folder, ["one"], {"two": 3}, 3, pushdown=True).filter("timestep = 3").rdd.getNumPartitions() == 1


def test_filters_are_refused_where_spark_refuses_them(spark, folder):
    spark.conf.unset(PUSHDOWN)
    with pytest.raises(ValueError, match="filterPushdown"):
        grid_rows(spark, folder, "two", 2, 3, pushdown=True)
    df = grid_rows(spark, folder, "two", 2, 3)
    assert df.filter("timestep = 2").count() == 30 and df.count() == 90


def test_features_are_stacked_without_a_shuffle(spark, folder):
    df = NetCDFDataLoader(["one"], ["two"], 3, data_dir=folder, spark=spark).load_feature_data()
    assert "Exchange" not in plan(df) and "halfstep_features" in plan(df)


def test_many_features_are_planned_quickly(spark, tmp_path):
    (tmp_path / "v_1.nc").write_bytes(classic.write({"v": (["y", "x"], np.arange(256 * 50, dtype=np.float32).reshape(256, 50))}))
    load = NetCDFDataLoader([], ["v"], 1, data_dir=str(tmp_path), spark=spark)
    load.load_feature_data()
    began = time.perf_counter()
    df = load.load_feature_data()
    assert time.perf_counter() - began < 1 and len(load.features) == 256
    assert df.filter("v_255 = 255 * 50 + x").count() == 50


def test_only_the_bytes_asked_for_are_read(tmp_path):
    n = 400_000
    v = {"a": (["x"], np.arange(n, dtype=np.int32)), "b": (["y", "x"], np.arange(2 * n, dtype=np.float32).reshape(2, n))}
    (tmp_path / "b_1.nc").write_bytes(classic.write(v, 2))
    with File(str(tmp_path / "b_1.nc")) as f:
        assert f.shape("b") == (2, n) and f.read <= HEADER + 4
        start, part = f.part("b", 3, 100)
        assert start == 12_000 and part.shape == (2, 4_000) and part[1, 0] == n + 12_000
        assert f.read <= HEADER + 4 + 2 * 4 * 4_000
    text = cdl_text("c", 1, np.arange(50_000, dtype=np.float32))
    (tmp_path / "c_1.cdl").write_text(text)
    with File(str(tmp_path / "c_1.cdl")) as f:
        assert f.shape("c") == (50_000,) and f.read <= HEADER + 4 < len(text)


def test_long_headers_and_records(tmp_path):
    many = {f"variable_with_a_long_name_{k}": ([f"d{k}"], np.arange(3, dtype=np.int32)) for k in range(600)}
    (tmp_path / "m.nc").write_bytes(classic.write(many))
    with File(str(tmp_path / "m.nc")) as f:
        assert f.part("variable_with_a_long_name_599", 1, 3) == (1, np.array([1]))
    raw = bytearray(classic.write({"v": (["t", "x"], np.arange(8, dtype=np.int32).reshape(4, 2)), "w": (["t"], np.arange(4, dtype=np.int32))}))
    at = raw.index(b"t\0\0\0") + 4
    raw[at : at + 4] = bytes(4)  # t is the record dimension: values of v and w take turns
    raw[4:8] = (4).to_bytes(4, "big")
    body = len(raw) - 48
    v, w = np.frombuffer(bytes(raw[body : body + 32]), ">i4").reshape(4, 2), np.frombuffer(bytes(raw[body + 32 :]), ">i4")
    raw[body:] = np.concatenate([v, w[:, None]], 1).astype(">i4").tobytes()
    raw[body - 4 : body] = (body + 8).to_bytes(4, "big")
    (tmp_path / "r.nc").write_bytes(bytes(raw))
    assert classic.parse(bytes(raw))["v"].tolist() == [[0, 1], [2, 3], [4, 5], [6, 7]]
    with File(str(tmp_path / "r.nc")) as f:
        assert f.part("v", 1, 2)[1].tolist() == [[1], [3], [5], [7]] and f.part("w", 1, 2)[1].tolist() == [2, 3]


@pytest.mark.parametrize("kind", ["float", "double", "int"])
def test_written_files_are_read_back(spark, tmp_path, kind):
    rows = [("one", t, x, None, None if (t, x) == (2, 3) and kind != "int" else float(t + x)) for t in (1, 2) for x in range(40)] + [("two", 1, x, y, x + y * 1000.0) for y in range(3) for x in range(7)]
    df = spark.createDataFrame(rows, "variable string, timestep int, x int, y int, value double").repartition(5)
    write_classic(df, str(tmp_path / "out"), kind, values=16)
    assert sorted(os.listdir(tmp_path / "out")) == ["one_1.nc", "one_2.nc", "two_1.nc"]
    got = grid_rows(spark, str(tmp_path / "out"), "one", 1, 2).union(grid_rows(spark, str(tmp_path / "out"), "two", 2, 1)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows))


def test_a_write_that_fails_leaves_no_file(spark, tmp_path):
    rows = [("one", 1, x, None, float(x)) for x in range(10)]
    schema = "variable string, timestep int, x int, y int, value double"
    for bad in (rows[:4] + rows[5:], rows + rows[:1], rows[:4] + rows[5:] + rows[:1]):
        with pytest.raises(Exception, match="not one for each of its 10 places"):
            write_classic(spark.createDataFrame(bad, schema), str(tmp_path / "bad"))
        assert os.listdir(tmp_path / "bad") == []
    failing = spark.createDataFrame(rows, schema).withColumn("value", F.when(F.col("x") == 9, F.raise_error(F.lit("broken"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        write_classic(failing, str(tmp_path / "bad"))
    assert os.listdir(tmp_path / "bad") == []
    with pytest.raises(ValueError, match="mounted"):
        ClassicWriter("s3://bucket/folder", [], "float")


TEXT = """netcdf v_1 { // a "comment
dimensions:
  x = 4 ; y = UNLIMITED ;
variables:
  short v(x) ;
    v:scale_factor = 0.5f ; v:add_offset = 10. ; v:_FillValue = -9s ;
    v:note = "not // a comment ; scale_factor = 3" ;
  float w(x) ;
  double z(y, x) ;
data:
  v = 1, 2s, -9, _ ;
  w = NaNf, -Infinityf, 1e-3f, .5 ; // last
  z = 1, 2, 3, 4, 5, 6, 7, 8 ;
}"""


def test_attributes_suffixes_and_strings_of_text_files(spark, tmp_path):
    out = cdl.parse(TEXT.encode())
    assert out["v"].tolist() == [10.5, 11.0, None, None] and out["z"].shape == (2, 4)
    assert str(out["w"].tolist()) == str([float("nan"), float("-inf"), float(np.float32(1e-3)), 0.5])
    (tmp_path / "v_1.cdl").write_text(TEXT)
    (tmp_path / "z_1.cdl").write_text(TEXT)
    assert [r["value"] for r in grid_rows(spark, str(tmp_path), "v", 1, 1).orderBy("x").collect()] == [10.5, 11.0, None, None]
    assert grid_rows(spark, str(tmp_path), "z", 2, 1).count() == 8
    with pytest.raises(ValueError, match="is not a number"):
        cdl.parse(TEXT.replace("2s", "two").encode())


def test_what_the_loader_says_and_its_defaults(spark, tmp_path):
    load = NetCDFDataLoader(["one"], [], 3, data_dir=write(tmp_path), spark=spark)
    assert load.num_timesteps == 3 and inspect.signature(NetCDFDataLoader).parameters["data_dir"].default == "data"
    with pytest.raises(AssertionError, match="Only feature data with 1 or 2 dimensions are supported."):
        grid_rows(spark, load.data_dir, "one", 3, 1)
    with pytest.raises(ValueError, match="num_timesteps"):
        NetCDFDataLoader(["one"], [], 0, data_dir=load.data_dir, spark=spark).load_feature_data()
    a, b = FCNN(4, seed=1), FCNN(4, seed=1)
    assert (a.hidden.weight == b.hidden.weight).all() and abs(a.hidden.weight).max() <= 0.5 and (FCNN(4, seed=2).hidden.weight != a.hidden.weight).any()


def test_a_relative_folder(spark, tmp_path, monkeypatch):
    write(tmp_path, "1")
    assert grid_rows(spark, os.path.relpath(tmp_path), "one", 1, 3).count() == 30


def test_stream_and_batch_agree_after_each_timestep(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    given, got = tmp_path / "in", []
    given.mkdir()
    try:
        for t in (1, 2, 3):
            (given / f"ncsteps_{t}.cdl").write_text(cdl_text("ncsteps", t, arrays(t)["ncsteps"]))
            q = class_widths(arriving(spark, str(given))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination()
            widths = spark.read.parquet(str(tmp_path / "out"))
            load = NetCDFDataLoader([], [], t, data_dir=str(given), spark=spark)
            batch = load.load_target_data()
            got.append(tuple(widths.filter(F.col("num_timesteps") == t).first()))
            assert got[-1] == (t, 10 * t, load.max_nhsteps)
            now = widened(batch.select("timestep", "x", "nhsteps"), widths)
            assert now.exceptAll(batch).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
