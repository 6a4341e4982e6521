import numpy as np
import pytest
from grids import arrays, cdl_text, write
from pyspark.sql import functions as F

from halfstep import NetCDFDataLoader
from halfstep.sources import cdl, classic, read_grid, variable_shape


@pytest.fixture(params=["cdl", "1", "2", "5"])
def folder(request, tmp_path):
    return write(tmp_path, request.param)


@pytest.fixture(params=["ranges", "whole files"])
def reader(request, monkeypatch):
    """Files read by ranges, and as in stores that only Spark reads."""
    if request.param != "ranges":
        monkeypatch.setattr("halfstep.dataset.SCHEMES", ())


@pytest.fixture
def text_folder(tmp_path):
    return write(tmp_path)


def test_missing_folder(spark):
    with pytest.raises(OSError, match="Data directory '/no/such/folder' does not exist."):
        NetCDFDataLoader(["one"], ["two"], 1, data_dir="/no/such/folder", spark=spark)


def test_folder_is_kept(spark, text_folder):
    loader = NetCDFDataLoader(["one"], ["two"], 2, data_dir=text_folder, spark=spark)
    assert (loader.data_dir, loader.num_timesteps) == (text_folder, 2)


def test_errors_before_loading(spark, text_folder):
    loader = NetCDFDataLoader(["one"], ["two"], 1, data_dir=text_folder, spark=spark)
    with pytest.raises(RuntimeError, match=r"Features have not been loaded. Call load_feature_data\(\) first."):
        _ = loader.features
    with pytest.raises(RuntimeError, match=r"Max halving steps have not been set. Call load_target_data\(\) first."):
        _ = loader.max_nhsteps


@pytest.mark.parametrize("t", [1, 2, 3])
def test_target(spark, text_folder, t):
    loader = NetCDFDataLoader(["one"], ["two"], t, data_dir=text_folder, spark=spark)
    rows = loader.load_target_data().orderBy("timestep", "x").collect()
    assert loader.max_nhsteps == t + 2
    assert len(rows) == 10 * t and all(len(r["target"]) == t + 3 and sum(r["target"]) == 1 for r in rows)
    assert [r["target"].index(1) for r in rows] == [r["nhsteps"] for r in rows]
    counts = np.array([r["target"] for r in rows]).sum(0).tolist()
    assert counts == {1: [8, 0, 1, 1], 2: [16, 0, 2, 1, 1], 3: [24, 0, 3, 1, 1, 1]}[t]


def test_features(spark, folder, reader):
    given = (["one"], ["two"])
    loader = NetCDFDataLoader(*given, 3, data_dir=folder, spark=spark)
    for _ in range(2):  # loading again gives the same, and the caller's lists stay as they are
        df = loader.load_feature_data()
        assert df.columns == ["timestep", "x", "one", "two_0", "two_1", "two_2"]
        assert loader.features == df.columns[2:] and given == (["one"], ["two"])
    rows = [tuple(r) for r in df.orderBy("timestep", "x").collect()]
    assert rows == [(t, x, *(float(k) for k in (10 * (t - 1) + x, 30 * (t - 1) + x, 30 * (t - 1) + 10 + x, 30 * (t - 1) + 20 + x))) for t in (1, 2, 3) for x in range(10)]


def test_target_of_classic_files(spark, folder, reader):
    loader = NetCDFDataLoader(["one"], ["two"], 3, data_dir=folder, spark=spark)
    assert [r["nhsteps"] for r in loader.load_target_data().orderBy("timestep", "x").collect()] == [0, 0, 0, 2, 0, 0, 0, 0, 3, 0, 4, 0, 0, 0, 0, 0, 2, 0, 0, 0, 0, 0, 0, 0, 5, 0, 2, 0, 0, 0]


def test_values_pass_through_32_bits(spark, tmp_path):
    (tmp_path / "v_1.cdl").write_text("netcdf v_1 {\ndimensions:\n x = 2 ;\nvariables:\n double v(x) ;\ndata:\n v = 0.1, 1e-3 ;\n}")
    loader = NetCDFDataLoader(["v"], [], 1, data_dir=str(tmp_path), spark=spark)
    df = loader.load_feature_data("double")
    assert dict(df.dtypes)["v"] == "double"
    assert [r["v"] for r in df.orderBy("x").collect()] == [float(np.float32(0.1)), float(np.float32(1e-3))]


def test_features_and_targets_must_cover_the_same_points(spark, text_folder, tmp_path):
    loader = NetCDFDataLoader(["one"], ["two"], 3, data_dir=text_folder, spark=spark)
    assert loader.load().count() == 30
    (tmp_path / "ncsteps_2.cdl").write_text(cdl_text("ncsteps", 2, np.ones(9, np.int32)))
    with pytest.raises(Exception, match="don't cover the same grid points"):
        loader.load().collect()


def test_timesteps_of_other_sizes(spark, tmp_path, reader):
    for t, n in ((1, 4), (2, 7)):
        (tmp_path / f"one_{t}.cdl").write_text(cdl_text("one", t, np.arange(n, dtype=np.float32)))
        (tmp_path / f"two_{t}.cdl").write_text(cdl_text("two", t, np.zeros((2, n), np.float32)))
    loader = NetCDFDataLoader(["one"], ["two"], 2, data_dir=str(tmp_path), spark=spark)
    assert loader.load_feature_data().groupBy("timestep").count().orderBy("timestep").collect() == [(1, 4), (2, 7)]


def test_components_must_be_as_many_at_all_timesteps(spark, tmp_path, reader):
    for t, n in ((1, 2), (2, 3)):
        (tmp_path / f"two_{t}.cdl").write_text(cdl_text("two", t, np.zeros((n, 5), np.float32)))
    loader = NetCDFDataLoader([], ["two"], 2, data_dir=str(tmp_path), spark=spark)
    with pytest.raises(Exception, match="more components"):
        loader.load_feature_data().collect()


def test_points_that_lack_a_feature(spark, tmp_path, reader):
    (tmp_path / "a_1.cdl").write_text(cdl_text("a", 1, np.zeros(3, np.float32)))
    (tmp_path / "b_1.cdl").write_text(cdl_text("b", 1, np.zeros(2, np.float32)))
    loader = NetCDFDataLoader(["a", "b"], [], 1, data_dir=str(tmp_path), spark=spark)
    with pytest.raises(Exception, match="'b' has not exactly one value at timestep 1, x 2"):
        loader.load_feature_data().collect()


def test_declared_rank_is_checked(spark, text_folder, reader):
    with pytest.raises(Exception, match="'two' was declared with 1"):
        NetCDFDataLoader(["two"], [], 1, data_dir=text_folder, spark=spark).load_feature_data().collect()


def test_arguments_of_the_source(spark, text_folder):
    with pytest.raises(ValueError, match="num_timesteps"):
        read_grid(spark, text_folder, {"one": 1}, 0)
    with pytest.raises(AssertionError, match="Only feature data with 1 or 2 dimensions are supported."):
        read_grid(spark, text_folder, {"one": 3}, 1)
    assert variable_shape(spark, text_folder, "two") == (3, 10)


def test_missing_file(spark, text_folder, reader):
    with pytest.raises(Exception, match="one_4"):
        NetCDFDataLoader(["one"], [], 4, data_dir=text_folder, spark=spark).load_feature_data().collect()


def test_fill_values_are_null(spark, tmp_path):
    (tmp_path / "v_1.cdl").write_text("netcdf v_1 { // text\ndimensions:\n x = 3 ;\nvariables:\n float v(x) ;\n  v:_FillValue = -9.f ;\n  v:units = \"m\" ;\ndata:\n v = 1.5f, _, -9 ;\n}")
    assert [r["value"] for r in read_grid(spark, str(tmp_path), {"v": 1}, 1).orderBy("x").collect()] == [1.5, None, None]


def test_classic_records_and_packing():
    v = np.arange(6, dtype=np.float32).reshape(2, 3)
    for version in (1, 2, 5):
        raw = classic.write({"two": (["y", "x"], v), "n": (["x"], np.arange(3, dtype=np.int32))}, version)
        out = classic.parse(raw)
        assert (out["two"] == v).all() and out["n"].tolist() == [0, 1, 2]
    with pytest.raises(ValueError):
        classic.parse(b"text")
    assert cdl.parse(cdl_text("two", 1, arrays(1)["two"]).encode())["two"].shape == (3, 10)
    with pytest.raises(ValueError):
        cdl.parse(b"no such file")


def test_rows_in_order(spark, text_folder):
    from halfstep.sources.grid import with_row_numbers

    df = with_row_numbers(read_grid(spark, text_folder, {"one": 1}, 3))
    assert [r["row"] for r in df.orderBy("timestep", "x").select(F.col("row")).collect()] == list(range(30))


def test_written_files_are_read_back(spark, tmp_path, reader):
    from halfstep.sources import write_cdl

    rows = [("one", t, x, None, None if (t, x) == (2, 3) else t + x / 8) for t in (1, 2) for x in range(30)] + [("two", 1, x, y, x * 1e-9 + y * 1e20) for y in range(3) for x in range(5)]
    write_cdl(spark.createDataFrame(rows, "variable string, timestep int, x int, y int, value float").repartition(4), str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["one_1.cdl", "one_2.cdl", "two_1.cdl"]
    got = read_grid(spark, str(tmp_path), {"one": 1}, 2).union(read_grid(spark, str(tmp_path), {"two": 2}, 1)).collect()
    value = lambda v: None if v is None else float(np.float32(v))
    assert sorted(map(str, map(tuple, got))) == sorted(str((a, b, c, d, value(v))) for a, b, c, d, v in rows)
    with pytest.raises(Exception, match="feature 'one' is null at timestep 2, x 3"):
        NetCDFDataLoader(["one"], [], 2, data_dir=str(tmp_path), spark=spark).load_feature_data().collect()


def test_grids_of_many_ranges(spark, tmp_path, reader):
    n = 20_000
    (tmp_path / "a_1.nc").write_bytes(classic.write({"a": (["x"], np.arange(n, dtype=np.float32))}))
    (tmp_path / "b_1.nc").write_bytes(classic.write({"b": (["y", "x"], np.arange(2 * n, dtype=np.float32).reshape(2, n))}))
    df = NetCDFDataLoader(["a"], ["b"], 1, data_dir=str(tmp_path), spark=spark).load_feature_data("double")
    assert df.filter("a = x and b_0 = x and b_1 = x + 20000").count() == df.count() == n


def test_names_that_clash(spark, tmp_path):
    for name, v in (("x", np.zeros(3, np.float32)), ("v_0", np.zeros(3, np.float32)), ("v", np.zeros((2, 3), np.float32))):
        (tmp_path / f"{name}_1.cdl").write_text(cdl_text(name, 1, v))
    for one, two in ((["x"], []), (["v_0"], ["v"]), (["v_0", "v_0"], [])):
        with pytest.raises(ValueError, match="different names"):
            NetCDFDataLoader(one, two, 1, data_dir=str(tmp_path), spark=spark).load_feature_data()
    with pytest.raises(ValueError, match="dtype must be one of"):
        NetCDFDataLoader(["v_0"], [], 1, data_dir=str(tmp_path), spark=spark).load_feature_data("half")


def test_records_of_a_file_written_as_a_stream():
    raw = bytearray(classic.write({"v": (["t"], np.arange(4, dtype=np.int32))}))
    at = raw.index(b"t\0\0\0") + 4
    raw[at : at + 4] = bytes(4)  # dimension t is the record dimension,
    raw[4:8] = b"\xff" * 4  # and the number of records isn't told
    assert classic.parse(bytes(raw))["v"].tolist() == [0, 1, 2, 3]


def test_many_features_of_whole_files_are_planned_quickly(spark, tmp_path, monkeypatch):
    import time

    monkeypatch.setattr("halfstep.dataset.SCHEMES", ())
    (tmp_path / "v_1.nc").write_bytes(classic.write({"v": (["y", "x"], np.arange(256 * 50, dtype=np.float32).reshape(256, 50))}))
    load = NetCDFDataLoader([], ["v"], 1, data_dir=str(tmp_path), spark=spark)
    load.load_feature_data()
    began = time.perf_counter()
    df = load.load_feature_data()
    assert time.perf_counter() - began < 2 and df.filter("v_255 = 255 * 50 + x").count() == 50
