"""CDL files written and read by many tasks: no task has a file."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from halfstep.sources import cdl, read_grid, write_cdl, write_classic
from halfstep.sources.lines import Block, placed, rows_of

BIG = "netcdf v_1 {\ndimensions:\n x = 50 ; y = 3 ;\nvariables:\n double v(y, x) ; float w(x) ;\n v:note = \"data: of \\\"v\\\" // 1 ;\n x = 2\" ; v:_FillValue = 7. ;\n v:scale_factor = 2 ;\n// data: not yet\ndata:\n"
V = ",\n".join(", ".join("_" if k % 11 == 0 else f"{k}d" if k % 13 == 0 else str(k) for k in range(i, i + 10)) for i in range(0, 150, 10))
W = ",\n".join(map(str, range(50)))
#: Text, and whether it is read by blocks.
TEXTS = {
    "own first": (f"{BIG} v =\n{V} ; // one, two = ;\n w = {W} ;\n}}\n", True),
    "other first": (f"{BIG} w\n = {W}\n ;\n\n v = {V}\n;\n}}", True),
    "in one line": (f"{BIG} w = {W.replace(chr(10), ' ')} ; v = {V.replace(chr(10), ' ')} ;}}", True),
    "carriage returns": (f"{BIG} v =\n{V} ;\n w = {W} ;\n}}\n".replace("\n", "\r\n"), True),
    "comments": (f"{BIG} v =\n{V.replace(chr(10), ' // v(0, 1) ; = }' + chr(10))} ;\n}}\n", True),
    "length of the data": (f"{BIG.replace('y = 3', 'y = UNLIMITED')} v =\n{V} ;\n}}\n", True),
    "a string in the data": (f"{BIG} w =\n{W} ;\n c = \"v = 1 ;\" ;\n v =\n{V} ;\n}}\n", False),
}


def by_blocks(text: str, edges: list[int], variable: str = "v", rank: int = 2):
    """Rows of a text whose lines are cut into blocks at these lines, None if it isn't read so."""
    lines, told, given = text.encode().split(b"\n"), [], []
    for k, (a, b) in enumerate(zip([0, *edges], [*edges, len(lines)], strict=True)):
        block = Block(variable, k)
        for i in range(a, b, 3):
            given += [(variable, 1, k, lead, first, values) for lead, first, values in block.feed(lines[i : min(b, i + 3)])]
        told.append((k, json.loads(block.told())))
    places = placed(told, rank)
    if places is None:
        return None
    names = ["variable", "timestep", "block", "lead", "first", "values"]
    batches = (pa.RecordBatch.from_arrays([*(pa.array([x]) for x in g[:5]), pa.ListArray.from_arrays(pa.array([0, len(g[5])], pa.int32()), g[5])], names) for g in given)
    return sorted((r["y"], r["x"], r["value"]) for b in rows_of({(variable, 1, k): p for k, p in places.items()})(batches) for r in b.to_pylist())


@pytest.mark.parametrize("name", TEXTS)
def test_blocks_cut_anywhere_give_the_file(name):
    text, plain = TEXTS[name]
    whole = cdl.parse(text.encode())["v"]
    want = sorted((y, x, None if whole.mask[y, x] else float(np.float32(whole.data[y, x]))) for y in range(3) for x in range(50))
    header, n = text[: text.index("\ndata:")].count("\n") + 2, text.count("\n") + 1
    cuts, dealt = random.Random(name), 0
    for k in range(200):
        got = by_blocks(text, sorted(cuts.sample(range(header, n), min(n - header, k % 6))))
        dealt += got is not None
        if got is not None:
            assert str(got) == str(want)
    assert dealt > 100 if plain else dealt == 0


def test_what_blocks_dont_tell_is_left_to_the_whole_file():
    good = "netcdf v_1 {\ndimensions:\n x = 4 ;\nvariables:\n float v(x) ;\ndata:\n v = 1, 2,\n 3, 4 ;\n}\n"
    assert by_blocks(good, [7], rank=1) == [(None, 0, 1.0), (None, 1, 2.0), (None, 2, 3.0), (None, 3, 4.0)]
    for bad in (good.replace("4 ;\n}", "4\n}"), good.replace("3, 4", "3"), good.replace("3, 4", "3, four"), good.replace(" v =", " w ="), good.replace("float v", "float w"), good.replace("}", "v = 1, 2, 3, 4 ;\n}"), good.replace("netcdf", "net"), "", "\n"):
        assert by_blocks(bad, [7] if bad.count("\n") > 7 else [], rank=1) is None
    assert by_blocks(good, [3], rank=1) is None and by_blocks(good, [7], rank=2) is None


def most_rows(spark, run, group: str) -> int:
    """The rows that one task of these jobs took from a shuffle, at most."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    store = sc._jsc.sc().statusStore()
    most = 0
    for job in sc.statusTracker().getJobIdsForGroup(group):
        for stage in sc.statusTracker().getJobInfo(job).stageIds:
            tasks = store.taskList(stage, 0, 1_000) if sc.statusTracker().getStageInfo(stage) else None
            for k in range(tasks.size() if tasks else 0):
                metrics = tasks.apply(k).taskMetrics()
                most = max(most, metrics.get().shuffleReadMetrics().recordsRead() if metrics.isDefined() else 0)
    return most


@pytest.mark.parametrize("form", ["cdl", "nc"])
def test_a_long_file_is_written_and_read_by_many_tasks(spark, tmp_path, form):
    points, lines = 30_000, 64
    k = F.col("id")
    grid = spark.range(points * lines, numPartitions=8).select(F.lit("v").alias("variable"), F.lit(1).alias("timestep"), (k % points).cast("int").alias("x"), (k / points).cast("int").alias("y"), F.when(k % 1_000 == 7, None).otherwise(k % 100_003 - 0.5).cast("float").alias("value"))
    write = write_cdl if form == "cdl" else write_classic
    assert most_rows(spark, lambda: write(grid, str(tmp_path)), f"write {form}") < points * lines / 2
    if form == "nc":
        return
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        got = read_grid(spark, str(tmp_path), {"v": 2}, 1)
        assert got.rdd.getNumPartitions() > 1 and "binaryFile" not in got._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    place = F.col("y").cast("long") * points + F.col("x")
    wrong = ~F.col("value").eqNullSafe(F.when(place % 1_000 == 7, None).otherwise(place % 100_003 - 0.5).cast("float"))
    sums = got.agg(F.count(F.lit(1)), F.countDistinct(place), F.sum(wrong.cast("int"))).first()
    assert tuple(sums) == (points * lines, points * lines, 0)


def test_odd_files_stand_beside_others(spark, tmp_path):
    (tmp_path / "v_1.cdl").write_text(TEXTS["own first"][0])
    (tmp_path / "v_2.cdl").write_text(TEXTS["a string in the data"][0])
    got = read_grid(spark, str(tmp_path), {"v": 2}, 2)
    assert got.count() == 300 and got.filter("timestep = 2 and value is null").count() == got.filter("timestep = 1 and value is null").count()
    (tmp_path / "v_2.cdl").write_text("\n")
    with pytest.raises(Exception, match="not a CDL file"):
        read_grid(spark, str(tmp_path), {"v": 2}, 2).collect()


def test_lines_written_where_no_folder_is_mounted(spark, tmp_path):
    from halfstep.sources.grid import LINE, _write_lines

    n = 2 * LINE + 5
    rows = spark.range(2 * n).select(F.lit("v").alias("variable"), F.lit(1).alias("timestep"), (F.col("id") % n).cast("int").alias("x"), (F.col("id") / n).cast("int").alias("y"), F.when(F.col("id") != 9, F.col("id").cast("float")).alias("value"))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    _write_lines(rows.repartition(3), str(tmp_path / "out"), hadoop.Path(str(tmp_path)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()))
    got = read_grid(spark, str(tmp_path / "out"), {"v": 2}, 1)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, rows.collect())))


def test_values_of_any_length_take_their_cell():
    raw = np.random.default_rng(3).integers(0, 2**32, 200_000, dtype=np.uint32).view(np.float32)
    v = np.concatenate([raw[~np.isnan(raw)], np.array([np.inf, -np.inf, 0, -0.0, 1e-45, -3.4028235e38, -0.0000018703921], np.float32)])
    text = cdl.head("v_1", "v", v.shape) + cdl.cells(pa.array(v), np.arange(len(v)), len(v) - 1).tobytes() + cdl.END
    assert (cdl.parse(text)["v"].data == v).all() and text.endswith(b";\n}\n")
    hidden = cdl.cells(pa.array([None, float("nan")], pa.float32()), np.arange(2), 1).tobytes()
    assert hidden.split() == [b"_,", b"nan", b";"]
