"""Each operator applied to a whole table.

`part` stands in for the target: p_size is the number of steps, p_partkey % 3 + 1 the timestep. `embeddings` stands in
for a 2D variable and for the network's input. The weights are a formula, which the SQL repeats. The queries of the loader
and of the data sources write both as classic files first, those of the binary source as text (CDL), and read those.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import NetCDFDataLoader
from ..functions import one_hot, relu, softmax
from ..operators import FCNN, Dense, HalvingClassifier, class_histogram, dense, dense_relational, feature_vector, max_nhsteps, onehot_long, onehot_vector, onehot_wide, slice_unpack, slices_wide, softmax_relational, stack_features, with_nhsteps
from ..operators.network import argmax
from ..sources import grid_rows, read_grid, variable_shape, write_cdl, write_classic
from ..sources.datasource import PUSHDOWN
from ..sources.grid import paths, with_row_numbers
from ..storage import cut, new_path, numbered
from ..streaming import arriving, class_widths

INPUTS, HIDDEN, CLASSES, DIGITS = 64, 50, 10, 6


def model() -> FCNN:
    i, h, k = np.arange(INPUTS), np.arange(HIDDEN), np.arange(CLASSES)
    hidden = Dense(((h[:, None] * 31 + i * 17) % 101 - 50) / 500.0, ((h * 7) % 11 - 5) / 100.0)
    output = Dense(((k[:, None] * 13 + h * 29) % 97 - 48) / 400.0, ((k * 5) % 7 - 3) / 50.0)
    return FCNN(INPUTS, CLASSES - 1, HIDDEN, hidden=hidden, output=output)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 3 + 1).cast("int").alias("timestep"))
    return with_nhsteps(part, "p_size")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def exploded(df: DataFrame, array: str, index: str, value: str) -> DataFrame:
    return df.select("vec_id", F.posexplode(array).alias(index, value))


def nhsteps(spark, sf_dir):
    return steps(spark, sf_dir).select("p_partkey", "p_size", "nhsteps")


def max_nhsteps_query(spark, sf_dir):
    return steps(spark, sf_dir).agg(F.max("nhsteps").alias("max_nhsteps"))


def max_nhsteps_by_prefix(spark, sf_dir):
    """The largest class of the first 1, 2 and 3 timesteps: each row counts for its timestep and all later prefixes."""
    upto = F.explode(F.sequence(F.col("timestep"), F.lit(3))).alias("num_timesteps")
    return steps(spark, sf_dir).select("nhsteps", upto).groupBy("num_timesteps").agg(F.max("nhsteps").alias("max_nhsteps"))


def class_histogram_dense(spark, sf_dir):
    """Classes of squared sizes, among which class 1 doesn't occur."""
    squares = read(spark, sf_dir, "part").select((F.col("p_size") * F.col("p_size")).alias("ncsteps"))
    return class_histogram(with_nhsteps(squares, "ncsteps"))


def onehot_long_query(spark, sf_dir):
    return onehot_long(steps(spark, sf_dir), ["p_partkey"])


def onehot_wide_query(spark, sf_dir):
    df = steps(spark, sf_dir)
    return onehot_wide(df, ["p_partkey"], max_nhsteps(df))


def onehot_array(spark, sf_dir):
    """The array form, as one string for each row."""
    df = steps(spark, sf_dir)
    return df.select("p_partkey", F.concat_ws("", one_hot(F.col("nhsteps"), max_nhsteps(df)).cast("array<string>")).alias("target"))


def timestep_concat(spark, sf_dir):
    """Rows of all timesteps in order: x is the place within the timestep, row over all of them. Rows are dealt by ranges
    of (timestep, p_partkey), so a timestep is sorted by many tasks."""
    part = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 3 + 1).cast("int").alias("timestep"))
    return placed(part, "p_partkey").select("p_partkey", "timestep", "x", "row")


def placed(df: DataFrame, key: str) -> DataFrame:
    """df with row, its place by (timestep, key), and x, its place within the timestep."""
    rows = cut(numbered(df, [F.col("timestep"), F.col(key)], "row"))
    starts = rows.groupBy("timestep").agg(F.min("row").alias("_start"))
    return rows.join(F.broadcast(starts), "timestep").withColumn("x", (F.col("row") - F.col("_start")).cast("int")).drop("_start")


def float32_cast(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("float").cast("double").alias("price"))


def slice_unpack_query(spark, sf_dir):
    return slice_unpack(vectors(spark, sf_dir), ["vec_id"], "embedding")


def feature_registry(spark, sf_dir):
    """pos and name of each feature: p_retailprice and the components of embedding, whose number is read from the data."""
    n = vectors(spark, sf_dir).select(F.size("embedding").alias("n")).agg(F.max("n").alias("n"))
    names = F.concat(F.array(F.lit("p_retailprice")), F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.concat(F.lit("embedding_"), j.cast("string"))))
    return n.select(F.posexplode(names).alias("pos", "name"))


def feature_stack(spark, sf_dir):
    """label and the components of each vector as columns."""
    base = read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("float").alias("label"), "embedding")
    return slices_wide(base, ["vec_id", "label"], "embedding", INPUTS, "embedding")


def feature_stack_long(spark, sf_dir):
    """Features stacked from the long form that the grid source gives: a scalar variable and a component variable of
    every vector, brought together on (timestep, x) in one shuffle."""
    base = read(spark, sf_dir, "embeddings").select(F.lit(1).alias("timestep"), F.col("vec_id").cast("int").alias("x"), F.col("label").cast("float").alias("label"), F.col("embedding").alias("e"))
    one = base.select(F.lit("label").alias("variable"), "timestep", "x", F.lit(None).cast("int").alias("y"), F.col("label").alias("value"))
    two = base.select(F.lit("embedding").alias("variable"), "timestep", "x", F.posexplode("e").alias("y", "value"))
    return stack_features(one.unionByName(two), ["label"], {"embedding": INPUTS}).select(F.col("x").cast("long").alias("vec_id"), "label", *(f"embedding_{j}" for j in range(INPUTS)))


# ---- the loader: parts and vectors are written as files to the shared folder and loaded from there


_written: dict[tuple, str] = {}


def state(spark: SparkSession, path: str) -> tuple:
    """Length and time of a table's files, so that files made of a changed table aren't taken for those of this one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.getFileStatus(at)
    files = fs.listStatus(at) if found.isDirectory() else [found]
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def grids(spark: SparkSession, sf_dir: str, form: str = "nc") -> str:
    """The folder of files, written once an application for each state of the tables: ncsteps is p_size of part; label and
    embedding are those of the vectors. p_partkey and vec_id modulo 3, plus 1, are the timesteps, and their order that of
    the grid points."""
    key = (spark.sparkContext.applicationId, form, *(state(spark, f"{sf_dir}/{t}.parquet") for t in ("part", "embeddings")))
    if key in _written:
        return _written[key]
    steps = part_points(spark, sf_dir).select(F.lit("ncsteps").alias("variable"), "timestep", "x", F.lit(None).cast("int").alias("y"), F.col("p_size").cast("float").alias("value"))
    points = cut(vector_points(spark, sf_dir))
    one = points.select(F.lit("label").alias("variable"), "timestep", "x", F.lit(None).cast("int").alias("y"), F.col("label").cast("float").alias("value"))
    two = points.select(F.lit("embedding").alias("variable"), "timestep", "x", F.posexplode("embedding").alias("y", "value"))
    folder = new_path(spark)
    write(steps.unionByName(one).unionByName(two), folder, form)
    _written[key] = folder
    return folder


def write(grid: DataFrame, folder: str, form: str = "nc", kind: str = "float") -> None:
    if form == "nc":
        write_classic(cut(grid), folder, kind)
    else:
        write_cdl(cut(grid), folder)


def part_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 3 + 1).cast("int").alias("timestep"), "p_size", "p_retailprice")
    return placed(part, "p_partkey")


def vector_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(read(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 3 + 1).cast("int").alias("timestep"), "label", "embedding"), "vec_id")


def loader(spark: SparkSession, folder: str, timesteps: int = 3) -> NetCDFDataLoader:
    return NetCDFDataLoader(["label"], ["embedding"], timesteps, data_dir=folder, spark=spark)


def loader_targets(spark, sf_dir):
    """Targets of the files (the one-hot array as a string), and the largest class that the loader then has."""
    load = loader(spark, grids(spark, sf_dir))
    target = load.load_target_data()
    return target.select("timestep", "x", "nhsteps", F.concat_ws("", F.col("target").cast("array<string>")).alias("target"), F.lit(load.max_nhsteps).alias("max_nhsteps"))


def loader_prefixes(spark, sf_dir):
    """Rows and the largest class of the first 1, 2 and 3 timesteps, each loaded from the files."""
    folder, out = grids(spark, sf_dir), None
    for n in (1, 2, 3):
        load = loader(spark, folder, n)
        some = load.load_target_data().agg(F.lit(n).alias("num_timesteps"), F.count(F.lit(1)).alias("n_rows"), F.lit(load.max_nhsteps).alias("max_nhsteps"))
        out = some if out is None else out.unionByName(some)
    return out


def loader_features(spark, sf_dir):
    """Features of the files, a column for each."""
    return loader(spark, grids(spark, sf_dir)).load_feature_data()


def loader_features_double(spark, sf_dir):
    """1D features as doubles that have passed through 32-bit floats."""
    return NetCDFDataLoader(["label"], [], 3, data_dir=grids(spark, sf_dir), spark=spark).load_feature_data("double")


def loader_feature_names(spark, sf_dir):
    load = loader(spark, grids(spark, sf_dir))
    load.load_feature_data()
    return spark.createDataFrame(list(enumerate(load.features)), "pos int, name string")


def loader_aligned(spark, sf_dir):
    """Targets and features of each grid point, both of the vectors (a label l counts as 2 to the power l modulo 5)."""
    rows = vector_points(spark, sf_dir).select("timestep", "x", F.lit(None).cast("int").alias("y"), F.explode(F.array(F.struct(F.lit("ncsteps").alias("variable"), F.pow(F.lit(2.0), F.col("label") % 5).cast("float").alias("value")), F.struct(F.lit("label").alias("variable"), F.col("label").cast("float").alias("value")))).alias("_v"))
    folder = new_path(spark)
    write(rows.select("_v.variable", "timestep", "x", "y", "_v.value"), folder)
    return NetCDFDataLoader(["label"], [], 3, data_dir=folder, spark=spark).load().select("timestep", "x", "nhsteps", "label")


def source_rows_1d(spark, sf_dir):
    """One variable of rank 1 as rows, over all timesteps, with its place in all."""
    grid = read_grid(spark, grids(spark, sf_dir, "cdl"), {"ncsteps": 1}, 3)
    return with_row_numbers(cut(grid)).select("variable", "timestep", "x", "value", "row")


def source_rows_2d(spark, sf_dir):
    """One variable of rank 2 as rows: components by grid points, joined over the timesteps along the grid."""
    grid = read_grid(spark, grids(spark, sf_dir, "cdl"), {"embedding": 2}, 3)
    return with_row_numbers(cut(grid)).select("timestep", "x", F.col("y").alias("component"), "value", "row")


def source_files(spark, sf_dir):
    """The files that a loader of two timesteps reads, and the shape that the first one of each variable has."""
    folder = grids(spark, sf_dir, "cdl")
    names = [(v, t, path.rpartition("/")[2]) for v in ("embedding", "label", "ncsteps") for t, path in enumerate(paths(spark, folder, [v], range(1, 3)), 1)]
    shapes = {v: "x".join(map(str, variable_shape(spark, folder, v))) for v in ("embedding", "label", "ncsteps")}
    return spark.createDataFrame([(v, t, f, shapes[v]) for v, t, f in names], "variable string, timestep int, file string, shape string")


def loader_price_double(spark, sf_dir):
    """A feature of doubles that 32-bit floats can't hold, from files of doubles, loaded as doubles."""
    prices = part_points(spark, sf_dir).select(F.lit("price").alias("variable"), "timestep", "x", F.lit(None).cast("int").alias("y"), F.col("p_retailprice").alias("value"))
    folder = new_path(spark)
    write(prices, folder, kind="double")
    return NetCDFDataLoader(["price"], [], 3, data_dir=folder, spark=spark).load_feature_data("double")


def grid_source_1d(spark, sf_dir):
    """One variable of rank 1 through the data source, with its place in all timesteps."""
    return with_row_numbers(grid_rows(spark, grids(spark, sf_dir), "ncsteps", 1, 3)).select("variable", "timestep", "x", "value", "row")


def grid_source_2d(spark, sf_dir):
    """One variable of rank 2 through the data source, in parts of a file."""
    grid = with_row_numbers(grid_rows(spark, grids(spark, sf_dir), "embedding", 2, 3, values=1 << 16))
    return grid.select("timestep", "x", F.col("y").alias("component"), "value", "row")


def grid_pushdown(spark, sf_dir):
    """The second timestep alone, by a filter that the data source takes: other timesteps' files aren't read."""
    spark.conf.set(PUSHDOWN, "true")
    grid = grid_rows(spark, grids(spark, sf_dir), "embedding", 2, 3, pushdown=True).filter("timestep = 2")
    return grid.select("timestep", "x", F.col("y").alias("component"), "value")


def stream_prefixes(spark, sf_dir):
    """Rows and the largest class after each timestep of a stream of files."""
    folder, out, checkpoint = grids(spark, sf_dir), new_path(spark), new_path(spark)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        widths = class_widths(arriving(spark, folder, files=1_000))
        query = widths.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(widths.schema).parquet(out)


def onehot_vector_query(spark, sf_dir):
    """The vector form of targets, as one string for each row."""
    digits = F.transform(vector_to_array("target"), lambda v: v.cast("int").cast("string"))
    return onehot_vector(steps(spark, sf_dir)).select("p_partkey", F.concat_ws("", digits).alias("target"))


def feature_vector_query(spark, sf_dir):
    """label and the components of each vector, assembled as one vector and taken out of it again."""
    names = ["label", *(f"embedding_{j}" for j in range(INPUTS))]
    base = feature_vector(feature_stack(spark, sf_dir), names, "_v").select("vec_id", vector_to_array("_v", "float32").alias("_v"))
    return base.select("vec_id", *(F.get("_v", F.lit(k)).alias(n) for k, n in enumerate(names)))


def fcnn_native(spark, sf_dir):
    """The forward pass by expressions alone."""
    out = vectors(spark, sf_dir).select("vec_id", model().native(F.col("embedding")).alias("p"))
    return exploded(out, "p", "cls", "p_cls").select("vec_id", "cls", F.round("p_cls", DIGITS).alias("p"))


def fcnn_pipeline(spark, sf_dir):
    """The forward pass as a stage of a pipeline that was saved and loaded again."""
    path = new_path(spark)
    df = vectors(spark, sf_dir)
    Pipeline(stages=[HalvingClassifier(model(), "embedding", "p")]).fit(df).write().save(path)
    return exploded(PipelineModel.load(path).transform(df), "p", "cls", "p_cls").select("vec_id", "cls", F.round("p_cls", DIGITS).alias("p"))


def fcnn_from_table(spark, sf_dir):
    """The forward pass of a network whose weights were written as a table and read again."""
    m = FCNN.from_table(cut(model().to_table(spark)))
    return exploded(m(vectors(spark, sf_dir), "embedding", "p"), "p", "cls", "p_cls").select("vec_id", "cls", F.round("p_cls", DIGITS).alias("p"))


def dense_hidden(spark, sf_dir):
    out = dense(vectors(spark, sf_dir), "embedding", model().hidden, "h")
    return exploded(out, "h", "unit", "v").withColumn("v", F.round("v", DIGITS))


def relu_hidden(spark, sf_dir):
    out = dense(vectors(spark, sf_dir), "embedding", model().hidden, "h")
    return exploded(out, "h", "unit", "v").select("vec_id", "unit", F.round(relu(F.col("v")), DIGITS).alias("v"))


def logits(spark, sf_dir):
    m = model()
    hidden = dense(vectors(spark, sf_dir), "embedding", m.hidden, "h").withColumn("a", F.transform("h", relu)).drop("h")
    return dense(hidden, "a", m.output, "z").select("vec_id", "z")


def dense_output(spark, sf_dir):
    return exploded(logits(spark, sf_dir), "z", "cls", "z_cls").select("vec_id", "cls", F.round("z_cls", DIGITS).alias("z"))


def softmax_query(spark, sf_dir):
    out = logits(spark, sf_dir).select("vec_id", softmax(F.col("z")).alias("p"))
    return exploded(out, "p", "cls", "p_cls").select("vec_id", "cls", F.round("p_cls", DIGITS).alias("p"))


def fcnn_forward(spark, sf_dir):
    out = model()(vectors(spark, sf_dir), "embedding", "p")
    return exploded(out, "p", "cls", "p_cls").select("vec_id", "cls", F.round("p_cls", DIGITS).alias("p"))


def fcnn_relational(spark, sf_dir):
    """The forward pass with weights in tables: joins, sums and windows only."""
    m = model()

    def tables(layer: Dense) -> tuple[DataFrame, DataFrame]:
        w = [(o, i, float(layer.weight[o, i])) for o in range(layer.out_features) for i in range(layer.in_features)]
        return spark.createDataFrame(w, "o int, i int, w double"), spark.createDataFrame([(o, float(b)) for o, b in enumerate(layer.bias)], "o int, b double")

    values = exploded(vectors(spark, sf_dir), "embedding", "i", "v").withColumn("v", F.col("v").cast("double"))
    hidden = dense_relational(values, *tables(m.hidden), "vec_id").select("vec_id", F.col("o").alias("i"), relu(F.col("v")).alias("v"))
    out = softmax_relational(dense_relational(hidden, *tables(m.output), "vec_id"), "vec_id")
    return out.select("vec_id", F.col("o").alias("cls"), F.round("p", DIGITS).alias("p"))


def prob_sum(spark, sf_dir):
    out = model()(vectors(spark, sf_dir), "embedding", "p")
    return out.select("vec_id", F.round(F.aggregate("p", F.lit(0.0), lambda a, b: a + b), 9).alias("total"))


def predicted_class(spark, sf_dir):
    """An addition: the most probable class, and the timestep halved so often."""
    out = model()(vectors(spark, sf_dir), "embedding", "p").select("vec_id", argmax(F.col("p")).alias("cls"))
    return out.withColumn("dt", F.pow(F.lit(0.5), F.col("cls")))


QUERIES = {
    "nhsteps": nhsteps,
    "max_nhsteps": max_nhsteps_query,
    "max_nhsteps_by_prefix": max_nhsteps_by_prefix,
    "class_histogram_dense": class_histogram_dense,
    "onehot_long": onehot_long_query,
    "onehot_wide": onehot_wide_query,
    "onehot_array": onehot_array,
    "timestep_concat": timestep_concat,
    "float32_cast": float32_cast,
    "slice_unpack": slice_unpack_query,
    "feature_registry": feature_registry,
    "feature_stack": feature_stack,
    "feature_stack_long": feature_stack_long,
    "loader_targets": loader_targets,
    "loader_prefixes": loader_prefixes,
    "loader_features": loader_features,
    "loader_features_double": loader_features_double,
    "loader_feature_names": loader_feature_names,
    "loader_aligned": loader_aligned,
    "source_rows_1d": source_rows_1d,
    "source_rows_2d": source_rows_2d,
    "source_files": source_files,
    "loader_price_double": loader_price_double,
    "grid_source_1d": grid_source_1d,
    "grid_source_2d": grid_source_2d,
    "grid_pushdown": grid_pushdown,
    "stream_prefixes": stream_prefixes,
    "onehot_vector": onehot_vector_query,
    "feature_vector": feature_vector_query,
    "fcnn_native": fcnn_native,
    "fcnn_pipeline": fcnn_pipeline,
    "fcnn_from_table": fcnn_from_table,
    "dense_hidden": dense_hidden,
    "relu_hidden": relu_hidden,
    "dense_output": dense_output,
    "softmax": softmax_query,
    "fcnn_forward": fcnn_forward,
    "fcnn_relational": fcnn_relational,
    "prob_sum": prob_sum,
    "predicted_class": predicted_class,
}
