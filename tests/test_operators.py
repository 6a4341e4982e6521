import numpy as np
import pytest
from pyspark.sql import functions as F

from halfstep import FCNN
from halfstep.functions import nhsteps, one_hot, relu, softmax
from halfstep.operators import Dense, class_histogram, dense_relational, feature_names, onehot_long, onehot_wide, slices_wide, softmax_relational
from halfstep.plans import QUERIES, SQL
from halfstep.plans.queries import model
from halfstep.streaming import class_counts, halving_stream, score_stream

SMALLEST = "/root/testdata/sf0.001"


def test_rounding_in_log_space(spark):
    df = spark.createDataFrame([(k,) for k in (1, 2, 3, 5, 6, 11, 12, 50)], "n int")
    assert [r[0] for r in df.select(nhsteps(F.col("n"))).collect()] == [0, 1, 2, 2, 3, 3, 4, 6]


@pytest.mark.parametrize("value", [0.0, -1.0, 0.5, None, float("nan")])
def test_counts_without_a_class(spark, value):
    with pytest.raises(Exception, match="ncsteps must be positive"):
        spark.createDataFrame([(value,)], "n double").select(nhsteps(F.col("n"))).collect()


def test_one_hot_keeps_empty_classes(spark):
    df = spark.createDataFrame([(0,), (3,)], "c int")
    assert [r[0] for r in df.select(one_hot(F.col("c"), 3)).collect()] == [[1, 0, 0, 0], [0, 0, 0, 1]]
    df = df.select(F.monotonically_increasing_id().alias("id"), F.col("c").alias("nhsteps"))
    assert onehot_wide(df, ["id"], 3).columns == ["id", "target_0", "target_1", "target_2", "target_3"]
    assert onehot_long(df, ["id"]).count() == 8
    assert sorted(class_histogram(df).collect()) == [(0, 1), (1, 0), (2, 0), (3, 1)]


def test_relu_and_softmax(spark):
    df = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "v double")
    assert [r[0] for r in df.select(relu(F.col("v"))).collect()] == [0.0, 2.0, None]
    (p,) = spark.createDataFrame([([1000.0, 1000.0, 900.0],)], "z array<double>").select(softmax(F.col("z"))).first()
    assert p == pytest.approx([0.5, 0.5, 0.0])


def test_layer_sizes():
    m = FCNN(10, 5, 50)
    assert (m.hidden.in_features, m.hidden.out_features, m.output.in_features, m.output.out_features) == (10, 50, 50, 6)
    assert FCNN(4).output.out_features == 6 and FCNN(4).hidden.out_features == 50
    with pytest.raises(ValueError):
        FCNN(10, 5, 50, hidden=Dense(np.zeros((50, 9)), np.zeros(50)))


@pytest.mark.parametrize("batch", [1, 5])
def test_output_of_a_matrix(batch):
    out = FCNN(10, 5, 50)(np.random.default_rng(0).normal(size=(batch, 10)))
    assert out.shape == (batch, 6) and out.sum(1) == pytest.approx(np.ones(batch), rel=1e-5)


def test_weights_in_and_out(spark, tmp_path):
    m = FCNN(3, 2, 4, seed=5)
    again = FCNN.from_parameters(m.parameters)
    m.to_table(spark).write.parquet(str(tmp_path / "weights"))
    read = FCNN.from_table(spark.read.parquet(str(tmp_path / "weights")))
    x = np.random.default_rng(2).normal(size=(5, 3))
    assert sorted(m.parameters) == ["hidden.bias", "hidden.weight", "output.bias", "output.weight"]
    assert (again(x) == m(x)).all() and (read(x) == m(x)).all()


def test_batches_agree_with_tables(spark):
    x = np.random.default_rng(1).normal(size=(7, 10))
    m = FCNN(10, 5, 12, seed=3)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id int, features array<double>")
    rows = m(df).orderBy("id").collect()
    assert np.allclose([r["probabilities"] for r in rows], m(x), atol=1e-12)

    def tables(layer):
        w = [(o, i, float(layer.weight[o, i])) for o in range(layer.out_features) for i in range(layer.in_features)]
        return spark.createDataFrame(w, "o int, i int, w double"), spark.createDataFrame([(o, float(b)) for o, b in enumerate(layer.bias)], "o int, b double")

    values = df.select("id", F.posexplode("features").alias("i", "v"))
    hidden = dense_relational(values, *tables(m.hidden), "id").select("id", F.col("o").alias("i"), relu(F.col("v")).alias("v"))
    p = softmax_relational(dense_relational(hidden, *tables(m.output), "id"), "id").orderBy("id", "o").collect()
    assert np.allclose(np.array([r["p"] for r in p]).reshape(7, 6), m(x), atol=1e-12)


def test_inputs_of_another_width(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "features array<double>")
    with pytest.raises(Exception, match="arrays of 10 numbers"):
        FCNN(10)(df).collect()


def test_features_by_slices(spark):
    assert feature_names(["a"], {"b": 2}) == ["a", "b_0", "b_1"]
    df = spark.createDataFrame([(1, [0.5, 1.5])], "id int, v array<float>")
    assert slices_wide(df, ["id"], "v", 2, "b").collect() == [(1, 0.5, 1.5)]
    with pytest.raises(Exception, match="3 components"):
        slices_wide(df, ["id"], "v", 3, "b").collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("part", "embeddings"):
        con.sql(f"create view {t} as select * from '{SMALLEST}/{t}.parquet'")
    got, want = QUERIES[name](spark, SMALLEST).toPandas(), con.sql(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (d[columns].sort_values(columns).reset_index(drop=True) for d in (got, want))
    for c in columns:
        if a[c].dtype.kind == "f":
            assert np.allclose(a[c], b[c], atol=2e-6), c
        else:
            assert a[c].tolist() == b[c].tolist(), c


def test_streams(spark, tmp_path):
    vectors = spark.createDataFrame([(k, [float(k)] * 64, 2 ** (k % 3), f"2024-01-01 00:0{k}:00") for k in range(6)], "id int, features array<double>, ncsteps int, at string")
    vectors.withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, features array<double>, ncsteps int, at timestamp").parquet(str(tmp_path / "in"))
    out = class_counts(score_stream(halving_stream(stream, "ncsteps", 4), model()), "at", "10 minutes", "1 minute")
    q = out.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["nhsteps"], r["n"]) for r in spark.table("counts").collect()) == [(0, 2), (1, 2), (2, 2)]
    scored = score_stream(halving_stream(stream, "ncsteps", 4), model())
    q = scored.writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").filter(F.size("probabilities") == 10).count() == 6


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["vec_id", "cls", "p"]
    assert set(SQL) <= set(e.oracle_sql()) <= set(e.queries())
