"""The classifier as an ML stage and as expressions, and vector forms."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from halfstep import FCNN
from halfstep.functions import one_hot
from halfstep.operators import HalvingClassifier, feature_vector, onehot_vector


@pytest.fixture
def inputs(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(20, 6))
    spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id int, features array<double>").write.parquet(str(tmp_path / "x"))
    return x, spark.read.parquet(str(tmp_path / "x"))


def test_expressions_give_the_same_without_python_or_shuffle(inputs):
    x, df = inputs
    m = FCNN(6, 4, 9, seed=2)
    out = df.select("id", m.native(F.col("features")).alias("p"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert np.allclose([r["p"] for r in out.orderBy("id").collect()], m(x), atol=1e-12)
    for bad in ("array(1.0D)", "cast(null as array<double>)", "transform(features, v -> if(v > 0, v, null))"):
        with pytest.raises(Exception, match="inputs must be arrays of 6 numbers without nulls"):
            df.select(m.native(F.expr(bad))).collect()


@pytest.mark.parametrize("method", ["batches", "native"])
def test_a_saved_stage_scores_alike(inputs, tmp_path, method):
    x, df = inputs
    m = FCNN(6, 4, 9, seed=3)
    stage = HalvingClassifier(m, "features", "p", method)
    stage.write().overwrite().save(str(tmp_path / "stage"))
    again = HalvingClassifier.load(str(tmp_path / "stage"))
    assert again.uid == stage.uid and again.getOrDefault(again.method) == method
    assert np.allclose([r["p"] for r in again.transform(df).orderBy("id").collect()], m(x), atol=1e-12)
    pipeline = Pipeline(stages=[HalvingClassifier(m, "vector", "p", method)])
    vectors = df.select("id", array_to_vector("features").alias("vector"))
    pipeline.fit(vectors).write().save(str(tmp_path / "pipeline"))
    out = PipelineModel.load(str(tmp_path / "pipeline")).transform(vectors)
    assert out.columns == ["id", "vector", "p"] and np.allclose([r["p"] for r in out.orderBy("id").collect()], m(x), atol=1e-12)


def test_schemas_that_cannot_be_scored(spark):
    stage = HalvingClassifier(FCNN(2), "v", "p")
    assert stage.transformSchema(spark.createDataFrame([([1.0, 2.0],)], "v array<double>").schema).names == ["v", "p"]
    for schema, what in (("w int", "no column 'v'"), ("v string", "must be an array"), ("v array<double>, p int", "a column 'p' already")):
        with pytest.raises(ValueError, match=what):
            stage.transformSchema(spark.createDataFrame([], schema).schema)


def test_vectors_equal_arrays_with_empty_classes(spark):
    df = spark.createDataFrame([(0,), (3,), (3,), (5,)], "nhsteps int")
    out = onehot_vector(df).select(vector_to_array("target").cast("array<int>").alias("v"), one_hot(F.col("nhsteps"), 5).alias("a"))
    assert all(r["v"] == r["a"] and len(r["v"]) == 6 for r in out.collect())
    features = spark.createDataFrame([(1, 0.5, 2.5), (2, None, 1.0)], "id int, a double, b double")
    assert feature_vector(features.filter("id = 1"), ["b", "a"]).first()["features"].toArray().tolist() == [2.5, 0.5]
    with pytest.raises(Exception, match="null"):
        feature_vector(features, ["a", "b"]).collect()
