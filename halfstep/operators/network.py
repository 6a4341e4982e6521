"""The one-hidden-layer classifier: dense, ReLU, dense, softmax.

`FCNN` scores Arrow batches by numpy, which needs no shuffle and no more memory than a batch; the relational forms of
the same layers, for weights in tables, are for layers too wide to broadcast and for checks. `native` gives the
probabilities as one expression on arrays, without Python workers and without a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import relu


class Dense:
    """Weights (out by in) and biases of a layer."""

    def __init__(self, weight: np.ndarray, bias: np.ndarray):
        self.weight, self.bias = np.asarray(weight, np.float64), np.asarray(bias, np.float64)
        if self.weight.ndim != 2 or self.bias.shape != self.weight.shape[:1]:
            raise ValueError("weight must be out x in, and bias as long as out")

    @classmethod
    def seeded(cls, size_in: int, size_out: int, seed: int) -> Dense:
        """Uniform within 1 / sqrt(in)."""
        r, a = np.random.default_rng(seed), size_in**-0.5
        return cls(r.uniform(-a, a, (size_out, size_in)), r.uniform(-a, a, size_out))

    @property
    def in_features(self) -> int:
        return self.weight.shape[1]

    @property
    def out_features(self) -> int:
        return self.weight.shape[0]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weight.T + self.bias


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column; each must have this width and no null."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    if (lengths != width).any() or flat.null_count:
        raise ValueError(f"inputs must be arrays of {width} numbers without nulls")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _applied(df: DataFrame, column: str, name: str, width: int, function) -> DataFrame:
    """df with an array column that function (matrix to matrix) gives for each batch."""
    at = df.columns.index(column)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(_matrix(batch.column(at), width))
            ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], [*batch.schema.names, name])

    return df.mapInArrow(rows, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType(), False))]))


def dense(df: DataFrame, column: str, layer: Dense, name: str) -> DataFrame:
    return _applied(df, column, name, layer.in_features, layer)


class FCNN:
    """input_size numbers to probabilities of classes 0 to max_nhsteps."""

    def __init__(self, input_size: int, max_nhsteps: int = 5, hidden_size: int = 50, seed: int = 0, hidden: Dense | None = None, output: Dense | None = None):
        self.hidden = hidden or Dense.seeded(input_size, hidden_size, seed)
        self.output = output or Dense.seeded(hidden_size, max_nhsteps + 1, seed + 1)
        if (self.hidden.in_features, self.hidden.out_features, self.output.in_features, self.output.out_features) != (input_size, hidden_size, hidden_size, max_nhsteps + 1):
            raise ValueError("the layers don't have the sizes given")

    @property
    def parameters(self) -> dict[str, np.ndarray]:
        """Weights and biases by name: copies, which may be changed."""
        return {f"{name}.{kind}": getattr(layer, kind).copy() for name, layer in (("hidden", self.hidden), ("output", self.output)) for kind in ("weight", "bias")}

    @classmethod
    def from_parameters(cls, parameters: dict[str, np.ndarray]) -> FCNN:
        hidden, output = (Dense(parameters[f"{name}.weight"], parameters[f"{name}.bias"]) for name in ("hidden", "output"))
        return cls(hidden.in_features, output.out_features - 1, hidden.out_features, hidden=hidden, output=output)

    def to_table(self, spark: SparkSession) -> DataFrame:
        """(layer, o, i, w): a row for each weight, and one with null i for each bias."""
        rows = []
        for name, layer in (("hidden", self.hidden), ("output", self.output)):
            rows += [(name, o, i, float(layer.weight[o, i])) for o in range(layer.out_features) for i in range(layer.in_features)]
            rows += [(name, o, None, float(b)) for o, b in enumerate(layer.bias)]
        return spark.createDataFrame(rows, "layer string, o int, i int, w double")

    @classmethod
    def from_table(cls, table: DataFrame) -> FCNN:
        """The network of such a table, which comes to the driver, as the weights of a network do."""
        found: dict[str, dict] = {"hidden": {}, "output": {}}
        for r in table.collect():
            found[r["layer"]][r["o"], r["i"]] = r["w"]
        parameters = {}
        for name, w in found.items():
            sizes = [1 + max(k[j] for k in w if k[j] is not None) for j in (0, 1)]
            parameters[f"{name}.weight"] = np.array([[w[o, i] for i in range(sizes[1])] for o in range(sizes[0])])
            parameters[f"{name}.bias"] = np.array([w[o, None] for o in range(sizes[0])])
        return cls.from_parameters(parameters)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.output(np.maximum(self.hidden(x), 0.0))
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def native(self, x: Column) -> Column:
        """Probabilities from an array column; arrays of another width, null, or with nulls in them are errors."""
        n = self.hidden.in_features
        fits = (F.size(x) == n) & ~F.exists(x, F.isnull)
        given = F.when(F.coalesce(fits, F.lit(False)), x.cast("array<double>")).otherwise(F.raise_error(F.lit(f"inputs must be arrays of {n} numbers without nulls")))
        return let(given, lambda v: let(F.transform(layer_native(v, self.hidden), relu), lambda a: let(layer_native(a, self.output), softmax_native)))

    def __call__(self, data: DataFrame | np.ndarray, column: str = "features", name: str = "probabilities"):
        """Probabilities of a matrix, or a DataFrame with them as an array column."""
        if isinstance(data, DataFrame):
            return _applied(data, column, name, self.hidden.in_features, self.probabilities)
        return self.probabilities(np.atleast_2d(np.asarray(data, np.float64)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for each row, also where use has it inside of lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def layer_native(x: Column, layer: Dense) -> Column:
    """An array of the layer's outputs. The weights are a constant of the plan."""
    rows = [{"w": w, "b": b} for w, b in zip(layer.weight.tolist(), layer.bias.tolist(), strict=True)]
    weights = F.from_json(F.lit(json.dumps(rows)), "array<struct<w:array<double>,b:double>>", {"allowNonNumericNumbers": "true"})
    return F.transform(weights, lambda r: F.aggregate(F.zip_with(x, r["w"], lambda a, w: a * w), F.lit(0.0), lambda total, v: total + v) + r["b"])


def softmax_native(z: Column) -> Column:
    exps = let(F.array_max(z), lambda top: F.transform(z, lambda v: F.exp(v - top)))
    return let(exps, lambda e: let(F.aggregate(e, F.lit(0.0), lambda total, v: total + v), lambda total: F.transform(e, lambda v: v / total)))


def dense_relational(values: DataFrame, weights: DataFrame, biases: DataFrame, key: str) -> DataFrame:
    """values (key, i, v), weights (o, i, w), biases (o, b) to (key, o, v): a join and a sum for each output."""
    products = values.join(weights, "i").groupBy(key, "o").agg(F.sum(F.col("v") * F.col("w")).alias("_s"))
    return products.join(biases, "o").select(key, "o", (F.col("_s") + F.col("b")).alias("v"))


def softmax_relational(values: DataFrame, key: str) -> DataFrame:
    """values (key, o, v) to (key, o, p) over the outputs of each key."""
    of = Window.partitionBy(key)
    e = values.withColumn("_e", F.exp(F.col("v") - F.max("v").over(of)))
    return e.select(key, "o", (F.col("_e") / F.sum("_e").over(of)).alias("p"))


def argmax(probabilities: Column) -> Column:
    """The most probable class, the lowest of equal ones (an addition: the classifier itself gives probabilities)."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")
