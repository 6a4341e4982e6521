"""The classifier as a stage of Spark ML pipelines, and the vector forms of targets and features."""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .network import FCNN


class HalvingClassifier(Transformer, HasInputCol, HasOutputCol, MLReadable, MLWritable):
    """Adds the probabilities of a network to rows whose input is an array or an ML vector. method is `batches` (numpy on
    Arrow batches) or `native` (expressions only). Saved as metadata and a table of weights."""

    method = Param(Params._dummy(), "method", "how rows are scored: batches or native", TypeConverters.toString)

    def __init__(self, model: FCNN | None = None, inputCol: str = "features", outputCol: str = "probabilities", method: str = "batches"):
        super().__init__()
        self.model = model
        self._setDefault(inputCol="features", outputCol="probabilities", method="batches")
        self._set(inputCol=inputCol, outputCol=outputCol, method=method)

    def transformSchema(self, schema: T.StructType) -> T.StructType:
        """The schema that transform() gives for this one; an error where it can't be scored."""
        name, out = self.getInputCol(), self.getOutputCol()
        if name not in schema.names:
            raise ValueError(f"there is no column '{name}'")
        kind = schema[name].dataType
        if not isinstance(kind, VectorUDT) and not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType)):
            raise ValueError(f"column '{name}' must be an array of numbers or a vector, not {kind.simpleString()}")
        if out in schema.names:
            raise ValueError(f"there is a column '{out}' already")
        return T.StructType([*schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        self.transformSchema(dataset.schema)
        name, out = self.getInputCol(), self.getOutputCol()
        given = vector_to_array(name) if isinstance(dataset.schema[name].dataType, VectorUDT) else F.col(name)
        if self.getOrDefault(self.method) == "native":
            return dataset.withColumn(out, self.model.native(given))
        return self.model(dataset.withColumn("_halfstep_in", given), "_halfstep_in", out).drop("_halfstep_in")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, stage: HalvingClassifier):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.model.to_table(self.sparkSession).coalesce(1).write.parquet(f"{path}/weights")


class _Reader(MLReader):
    def load(self, path: str) -> HalvingClassifier:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = HalvingClassifier(FCNN.from_table(self.sparkSession.read.parquet(f"{path}/weights")))
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage


def onehot_vector(df: DataFrame, name: str = "nhsteps", out: str = "target") -> DataFrame:
    """df with the one-hot vector over classes 0 to the largest one, with those that don't occur; the encoder learns the
    largest class."""
    given = df.withColumn("_halfstep_class", F.col(name).cast("double"))
    return OneHotEncoder(inputCol="_halfstep_class", outputCol=out, dropLast=False).fit(given).transform(given).drop("_halfstep_class")


def feature_vector(df: DataFrame, names: list[str], out: str = "features") -> DataFrame:
    """df with the features of these columns as one vector; a null is an error."""
    return VectorAssembler(inputCols=names, outputCol=out, handleInvalid="error").transform(df)
