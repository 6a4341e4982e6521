"""The loader: targets and features of a folder of gridded variables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions import one_hot
from .operators import feature_names, stack_ranges, with_nhsteps
from .sources import feature_rows, grid_rows, read_grid, read_ranges, variable_shape
from .sources.ranges import SCHEMES, scheme
from .storage import cut, ship

TARGET = "ncsteps"
DTYPES = {"float": "float", "float32": "float", "double": "double", "float64": "double", "int": "int", "int32": "int"}


class NetCDFDataLoader:
    """Loads `<variable>_<timestep>` files for timesteps 1 to num_timesteps.

    features_1d and features_2d name variables of rank 1, (x), and rank 2, (component, x). The lists are copied, so
    loading twice gives the same.
    """

    def __init__(self, features_1d: list[str], features_2d: list[str], num_timesteps: int, data_dir: str = "data", spark: SparkSession | None = None):
        self._features_1d, self._features_2d = list(features_1d), list(features_2d)
        self._features: list[str] | None = None
        self._max_nhsteps: int | None = None
        self.num_timesteps = num_timesteps
        self.spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(data_dir)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            raise OSError(f"Data directory '{data_dir}' does not exist.")
        self.data_dir = data_dir
        ship(self.spark)

    @property
    def _by_ranges(self) -> bool:
        """Whether the folder is in a store from which tasks read byte ranges; others are read by Spark's binary source."""
        return scheme(self.data_dir) in SCHEMES

    @property
    def max_nhsteps(self) -> int:
        """The largest class of the loaded targets."""
        if self._max_nhsteps is None:
            raise RuntimeError("Max halving steps have not been set. Call load_target_data() first.")
        return self._max_nhsteps

    @property
    def features(self) -> list[str]:
        """The names of the loaded features, in the order of their columns."""
        if self._features is None:
            raise RuntimeError("Features have not been loaded. Call load_feature_data() first.")
        return self._features

    def load_target_data(self) -> DataFrame:
        """timestep, x, nhsteps, and target, the one-hot array over classes 0 to max_nhsteps, which this sets. The files
        are parsed once: their classes are kept as a table in the shared folder, and the largest one is observed as that is
        written."""
        given = grid_rows(self.spark, self.data_dir, TARGET, 1, self.num_timesteps) if self._by_ranges else read_grid(self.spark, self.data_dir, {TARGET: 1}, self.num_timesteps)
        seen = Observation()
        steps = cut(with_nhsteps(given, "value").select("timestep", "x", "nhsteps").observe(seen, F.max("nhsteps").alias("most")))
        self._max_nhsteps = seen.get["most"]
        return steps.withColumn("target", one_hot(F.col("nhsteps"), self._max_nhsteps))

    def load_feature_data(self, dtype: str = "float") -> DataFrame:
        """timestep, x, and a column for each feature. Values pass through 32-bit floats whatever the dtype. Null values
        are errors, as are names that clash with each other or with timestep and x."""
        if dtype not in DTYPES:
            raise ValueError(f"dtype must be one of {', '.join(DTYPES)}, not '{dtype}'")
        components = {v: variable_shape(self.spark, self.data_dir, v)[0] for v in self._features_2d}
        ranks = dict.fromkeys(self._features_1d, 1) | dict.fromkeys(self._features_2d, 2)
        if not ranks:
            raise ValueError("there are no features to load")
        names = feature_names(self._features_1d, components)
        columns = ["timestep", "x", *(n.lower() for n in names)]  # columns are told apart without regard to case
        clash = sorted({n for n in columns if columns.count(n) > 1})
        if clash or len(ranks) < len(self._features_1d) + len(self._features_2d):
            raise ValueError(f"features, timestep and x must have different names: {', '.join(clash) or 'a variable is given twice'}")
        self._features = names
        if self._by_ranges:
            return feature_rows(self.spark, self.data_dir, self._features_1d, components, self.num_timesteps, DTYPES[dtype])
        return stack_ranges(read_ranges(self.spark, self.data_dir, ranks, self.num_timesteps), self._features_1d, components, DTYPES[dtype])

    def load(self, dtype: str = "float") -> DataFrame:
        """Targets and features of each grid point; one without the other is an error."""
        target, features = self.load_target_data(), self.load_feature_data(dtype)
        both = target.withColumn("_t", F.lit(True)).join(features.withColumn("_f", F.lit(True)), ["timestep", "x"], "full")
        aligned = F.when(F.col("_t").isNull() | F.col("_f").isNull(), F.raise_error(F.concat(F.lit("target and features don't cover the same grid points, as at timestep "), F.col("timestep").cast("string"), F.lit(", x "), F.col("x").cast("string")))).otherwise(F.col("timestep"))
        return both.withColumn("timestep", aligned.cast("int")).drop("_t", "_f")
