"""DataFrame to DataFrame operators."""

from .features import feature_names, slice_unpack, slices_wide, stack_features, stack_ranges
from .network import Dense, FCNN, dense, dense_relational, softmax_relational
from .stage import HalvingClassifier, feature_vector, onehot_vector
from .target import class_histogram, max_nhsteps, onehot_long, onehot_wide, with_nhsteps

__all__ = ["Dense", "FCNN", "HalvingClassifier", "class_histogram", "dense", "dense_relational", "feature_names", "feature_vector", "max_nhsteps", "onehot_long", "onehot_vector", "onehot_wide", "slice_unpack", "slices_wide", "softmax_relational", "stack_features", "stack_ranges", "with_nhsteps"]
