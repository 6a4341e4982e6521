"""Readers of gridded variables, one file for each variable and timestep, and writers."""

from .datasource import feature_rows, grid_rows, registered, write_classic
from .grid import read_grid, read_ranges, variable_shape, write_cdl
from .names import FORMATS, file_name

__all__ = ["FORMATS", "feature_rows", "file_name", "grid_rows", "read_grid", "read_ranges", "registered", "variable_shape", "write_cdl", "write_classic"]
