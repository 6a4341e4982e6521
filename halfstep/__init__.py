"""Gridded timestep-halving analytics on PySpark."""

from .dataset import NetCDFDataLoader
from .operators.network import FCNN

__all__ = ["FCNN", "NetCDFDataLoader"]
