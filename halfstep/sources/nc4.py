"""NetCDF-4 files, read by the netCDF4 library where it is installed."""

from __future__ import annotations

import numpy as np


def parse(content: bytes) -> dict[str, np.ma.MaskedArray]:
    try:
        import netCDF4
    except ImportError as e:
        raise ImportError("NetCDF-4 (HDF5) files need the netCDF4 library; CDL text and NetCDF classic files don't") from e
    with netCDF4.Dataset("in-memory.nc", "r", memory=content) as nc:
        return {name: np.ma.asarray(v[...]) for name, v in nc.variables.items()}
