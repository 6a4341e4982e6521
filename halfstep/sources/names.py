"""Names of files and columns of gridded variables."""

from __future__ import annotations

#: Extensions, in the order in which a folder is searched for them.
FORMATS = ("nc", "cdl")
SCHEMA = "variable string, timestep int, x int, y int, value float"


def file_name(folder: str, variable: str, timestep: int, extension: str) -> str:
    return f"{folder.rstrip('/')}/{variable}_{timestep}.{extension}"
