"""Grids by formula, in files: 10 points, 3 components, 3 timesteps."""

import numpy as np

from halfstep.sources import classic

#: Steps other than 1: (timestep, x) to count.
STEPS = {(1, 3): 4, (1, 8): 8, (2, 0): 16, (2, 6): 4, (3, 4): 32, (3, 6): 4}
POINTS, COMPONENTS, TIMESTEPS = 10, 3, 3


def arrays(t: int) -> dict[str, np.ndarray]:
    x = np.arange(POINTS)
    steps = np.array([STEPS.get((t, k), 1) for k in x], np.int32)
    one = (10.0 * (t - 1) + x).astype(np.float32)
    two = (30.0 * (t - 1) + 10.0 * np.arange(COMPONENTS)[:, None] + x).astype(np.float32)
    return {"ncsteps": steps, "one": one, "two": two}


def cdl_text(name: str, t: int, v: np.ndarray) -> str:
    kind, dims = ("int" if v.dtype.kind == "i" else "float"), "(x)" if v.ndim == 1 else "(y, x)"
    sizes = f"\tx = {v.shape[-1]} ;\n" + (f"\ty = {v.shape[0]} ;\n" if v.ndim == 2 else "")
    rows = ",\n  ".join(", ".join(map(str, r)) for r in np.atleast_2d(v))
    return f"netcdf {name}_{t} {{\ndimensions:\n{sizes}variables:\n\t{kind} {name}{dims} ;\ndata:\n\n {name} = \n  {rows} ;\n}}\n"


def write(folder, form: str = "cdl", timesteps: int = TIMESTEPS) -> str:
    for t in range(1, timesteps + 1):
        for name, v in arrays(t).items():
            if form == "cdl":
                (folder / f"{name}_{t}.cdl").write_text(cdl_text(name, t, v))
            else:
                (folder / f"{name}_{t}.nc").write_bytes(classic.write({name: (["y", "x"][-v.ndim :], v)}, int(form)))
    return str(folder)
