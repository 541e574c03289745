"""Settings of the commands: defaults, replaced by what a YAML file says. Unknown keys are reported, not refused."""

from __future__ import annotations

import os
import warnings
from dataclasses import dataclass, fields
from typing import Any

from tomoframe.functions.volume import Search


@dataclass(frozen=True)
class Settings:
    table: str = ""
    tables: tuple[str, ...] = ()
    tomograms: str | tuple[str, ...] = ""
    volumes: str = ""
    reference: str = ""
    references: tuple[str, ...] = ()
    mask: str = ""
    output: str = ""
    output_star: str = ""
    pair_by: str = "tag"
    tomogram_size: tuple[float, ...] | None = None
    sidelength: int = 0
    fill: int = -1
    symmetry: str = "c1"
    tags: tuple[int, ...] | None = None
    apply_wedge: bool = False
    iterations: int = 3
    swap: bool = True
    count: int = 100
    noise: float = 0.1
    noise_only: int = 0
    seed: int = 42
    pixel_size: float = 1.0
    cone_range: float = 360.0
    cone_step: float = 15.0
    inplane_range: float = 360.0
    inplane_step: float = 15.0
    shift_search: int = 3
    shift_mode: str = "cube"
    subpixel: bool = True
    cc_mode: str = "ncc"
    cc_local_window: int = 5
    multigrid_levels: int = 1
    lowpass: float = 0.0
    wedge_apply_to: str = "both"

    @property
    def size(self) -> tuple[float, ...] | None:
        """x, y, z of the tomograms."""
        if self.tomogram_size is not None and len(self.tomogram_size) != 3:
            raise ValueError("tomogram_size has three numbers")
        return self.tomogram_size

    @property
    def search(self) -> Search:
        return Search(self.cone_range, self.cone_step, self.inplane_range, self.inplane_step, self.shift_search, self.shift_mode, self.subpixel, self.cc_mode, self.cc_local_window, self.multigrid_levels, self.lowpass or None, self.pixel_size, self.wedge_apply_to)

    def need(self, *names: str) -> None:
        missing = [n for n in names if not getattr(self, n)]
        if missing:
            raise ValueError(f"missing settings: {', '.join(missing)}")


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """`over` on top of `base`, section by section."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def settings(values: dict[str, Any] | None, **more: Any) -> Settings:
    values = merged(values or {}, {k: v for k, v in more.items() if v is not None})
    known = {f.name for f in fields(Settings)}
    for k in sorted(set(values) - known):
        warnings.warn(f"unknown setting {k}", stacklevel=2)
    return Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known and v is not None})


PATHS = ("table", "tables", "tomograms", "volumes", "reference", "references", "mask", "output", "output_star")


def resolved(path: str, folder: str) -> str:
    """A relative path as one below `folder`; absolute ones and those of other file systems stay."""
    return path if not path or os.path.isabs(path) or "://" in path else os.path.normpath(os.path.join(folder, path))


def load(path: str, **more: Any) -> Settings:
    """The settings of a file; relative paths in it are relative to its folder."""
    import yaml

    with open(path, encoding="utf-8") as f:
        values = yaml.safe_load(f) or {}
    folder = os.path.dirname(os.path.abspath(path))
    for k in PATHS:
        if isinstance(values.get(k), str):
            values[k] = resolved(values[k], folder)
        elif isinstance(values.get(k), list):
            values[k] = [resolved(v, folder) for v in values[k]]
    return settings(values, **more)
