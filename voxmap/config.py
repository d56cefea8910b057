"""Map configuration: bounds, resolution, kernel and hit threshold, with the two named presets."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass


@dataclass(frozen=True)
class MapConfig:
    low: tuple[float, float, float] = (-10.0, -10.0, -10.0)
    high: tuple[float, float, float] = (10.0, 10.0, 10.0)
    res: float = 0.10
    max_cells: int = 10_000
    min_range: float = 1.0
    max_range: float = 100.0
    every: int = 1
    occ_min_hits: int = 1
    bins_az: int = 40
    bins_el: int = 40
    shadow_radius: int = 6
    distance_mode: str = "L1"
    kernel_size: int = 11
    tolerance_us: int = 100_000
    use_tf: bool = True
    history: int = 100

    def __post_init__(self):
        put = lambda k, v: object.__setattr__(self, k, v)
        if abs(1 / self.res - round(1 / self.res)) > 1e-6:
            raise ValueError("1 / res must be an integer")
        if self.every < 1:
            raise ValueError("down-sampling keeps every n-th point with n >= 1")
        if not 1 <= self.occ_min_hits <= 255:
            raise ValueError("occ_min_hits must be 1 to 255")
        if self.kernel_size % 2 == 0:
            put("kernel_size", self.kernel_size + 1)
        if self.distance_mode not in ("L1", "L2"):
            warnings.warn(f"unknown distance mode {self.distance_mode!r}: L1 is used", stacklevel=2)
            put("distance_mode", "L1")

    @property
    def per_metre(self) -> int:
        """Voxels along a cell's edge; a cell is one cubic metre."""
        return round(1 / self.res)

    @property
    def radius(self) -> int:
        return self.kernel_size // 2

    @property
    def origin(self) -> tuple[int, int, int]:
        """The storage grid's minimum: bounds are snapped outward to whole metres."""
        return tuple(math.floor(x) for x in self.low)

    @property
    def cells(self) -> tuple[int, int, int]:
        return tuple(math.ceil(h) - math.floor(lo) for lo, h in zip(self.low, self.high, strict=True))


CODE_DEFAULTS = MapConfig()
COLLEGE = MapConfig((-100.0, -100.0, -10.0), (100.0, 100.0, 50.0), 0.05, 75_000, 1.5, 50.0, 1, 50, 60, 60, 5, "L2", 7)
MAI = MapConfig((-100.0, -100.0, -15.0), (100.0, 100.0, 15.0), 0.05, 50_000, 0.0, 35.0, 1, 1, 60, 60, 5, "L2", 5, use_tf=True)
PRESETS = {"default": CODE_DEFAULTS, "college": COLLEGE, "mai": MAI}
