"""The roles that columns of a sensor table play."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class AssetSpec:
    """Operators take column names from here; nothing is positional."""

    asset: str
    time: str
    sensors: tuple[str, ...]
    regime: tuple[str, ...] = ()
    name: str = "fleet"
    healthy_window: int = 20
    smoothing_window: int = 1
    trend_window: int = 20
    persistence: int = 3
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)

    @property
    def required_columns(self) -> list[str]:
        return list(dict.fromkeys([self.asset, self.time, *self.regime, *self.sensors]))
