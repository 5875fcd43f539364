"""Settings of the tagger."""

from __future__ import annotations

from dataclasses import dataclass

CLUSTER_MODES = ("5prime", "middle", "3prime")


@dataclass(frozen=True)
class TagConfig:
    """Bin sizes in bases. ``midpoint_only`` leaves exon lengths out of XC; ``primary_only`` tags no secondary or supplementary record."""

    clustermode: str = "middle"
    position_quantum: int = 10_000
    span_quantum: int = 1_000
    exon_quantum: int = 1_000
    xc_bin_size: int = 10
    xc_position_quantum: int = 1_000
    x5x3_bin_size: int = 200
    xc_midpoint_only: bool = False
    primary_only: bool = False

    def __post_init__(self):
        if self.clustermode not in CLUSTER_MODES:
            raise ValueError(f"clustermode is one of {', '.join(CLUSTER_MODES)}, not {self.clustermode!r}")
        for name in ("position_quantum", "span_quantum", "exon_quantum", "xc_bin_size", "xc_position_quantum", "x5x3_bin_size"):
            if not isinstance(getattr(self, name), int) or getattr(self, name) <= 0:
                raise ValueError(f"{name} is a number of bases over 0, not {getattr(self, name)!r}")
