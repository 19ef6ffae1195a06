"""Options of a solve, and the two presets."""

from __future__ import annotations

from dataclasses import dataclass, replace

CHOICES = {
    "matching": ("none", "transversal", "mc64"), "ordering": ("natural", "min_degree", "dissection", "column_degree", "auto"),
    "pivoting": ("none", "partial", "complete"), "refinement": ("none", "stationary", "bicgstab"), "dtype": ("float64", "float32", "complex128"),
}


@dataclass(frozen=True)
class SolveOptions:
    """How a system is analyzed, factored and solved. ``max_factor_nonzeros``: refuse factors of more scalars before allocating any; 0, the default, is no limit."""

    matching: str = "transversal"
    ordering: str = "min_degree"
    pivoting: str = "partial"
    equilibrate: bool = True
    relaxed_width: int = 4
    max_zero_rows: int = 4
    fill_fraction: float = 0.3
    max_block: int = 128
    pivot_threshold: float | None = None
    refinement: str = "bicgstab"
    max_refinements: int = 5
    refine_tolerance: float = 2.220446049250313e-16
    refine_only_if_perturbed: bool = False
    failure_threshold: float = 1e-6
    max_factor_nonzeros: int = 0
    dtype: str = "float64"

    def __post_init__(self):
        for name, allowed in CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")
        if self.max_block < 0 or self.max_refinements < 0 or self.max_factor_nonzeros < 0:
            raise ValueError("limits are not negative")

    def but(self, **changes) -> SolveOptions:
        return replace(self, **changes)


#: Always refined, rows pivoted inside blocks.
LEVELLED = SolveOptions()
#: Any pattern, rows and columns pivoted inside blocks, refined only if a pivot was replaced.
DYNAMIC = SolveOptions(pivoting="complete", refine_only_if_perturbed=True)
PRESETS = {"levelled": LEVELLED, "dynamic": DYNAMIC}
