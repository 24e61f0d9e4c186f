"""Parameters that the operators read."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    """Thresholds of the typology. The defaults for monthly panels."""

    min_periods: int = 18
    min_year_rows: int = 6
    years: tuple[int, int] = (2023, 2024)
    c_reg: float = 0.2
    c_grid: tuple[float, ...] = (0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0)
    max_iter: int = 3000
    tol: float = 1e-6
    kmeans_modes: int = 4
    graph_modes: int = 5
    eps_grid: tuple[float, ...] = (0.15, 0.20, 0.25, 0.30, 0.35, 0.40)
    window_eps: float = 0.30
    resolution: float = 0.5
    seed: int = 42
    min_community: int = 10
    window_length: int = 6
    window_min_rows: int = 4
    window_min_entities: int = 50
    edge_rows: int = 3
    bootstrap: int = 100
    n_init: int = 30
    meta: frozenset[str] = field(default=frozenset({"mo_norm", "kmeans_cluster", "income_source", "new_cluster", "cluster", "income_matched", "louvain", "entity", "window"}))


MONTHLY = Params()
#: Quarterly panels of the star schema: four quarters make a year, six quarters a window.
QUARTERLY = Params(min_year_rows=4, years=(1999, 2000), window_min_entities=5, min_community=3)
