"""Settings of the configured report, from YAML or defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


@dataclass(frozen=True)
class GraphSettings:
    name: str = "test_graph.txt"
    display_name: str = ""
    max_k: int | None = None
    auto_download: bool = True  # kept for old files; nothing is ever downloaded


@dataclass(frozen=True)
class OutputSettings:
    output_dir: str = "."
    filename: str = ""
    format: str = "parquet"
    dpi: int = 300
    show_plot: bool = False


# The names and defaults of existing settings files. Style settings are accepted, so that such files can be read; chart tables have no style.
@dataclass(frozen=True)
class PlotSettings:
    figure_size: tuple[int, int] = (10, 7)
    title_fontsize: int = 15
    label_fontsize: int = 14
    legend_fontsize: int = 12
    info_box_fontsize: int = 10
    alpha_k_color: str = "red"
    dk_color: str = "blue"
    alpha_k_linestyle: str = "o-"
    dk_linestyle: str = "s--"
    linewidth: int = 3
    markersize: int = 8
    show_grid: bool = True
    grid_alpha: float = 0.3
    show_value_labels: bool = True


@dataclass(frozen=True)
class InfoBoxSettings:
    show: bool = True
    position: str = "upper left"
    constant_color: str = "lightblue"
    varying_color: str = "lightgreen"


@dataclass(frozen=True)
class ComputationSettings:
    max_nodes_for_exact: int = 15
    verbose: bool = True
    print_table: bool = True


@dataclass(frozen=True)
class Config:
    graph: GraphSettings = field(default_factory=GraphSettings)
    output: OutputSettings = field(default_factory=OutputSettings)
    plot: PlotSettings = field(default_factory=PlotSettings)
    info_box: InfoBoxSettings = field(default_factory=InfoBoxSettings)
    computation: ComputationSettings = field(default_factory=ComputationSettings)

    @property
    def title(self) -> str:
        """The display name, or one made from the graph's file name."""
        stem = self.graph.name.rsplit(".", 1)[0] if self.graph.name.lower().endswith((".txt", ".gz")) else self.graph.name
        return self.graph.display_name or stem.replace("_", " ").title()

    def k_max(self, n: int) -> int:
        """The last k: max_k or 20, never beyond n - 1."""
        return min(n - 1, 20 if self.graph.max_k is None else self.graph.max_k)


def merged(base: Any, values: dict) -> Any:
    """base with the values of a nested dict; unknown names raise."""
    known = {f.name for f in fields(base)}
    if unknown := set(values) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(base, **{k: merged(getattr(base, k), v or {}) if is_dataclass(getattr(base, k)) else tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def load(path: str | None = None, graph: str | None = None) -> Config:
    """Defaults, changed by the file if it is there (it is never written), then by the graph name given."""
    config = Config()
    if path and os.path.exists(path):
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("reading a configuration file needs PyYAML") from error
        with open(path, encoding="utf-8") as f:
            config = merged(config, yaml.safe_load(f) or {})
    return replace(config, graph=replace(config.graph, name=graph)) if graph else config
