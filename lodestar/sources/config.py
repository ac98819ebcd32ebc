"""Configuration and architecture contract, in TOML."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass
class Config:
    """Settings; flags beat the environment (LODESTAR_*), which beats the file, which beats these defaults."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    modules: dict[str, str] = field(default_factory=dict)
    module_depth: int = 1
    max_file_bytes: int = 5 << 20
    window_days: int = 365
    max_commits: int = 5000
    half_life_days: float = 180.0
    banned_imports: dict[str, str] = field(default_factory=dict)
    boundaries: list[list[str]] = field(default_factory=list)

    @classmethod
    def load(cls, path: str | None = None, **flags) -> Config:
        values = tomllib.loads(Path(path).read_text()) if path and Path(path).exists() else {}
        for f in fields(cls):
            if (env := os.environ.get(f"LODESTAR_{f.name.upper()}")) is not None:
                values[f.name] = type(f.default)(env) if isinstance(f.default, (int, float)) else env.split(",")
        return cls(**values | {k: v for k, v in flags.items() if v is not None})


MODES = tuple("off warn new-violations strict".split())


@dataclass
class Contract:
    """Components by globs, and the edges between them that are declared, forbidden, restricted or required."""

    mode: str = "warn"
    components: dict[str, list[str]] = field(default_factory=dict)
    depends: list[tuple[str, str]] = field(default_factory=list)
    forbidden: list[tuple[str, str]] = field(default_factory=list)
    restricted: dict[str, list[str]] = field(default_factory=dict)
    interfaces: dict[str, list[str]] = field(default_factory=dict)
    required: list[tuple[str, str]] = field(default_factory=list)
    budgets: dict[str, int] = field(default_factory=dict)
    coverage: dict[str, float] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Contract:
        raw = tomllib.loads(text)
        out = cls(mode=raw.get("mode", "warn"))
        for name, c in raw.get("component", {}).items():
            out.components[name] = list(c["paths"])
            out.depends += [(name, t) for t in c.get("depends_on", [])]
            out.forbidden += [(name, t) for t in c.get("forbids", [])]
            out.required += [(name, s) for s in c.get("requires", [])]
            for key, table in (("allow_from", out.restricted), ("interface", out.interfaces), ("complexity_budget", out.budgets), ("coverage_floor", out.coverage)):
                if key in c:
                    table[name] = c[key]
        out.validate()
        return out

    def validate(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        for a, b in [*self.depends, *self.forbidden]:
            for x in (a, b):
                if x not in self.components:
                    raise ValueError(f"unknown component {x!r}")
        if both := set(self.depends) & set(self.forbidden):
            raise ValueError(f"both declared and forbidden: {sorted(both)}")
        for floor in self.coverage.values():
            if not 0 <= floor <= 1:
                raise ValueError("coverage floors lie between 0 and 1")

    def globs(self) -> list[tuple[str, str]]:
        return [(n, g) for n, gs in self.components.items() for g in gs]
