"""Engine settings: frozen dataclasses, read from YAML, overridden by nested dicts."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml


@dataclass(frozen=True)
class Construction:
    """How documents become a graph."""

    #: Fixed value: datasets whose documents are title and text.
    whole_documents: tuple[str, ...] = ("hotpot", "2wiki", "musique", "demo")
    batch_size: int = 100
    batched: bool = False
    first_line_only: bool = False


@dataclass(frozen=True)
class Grouping:
    """How entities are grouped."""

    hub_percentile: float = 80.0
    structural_mix: str = "DEGREE_HEAVY"
    clusters: int = 50
    fuzziness: float = 1.5
    rounds: int = 100
    least_members: int = 10


@dataclass(frozen=True)
class Retrieval:
    """How questions are answered."""

    top_k: int = 20
    max_experts: int | None = 5
    reflection_steps: int = 0
    decompose: bool = False
    strict: bool = False


@dataclass(frozen=True)
class Dataset:
    """Where a dataset's files are."""

    corpus: str = ""
    questions: str = ""
    ontology: str = ""


@dataclass(frozen=True)
class EngineConfig:
    """All settings."""

    construction: Construction = field(default_factory=Construction)
    grouping: Grouping = field(default_factory=Grouping)
    retrieval: Retrieval = field(default_factory=Retrieval)
    datasets: dict[str, Dataset] = field(default_factory=dict)
    prompts: dict[str, str] = field(default_factory=dict)
    output: str = "output"

    def dataset(self, name: str) -> Dataset:
        """A dataset's files; unknown names are an error."""
        if name not in self.datasets:
            raise ValueError(f"no dataset {name!r} is configured")
        return self.datasets[name]

    def paths(self, name: str) -> dict[str, str]:
        """Where a dataset's tables are written."""
        return {k: f"{self.output}/{name}/{k}" for k in ("chunks", "nodes", "edges", "groups", "vectors", "results", "checkpoint")}

    def override(self, values: dict[str, Any]) -> EngineConfig:
        """A copy with nested values replaced."""
        return _build(EngineConfig, _merge(dataclasses.asdict(self), values))

    def to_dict(self) -> dict[str, Any]:
        """Plain nested values."""
        return dataclasses.asdict(self)


def _merge(old: dict, new: dict) -> dict:
    out = dict(old)
    for k, v in new.items():
        out[k] = _merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


_PARTS = {"construction": Construction, "grouping": Grouping, "retrieval": Retrieval}


def _build(cls: type, values: dict[str, Any]) -> Any:
    known = {f.name for f in dataclasses.fields(cls)}
    if unknown := set(values) - known:
        raise ValueError(f"{cls.__name__} has no {', '.join(sorted(unknown))}")
    done = {}
    for k, v in values.items():
        if cls is EngineConfig and k in _PARTS:
            v = _build(_PARTS[k], v or {})
        elif cls is EngineConfig and k == "datasets":
            v = {n: d if isinstance(d, Dataset) else _build(Dataset, d) for n, d in (v or {}).items()}
        elif isinstance(v, list):
            v = tuple(v)
        done[k] = v
    out = cls(**done)
    if isinstance(out, Grouping) and not 0 <= out.hub_percentile <= 100:
        raise ValueError("hub_percentile is a percentage")
    if isinstance(out, Retrieval) and out.top_k < 1:
        raise ValueError("top_k is at least 1")
    return out


def load_config(path: str | Path) -> EngineConfig:
    """Settings of a YAML file; what it leaves out keeps its default."""
    with open(path, encoding="utf-8") as f:
        return _build(EngineConfig, yaml.safe_load(f) or {})


def save_config(config: EngineConfig, path: str | Path) -> None:
    """Write settings as YAML."""
    values = config.to_dict()
    values["construction"]["whole_documents"] = list(values["construction"]["whole_documents"])
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(values, sort_keys=False), encoding="utf-8")


def parse_mode(mode: str) -> dict[str, Any]:
    """Overrides for a mode name: ``reflect-3``, ``decompose``, ``all-experts``, ``batched``, ``mix-AVERAGE``, joined by ``_``."""
    out: dict[str, dict[str, Any]] = {"construction": {}, "retrieval": {}, "grouping": {}}
    for part in mode.split("_"):
        name, _, value = part.partition("-")
        if name == "reflect":
            out["retrieval"]["reflection_steps"] = int(value)
        elif part == "decompose":
            out["retrieval"]["decompose"] = True
        elif part == "batched":
            out["construction"]["batched"] = True
        elif part == "all-experts":
            out["retrieval"]["max_experts"] = None
        elif name == "mix":
            out["grouping"]["structural_mix"] = value
    return {k: v for k, v in out.items() if v}
