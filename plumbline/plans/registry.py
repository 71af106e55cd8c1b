"""Components by stage and name, each with a closed configuration."""

from __future__ import annotations

import dataclasses
import typing
from collections.abc import Callable
from typing import Any

STAGES = ("chunker", "retriever", "reranker", "generator")
_known: dict[str, dict[str, type]] = {s: {} for s in STAGES}


def register(stage: str, name: str) -> Callable[[type], type]:
    """Register a component: a dataclass whose fields are its configuration.

    The same class may be registered again; another one under the same name is an error.
    """
    if stage not in _known:
        raise ValueError(f"there is no stage {stage!r}; there are {STAGES}")

    def keep(cls: type) -> type:
        if _known[stage].get(name, cls) is not cls:
            raise ValueError(f"{stage} {name!r} is registered already")
        cls.stage, cls.type = stage, name
        _known[stage][name] = cls
        return cls

    return keep


def component(stage: str, name: str) -> type:
    if name not in _known[stage]:
        raise KeyError(f"no {stage} {name!r}; there are {sorted(_known[stage])}")
    return _known[stage][name]


def components(stage: str | None = None) -> dict[str, list[str]]:
    return {s: sorted(_known[s]) for s in ([stage] if stage else STAGES)}


def make(stage: str, config: dict[str, Any]) -> Any:
    """A component from its configuration, which names its ``type``; unknown fields and wrong types are errors."""
    if not config.get("type"):
        raise ValueError(f"{stage} has no type: {config!r}")
    cls = component(stage, config["type"])
    own = {k: v for k, v in config.items() if k != "type"}
    fields = {f.name: f for f in dataclasses.fields(cls)}
    if unknown := sorted(set(own) - set(fields)):
        raise ValueError(f"{stage} {config['type']!r} has no fields {unknown}; it has {sorted(fields)}")
    kinds = typing.get_type_hints(cls)
    for k, v in own.items():
        if kinds[k] in (int, float, str, bool) and (not isinstance(v, (int, float) if kinds[k] is float else kinds[k]) or (isinstance(v, bool) and kinds[k] is not bool)):
            raise ValueError(f"{stage} {config['type']!r}: {k} must be {kinds[k].__name__}, not {v!r}")
    return cls(**own)


def fingerprint(part: Any) -> dict[str, Any]:
    """Stage, name and configuration of a component, for hashes."""
    config = {k: v for k, v in dataclasses.asdict(part).items() if not callable(v)}
    return {"stage": part.stage, "name": part.type, "type": part.type, **config}
