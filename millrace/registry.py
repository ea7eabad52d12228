"""Stages by name."""

from __future__ import annotations

from collections.abc import Callable

_STAGES: dict[str, dict[str, Callable]] = {"generator": {}, "transformer": {}, "filter": {}}


def register(kind: str, name: str):
    """Decorator that registers a generator, transformer or filter."""

    def put(stage: Callable) -> Callable:
        _STAGES[kind][name] = stage
        return stage

    return put


def get(kind: str, name: str) -> Callable:
    try:
        return _STAGES[kind][name]
    except KeyError:
        raise KeyError(f"no {kind} named {name}; there are {', '.join(sorted(_STAGES.get(kind, {})))}") from None


def names(kind: str) -> list[str]:
    return sorted(_STAGES[kind])
