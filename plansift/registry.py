"""Extension points: encoders, vocabularies and measures by name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_held: dict[str, dict[str, Any]] = {"encoder": {}, "vocabulary": {}, "metric": {}}


def _register(kind: str, name: str, what: Any) -> Any:
    if name in _held[kind]:
        raise ValueError(f"there is a {kind} of that name: {name}")
    _held[kind][name] = what
    return what


def register_encoder(name: str, encode: Callable) -> Callable:
    """A function from a table of texts or images to ``stem, vector``."""
    return _register("encoder", name, encode)


def register_vocabulary(name: str, seed: dict[str, dict[str, list[str]]]) -> dict:
    """A vocabulary in the form of :data:`plansift.functions.vocabulary.SEED`."""
    return _register("vocabulary", name, seed)


def register_metric(name: str, measure: Callable) -> Callable:
    """A function from truth and prediction in long form to a table of measures."""
    return _register("metric", name, measure)


def named(kind: str, name: str) -> Any:
    return _held[kind][name]


def names(kind: str) -> list[str]:
    return sorted(_held[kind])
