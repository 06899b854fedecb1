"""Every operator as a named query over the driver tables, with its checking SQL."""

from __future__ import annotations

from importlib import import_module

from cliploom import registry

_MODULES = ("scalars", "selection", "pairing", "bursts", "telemetry", "container", "audio", "recordings", "frames", "streams")


def _load() -> None:
    for name in _MODULES:
        import_module(f"cliploom.catalog.{name}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracles():
    _load()
    return dict(registry.ORACLES)
