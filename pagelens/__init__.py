"""pagelens: page observations, their telemetry and training data on Spark.

The operators' modules are the library's interface; they load when first named.
"""

from __future__ import annotations

import importlib

_MODULES = {name: f"pagelens.operators.{name}" for name in ("boxes", "hierarchy", "messages", "nested", "pages", "raster", "redaction", "telemetry", "trajectory")}
_MODULES |= {"streams": "pagelens.streaming.streams", "markup": "pagelens.sources.markup", "png": "pagelens.sources.png", "columns": "pagelens.functions.columns", "session": "pagelens.session"}
__all__ = sorted(_MODULES)


def __getattr__(name: str):
    if name in _MODULES:
        return importlib.import_module(_MODULES[name])
    raise AttributeError(name)
