"""Values built once per Python worker."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any


def per_worker(name: str, build: Callable[[], Any]) -> Any:
    """``build()``, kept under ``name`` for the life of this worker process."""
    held = sys.modules.setdefault("_tramloom_held", types.ModuleType("_tramloom_held"))
    if not hasattr(held, name):
        setattr(held, name, build())
    return getattr(held, name)
