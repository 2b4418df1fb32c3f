"""Make UDF code available to Python workers on any cluster.

Functions of the modules registered here are pickled by value (their code
travels with the task), so executors need no copy of this package.
"""

from __future__ import annotations

import sys


def ship_by_value(module_name: str) -> None:
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[module_name])
    except Exception:  # pragma: no cover - older cloudpickle
        pass
