"""Make functions that run in Python workers independent of the package being installed there."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_by_value(module_name: str) -> None:
    """Pickle the module's functions with their code instead of by import path."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
