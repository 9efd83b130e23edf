"""Classes of this package that Python workers run go to them by value, so that executors need no copy of it."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def carried(module: str) -> None:
    """Ship what this module defines with every job that uses it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
