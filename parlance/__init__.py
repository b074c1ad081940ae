"""Chat analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Task functions travel to the executors by value, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .config import Config, Identity, PersonRule, ThemeRule, load_config  # noqa: E402
from .model import Chat, Filters  # noqa: E402

__all__ = ["Chat", "Config", "Filters", "Identity", "PersonRule", "ThemeRule", "load_config"]
