"""Settling times, shape features and review tables for large sets of sampled signals."""

from settlespark.operators.settle import Rule
from settlespark.signals import Signals

__all__ = ["Rule", "Signals"]
