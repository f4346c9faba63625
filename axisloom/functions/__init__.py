"""Column functions that the operators and queries share."""

from .columns import exact_money, hour_index, nearest, rounded

__all__ = ["exact_money", "hour_index", "nearest", "rounded"]
