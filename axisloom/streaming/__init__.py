"""Frames that grow: contractions are linear, so a stream of new coordinates adds its contraction to what is there."""

from .accumulate import accumulated, contracted, updated

__all__ = ["accumulated", "contracted", "updated"]
