"""Frames from tables and files, and back."""

from .tables import arrays, read_frame, table, write_frame

__all__ = ["arrays", "read_frame", "table", "write_frame"]
