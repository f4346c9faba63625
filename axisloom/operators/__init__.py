"""Operators on frames. All return lazy frames."""
