"""Whole jobs put together from the operators, and their sinks."""
