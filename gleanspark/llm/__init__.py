"""Operators of a training-data pipeline. Nothing else in gleanspark imports this subpackage."""
