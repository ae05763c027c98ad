"""Operators of a training-data pipeline. Nothing else in plumbline imports this subpackage."""
