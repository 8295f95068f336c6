"""Operators of a training-data pipeline.  Nothing else in the package imports
this sub-package; ``queries.py`` binds the operators to the given tables."""
