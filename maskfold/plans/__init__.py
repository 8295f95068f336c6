"""Composed jobs: the query catalog and experiment grids."""
