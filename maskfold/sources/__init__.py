"""Readers for the input tables, dataset builders and result-table sinks."""
