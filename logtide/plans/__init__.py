"""Compositions of operators: driver-table views, experiments, analyses and the query catalogue."""
