"""Readers and writers for points, grids, series, curves and result tables."""
