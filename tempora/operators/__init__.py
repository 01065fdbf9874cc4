"""Operators over time-series tables: checks, order, shifts, padding, windows, quality, importance."""
