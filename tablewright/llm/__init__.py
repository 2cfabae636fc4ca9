"""Operators for preparing training text: scans, filters, near-duplicate joins, mixing and packing.

Nothing outside this package imports it, apart from the guarded entry point.
"""
