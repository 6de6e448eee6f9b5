"""Calibrated totals from partial, gappy counts, as Spark DataFrame jobs."""
