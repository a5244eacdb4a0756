"""Scalar functions that built-in expressions cannot state."""
