"""Sievewright: a PySpark engine that turns untrusted message archives into trustworthy tables."""

__version__ = "0.1.0"
