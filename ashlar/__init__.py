"""Ashlar: Spark-first forensics over binary assets, archives and training text."""

__version__ = "0.1.0"
