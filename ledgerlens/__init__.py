"""Reputation analytics over signed event logs, and corpus operators, on PySpark."""
