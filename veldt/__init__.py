"""Declarative PySpark operators for event-sequence risk and reward analysis."""
