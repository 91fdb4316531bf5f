"""Stateful stream operators, sinks and jobs."""
