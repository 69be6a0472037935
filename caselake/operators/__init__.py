"""Operators on logs: each takes DataFrames or logs and returns DataFrames or logs."""
