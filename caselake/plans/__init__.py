"""Descriptions of logs and experiments, and plans that several operators share."""
