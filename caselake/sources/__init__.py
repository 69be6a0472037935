"""Readers and writers of logs, scores, predictions and models."""
