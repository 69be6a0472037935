"""Registered queries: each applies an operator to whole tables; most have a SQL twin."""
